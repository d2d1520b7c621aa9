"""The queries of this subpackage, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from trackloom.llm.bpe import op7_bpe
from trackloom.llm.chat import OP6_SQL, op6_chat
from trackloom.llm.chroma import op9_chroma
from trackloom.llm.decontaminate import OP4_SQL, op4_decontaminate
from trackloom.llm.linededup import OP5_SQL, op5_line_dedup
from trackloom.llm.neighbours import OP12_SQL, op12_neighbours
from trackloom.llm.ngramjoin import OP2_SQL, op2_ngram_join
from trackloom.llm.periodic import OP13_SQL, op13_runs
from trackloom.llm.phrases import OP11_SQL, op11_phrases
from trackloom.llm.quality import op8_quality
from trackloom.llm.repeats import op3_repeats
from trackloom.llm.toxicity import op1_toxicity
from trackloom.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_repeats": op3_repeats,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat": op6_chat,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_chroma": op9_chroma,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_neighbours": op12_neighbours,
    "op13_runs": op13_runs,
}
ORACLES = {"op2_ngram_join": OP2_SQL, "op4_decontaminate": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_chat": OP6_SQL, "op10_warc": OP10_SQL, "op11_phrases": OP11_SQL, "op12_neighbours": OP12_SQL, "op13_runs": OP13_SQL}
