"""Chat formatting at token level.

Each turn is encoded on its own: a reserved id opens the turn of a role, the role's and the text's tokens follow, and a
reserved id ends it. Since texts never yield reserved ids, content can't end a turn; control strings in
content are escaped as well, so that the formatted text can be read back. Loss masks come from prefix sums over the
turns' lengths.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, shared_dir, table

#: Ids above the vocabulary's own (50,257 of them), and the strings that stand for them in the formatted text.
OPEN, TEXT, CLOSE = 50257, 50258, 50259
MARKS = {OPEN: "<|turn|>", TEXT: "<|text|>", CLOSE: "<|end|>"}
#: Control strings of this and of other templates: their first character is doubled by a backslash in content.
CONTROL = [*MARKS.values(), "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPE = re.compile("\\\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
#: tokens of a row of output
PART_TOKENS = 1 << 13
#: turn numbers of a conversation that one task assembles
BLOCK_TURNS = 256
#: Texts that the tokenizer gets at once.
SLICE_ROWS = 100


def escape(text: str) -> str:
    """A backslash before every backslash, and after the first character of every control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return re.sub(r"\\(\\?)", r"\1", text)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):  # noqa: ANN201
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode_turns(df: DataFrame, path: str) -> DataFrame:
    """(conv_id, turn, role, text, ids, loss_from, loss_to, chars) of rows (conv_id, turn, role, text).

    ``ids`` is the turn's segment as little-endian unsigned 32-bit integers, [loss_from, loss_to) its tokens under the loss: the text of
    an assistant turn. ``chars`` are the code points of its formatted text. A null role or text is empty.
    """
    src = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        encode = functools.lru_cache(maxsize=1000)(lambda role: tok.encode(role, add_special_tokens=False).ids)
        marks = sum(map(len, MARKS.values()))
        for batch in batches:
            roles = [escape(r) for r in batch.column(2).to_pylist()]
            texts = [escape(t) for t in batch.column(3).to_pylist()]
            heads = [encode(r) for r in roles]
            bodies = [e.ids for k in range(0, len(texts), SLICE_ROWS) for e in tok.encode_batch_fast(texts[k : k + SLICE_ROWS], add_special_tokens=False)]
            ids = [np.array([OPEN, *h, TEXT, *b, CLOSE], "<u4").tobytes() for h, b in zip(heads, bodies)]
            mine = [r == "assistant" for r in roles]
            first = [len(h) + 2 for h in heads]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(ids, pa.binary()),
                    pa.array([f if m else 0 for f, m in zip(first, mine)], pa.int64()),
                    pa.array([f + len(b) if m else 0 for f, b, m in zip(first, bodies, mine)], pa.int64()),
                    pa.array([marks + len(r) + len(t) for r, t in zip(roles, texts)], pa.int64()),
                ],
                names=["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to", "chars"],
            )

    return src.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, loss_from long, loss_to long, chars long")


def masks(lengths: np.ndarray, loss_from: np.ndarray, loss_to: np.ndarray) -> np.ndarray:
    """The loss mask of segments laid end to end: +1 where loss begins, -1 where it ends, summed up."""
    starts = np.cumsum(lengths) - lengths
    edges = np.zeros(int(lengths.sum()) + 1, np.int32)
    np.add.at(edges, starts + loss_from, 1)
    np.add.at(edges, starts + loss_to, -1)
    return np.cumsum(edges[:-1]).astype(np.uint8)


def assemble(turns: DataFrame, part_tokens: int = PART_TOKENS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, block, part, ids, mask, chars): each conversation's segments spliced in order of turn, role and text.

    A conversation comes in blocks of ``block_turns`` turn numbers, which may be in different tasks, and a block of more than ``part_tokens``
    tokens in several parts, so that neither a task nor a row holds a whole conversation. The masks of a part are its own prefix
    sums. Sorting within partitions spills to disk; a null conv_id is a conversation too, null turns come first.
    """
    block = F.coalesce(F.floor(F.col("turn") / block_turns).cast("long"), F.lit(-(2**62)))
    rows = turns.withColumn("block", block).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text").select("conv_id", "block", "ids", "loss_from", "loss_to", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        whose, part, tokens = None, 0, 0

        def close() -> None:
            nonlocal held, tokens
            segments = [np.frombuffer(h[0], "<u4") for h in held]
            mask = masks(np.array([len(s) for s in segments]), np.array([h[1] for h in held]), np.array([h[2] for h in held]))
            out.append((*whose, part, np.concatenate(segments).tobytes(), mask.tobytes(), sum(h[3] for h in held)))
            held, tokens = [], 0

        def flush() -> pa.RecordBatch:
            kinds = [("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("mask", pa.binary()), ("chars", pa.int64())]
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])
            out.clear()
            return got

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:2] != whose:
                    close()
                    part = 0
                elif held and tokens >= part_tokens:
                    close()
                    part += 1
                elif not held:
                    part = 0
                whose = row[:2]
                held.append(row[2:])
                tokens += len(row[2]) // 4
            if len(out) > 200:
                yield flush()
        if held:
            close()
        yield flush()

    return rows.mapInArrow(run, "conv_id long, block long, part int, ids binary, mask binary, chars long")


def format_chats(df: DataFrame, path: str) -> DataFrame:
    """Token ids and loss masks of conversations, by parts."""
    return assemble(encode_turns(df, path))


def text_of(ids: np.ndarray, path: str) -> str:
    """The formatted text that ids stand for."""
    out, tok = [], tokenizer(path)
    cuts = np.flatnonzero(ids >= OPEN)
    last = 0
    for c in cuts:
        out += [tok.decode(ids[last:c].tolist(), skip_special_tokens=False), MARKS[int(ids[c])]]
        last = c + 1
    return "".join([*out, tok.decode(ids[last:].tolist(), skip_special_tokens=False)])


def read_back(parts: DataFrame, path: str) -> DataFrame:
    """Per conversation what its ids and mask say: turns, their digest, the text under the loss and its digest, formatted length.

    Takes rows of assemble() in any order. A conversation's parts are streamed in order through one task, for its digests, and none is kept.
    """
    parts = parts.select("conv_id", "block", "part", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").select("conv_id", "ids", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        out: list[tuple] = []
        state: list | None = None
        conv = None

        def done() -> None:
            turns, digest, chars, loss, formatted = state
            out.append((conv, turns, digest.hexdigest(), chars, loss.hexdigest(), formatted))

        for batch in batches:
            for c, raw, raw_mask in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or c != conv:
                    if state is not None:
                        done()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.frombuffer(raw, "<u4"), np.frombuffer(raw_mask, np.uint8)
                opens, texts, closes = (np.flatnonzero(ids == k).tolist() for k in (OPEN, TEXT, CLOSE))
                segments = [ids[a + 1 : b].tolist() for o, t, e in zip(opens, texts, closes) for a, b in ((o, t), (t, e))]
                said = tok.decode_batch(segments, skip_special_tokens=False)
                for k, (t, e) in enumerate(zip(texts, closes)):
                    role, text = unescape(said[2 * k]), unescape(said[2 * k + 1])
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    own = mask[t + 1 : e]
                    if len(own) and own.all():
                        state[2] += len(text)
                        state[3].update(text.encode())
                    elif own.any() or mask[t] or mask[e]:
                        raise ValueError(f"conversation {conv}: a loss mask that isn't one whole text")
                    state[4] += len(said[2 * k]) + len(said[2 * k + 1]) + sum(map(len, MARKS.values()))
        if state is not None:
            done()
        kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All conversations and conversation -7, formatted, written to the shared folder and read back from there."""
    path = path or vocabulary_path()
    arrow_batches(spark)
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    folder = shared_dir(spark)
    format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra), path).write.parquet(folder)
    return read_back(spark.read.parquet(folder), path)


OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({sum(map(len, MARKS.values()))} + length(role) + length(text)
         + len(regexp_extract_all(role, '{"|".join(["\\\\\\\\"] + [re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)])}'))
         + len(regexp_extract_all(text, '{"|".join(["\\\\\\\\"] + [re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)])}'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
