"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Tasks build automata of shares of the items' words, one for a usual benchmark; they are sent to every task, up to a bound of bytes at once, and
documents are streamed through them, following the longest match that ends at each word. Words are compared by 64-bit hashes. Only runs
of words that all occur in some item can hold a window, so other words end a match without a step.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.bytesops import U64, Words, chunks
from trackloom.llm.common import arrow_batches, checkpointed, docs_table, table

WINDOW = 13
#: A document is contaminated if at least 1 in so many of its words is hit.
COVERAGE = 20
#: Words of the items that one automaton may hold (some 100 bytes each); more items make more automata.
AUTOMATON_WORDS = 1_000_000
#: Automata that are sent to every task, and documents that meet several automata, at once.
PASS_BYTES, TEXT_BYTES = 256 << 20, 32 << 20


class SuffixAutomaton:
    """All substrings of several word sequences; ``step`` tracks the longest match."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.move: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, move: dict[int, int], link: int) -> int:
        self.move.append(move)
        self.length.append(length)
        self.link.append(link)
        return len(self.move) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the last sequence with one more word."""
        move, link, length = self.move, self.link, self.length
        there = move[last].get(word)
        if there is not None and length[there] == length[last] + 1:
            return there
        if there is not None:
            clone = self._state(length[last] + 1, dict(move[there]), link[there])
            p = last
            while p >= 0 and move[p].get(word) == there:
                move[p][word] = clone
                p = link[p]
            link[there] = clone
            return clone
        new, p = self._state(length[last] + 1, {}, -1), last
        while p >= 0 and word not in move[p]:
            move[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = move[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = self._state(length[p] + 1, dict(move[q]), link[q])
                while p >= 0 and move[p].get(word) == q:
                    move[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    def build(self, items: Iterable[tuple[int | None, list[int]]]) -> SuffixAutomaton:
        """Enters the items; items of no words have no window."""
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n, k = len(self.move), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        #: the ancestor that holds the suffix of ``window`` words
        self.holder = [-1] * n
        for s in order:
            if self.length[s] >= k:
                self.holder[s] = s if self.length[self.link[s]] < k else self.holder[self.link[s]]
        full: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        for item, words in items:
            s = 0
            for at, w in enumerate(words):
                s = self.move[s][w]
                if at + 1 >= k:
                    full.setdefault(self.holder[s], set()).add(item)
            if len(words) < k:
                short.setdefault(s, {}).setdefault(len(words), set()).add(item)
        self.full = full
        #: (size, items) of whole short items: those that end in the state itself, and those further up
        self.own = {s: sorted(x.items()) for s, x in short.items()}
        self.above: dict[int, list] = {}
        for s in order:
            up = self.link[s]
            if got := self.own.get(up, []) + self.above.get(up, []):
                self.above[s] = got
        self.least = min([k, *(len(w) for _, w in items)]) if items else 0
        return self

    def scan(self, words: list[int], first: int, spans: list[tuple[int, int]], found: set) -> None:
        """Streams words whose first is number ``first``; adds hit spans [a, b) and the items' ids."""
        move, link, length, k = self.move, self.link, self.length, self.window
        holder, full, own, above = self.holder, self.full, self.own, self.above
        state = matched = 0
        for at, w in enumerate(words, first + 1):
            while (to := move[state].get(w)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= k and (hit := full.get(holder[state])):
                spans.append((at - k, at))
                found |= hit
            for size, hit in own.get(state, ()):
                if size <= matched:
                    spans.append((at - size, at))
                    found |= hit
            for size, hit in above.get(state, ()):
                spans.append((at - size, at))
                found |= hit


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Items:
    """An automaton with its vocabulary of word hashes."""

    def __init__(self, rows: Iterable[tuple[int | None, str | None]], window: int = WINDOW) -> None:
        rows = list(rows)
        sequences = []
        if rows:
            data = pa.array([t or "" for _, t in rows], pa.large_string())
            for row, raw, offsets in chunks(data):
                w = Words(raw, offsets)
                sequences += [(rows[row + k][0], w.hash[w.first[k] : w.first[k + 1]]) for k in range(len(offsets) - 1)]
        self.vocab = np.unique(np.concatenate([np.zeros(0, U64), *(s for _, s in sequences)]))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.vocab >> U64(48)).astype(np.int64)] = True
        self.automaton = SuffixAutomaton(window).build((i, np.searchsorted(self.vocab, s).tolist()) for i, s in sequences)

    def match(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, int]], list[int]]]:
        """For each text: words, hit spans by word, by byte, item ids."""
        least = self.automaton.least
        for _, data, offsets in chunks(texts):
            w = Words(data, offsets)
            n = len(w.hash)
            maybe = np.flatnonzero(self.bits[(w.hash >> U64(48)).astype(np.int64)]) if len(self.vocab) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(self.vocab, w.hash[maybe]), max(len(self.vocab) - 1, 0))
            same = self.vocab[at] == w.hash[maybe] if len(maybe) else np.zeros(0, bool)
            place, token = maybe[same], at[same]
            # runs of neighbouring words of one text
            cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(w.doc[place]) != 0)) + 1
            starts = np.concatenate([[0], cut]).astype(np.int64) if len(place) else np.zeros(0, np.int64)
            ends = np.concatenate([cut, [len(place)]]).astype(np.int64) if len(place) else np.zeros(0, np.int64)
            long = ends - starts >= max(least, 1)
            hits: dict[int, tuple[list, set]] = {}
            if least:
                for a, b in zip(starts[long].tolist(), ends[long].tolist()):
                    doc = int(w.doc[place[a]])
                    spans, found = hits.get(doc) or ([], set())
                    self.automaton.scan(token[a:b].tolist(), int(place[a] - w.first[doc]), spans, found)
                    if spans:
                        hits[doc] = spans, found
            assert n == w.first[-1]
            for doc in range(len(offsets) - 1):
                spans, found = hits.get(doc, ([], set()))
                words = _merged(spans)
                base, byte0 = int(w.first[doc]), int(offsets[doc])
                yield int(w.first[doc + 1] - base), words, [(int(w.start[base + a]) - byte0, int(w.end[base + b - 1]) - byte0) for a, b in words], sorted(i for i in found if i is not None)


def pieces(words_from: pa.Array, ids: list, window: int, most: int) -> Iterator[tuple[int | None, str]]:
    """Items as (id, text); one of more than ``most`` words in pieces that overlap by a word less than a window, so that each window lies in one."""
    for row, raw, offsets in chunks(words_from):
        w = Words(raw, offsets)
        for k in range(len(offsets) - 1):
            a, b = int(w.first[k]), int(w.first[k + 1])
            for start in range(a, b, most):
                stop = min(start + most + window - 1, b)
                yield ids[row + k], raw[w.start[start] : w.end[stop - 1]].tobytes().decode()
                if stop == b:
                    break


def automata(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> DataFrame:
    """(automaton): pickled automata, built by tasks from shares of the items; a share has about ``most`` words, and ``most`` at least in one piece.

    Items are cut into pieces of at most ``most`` words first and dealt by a running count of words, so no share depends on how texts are spaced.
    """
    most = max(most, window)
    src = items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(pieces(batch.column(1), batch.column(0).to_pylist(), window, most))
            sizes = [len(Words(np.frombuffer(raw := t.encode(), np.uint8), np.array([0, len(raw)])).hash) for _, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string()), pa.array(sizes, pa.int64())], names=["i", "t", "n"])

    cuts = src.mapInArrow(cut, "i long, t string, n long").distinct()
    total = cuts.agg(F.sum("n")).first()[0] or 0
    shares = max(1, -(-total // most))

    def build(t: pa.Table) -> pa.Table:
        return pa.table({"automaton": pa.array([pickle.dumps(Items(zip(t["i"].to_pylist(), t["t"].to_pylist()), window))], pa.binary())})

    return cuts.withColumn("share", F.pmod(F.xxhash64("i", "t"), F.lit(shares))).groupBy("share").applyInArrow(build, "automaton binary")


def _passes(blobs: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of automata of at most ``most`` bytes, or one that is larger."""
    held: list[bytes] = []
    for blob in blobs:
        if held and sum(map(len, held)) + len(blob) > most:
            yield held
            held = []
        held.append(blob)
    yield held


def _stream(batches: Iterator[pa.RecordBatch], blobs: list[bytes], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with what all automata find in their texts, added to what earlier passes found.

    Several automata are loaded one after the other for some TEXT_BYTES of documents at once, so none is loaded for each batch.
    """
    one = pickle.loads(blobs[0]) if len(blobs) == 1 else None
    held: list[pa.RecordBatch] = []

    def found(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [[(0, [], [], [])] * b.num_rows for b in part]
        for blob in blobs:
            own = one or pickle.loads(blob)
            for k, b in enumerate(part):
                got = own.match(b.column(at))
                every[k] = [(n, w, y, i) if not (w1 or i1) else (n, _merged(w1 + w), _merged(y1 + y), sorted({*i1, *i})) for (_, w1, y1, i1), (n, w, y, i) in zip(every[k], got)]
        for b, rows in zip(part, every):
            if b.num_columns > len(names):  # an earlier pass's columns
                *own_columns, words, places, ids = b.columns
                rows = [(n, _merged(w + [(s["start"], s["end"]) for s in w0]), _merged(y + [(s["start"], s["end"]) for s in y0]), sorted({*i, *i0})) for (n, w, y, i), w0, y0, i0 in zip(rows, words.to_pylist(), places.to_pylist(), ids.to_pylist())]
            else:
                own_columns = b.columns
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            as_spans = lambda x: [{"start": a, "end": e} for a, e in x]
            yield pa.RecordBatch.from_arrays(
                [
                    *own_columns, pa.array([n for n, *_ in rows], pa.int64()), pa.array([as_spans(w) for _, w, _, _ in rows], spans),
                    pa.array([as_spans(y) for _, _, y, _ in rows], spans), pa.array([i for *_, i in rows], pa.list_(pa.int64()))],
                names=[*names, "n_words", "__words", "spans", "item_ids"])

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if one or size >= TEXT_BYTES:
            yield from found(held)
            held, size = [], 0
    if held:
        yield from found(held)


def find(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most: int = AUTOMATON_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Rows of ``df`` with n_words, n_hit, spans (bytes [start, end) of merged hit runs) and item_ids (sorted).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one. No
    shuffle of ``df``. Automata of ``most`` words each are built by tasks; those of up to ``pass_bytes`` are sent to all tasks at once, and where
    there are more, the documents with what was found so far are written to the shared folder between passes. Ids are whole numbers. Null
    or empty texts have no words. Items with a null id hit words but aren't listed. Columns of ``df`` with the
    names of results are replaced; a null id and repeated rows stay.
    """
    carried = [c for c in df.columns if c not in ("n_words", "n_hit", "__words", "spans", "item_ids")]
    out = df.select(*[F.col(f"`{c}`") for c in carried])
    at, context = carried.index(text_col), df.sparkSession.sparkContext
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    span = "array<struct<start: long, end: long>>"
    built = checkpointed(automata(items, item_id, item_text, window, most))
    blobs = (bytes(r[0]) for r in built.toLocalIterator())
    for number, group in enumerate(_passes(blobs, pass_bytes)):
        if number:
            out = checkpointed(out).drop("n_words")
        shared = context.broadcast(group or [pickle.dumps(Items([], window))])
        out = out.mapInArrow(lambda it, shared=shared: _stream(it, shared.value, at, carried), f"{fields}, n_words long, __words {span}, spans {span}, item_ids array<long>")
    hit = F.aggregate("__words", F.lit(0).cast("long"), lambda n, w: n + w["end"] - w["start"])
    return out.select(*[F.col(f"`{c}`") for c in carried], "n_words", hit.alias("n_hit"), "spans", "item_ids")


def judged(found: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Adds ``contaminated``: some word is hit, and at least one in ``coverage``."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words")))


def remove(df: DataFrame, items: DataFrame, text_col: str = "text", coverage: int | None = COVERAGE, longest: int | None = None, **options: object) -> DataFrame:
    """``df`` without contaminated documents, and without hit spans of more than ``longest`` words.

    ``coverage`` None drops no document and ``longest`` None cuts no span; other texts stay as they are.
    """
    columns = df.columns
    out = find(df, items, text_col=text_col, **options)
    if coverage is not None:
        out = judged(out, coverage).where(~F.col("contaminated"))
    if longest is not None:

        @F.pandas_udf("string")
        def cut(texts, spans):  # noqa: ANN001, ANN202
            def one(text, own):  # noqa: ANN001, ANN202
                if text is None or own is None or not len(own):
                    return text
                raw, kept, last = text.encode(), [], 0
                for s in own:
                    part = raw[s["start"] : s["end"]]
                    if len(Words(np.frombuffer(part, np.uint8), np.array([0, len(part)])).hash) > longest:
                        kept.append(raw[last : s["start"]])
                        last = s["end"]
                return b"".join([*kept, raw[last:]]).decode()

            return texts.combine(spans, one)

        out = out.withColumn(text_col, F.when(F.size("spans") > 0, cut(F.col(text_col), F.col("spans"))).otherwise(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    arrow_batches(spark)
    out = judged(find(docs_table(spark, sf_dir), table(spark, sf_dir, "benchmark")))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, list_slice(w, i, i + least(len(w), 13) - 1) AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, i, s.size, list_slice(w, i, i + s.size - 1) AS win
  FROM d, sizes s, unnest(range(1, greatest(len(w) - s.size + 2, 1))) AS t(i)),
hits AS (SELECT DISTINCT p.r, p.i, p.size, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.win = x.win),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(j) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
