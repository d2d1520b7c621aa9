"""Periodic runs of words, from Lyndon arrays under both orders of the words.

A stretch that repeats with a period holds a Lyndon root, the longest Lyndon word at its place under one of the two orders. The first phase
of Baier's suffix sorter groups suffixes by just these words: the highest group is done, and each of its suffixes lengthens the word of the
nearest suffix before it that isn't done. The roots are extended to both sides as far as words a period apart are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.bytesops import _POWERS, U64, Words, chunks, mix
from trackloom.llm.common import arrow_batches, docs_table

#: Least length of a run in words, beside twice its period.
LEAST = 12
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def lyndon_array(s: list[int], letters: int) -> list[int]:
    """Length of the longest Lyndon word at each place; letters are 0 to ``letters`` - 1, the end is smaller than all."""
    n = len(s)
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, x in enumerate(s):
        members[x].append(i)
    size, below, above = [1] * letters, list(range(-1, letters - 1)), [*range(1, letters), -1]
    group, out = list(s), [0] * n
    left, right = list(range(-1, n)), [*range(1, n + 1), 0]  # places that aren't done yet; slot n stands for both ends
    g = letters - 1
    while g >= 0:
        length, split, before = size[g], {}, -1
        times = 0
        for i in members[g]:
            if group[i] != g:
                continue
            out[i] = length
            j, r = left[i], right[i]
            right[j], left[r] = r, j
            if j == before:
                times += 1
                continue
            if before >= 0:
                split.setdefault((group[before], times), []).append(before)
            before, times = j, 1
        if before >= 0:
            split.setdefault((group[before], times), []).append(before)
        # those that were lengthened come right above their old group, the more often the higher
        for old, often in sorted(split, reverse=True):
            new = len(size)
            moved = split[old, often]
            for j in moved:
                group[j] = new
            members.append(moved)
            size.append(size[old] + often * length)
            up = above[old]
            # of one old group the highest comes first, and the next ones below it
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    return out


def stretches(word: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of words that hold all runs whole.

    A run of ``least`` words or more of period q has its first and last windows of ``least`` / 2 words again at distance q, with gaps of fewer
    windows between. So windows that occur only once in their neighbourhood part the text; what is left is looked at again until nothing parts.
    """
    size = max(least // 2, 1)
    m = len(word) - size + 1
    if m < 2:
        return []
    value = mix(doc.astype(U64) + U64(1))[:m]
    for k in range(size):
        value = value * U64(0x9E3779B97F4A7C15) + word[k : k + m]
    value = mix(value)
    whole = doc[:m] == doc[size - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(value[at], kind="stable")]
    same = value[order[1:]] == value[order[:-1]]
    one, two = order[:-1][same], order[1:][same]  # each window and its next occurrence
    while len(one):
        marked = np.zeros(m, bool)
        marked[one] = marked[two] = True
        places = np.flatnonzero(marked)
        # gaps of up to size - 1 windows stay within a stretch
        heads = np.concatenate([[True], (np.diff(places) > size) | (doc[places[1:]] != doc[places[:-1]])])
        part = np.cumsum(heads)
        number = np.zeros(m, np.int64)
        number[places] = part
        keep = number[one] == number[two]
        if keep.all():
            first = places[heads]
            last = places[np.append(np.flatnonzero(heads)[1:] - 1, len(places) - 1)] + size
            return [(a, b) for a, b in zip(first.tolist(), last.tolist()) if b - a >= least]
        one, two = one[keep], two[keep]
    return []


class _Extensions:
    """How far words a distance apart are equal, by hashes of stretches, to the right or to the left."""

    def __init__(self, w: np.ndarray) -> None:
        self.n = len(w)
        self.up, self.down = (p[: self.n + 1] for p in _POWERS.get(self.n + 1))
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(mix(w.astype(U64) + U64(1)) * self.up[: self.n], out=self.sums[1:])

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[a + length] - self.sums[a]) * self.up[b - a] == self.sums[b + length] - self.sums[b]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches from a and from b > a."""
        return self._grow(self.n - b, lambda i, got, step: self._equal(a[i] + got, b[i] + got, step))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that end before a and before b > a."""
        return self._grow(a, lambda i, got, step: self._equal(a[i] - got - step, b[i] - got - step, step))

    @staticmethod
    def _grow(most: np.ndarray, equal) -> np.ndarray:  # noqa: ANN001
        got = np.zeros(len(most), np.int64)
        step = 1 << max(int(most.max()).bit_length() - 1, 0) if len(most) else 0
        while step:
            i = np.flatnonzero(got + step <= most)
            good = equal(i, got[i], np.full(len(i), step))
            got[i[good]] += step
            step >>= 1
        return got


def _exactly(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """(start, end) of the stretch around the root at i, word by word."""
    unequal = np.flatnonzero(w[:-p] != w[p:])
    at = int(np.searchsorted(unequal, i))
    return (int(unequal[at - 1]) + 1 if at else 0), (int(unequal[at]) + p if at < len(unequal) else len(w))


def runs_of(w: np.ndarray, lengths: list[int], least: int) -> np.ndarray:
    """(start, end, period) of the runs in stretches of whole numbers that lie end to end."""
    roots = []
    at = 0
    for length in lengths:
        own, ranks = np.unique(w[at : at + length], return_inverse=True)
        s = ranks.tolist()
        for letters in (s, (len(own) - 1 - ranks).tolist()):
            p = np.array(lyndon_array(letters, len(own)))
            i = np.flatnonzero(2 * p <= length)
            roots.append(np.stack([i + at, p[i]]))
        at += length
    # a number of its own after each stretch ends all extensions there
    ends = np.cumsum(lengths)
    gap = np.arange(len(w)) + np.repeat(np.arange(len(lengths)), lengths)
    spaced = np.empty(len(w) + len(lengths), np.int64)
    spaced[gap] = w
    spaced[ends + np.arange(len(lengths))] = int(w.max()) + 1 + np.arange(len(lengths))
    root = np.unique(np.concatenate(roots, axis=1), axis=1)
    i, p = gap[root[0]], root[1]
    near = (spaced[i] == spaced[i + p]) | ((spaced[np.maximum(i, 1) - 1] == spaced[np.maximum(i, 1) + p - 1]) & (i > 0))
    i, p = i[near], p[near]
    reach = _Extensions(spaced)
    start, end = i - reach.left(i, i + p), i + p + reach.right(i, i + p)
    found = np.unique(np.stack([start, end, p])[:, end - start >= np.maximum(least, 2 * p)], axis=1)
    good = []
    for a, b, q in found.T.tolist():
        if (spaced[a : b - q] == spaced[a + q : b]).all():
            good.append((a, b, q))
        else:  # two hashes agreed by chance
            good += [(*_exactly(spaced, x, q), q) for x in i[(p == q) & (start == a) & (end == b)].tolist()]
    good = np.array(sorted(set(good)), np.int64).reshape(-1, 3)
    good = good[good[:, 1] - good[:, 0] >= np.maximum(least, 2 * good[:, 2])]
    shift = np.searchsorted(ends + np.arange(len(lengths)), good[:, 0])
    good[:, 0] -= shift
    good[:, 1] -= shift
    return good


def chunk_runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[Words, np.ndarray]:
    """The words of a chunk of texts and the runs in them, as (start, end, period) in word numbers of the chunk."""
    words = Words(data, offsets, ~BLANK, None)
    parts = stretches(words.hash, words.doc, least)
    if not parts:
        return words, np.zeros((0, 3), np.int64)
    lengths = [b - a for a, b in parts]
    place = np.concatenate([np.arange(a, b) for a, b in parts])
    _, w = np.unique(words.hash[place], return_inverse=True)
    found = runs_of(w, lengths, least)
    # two stretches don't touch in a run, so that an end lies beside the place of its last word
    return words, np.stack([place[found[:, 0]], place[found[:, 1] - 1] + 1, found[:, 2]], axis=1)


def collapsed_bytes(data: np.ndarray, offsets: np.ndarray, words: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts' words joined by one blank, without those that a run holds after its first period."""
    n = len(words.start)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(cover)[:n] == 0)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.start[kept]] += 1
    edge[words.end[kept]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    follows = kept[:-1][words.doc[kept[1:]] == words.doc[kept[:-1]]]
    out = data.copy()
    out[words.end[follows]] = 0x20
    inside[words.end[follows]] = True
    ends = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    return out[inside], ends[offsets]


def runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed), a row per row of ``df``: the runs of each text's words by start, then period, and the text without them.

    Words are what blanks, tabs and line ends part, as they are spelt. A run is a stretch of ``least`` words or more, and of twice its smallest
    period or more, that no neighbouring word extends. ``collapsed`` has the words joined by one blank, without those that lie in a run after
    its first period. A null or blank text has no words, no runs and an empty ``collapsed``. Rows are taken one by one, whatever ids repeat;
    a null id stays null. One text is one task's.
    """
    src = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                words, found = chunk_runs(data, offsets, least)
                n = len(offsets) - 1
                doc = words.doc[found[:, 0]] if len(found) else np.zeros(0, np.int64)
                own = pa.StructArray.from_arrays([pa.array(found[:, 0] - words.first[doc]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], fields=list(struct))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), own)
                text, at = collapsed_bytes(data, offsets, words, found)
                texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(words.first)), lists, texts], names=["k", "n_words", "runs", "collapsed"])

    out = src.mapInArrow(run, f"k {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("k", id_col)


def with_cycles(text: Column, key: Column) -> Column:
    """The texts of one id in ten, by its checksum, with a tail that repeats a stretch of their words; the others as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycled(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        taken = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
        return F.when(n > 0, F.array_join(taken, " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the array of one is there so that the words are found once a text
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), cycled), 1)).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, with tails that repeat in one id of ten: its runs, the longest of them, and digests of all runs and of the text without them."""
    arrow_batches(spark)
    docs = docs_table(spark, sf_dir)
    found = runs(docs.select("doc_id", with_cycles(F.col("text"), F.col("doc_id")).alias("text")))
    ordered = F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period")))
    top = found.withColumn("top", F.array_min(ordered)).withColumn("length", -F.col("top.least"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), "length", F.col("top.period").alias("period"),
        F.expr("(1000 * length) div top.period").alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


# equal stretches of six words a period apart join to a run's equal words: a run has twelve words and twice its period
OP13_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc_table),
places AS (SELECT doc_id, o, len(o) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM hashed),
cycles AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM places),
words AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w
  FROM cycles),
x AS (SELECT doc_id, i, w[i + 1] AS x FROM words, unnest(range(n)) AS u(i)),
six AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM words, unnest(range(n - 5)) AS u(i)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, p, min(i) AS start, max(i) + 6 + p - min(i) AS length FROM islands GROUP BY doc_id, p, island),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM stretches WHERE length >= 12 AND length >= 2 * p GROUP BY doc_id, start, length),
dropped AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(start + period, start + length)) AS u(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM x ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS r FROM runs GROUP BY doc_id)
SELECT words.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
  sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256, n AS n_words
FROM words LEFT JOIN top USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
