"""Collocations by count streams in prefix and in suffix order.

Blocks of documents count their phrases of one word, then of two, up to five. A phrase of n words is the pair of the phrases without its
last and without its first word; a block counts it only where both are frequent in the whole corpus. Blocks send their counts of pairs to
shards as packed lists in the order of a key that is dealt evenly, so that a pair takes some bytes, not a row; a shard adds up the counts
of all blocks and answers each with the numbers of its frequent pairs. The frequent phrases of each length are one stream of counts.
Sorted by the shorter prefix it is merged with the stream of phrases a word shorter, which gives the counts of all first parts and, for
each shorter phrase, its largest extension to the right; sorted by the shorter suffix, the counts of all rests and extensions to the left.
Both joins are sort-merge joins of sorted streams, no table of phrases is kept in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.bytesops import LOWER, U64, Words, chunks, mix, spans
from trackloom.llm.common import arrow_batches, block_count, checkpointed, give_back, remove, shared_dir, table

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that are counted together; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
#: Words of the corpus a shard of pairs, which bounds the pairs that meet in one task; and the fewest shards.
SHARD_WORDS, LEAST_SHARDS = 3 << 20, 8
#: Pairs whose keys are made or found at once.
SLICE = 1 << 18
#: Fixed classes of bytes: those that end a piece, and those that end a word.
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
IN_WORD = ~BREAKS
IN_WORD[[0x20, 0x09]] = False
NO_LANG = "und"


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, none below zero, compressed byte by byte; narrow ones where the numbers are small."""
    arrays = [x.astype("<u4" if not len(x) or int(x.max()) < 1 << 32 else "<u8", copy=False) for x in arrays]
    planes, at = np.empty(sum(x.nbytes for x in arrays), np.uint8), 0
    for x in arrays:
        for plane in x.view(np.uint8).reshape(-1, x.itemsize).T:
            planes[at : at + len(x)] = plane
            at += len(x)
    head = np.array([len(arrays), *(n for x in arrays for n in (x.itemsize, len(x)))], "<i8")
    return head.tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, "<i8", 1)[0])
    head = np.frombuffer(blob, "<i8", 2 * k, 8).reshape(k, 2)
    planes, at, out = np.frombuffer(pa.decompress(memoryview(blob)[8 + 16 * k :], int(head.prod(axis=1).sum()), codec="zstd"), np.uint8), 0, []
    for width, n in head.tolist():
        out.append(np.ascontiguousarray(planes[at : at + width * n].reshape(width, n).T).view(f"<u{width}").ravel())
        at += width * n
    return out


def _gaps(x: np.ndarray) -> np.ndarray:
    """What each of ascending numbers adds to the one before."""
    return np.diff(x, prepend=x.dtype.type(0))


def _by_count(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of those that occur, the most frequent first; the place of each number among these), so that frequent ones have small places."""
    order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    place = np.empty(len(count), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return order, place


class _Block:
    """Words of texts that come chunk by chunk: each word's number in its chunk, its place, and of each chunk its keys, their counts and a spelling of each."""

    def __init__(self) -> None:
        self.bytes, self.numbers, self.joined = 0, [], []
        self.langs: dict[str, int] = {}
        self.spelt: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        low = LOWER[data]
        words = Words(low, offsets, IN_WORD, None)
        self.bytes += len(data)
        if not len(words.start):
            return
        code = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)[words.doc]
        key = mix(words.hash ^ mix(code.astype(U64) + U64(1)))
        breaks = np.concatenate([[0], np.cumsum(BREAKS[low], dtype=np.int32)])
        joined = np.zeros(len(key), bool)
        joined[1:] = (words.doc[1:] == words.doc[:-1]) & (breaks[words.start[1:]] == breaks[words.end[:-1]])
        own, at, ix, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(at)
        at, place = at[order], np.empty(len(own), np.int32)
        place[order] = np.arange(len(own), dtype=np.int32)
        self.spelt.append((own[order], count[order].astype(np.int32), code[at].astype(np.int32), spans(low, words.start[at], words.end[at])))
        self.numbers.append(place[ix])
        self.joined.append(joined)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """The block's words with their counts, and a row with the place and number of each word; a break between pieces leaves a gap in the places."""
        if not self.numbers:
            return
        key, count, code, word = zip(*self.spelt)
        _, first, number = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
        count = np.bincount(number, np.concatenate(count)).astype(np.int64)  # exact, as no block has 2**53 words
        order, place = _by_count(count)
        number = np.split(place[number], np.cumsum([len(x) for x in key])[:-1])
        first = first[order]
        code, word, count = np.concatenate(code)[first], pa.concat_arrays(word).take(pa.array(first)).cast(pa.string()), count[order]
        self.spelt, key, place = [], None, None
        ix = np.concatenate([x[y] for x, y in zip(number, self.numbers)])
        at = np.cumsum(~np.concatenate(self.joined), dtype=np.int32)
        at += np.arange(len(ix), dtype=np.int32)
        lang = pa.array(list(self.langs)).take(pa.array(code))
        n = len(first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), lang, word, pa.array(count), pa.nulls(n, pa.binary())], names=["block", "ix", "lang", "word", "c", "state"])
        yield _state_row(["block", "ix", "lang", "word", "c"], [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()], block, _packed(_gaps(at), ix))


def _state_row(names: list[str], kinds: list[pa.DataType], block: int, blob: bytes) -> pa.RecordBatch:
    columns = [pa.array([block if name == "block" else None], kind) for name, kind in zip(names, kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([blob], pa.binary())], names=[*names, "state"])


def words_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, ix, lang, word, c) of each block's words, and (block, state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, data, offsets in chunks(batch.column(0)):
                block.add(data, offsets, langs[first : first + len(offsets) - 1])
                if block.bytes >= block_bytes:
                    yield from block.rows(number)
                    number, block = number + 1, _Block()
        yield from block.rows(number)

    return docs.mapInArrow(run, "block long, ix int, lang string, word string, c long, state binary")


class Keys:
    """Pairs of ids below 2**``width`` as keys that are dealt evenly over 2**(2 * width) numbers, and these cut into ranges of equal length, the shards."""

    ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, width: int, shards: int) -> None:
        if width > 32:
            raise ValueError("more than 2**32 frequent phrases of a length")
        self.width, self.shards, self.mask = width, shards, (1 << 2 * width) - 1
        self.starts = [((i << 2 * width) + shards - 1) // shards for i in range(shards)]

    def of(self, p: np.ndarray, s: np.ndarray) -> np.ndarray:
        x = (p.astype(U64) << U64(self.width)) | s.astype(U64)
        x = x * U64(self.ODD[0]) & U64(self.mask)
        return (x ^ (x >> U64(self.width))) * U64(self.ODD[1]) & U64(self.mask)

    def pairs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Undoes of()."""
        x = key * U64(pow(self.ODD[1], -1, 1 << 64)) & U64(self.mask)
        x = (x ^ (x >> U64(self.width))) * U64(pow(self.ODD[0], -1, 1 << 64)) & U64(self.mask)
        return (x >> U64(self.width)).astype(np.int64), (x & U64((1 << self.width) - 1)).astype(np.int64)

    def cuts(self, key: np.ndarray) -> np.ndarray:
        """Where each shard begins in ascending keys, and their end."""
        return np.append(np.searchsorted(key, np.array([x for x in self.starts if x <= self.mask], U64)), [len(key)] * (1 + sum(x > self.mask for x in self.starts)))


SENT = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("blob", pa.binary())])
SENT_DDL = "block long, shard int, blob binary"
COUNTED = pa.schema([("id", pa.int64()), ("p", pa.int64()), ("s", pa.int64()), ("f", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())])
COUNTED_DDL = "id long, p long, s long, f long, block long, blob binary"


def _sent(block: int, at: np.ndarray, here: np.ndarray, ids: np.ndarray, keys: Keys, last: bool) -> pa.Table:
    """A block's state (places, numbers and ids of its frequent phrases), and for each shard the keys and counts of their pairs."""
    beside = np.diff(at) == 1
    inside = np.append(beside, False)
    inside[1:] |= beside
    at, here = at[inside], here[inside]
    if not len(at):
        return SENT.empty_table()
    order, place = _by_count(np.bincount(here, minlength=len(ids)))
    here, ids = place[here], ids[order]
    own, count = _distinct(_pair_keys(at, here, ids, keys))
    cuts = keys.cuts(own)
    shards, blobs = [], []
    if not last:
        shards, blobs = [None], [_packed(_gaps(at), here, ids)]
    for shard, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            shards.append(shard)
            blobs.append(_packed(_gaps(own[a:b] - U64(keys.starts[shard])), count[a:b]))
    return pa.Table.from_arrays([pa.array(np.full(len(blobs), block)), pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], schema=SENT)


def _pair_keys(at: np.ndarray, here: np.ndarray, ids: np.ndarray, keys: Keys) -> np.ndarray:
    """The keys of each two phrases that begin one word apart."""
    key, n = np.empty(np.count_nonzero(np.diff(at) == 1), U64), 0
    for a in range(0, len(at), SLICE):
        x = a + np.flatnonzero(np.diff(at[a : a + SLICE + 1]) == 1)
        key[n : n + len(x)] = keys.of(ids[here[x]], ids[here[x + 1]])
        n += len(x)
    return key


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and their counts; ``key`` itself gets sorted."""
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.diff(first, append=len(key))


def _places(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each key is among the ascending ``known`` ones; -1: nowhere."""
    out = np.full(len(key), -1, np.int32)
    for a in range(0, len(key) if len(known) else 0, SLICE):
        x = key[a : a + SLICE]
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        out[a : a + SLICE] = np.where(known[at] == x, at, -1)
    return out


def pairs_of_words(state: pa.Table, often: pa.Table, keys: Keys, last: bool) -> pa.Table:
    """What a block sends of the pairs of its words that ``often`` holds, by their numbers in the block."""
    if not state.num_rows or not often.num_rows:
        return SENT.empty_table()
    give_back()
    gaps, ix = _unpacked(state["state"][0].as_py())
    number = np.full(int(ix.max()) + 1, -1, np.int32)
    number[often["ix"].to_numpy()] = np.arange(often.num_rows, dtype=np.int32)
    here = number[ix]
    at, keep = np.cumsum(gaps, dtype=np.int32), here >= 0
    at, here = at[keep], here[keep]
    del gaps, ix, keep
    return _sent(state["block"][0].as_py(), at, here, often["id"].to_numpy(), keys, last)


def longer(state: pa.Table, answers: pa.Table, known: Keys, keys: Keys, last: bool) -> pa.Table:
    """What a block sends of the pairs of those of its pairs that the shards' ``answers`` call frequent; ``known`` made the keys of these."""
    if not state.num_rows or not answers.num_rows:
        return SENT.empty_table()
    give_back()
    gaps, here, ids = _unpacked(state["blob"][0].as_py())
    at = np.cumsum(gaps, dtype=np.int32)
    key = _pair_keys(at, here, ids, known)
    at = at[:-1][np.diff(at) == 1]
    del gaps, here
    own = _distinct(key.copy())[0]
    cuts, places, found = known.cuts(own), [], []
    answers = answers.sort_by("shard")
    for shard, blob in zip(answers["shard"].to_pylist(), answers["blob"].to_pylist()):
        place, rank = (np.cumsum(x, dtype=np.int64) for x in _unpacked(blob))
        places.append(cuts[shard] + place)
        found.append(rank * known.shards + shard)
    here = _places(key, own[np.concatenate(places)])
    del own, key
    keep = here >= 0
    at, here = at[keep], here[keep]
    return _sent(state["block"][0].as_py(), at, here, np.concatenate(found), keys, last)


def counted(lists: pa.Table, keys: Keys, least: int) -> pa.Table:
    """A shard's frequent pairs with their counts in all blocks, and the answer to each block: which of its keys these are, and their ranks among them.

    In an answer's row the id is the shard's number. The id of a pair is its rank times the number of shards, plus the shard's number: ids are small and no two shards share one.
    """
    give_back()
    shard = lists["shard"][0].as_py()
    parts = [_unpacked(x) for x in lists["blob"].to_pylist()]
    key = np.concatenate([np.cumsum(gaps, dtype=U64) for gaps, _ in parts])
    count = np.concatenate([c for _, c in parts]).astype(np.int64)
    ends = np.cumsum([len(c) for _, c in parts])
    del parts
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    f = np.add.reduceat(count[order], np.flatnonzero(new))
    often = f >= least
    rank = np.where(often, np.cumsum(often) - 1, -1)
    each = np.empty(len(key), np.int64)
    each[order] = rank[np.cumsum(new) - 1]
    p, s = keys.pairs(key[new][often] + U64(keys.starts[shard]))
    n = len(p)
    blocks, blobs = [], []
    for block, mine in zip(lists["block"].to_pylist(), np.split(each, ends[:-1])):
        places = np.flatnonzero(mine >= 0)
        if len(places):
            blocks.append(block)
            blobs.append(_packed(_gaps(places), _gaps(mine[places])))
    found = pa.Table.from_arrays([pa.array(np.arange(n) * keys.shards + shard), pa.array(p), pa.array(s), pa.array(f[often]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=COUNTED)
    none = pa.nulls(len(blobs), pa.int64())
    answers = pa.Table.from_arrays([pa.array(np.full(len(blobs), shard)), none, none, none, pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], schema=COUNTED)
    return pa.concat_tables([found, answers])


def _with(step, *rest):  # noqa: ANN001, ANN002, ANN202
    return lambda state, often: step(state, often, *rest)


def _counted(keys: Keys, least: int):  # noqa: ANN202
    return lambda lists: counted(lists, keys, least)


def frequent_words(counts: DataFrame, shards: int, least: int) -> DataFrame:
    """The blocks' counts of words that all blocks together count often enough: (block, ix, id, head, lang, word, f); ``head`` is true once a word.

    A word has a row a block at most, so that none is a task's burden, however often it occurs. Words are dealt to shards and numbered there, so that ids are small.
    """
    w = W.partitionBy("shard", "lang", "word")
    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("lang", "word"), F.lit(shards)).cast("int")).repartition("shard")
    often = dealt.withColumn("f", F.sum("c").over(w)).withColumn("head", F.col("block") == F.min("block").over(w)).where(F.col("f") >= least)
    rank = F.dense_rank().over(W.partitionBy("shard").orderBy("lang", "word")) - 1
    return often.select("block", "ix", (rank.cast("long") * shards + F.col("shard")).alias("id"), "head", "lang", "word", "f")


def streams(docs: DataFrame, least: int, longest: int, block_bytes: int, base: str) -> tuple[list[DataFrame], DataFrame]:
    """The streams of frequent phrases by length, and (lang, n): words of each language. All are tables below ``base``."""
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def width(found: DataFrame) -> int:
        return max(1, int(found.agg(F.max("id")).first()[0] or 0).bit_length())

    made = written(words_of(docs, block_bytes), "counts1")
    counts = made.where("state is null").drop("state")
    total = written(counts.groupBy("lang").agg(F.sum("c").alias("n")), "total")
    shards = max(LEAST_SHARDS, block_count(total.agg(F.sum("n")).first()[0] or 0, SHARD_WORDS))
    often = written(frequent_words(counts, 8 * shards, least), "frequent1")
    out = [often.where("head").select("id", "lang", "word", "f")]
    for n in range(2, longest + 1):
        known, keys, last = keys if n > 2 else None, Keys(width(out[-1]), shards), n == longest
        if n == 2:
            state = made.where("state is not null").select("block", "state")
            step = _with(pairs_of_words, keys, last)
            answers = often.select("block", "ix", "id")
        else:
            state = made.where("shard is null").select("block", "blob")
            step = _with(longer, known, keys, last)
            answers = often.where("blob is not null").select("block", F.col("id").cast("int").alias("shard"), "blob")
        sent = written(state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(step, SENT_DDL), f"counts{n}")
        remove(spark, f"{base}/counts{n - 1}")
        made = sent
        often = written(made.where("shard is not null").groupBy("shard").applyInArrow(_counted(keys, least), COUNTED_DDL), f"frequent{n}")
        out.append(often.where("blob is null").select("id", "p", "s", "f"))
    return out, total


def scores(a: str, n: str, ls: str, rs: str) -> Column:
    """floor(1000 a n / (l r)) for each cut, divided as whole numbers of up to 38 digits."""
    top, bottom = f"cast(1000 as decimal(4,0)) * cast({a} as decimal(15,0)) * cast({n} as decimal(19,0))", f"cast(x as decimal(19,0)) * cast({rs}[i] as decimal(19,0))"
    return F.expr(f"transform({ls}, (x, i) -> ({top}) div ({bottom}))")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of 2 to ``longest`` words that occur ``least`` times or more in a language.

    A-Z are lower-cased; a text is cut into pieces at ``.,;:!?`` and line ends, a piece into words at blanks and tabs. ``a`` counts all
    occurrences within pieces. Of the cuts into two parts the one of the least ``score`` = floor(1000 a n / (l r)) counts, then the one of the
    shortest first part; l and r are the counts of its parts, n the language's words. A phrase that a longer one of equal count holds is
    left out: were it any longer one, one of the two that are a word longer has the same count.
    A null text has no words, a null language is ``und``. Rows count as often as they are repeated; ids and other columns aren't read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(text_col).alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("l"))
    base = shared_dir(spark)
    grams, total = streams(docs, least, longest, block_bytes, base)
    none = F.array().cast("array<long>")
    known = grams[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("ls"), none.alias("rs"))
    kept = []
    for n, stream in enumerate([*grams[1:], None], 2):
        if stream is not None:
            shorter = known
            prefix = shorter.select(F.col("id").alias("p"), "lang", "phrase", F.array_append("ls", F.col("f")).alias("ls"))
            suffix = shorter.select(F.col("id").alias("s"), "last", F.array_prepend("rs", F.col("f")).alias("rs"))
            in_prefix_order = stream.join(prefix.hint("merge"), "p")
            both = in_prefix_order.join(suffix.hint("merge"), "s")
            known = checkpointed(both.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "ls", "rs"))
            right = stream.groupBy(F.col("p").alias("id")).agg(F.max("f").alias("right"))
            left = stream.groupBy(F.col("s").alias("id")).agg(F.max("f").alias("left"))
            open_ = shorter.join(right.hint("merge"), "id", "left").join(left.hint("merge"), "id", "left").where("coalesce(greatest(`left`, `right`), 0) < f")
        else:
            open_ = known
        if n > 2:
            kept.append(open_.select("lang", "phrase", F.lit(n - 1).alias("words"), F.col("f").alias("a"), "ls", "rs"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    scored = rows.join(total, "lang").withColumn("scores", scores("a", "n", "ls", "rs"))
    best = scored.withColumn("score", F.array_min("scores")).withColumn("k", F.array_position("scores", F.col("score")).cast("int"))
    out = checkpointed(best.select("lang", "phrase", "words", "a", F.element_at("ls", F.col("k")).alias("l"), F.element_at("rs", F.col("k")).alias("r"), "n", "score"))
    remove(spark, base)
    return out


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases by score."""
    arrow_batches(spark)
    found = collocations(table(spark, sf_dir, "documents"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", place).where(F.col("rank") <= TOP).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, w[i:i + k - 1] AS ws, count(*) AS f
  FROM p, unnest(range(1, 6)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)
  GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1),
cuts AS (
  SELECT c.lang, c.ws, k, a, x.f AS l, y.f AS r, CAST(t.n AS HUGEINT) AS n, (1000::HUGEINT * a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM c, unnest(range(1, len(ws))) AS b(k)
  JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k]
  JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_ AS (
  SELECT DISTINCT c.lang, c.ws[i:j] AS ws, c.a
  FROM c, unnest(range(1, len(ws))) AS a(i), unnest(range(i + 1, len(ws) + 1)) AS b(j)
  WHERE j - i + 1 < len(ws)),
dropped AS (SELECT DISTINCT c.lang, c.ws FROM c JOIN inner_ i ON c.lang = i.lang AND c.ws = i.ws WHERE 100 * i.a >= 100 * c.a),
ranked AS (
  SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank
  FROM best ANTI JOIN dropped USING (lang, ws))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
