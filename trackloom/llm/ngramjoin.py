"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Documents of equal sets of five-word shingles are one class. Classes that share a band's hash are candidates; the candidate graph's
components are the clusters within which every two classes are compared on their whole sets. Small clusters share a task up to a bound
of shingles; a large one is cut into blocks, whose pairs are compared by tasks of their own. A task yields each class's number of
links and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.bytesops import U64, Words, chunks, mix, shingles
from trackloom.llm.common import arrow_batches, checkpointed, docs_table
from trackloom.llm.graph import connected_components

WORDS = 5
SIMILARITY = 0.8
#: Chance of a pair at just SIMILARITY to be a candidate: of a thousand million such links one is lost.
RECALL = 1 - 1e-9
#: Classes in a block of a large cluster, and shingles that a task compares, of small clusters together or of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def bands_for(similarity: float, recall: float, rows: int = 4) -> int:
    """Bands of ``rows`` values with which two sets of just this similarity share one with at least this chance."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def unique_sets(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted by row and value."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        keep = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
        value, row = value[keep], row[keep]
    return value, row


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(k, n, hi, lo, bands): distinct shingles, their set's 128-bit identity, and the band hashes; no bands without words."""
    src = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    r = np.random.default_rng(17)
    multipliers = r.integers(1, 2**63, bands * rows, dtype=np.uint64) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            own = np.zeros((batch.num_rows, bands), np.int64)
            for first, data, offsets in chunks(batch.column(1)):
                value, row = unique_sets(*shingles(Words(data, offsets), words))
                if not len(value):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                at = first + row[heads]
                n[at] = np.diff(np.append(heads, len(row)))
                hi[at] = np.add.reduceat(mix(value), heads).view(np.int64)
                lo[at] = np.add.reduceat(mix(value ^ U64(0x5851F42D4C957F2D)), heads).view(np.int64)
                for b in range(bands):
                    key = np.full(len(heads), b + 1, U64)
                    for j in range(rows):
                        least = np.minimum.reduceat((value * multipliers[b * rows + j]) >> U64(32), heads)
                        key = mix(key * U64(0x100000001B3) + least)
                    own[at, b] = key.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]), pa.int32()), pa.array(own[n > 0].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(hi), pa.array(lo), lists], names=["k", "n", "hi", "lo", "bands"])

    return src.mapInArrow(run, "k long, n long, hi long, lo long, bands array<long>")


def _forest(pairs: Iterator[tuple[int, np.ndarray]], n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(root of each of n nodes, forest edges) of pairs (i, neighbours)."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, others in pairs:
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
    return np.array([find(x) for x in range(n)]), edges


def _links(value: np.ndarray, row: np.ndarray, n: int, similarity: float, side: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each of n sets the later ones that are similar; with ``side`` only pairs across the two sides."""
    _, ids = np.unique(value, return_inverse=True)
    sizes = np.bincount(row, minlength=n)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    for i in range(n - 1):
        if not sizes[i]:
            continue
        mine = ids[starts[i] : starts[i] + sizes[i]]
        mark[mine] = True
        common = np.add.reduceat(mark[ids[starts[i + 1] :]].astype(np.int32), starts[i + 1 :] - starts[i + 1])
        mark[mine] = False
        rest = sizes[i + 1 :]
        good = (common >= similarity * (sizes[i] + rest - common) - 1e-9) & (rest > 0)
        if side is not None:
            good &= side[i + 1 :] != side[i]
        yield i, np.flatnonzero(good) + i + 1


def compare(group: pa.Table, words: int, similarity: float) -> pa.Table:
    """The links in a group of whole clusters, or between two blocks of one cluster.

    Rows (a, b, w, done): w is the documents that class a is linked with here; b a forest neighbour, or the final root if done.
    """
    out: list[tuple] = []
    cluster = group["cluster"].to_numpy()
    order = np.lexsort((group["hi"].to_numpy(), group["k"].to_numpy(), cluster))
    group = group.take(pa.array(order)).combine_chunks()
    same = np.ones(len(order), bool)  # repeated rows are one member
    for c in ("cluster", "k", "hi"):
        same[1:] &= np.diff(group[c].to_numpy()) == 0
    same[:1] = False
    group = group.filter(pa.array(~same)).combine_chunks()
    cluster, k, weight = (group[c].to_numpy() for c in ("cluster", "k", "weight"))
    heads = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]])) if len(cluster) else []
    for a, b in zip(heads, [*heads[1:], len(cluster)]):
        part = group.slice(a, b - a)
        texts = part["t"].combine_chunks() if isinstance(part["t"], pa.ChunkedArray) else part["t"]
        values, rows = [], []
        for first, data, offsets in chunks(texts):
            v, r = shingles(Words(data, offsets), words)
            values.append(v)
            rows.append(r + first)
        value, row = unique_sets(np.concatenate(values), np.concatenate(rows))
        n = b - a
        side = part["block"].to_numpy()
        blocks = int(part["blocks"][0].as_py())
        # pairs within a block are counted where it meets itself; with another block, of which nothing may be there, only pairs across
        cross = blocks > 1 and part["block"][0].as_py() != part["mate"][0].as_py()
        w = np.zeros(n, np.int64)
        own = weight[a:b]

        def counted(value=value, row=row, n=n, cross=cross, side=side, w=w, own=own) -> Iterator:  # noqa: ANN001
            for i, others in _links(value, row, n, similarity, side if cross else None):
                w[i] += own[others].sum()
                w[others] += own[i]
                yield i, others

        root, edges = _forest(counted(), n)
        ids = k[a:b]
        out += [(int(x), int(ids[r]) if blocks == 1 else None, int(c), blocks == 1) for x, r, c in zip(ids, root, w)]
        if blocks > 1:
            out += [(int(ids[i]), int(ids[j]), 0, False) for i, j in edges]
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64()), ("done", pa.bool_())]
    return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds)})


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, class_id, copy_id, n_links), a row per row of ``df``.

    Two documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of at least
    ``similarity``. ``n_links`` counts the other rows that a row is linked with; ``class_id`` is the smallest id that links
    lead to, ``copy_id`` the smallest id with an equal set. A text of fewer words, but some, has one shingle of
    all its words; one without words (null and empty texts too) is linked with none. A row with a null id
    has no links and a null class. Ids are whole numbers. Rows that share an id and a set count as two documents; rows that share an id only
    have the links of both.
    """
    rows = 4
    bands = bands_for(similarity, recall, rows)
    sig = checkpointed(signatures(df, id_col, text_col, words, bands, rows))
    classes = sig.where("n > 0 and k is not null").groupBy("hi", "lo", "n").agg(F.min("k").alias("rep"), F.count("*").alias("weight"), F.first("bands").alias("bands"))
    classes = checkpointed(classes)
    # the smaller side of each join below is written first: where both sides are plain shuffles, adaptive execution splits a hot key
    keyed = classes.select("rep", F.explode("bands").alias("h"))
    hubs = checkpointed(keyed.groupBy("h").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1").select("h", "hub"))
    edges = keyed.join(hubs, "h").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = connected_components(edges).withColumnRenamed("root", "cluster")
    known = checkpointed(classes.join(clusters, classes["rep"] == clusters["node"]).select("rep", "weight", "hi", "lo", "n", "cluster"))
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("shingles") / block_shingles)).cast("int")
    sizes = checkpointed(known.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).select("cluster", "m", "shingles", blocks.alias("blocks")))
    small = sizes.where("blocks = 1").agg(F.coalesce(F.sum("shingles"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    groups = max(1, -(-small[0] // block_shingles), -(-small[1] // block))
    # an id may stand for several sets: the text of a class is found by id, its set checked by identity
    members = known.join(sizes, "cluster").select("rep", "weight", "hi", "lo", "cluster", "blocks")
    texts = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).where("k is not null")
    found = texts.join(members, texts["k"] == members["rep"]).select("k", "t", "weight", "hi", "lo", "cluster", "blocks")
    found = _same_set(found, words)
    found = found.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    # blocks of a large cluster meet two by two; small clusters share groups
    mates = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    found = found.withColumn("mate", F.explode(mates))
    pair = F.xxhash64("cluster", F.least("block", "mate"), F.greatest("block", "mate"))
    found = found.withColumn("grp", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(pair))
    verified = found.groupBy("grp").applyInArrow(lambda t: compare(t, words, similarity), "a long, b long, w long, done boolean")
    verified = checkpointed(verified)
    linked = verified.groupBy("a").agg(F.sum("w").alias("w"), F.max(F.when(F.col("done"), F.col("b"))).alias("root"))
    roots = connected_components(verified.where("not done and b is not null").select("a", "b"))
    linked = linked.join(roots, linked["a"] == roots["node"], "left").select("a", "w", F.coalesce(roots["root"], linked["root"]).alias("root"))
    result = classes.join(linked, classes["rep"] == linked["a"], "left").select("hi", "lo", "n", "rep", (F.col("weight") - 1 + F.coalesce("w", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("class_id"))
    own = F.col("k").isNotNull() & (F.col("n") > 0)
    found = sig.where(own).select("k", "hi", "lo", "n").join(checkpointed(result), ["hi", "lo", "n"], "left")
    alone = sig.where(~own).select(F.col("k").alias(id_col), F.col("k").alias("class_id"), F.col("k").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return found.select(F.col("k").alias(id_col), "class_id", F.col("rep").alias("copy_id"), F.col("links").cast("long").alias("n_links")).unionByName(alone)


def _same_set(found: DataFrame, words: int) -> DataFrame:
    """Rows whose text has the class's set, one for each id and set."""
    columns = found.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi = np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in chunks(batch.column(1)):
                value, row = unique_sets(*shingles(Words(data, offsets), words))
                if len(value):
                    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    hi[first + row[heads]] = np.add.reduceat(mix(value), heads).view(np.int64)
            good = np.flatnonzero(hi == batch.column(3).to_numpy())
            _, first = np.unique(np.stack([batch.column(0).to_numpy()[good], hi[good]]), axis=1, return_index=True)  # repeated rows go once
            yield batch.take(pa.array(good[np.sort(first)]))

    return found.mapInArrow(run, kinds).select(*columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: class_id, copy_id, n_links."""
    arrow_batches(spark)
    return join(docs_table(spark, sf_dir))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y, c = a.n AND c = b.n AS equal FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8::DOUBLE * (a.n + b.n - c) - 1e-9::DOUBLE),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
own AS (SELECT x, count(*) AS n_links, min(CASE WHEN equal THEN y END) AS copy FROM links GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) AS class_id, least(d.doc_id, coalesce(copy, d.doc_id)) AS copy_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN classes c ON d.doc_id = c.x LEFT JOIN own o ON d.doc_id = o.x
"""
