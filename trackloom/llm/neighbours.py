"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells. Two vectors of a cosine at least the threshold differ by at most
a certain distance, and a vector must move some way in either half to come into another cell; the squares of both ways add up. A vector visits the cells
in order of that sum, as the two sorted sequences of ways give them, up to a bound at which the target recall is reached for pairs that just
reach the threshold. What it meets in the cells is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.bytesops import flat
from trackloom.llm.common import checkpointed, table
from trackloom.llm.graph import connected_components

SIMILARITY = 0.95
#: Share of pairs at just SIMILARITY, in random directions, that the index finds, and how much oftener one in the direction of another vector
#: may be missed. More similar pairs are found more often. A share of 1 visits all cells that may hold one.
RECALL, ALIKE = 0.999, 10
#: Different vectors that the codebooks and the bound are fitted to, those of the smallest hashes.
SAMPLE = 20_000
#: Vectors a cell by which the codebooks are sized, least and most entries of a codebook.
CELL, LEAST_CODES, MOST_CODES = 4096, 4, 1024
#: Entries and queries that a task compares, and queries at once.
ENTRIES, QUERIES, TILE = 8192, 16384, 512
TRIALS = 100_000


def usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their components) of the vectors that have a direction: not null, of ``dims`` finite components, not all zero. Other kinds of numbers become doubles."""
    if column.type.value_type != pa.float32():
        column = column.cast(pa.list_(pa.float64()))
    at = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dims) if dims > 0 else np.zeros(0, np.int64)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    x = values.reshape(len(at), max(dims, 1))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good] + x.dtype.type(0)


def unit_vectors(column: pa.Array, dims: int, single: bool) -> np.ndarray:
    """The unit vectors, in double precision, of components as bytes."""
    data, _ = flat(column)
    x = data.view(np.float32 if single else np.float64).reshape(len(column), dims).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def codebook(x: np.ndarray, codes: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centres of x after some rounds of Lloyd's iteration; an empty one takes the vector that is farthest from its centre."""
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[np.arange(codes) % len(x)]].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(x[i : i + 4096], c) for i in range(0, len(x), 4096)])
        own = near.argmin(1)
        count = np.bincount(own, minlength=codes)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[count > 0] = sums[count > 0] / count[count > 0, None]
        far = np.argsort(-near[np.arange(len(x)), own], kind="stable")
        empty = np.flatnonzero(count == 0)
        c[empty] = x[far[np.arange(len(empty)) % len(x)]]
    return c


class MultiIndex:
    """The grid over both halves and the bound on the ways of a visit."""

    def __init__(self, sample: np.ndarray, codes: int, similarity: float = SIMILARITY, recall: float = RECALL) -> None:
        self.codes, self.half = codes, max(sample.shape[1] // 2, 1)
        self.books = [codebook(h, codes) if h.shape[1] else np.zeros((codes, 0)) for h in self._halves(sample)]
        self.apart = [np.sqrt(_squares(c, c)) for c in self.books]
        #: no pair of the threshold is farther apart than this
        self.bound = 2 - 2 * similarity + 1e-9
        if recall < 1:
            self.bound = min(self.bound, self._fitted(sample, similarity, recall))

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def ways(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(cell, [squared way to each centre's region in the half, for both halves])."""
        cell, out = np.zeros(len(x), np.int64), []
        for h, c, apart in zip(self._halves(x), self.books, self.apart):
            near = _squares(h, c)
            own = near.argmin(1)
            between = apart[own]
            way = np.divide(near - near[np.arange(len(x)), own][:, None], 2 * between, out=np.zeros_like(near), where=between > 0)
            out.append(way * way)
            cell = cell * self.codes + own
        return cell, out

    def way_to(self, ways: list[np.ndarray], cell: np.ndarray) -> np.ndarray:
        i = np.arange(len(cell))
        return ways[0][i, cell // self.codes] + ways[1][i, cell % self.codes]

    def _fitted(self, sample: np.ndarray, similarity: float, recall: float) -> float:
        """The bound that finds this share of partners of just the threshold's similarity, each from the end with the smaller cell.

        Partners lie in random directions, and in those of other vectors, along which cells are cut; of the latter ``ALIKE`` times as many may be missed.
        The greater of both bounds counts.
        """
        r, step = np.random.default_rng(12), max(1, min(len(sample), 4096))
        found: tuple[list, list] = ([], [])
        for i in range(0, TRIALS, step):
            x = sample[np.arange(i, i + step) % len(sample)]
            for kind, z in enumerate((r.standard_normal(x.shape), sample[r.integers(0, len(sample), len(x))])):
                z = z - (z * x).sum(1, keepdims=True) * x
                norm = np.sqrt((z * z).sum(1, keepdims=True))
                y = similarity * x + np.sqrt(1 - similarity**2) * np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-9)
                (cx, wx), (cy, wy) = self.ways(x), self.ways(y)
                found[kind].append(np.where(cx <= cy, self.way_to(wx, cy), self.way_to(wy, cx))[norm[:, 0] > 1e-9])
        shares = recall, max(0.0, 1 - ALIKE * (1 - recall))
        return max((float(np.quantile(np.concatenate(f), q, method="higher")) for f, q in zip(found, shares) if sum(map(len, f))), default=0.0)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell of each vector, row, cell): the own cell and the cells after it that a vector visits, in order of the ways' sum.

        Both sequences of ways are sorted; for each place in the first, the places in the second that stay within the bound are a prefix that
        shrinks as the first goes on, so that only cells within the bound are formed. A pair of cells is visited from the smaller one alone.
        """
        cell, ways = self.ways(x)
        order = [w.argsort(1, kind="stable") for w in ways]
        one, two = (np.take_along_axis(w, o, 1) for w, o in zip(ways, order))
        rows, cells, sums = [], [], []
        for i in range(self.codes):
            left = self.bound - one[:, i]
            live = np.flatnonzero(left >= 0)
            if not len(live):
                break
            n = (two[live] <= left[live, None]).sum(1)
            row = np.repeat(live, n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            rows.append(row)
            cells.append(order[0][row, i] * self.codes + order[1][row, j])
            sums.append(one[row, i] + two[row, j])
        row, to, way = np.concatenate(rows), np.concatenate(cells), np.concatenate(sums)
        keep = to > cell[row]
        row, to, way = row[keep], to[keep], way[keep]
        first = np.lexsort((way, row))
        return cell, row[first], to[first]


def _forest(labels: np.ndarray, i: int, others: np.ndarray) -> list[int]:
    """Nodes among ``others`` of which an edge to i joins parts that weren't joined; their labels become one."""
    known, at = np.unique(labels[others], return_index=True)
    new = known != labels[i]
    if new.any():
        labels[np.isin(labels, known)] = labels[i]
    return others[at[new]].tolist()


def compare(group: pa.Table, similarity: float, dims: int, single: bool) -> pa.Table:
    """The links of a block of a cell's entries with each other (in the group's first chunk) and with the queries that came for it.

    Rows (a, b, w): w counts the vectors that class a is linked with here, b is a neighbour in a forest of the links.
    """
    group = group.combine_chunks()
    k, weight, asks = (group[c].to_numpy(zero_copy_only=False) for c in ("k", "weight", "asks"))
    vectors = unit_vectors(group["u"].chunk(0), dims, single)
    entries = np.flatnonzero(~asks)
    entries = entries[np.argsort(k[entries], kind="stable")]
    queries = np.flatnonzero(asks)
    e, own = vectors[entries], weight[entries].astype(float)
    total, labels, edges = np.zeros(len(k)), np.arange(len(k)), []
    inside = len(entries) > 0 and group["chunk"][0].as_py() == 0
    for rows in ([entries] if inside else []) + [queries]:
        for t in range(0, len(rows), TILE):
            some = rows[t : t + TILE]
            hit = vectors[some] @ e.T >= similarity
            if rows is entries:
                hit &= np.arange(len(entries)) > np.arange(t, t + len(some))[:, None]
            total[some] += hit @ own
            total[entries] += weight[some].astype(float) @ hit
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                edges += [(int(k[some[i]]), int(k[j])) for j in _forest(labels, some[i], entries[np.flatnonzero(hit[i])])]
    linked = np.flatnonzero(total)
    a = np.concatenate([k[linked], np.array([x for x, _ in edges], np.int64)])
    b = pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array([y for _, y in edges], pa.int64())])
    return pa.table({"a": pa.array(a, pa.int64()), "b": b, "w": pa.array(np.concatenate([total[linked].astype(np.int64), np.zeros(len(edges), np.int64)]))})


def _usable(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(k, u): u holds the components as bytes, null where there is no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1), dims)
            out = np.full(batch.num_rows, None, object)
            for i, v in zip(at.tolist(), x):
                out[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["k", "u"])

    src = df.select(F.col(id_col).cast("long").alias("k"), F.col(vec_col).alias("v"))
    return src.mapInArrow(run, "k long, u binary")


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL, sample: int = SAMPLE, cell: int = CELL,
    entries: int = ENTRIES, queries: int = QUERIES,
) -> DataFrame:
    """(id, n_links, component_id), a row per row of ``df``.

    Two vectors are linked if their cosine, in double precision, is at least ``similarity``, and if the index finds them. ``n_links`` counts the other vectors that
    one is linked with directly, ``component_id`` is the smallest id that links lead to, its own included. A vector that is null, empty, all zero, or
    holds a null or infinite component or no number, has no links; nor has one of another length than most of the table's vectors. A row with a null id has no
    links and a null component. Equal vectors are one class and are always linked. Rows that share id and vector count as two; rows that share an id only
    have the links of both. Ids are whole numbers.
    """
    length = df.where(f"`{vec_col}` is not null and size(`{vec_col}`) > 0").groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = int(length["n"]) if length else 0
    single = df.schema[vec_col].dataType.elementType == T.FloatType()
    units = checkpointed(_usable(df, id_col, vec_col, dims))
    good = units.where("k is not null and u is not null")
    classes = checkpointed(good.groupBy("u").agg(F.min("k").alias("k"), F.count("*").alias("weight")))
    n = classes.count()
    if not n:
        return units.select(F.col("k").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    fitted = classes.select("u").orderBy(F.xxhash64("u"), "u").limit(sample).toArrow()["u"].combine_chunks()
    codes = min(max(int(np.ceil(np.sqrt(n / cell))), LEAST_CODES), MOST_CODES)
    index = MultiIndex(unit_vectors(fitted, dims, single), codes, similarity, recall)

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit_vectors(batch.column(0), dims, single)
            own, row, to = index.visits(x)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32()), pa.array(to))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), lists], names=["u", "k", "weight", "cell", "visits"])

    routed = checkpointed(classes.select("u", "k", "weight").mapInArrow(routes, "u binary, k long, weight long, cell long, visits array<long>"))
    # at most a row a cell, of which the codebooks bound the number
    members = routed.groupBy("cell").agg(F.count("*").alias("m"))
    visitors = routed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    sizes = members.join(visitors, "cell", "left").select(
        "cell", F.ceil(F.col("m") / entries).alias("blocks"), F.greatest(F.ceil((F.coalesce("q", F.lit(0)) + F.when(F.col("m") > entries, F.col("m")).otherwise(0)) / queries), F.lit(1)).alias("chunks"))
    sizes = F.broadcast(checkpointed(sizes))
    block, chunk = F.pmod(F.xxhash64("k", "u"), F.col("blocks")), F.pmod(F.xxhash64("u", "k"), F.col("chunks"))
    at_home = routed.join(sizes, "cell").select("u", "k", "weight", "cell", block.alias("block"), "blocks", "chunks")
    stay = at_home.select("u", "k", "weight", "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"))
    # the own cell's other blocks are asked from the smaller block
    later = at_home.where("block + 1 < blocks").select("u", "k", "weight", "cell", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(True).alias("asks"))
    away = routed.select("u", "k", "weight", F.explode("visits").alias("cell")).join(sizes, "cell")
    away = away.select("u", "k", "weight", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(True).alias("asks"))
    met = stay.unionByName(later).unionByName(away).groupBy("cell", "block", "chunk").applyInArrow(lambda t: compare(t, similarity, dims, single), "a long, b long, w long")
    met = checkpointed(met)
    linked = met.groupBy("a").agg(F.sum("w").alias("w"))
    roots = connected_components(met.where("b is not null").select("a", "b"))
    result = classes.join(linked, classes["k"] == linked["a"], "left").join(roots, classes["k"] == roots["node"], "left")
    result = checkpointed(result.select("u", (F.col("weight") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("root", "k").alias("component_id")))
    found = good.join(result, "u").select(F.col("k").alias(id_col), "n_links", "component_id")
    alone = units.where("k is null or u is null").select(F.col("k").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return found.unionByName(alone)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: n_links, component_id, kept."""
    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP12_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
own AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(own.n, 0) AS n_links, least(v.vec_id, coalesce(low.y, v.vec_id)) AS component_id, v.vec_id <= coalesce(low.y, v.vec_id) AS kept
FROM v LEFT JOIN low ON v.vec_id = low.x LEFT JOIN own ON v.vec_id = own.x
"""
