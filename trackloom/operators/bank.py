"""Operators on an identity bank: quality gate, retrieval with competitors, ranking, admission, coverage, diverse choice.

Entries: exemplar_id, object_id, merged (aliases, may be null), episode_id, camera, bank_status, embedding (unit vector).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import boxes
from trackloom.operators.cells import Cells, matrix
from trackloom.operators.tables import written

#: Queries and entries of a task, and entries that a query meets at first.
QUERY_BLOCK, ENTRY_BLOCK, FIRST = 1024, 4096, 4096
LISTS = ("p_same", "p_all", "c_same", "c_all")


def quality_reason(excluded: Column, visible: Column, object_id: Column, area: Column, least_side: Column) -> Column:
    """The first reason for which a label is no exemplar, null for none."""
    return (
        F.when(F.coalesce(excluded, F.lit(False)), "ignored_reference").when(~F.coalesce(visible, F.lit(False)), "not_visible")
        .when(object_id == 1000, "derived_union_not_identity").when((area < 128) | (least_side < 8), "too_small_for_identity_embedding")
    )


def compatible(object_id: Column, merged: Column, wanted: Column) -> Column:
    """Whether an entry stands for an object: by its aliases if it has any, else by its own id."""
    own = F.when(merged.isNull() | (F.size(merged) == 0), F.array(object_id)).otherwise(merged)
    return F.array_contains(own, wanted)


def candidates(queries: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """Per query the numbers of its object's entries of its camera (n_same) and of all (n_all) and of competitors of its camera (m_same), the k
    most similar of each side, of the camera or of all: p_same, p_all, c_same, c_all, arrays of (sim, exemplar_id, object_id), ties by exemplar_id, and
    the number of entries that it was compared with (compared).

    Active entries of other episodes count, those without an embedding don't. The entries are cut into cells around coarse centres. A query first meets the cells that may hold
    the most similar entries, then those of which the bound says that they may still change one of its lists: for its own object's lists cells that hold entries of
    the object. So the lists are exact, however few cells are met. A task multiplies blocks of queries and entries and keeps k entries a query, side and
    scope, so pairs are never rows. A query without entries has no row.
    """
    bank = bank.where("bank_status = 'active' AND embedding IS NOT NULL").select("exemplar_id", "object_id", F.col("merged").cast("array<long>").alias("merged"), "episode_id", "camera", "embedding")
    queries = queries.select("query_id", "q_object_id", "q_episode_id", "q_camera", "q_embedding")
    cells, held = Cells.of(bank, "exemplar_id", "embedding")
    sides = _sides(queries, held)
    asked = _visits(queries, cells, lambda x, _: cells.first(x, FIRST))
    met = _met(asked, held, cells, k)
    if cells.size.sum() > FIRST:  # else every cell has been met
        met = written(met)
        lists = queries.join(met, "query_id").join(sides, "query_id")
        short = [(t, c, F.element_at(c, -1)["sim"]) for t, c in zip(("n_same", "n_all", "m_same", "m_all"), LISTS)]
        reach = [F.when(F.col(t) > F.size(c), F.when(F.size(c) == k, last).otherwise(F.lit(-np.inf))) for t, c, last in short]
        where = held.select(F.explode(_aliases()).alias("q_object_id"), "cell").groupBy("q_object_id").agg(F.collect_set("cell").alias("cells"))
        more = lists.select(*queries.columns, F.least(*reach[:2]).alias("own"), F.least(*reach[2:]).alias("other")).where("own IS NOT NULL OR other IS NOT NULL").join(where, "q_object_id", "left")

        def rest(x: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
            bounds, out = cells.bounds(x) + 2e-6, []  # products are rounded to six places
            limits = zip(cells.first(x, FIRST), bounds, *(batch.column(name).to_pylist() for name in ("own", "other", "cells")))
            for seen, bound, own, other, there in limits:
                go = np.zeros(len(bound), bool)
                if other is not None:
                    go |= bound >= other
                if own is not None and there:
                    go[there] |= bound[there] >= own
                go[seen] = False
                out.append(np.flatnonzero(go & np.isfinite(bound)))
            return out

        met = met.unionByName(_met(_visits(more, cells, rest), held, cells, k))
        met = met.groupBy("query_id").agg(F.sum("compared").alias("compared"), *[_best(name, k) for name in LISTS])
    return sides.where("n_all + m_all > 0").drop("m_all").join(met, "query_id")


def _aliases() -> Column:
    """The objects that an entry stands for."""
    return F.when(F.col("merged").isNull() | (F.size("merged") == 0), F.array(F.col("object_id").cast("long"))).otherwise(F.array_distinct("merged"))


def _sides(queries: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, n_same, n_all, m_same, m_all): entries of other episodes, of the query's object or not, in its camera or in all.

    Entries are counted by object, camera and episode; what a query's own episode has is taken off. Nulls are equal.
    """
    own = held.select(F.explode(_aliases()).alias("object"), "camera", "episode_id")
    keys = {"object": "q_object_id", "camera": "q_camera", "episode_id": "q_episode_id"}
    out = queries.select("query_id", *keys.values())
    counts = {}
    for rows, groups in ((own, (["object"], ["object", "episode_id"], ["object", "camera"], ["object", "camera", "episode_id"])), (held, (["camera"], ["camera", "episode_id"], ["episode_id"]))):
        for group in groups:
            name = "_".join(["n", *group])
            found = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in group]).agg(F.count("*").alias(name))
            on = [F.col(keys[c]).eqNullSafe(F.col(f"__{c}")) for c in group]
            out = out.join(found, on, "left").drop(*[f"__{c}" for c in group])
            counts[tuple(group)] = F.coalesce(name, F.lit(0))
    total = out.join(held.agg(F.count("*").alias("total")).hint("broadcast"))
    n_all, n_same = counts["object",] - counts["object", "episode_id"], counts["object", "camera"] - counts["object", "camera", "episode_id"]
    return total.select(
        "query_id", n_same.alias("n_same"), n_all.alias("n_all"), (counts["camera",] - counts["camera", "episode_id"] - n_same).alias("m_same"),
        (F.col("total") - counts["episode_id",] - n_all).alias("m_all"))


def _visits(queries: DataFrame, cells: Cells, chosen: Callable[[np.ndarray, pa.RecordBatch], list[np.ndarray]]) -> DataFrame:
    """A row for each query and cell that it visits."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    at = queries.columns.index("q_embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = chosen(matrix(batch.column(at)), batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tolist() for c in own], pa.list_(pa.int32()))], names=[*batch.schema.names, "visits"])

    out = queries.where("q_embedding IS NOT NULL").mapInArrow(run, f"{kinds}, visits array<int>")
    return out.select("query_id", "q_object_id", "q_episode_id", "q_camera", "q_embedding", F.explode("visits").alias("cell"))


def _met(asked: DataFrame, held: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, compared, p_same, p_all, c_same, c_all) of the visits to cells, which are cut into blocks of entries and parts of queries."""
    spark = held.sparkSession
    visitors = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = [(i, max(1, -(-int(n) // ENTRY_BLOCK)), max(1, -(-visitors.get(i, 0) // QUERY_BLOCK))) for i, n in enumerate(cells.size) if i in visitors]
    sizes = spark.createDataFrame(sizes, "cell int, blocks int, parts int").hint("broadcast")  # a row a cell

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        x = df.join(sizes, "cell")
        return x.withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("blocks", "parts")

    by = ["cell", "block", "part"]
    item = "array<struct<sim: double, exemplar_id: long, object_id: long>>"
    blocks = dealt(asked, "query_id", "part", "block").groupBy(*by).cogroup(dealt(held, "exemplar_id", "block", "part").groupBy(*by))
    found = blocks.applyInArrow(lambda left, right: _compared(left, right, k), "query_id long, compared long, " + ", ".join(f"{c} {item}" for c in LISTS))
    return found.groupBy("query_id").agg(F.sum("compared").alias("compared"), *[_best(name, k) for name in LISTS])


def _compared(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """A block of queries against a block of entries."""
    out: dict[str, list] = {name: [] for name in ("query_id", "compared", *LISTS)}
    if len(left) and len(right):
        right = right.sort_by("exemplar_id")
        v, u = (matrix(t[c].combine_chunks()) for t, c in ((left, "q_embedding"), (right, "embedding")))
        sim = np.round(v @ u.T, 6)

        def equal(a: str, b: str) -> np.ndarray:
            x, y = left[a].to_pylist(), right[b].to_pylist()
            number = {value: i for i, value in enumerate({*x, *y})}
            return np.array([number[i] for i in x])[:, None] == np.array([number[i] for i in y])

        other = ~equal("q_episode_id", "episode_id")
        positive = equal("q_object_id", "object_id")
        wanted = left["q_object_id"].to_numpy()
        for j, merged in enumerate(right["merged"].to_pylist()):
            if merged:
                positive[:, j] = np.isin(wanted, merged)
        same = equal("q_camera", "camera")
        masks = {"p_same": positive & same & other, "p_all": positive & other, "c_same": ~positive & same & other, "c_all": ~positive & other}
        rows, ids, objects = np.arange(len(sim)), right["exemplar_id"].to_pylist(), right["object_id"].to_pylist()
        for name, mask in masks.items():
            left_ = np.where(mask, sim, -np.inf)
            best: list[list] = [[] for _ in rows]
            for _ in range(k):
                at = left_.argmax(axis=1)
                value = left_[rows, at]
                for i in np.flatnonzero(value > -np.inf):
                    best[i].append({"sim": float(value[i]), "exemplar_id": ids[at[i]], "object_id": objects[at[i]]})
                left_[rows, at] = -np.inf
            out[name] = best
        out["query_id"], out["compared"] = left["query_id"].to_pylist(), [len(right)] * len(left)
    item = pa.list_(pa.struct([("sim", pa.float64()), ("exemplar_id", pa.int64()), ("object_id", pa.int64())]))
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "compared": pa.array(out["compared"], pa.int64()), **{c: pa.array(out[c], item) for c in LISTS}})


def _best(name: str, k: int) -> Column:
    """The k best of the blocks' lists."""
    first = F.transform(F.flatten(F.collect_list(name)), lambda e: F.struct((-e["sim"]).alias("s"), e["exemplar_id"].alias("exemplar_id"), e["object_id"].alias("object_id")))
    return F.transform(F.slice(F.sort_array(first), 1, k), lambda e: F.struct((-e["s"]).alias("sim"), e["exemplar_id"].alias("exemplar_id"), e["object_id"].alias("object_id"))).alias(name)


def top(queries: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """(query_id, exemplar_id, sim, place) of the k most similar entries of each query's object, in all cameras."""
    bank = bank.withColumn("merged", F.col("merged") if "merged" in bank.columns else F.lit(None).cast("array<long>"))
    return candidates(queries, bank, k).select("query_id", F.posexplode("p_all").alias("place", "e")).select("query_id", "e.exemplar_id", "e.sim", (F.col("place") + 1).alias("place"))


def retrieve(queries: DataFrame, bank: DataFrame, k: int = 3, same_camera: bool = True) -> DataFrame:
    """One row a query: status, similarity, margin over the best competitor, nearest exemplars, camera scope, references.

    The query's own episode is left out. Entries of the query's camera are preferred, separately for its object and for
    competitors; where there are none, all cameras count. Margin is null without a competitor.
    """
    bank = bank.withColumn("merged", F.col("merged") if "merged" in bank.columns else F.lit(None).cast("array<long>"))
    x = queries.select("query_id").join(candidates(queries, bank, k), "query_id", "left")
    own = (F.col("n_same") > 0) if same_camera else F.lit(False)
    other = (F.col("m_same") > 0) if same_camera else F.lit(False)
    near = F.when(own, F.col("p_same")).otherwise(F.col("p_all"))
    rival = F.try_element_at(F.when(other, F.col("c_same")).otherwise(F.col("c_all")), F.lit(1))
    first = F.try_element_at(near, F.lit(1))
    there = F.coalesce(F.col("n_all") > 0, F.lit(False))
    return x.select(
        "query_id", F.when(there, "retrieved").otherwise("no_reference").alias("status"), F.when(there, first["sim"]).alias("similarity"), F.when(there, F.round(first["sim"] - rival["sim"], 6)).alias("margin"),
        F.when(there, F.array_join(F.transform(near, lambda e: e["exemplar_id"].cast("string")), ",")).alias("nearest"), F.when(there, rival["object_id"]).alias("competitor_id"),
        F.when(~there, "none").when(own, "same_camera").otherwise("cross_camera_fallback").alias("camera_scope"), F.coalesce(F.when(own, F.col("n_same")).otherwise(F.col("n_all")), F.lit(0)).alias("references"))


def ranked(candidates: DataFrame, keys: list[str], score: Column, threshold: Column, eligible_first: bool = False) -> DataFrame:
    """The winner of each group by score, ties by candidate_id. The threshold is applied after ranking, or before if eligible candidates come first."""
    x = candidates.withColumn("score", score)
    if eligible_first:
        x = x.where(threshold)
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "candidate_id")
    x = x.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return x if eligible_first else x.where(threshold)


def admission(similarity: Column, margin: Column, mask_iou: Column, collision: Column, gap: Column, agreement: Column, candidate: Column) -> Column:
    """The first reason that keeps a candidate out, or admitted."""
    return (
        F.when(~candidate, "no_candidate").when(similarity.isNull() | margin.isNull(), "no_identity_reference").when((similarity < 0.50) | (margin < 0.05), "identity_evidence_low")
        .when(mask_iou < 0.80, "sam_boundary_confidence_low").when(F.coalesce(collision, F.lit(False)), "cross_identity_collision").when(gap.isNull() | (gap > 15), "await_second_observation")
        .when(F.coalesce(agreement, F.lit(0.0)) < 0.30, "short_window_disagreement").otherwise("admitted")
    )


def coverage(bank: DataFrame, objects: DataFrame, cameras: DataFrame, target: int = 3) -> DataFrame:
    """Active exemplars and distinct episodes of every object and camera, and whether the target is met, sparse or missing."""
    active = bank.where("bank_status = 'active'").groupBy("object_id", "camera").agg(F.count("*").alias("exemplars"), F.count_distinct("episode_id").alias("episodes"))
    x = objects.join(cameras.hint("broadcast")).join(active, ["object_id", "camera"], "left").fillna(0, ["exemplars", "episodes"])
    return x.withColumn("state", F.when(F.col("exemplars") >= target, "target_met").when(F.col("exemplars") > 0, "sparse").otherwise("missing"))


def shared_groups(rows: DataFrame, training: Column, evaluation: Column, group: str) -> DataFrame:
    """(group, training, evaluation): groups of which both splits have rows, such as episodes; disjoint splits share none."""
    out = rows.groupBy(group).agg(F.count_if(training).alias("training"), F.count_if(evaluation).alias("evaluation"))
    return out.where("training > 0 AND evaluation > 0")


def curated(bank: DataFrame, decisions: DataFrame) -> DataFrame:
    """The bank with reviewed exemplars (exemplar_id, reason, tags) excluded from retrieval; tags are taken over."""
    x = bank.join(decisions, "exemplar_id", "left")
    return x.withColumn("bank_status", F.when(F.col("reason").isNotNull(), "retrieval_excluded").otherwise(F.col("bank_status")))


def diverse(bank: DataFrame, keys: list[str], limit: int = 6, gap: int = 30) -> DataFrame:
    """(keys, exemplar_id, place) of up to ``limit`` entries a group, one by one: from the episode used least, the least similar to those chosen,
    the larger mask, the earlier.

    Entries nearer than ``gap`` frames to a chosen one of their episode are left out. The order of choice decides, so each choice is an
    aggregate over all groups, which takes the entries chosen before, ``limit`` a group, along; no task holds a group.
    """
    item = F.struct("exemplar_id", "episode_id", "frame_idx", F.col("embedding").alias("v"))
    entries = bank.select(*keys, "exemplar_id", "episode_id", "frame_idx", F.least("mask_area", F.lit(50_000)).alias("area"), "embedding")
    empty = F.filter(F.array(item), lambda x: F.lit(False))
    chosen = None
    for _ in range(limit):
        x = entries.withColumn("chosen", empty) if chosen is None else entries.join(chosen, keys)
        free = F.forall("chosen", lambda c: (c["exemplar_id"] != F.col("exemplar_id")) & ((c["episode_id"] != F.col("episode_id")) | (F.abs(c["frame_idx"] - F.col("frame_idx")) >= gap)))
        used = F.size(F.filter("chosen", lambda c: c["episode_id"] == F.col("episode_id")))
        nearest = F.array_max(F.transform("chosen", lambda c: boxes.cosine(F.col("embedding"), c["v"])))
        rank = F.struct((-used).alias("used"), F.coalesce(1 - nearest, F.lit(0.0)).alias("far"), "area", (-F.col("exemplar_id")).alias("early"))
        next_ = F.max_by(F.when(free, item), F.when(free, rank))
        found = x.groupBy(*keys).agg(F.first("chosen").alias("before"), next_.alias("next"))
        chosen = found.select(*keys, F.when(F.col("next").isNull(), F.col("before")).otherwise(F.concat("before", F.array("next"))).alias("chosen"))
    return chosen.select(*keys, F.posexplode("chosen").alias("place", "c")).select(*keys, "c.exemplar_id", (F.col("place") + 1).alias("place"))


def ordinals(chosen: DataFrame, order: list[str], prefix: str = "SB") -> DataFrame:
    """Adds a name of a prefix and a running number over all rows in order.

    Groups of the first column, such as objects, are counted first, and rows are numbered within them; only the counts, a row a group, pass one task.
    """
    group = order[0]
    sizes = chosen.groupBy(group).agg(F.count("*").alias("__n"))
    before = sizes.select(group, (F.sum("__n").over(W.orderBy(group).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    n = F.row_number().over(W.partitionBy(group).orderBy(*order))
    own = before.withColumnRenamed(group, "__g")
    return chosen.withColumn("__i", n).join(own, F.col(group).eqNullSafe(F.col("__g"))).withColumn("ordinal", F.format_string(prefix + "%04d", F.col("__before") + F.col("__i") - 1)).drop("__i", "__g", "__before")


def batches_of(path_rows: DataFrame, encoder: object) -> DataFrame:
    """The plug point of an encoder: ``encoder(list of rows) -> list of vectors`` is called on Arrow batches of rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            vectors = encoder(b.to_pylist())  # type: ignore[operator]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in path_rows.schema)
    return path_rows.mapInArrow(run, f"{kinds}, embedding array<float>")
