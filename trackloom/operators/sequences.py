"""Operators on ordered sequences of frames: chunks, islands, cooldowns, spaced choices, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackloom.operators.tables import written

#: Rows of a fold's output in a batch.
FOLD_ROWS = 5000
STREAM = ["episode_id", "camera"]


def chunk(frames: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """Adds chunk and shared: every frame once in its chunk, and a chunk's last frame once more as the next one's shared first."""
    keys = keys or STREAM
    w = W.partitionBy(*keys).orderBy("frame_idx")
    n = F.row_number().over(w) - 1
    numbered = frames.withColumn("chunk", F.floor(n / size).cast("long")).withColumn("__n", n).withColumn("__last", F.lead("frame_idx").over(w).isNull())
    ends = (F.col("__n") % size == size - 1) & ~F.col("__last")
    copies = F.when(ends, F.array(F.struct(F.col("chunk").alias("c"), F.lit(False).alias("s")), F.struct((F.col("chunk") + 1).alias("c"), F.lit(True).alias("s"))))
    copies = copies.otherwise(F.array(F.struct(F.col("chunk").alias("c"), F.lit(False).alias("s"))))
    return numbered.withColumn("__x", F.explode(copies)).withColumn("chunk", F.col("__x.c")).withColumn("shared", F.col("__x.s")).drop("__x", "__n", "__last")


def keyframes(frames: DataFrame, size: int, period: int, keys: list[str] | None = None) -> DataFrame:
    """Adds keyframe: every ``period``-th frame of a chunk, and the chunk's last."""
    keys = keys or STREAM
    n = F.row_number().over(W.partitionBy(*keys).orderBy("frame_idx")) - 1
    out = frames.withColumn("__n", n).withColumn("__c", F.floor(F.col("__n") / size))
    last = F.max("frame_idx").over(W.partitionBy(*keys, "__c")) == F.col("frame_idx")
    return out.withColumn("keyframe", (F.col("__n") % size % period == 0) | last).drop("__n", "__c")


def islands(df: DataFrame, keys: list[str], order: str, inside: Column, gap: int) -> DataFrame:
    """Adds island: a number for each run of rows that are inside and follow each other at just ``gap``; null outside."""
    w = W.partitionBy(*keys).orderBy(order)
    out = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    breaks = ~F.coalesce(F.lag("__in").over(w), F.lit(False)) | ~F.coalesce(F.col(order) - F.lag(order).over(w) == gap, F.lit(False))
    out = out.withColumn("__b", F.when(F.col("__in") & breaks, 1).otherwise(0))
    number = F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("island", F.when(F.col("__in"), number)).drop("__in", "__b")


def cooldown(df: DataFrame, keys: list[str], frame: str, wait: int) -> DataFrame:
    """(keys, frame) of rows that come ``wait`` frames or more after the last one kept; the first of a key is kept.

    What counts is the last row kept, not the last row. Each frame points to the first one that could be kept after it; those kept are what the first
    frame reaches. Pointers are doubled: with those that lead 1, 2, 4, ... steps on, the frames reached so far reach as many again, in as many
    rounds of joins as the longest chain's length has binary digits, whatever streams a key has. Equal frames count once, a null frame is left out, nulls among keys are equal. ``wait`` is positive.
    """
    if wait < 1:
        raise ValueError("a wait below 1")
    frames = df.where(F.col(frame).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(frame).cast("long").alias("__f")).distinct()
    own = [f"__k{i}" for i in range(len(keys))]
    jumps = written(_next_after(frames, own, wait))
    reached = written(frames.groupBy(*own).agg(F.min("__f").alias("__f")))
    while True:
        met = jumps.select(*[F.col(k).alias(f"{k}_") for k in own], F.col("__f").alias("__at"), F.col("__to"))
        on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in own]
        more = written(reached.join(met, [*on, F.col("__f") == F.col("__at")]).select(*own, F.col("__to").alias("__f")))
        if more.isEmpty():
            return reached.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.col("__f").alias(frame))
        reached = reached.unionByName(more)
        jumps = written(jumps.join(met.withColumnRenamed("__to", "__on"), [*on, F.col("__to") == F.col("__at")]).select(*own, "__f", F.col("__on").alias("__to")))


def _next_after(frames: DataFrame, keys: list[str], wait: int) -> DataFrame:
    """(keys, __f, __to): the first frame ``wait`` or more after each, where there is one.

    Frames lie in cells of ``wait`` frames. The next one is in the cell after the own one, where it is the first that is late enough, or it is the first of
    the next cell that has any; so rows are ordered within cells, and only a row a cell is ordered along a key.
    """
    cell = F.floor(F.col("__f") / wait).cast("long")
    x = frames.withColumn("__c", cell)
    firsts = x.groupBy(*keys, "__c").agg(F.min("__f").alias("__first"))
    along = W.partitionBy(*keys).orderBy("__c")
    cells = firsts.select(*keys, "__c", F.lead("__c").over(along).alias("__c1"), F.lead("__first").over(along).alias("__f1"), F.lead("__first", 2).over(along).alias("__f2"))
    # frames of a cell, and what frames of the cell before ask for, in falling order: the last frame before a question is the answer
    asks = x.select(*keys, (F.col("__c") + 1).alias("__c"), (F.col("__f") + wait).alias("__pos"), F.col("__f"), F.lit(None).cast("long").alias("__there"))
    there = x.select(*keys, "__c", F.col("__f").alias("__pos"), F.lit(None).cast("long").alias("__f"), F.col("__f").alias("__there"))
    fall = W.partitionBy(*keys, "__c").orderBy(F.desc("__pos"), F.desc_nulls_last("__there")).rowsBetween(W.unboundedPreceding, 0)
    found = there.unionByName(asks).withColumn("__in", F.last("__there", ignorenulls=True).over(fall)).where("__f IS NOT NULL").withColumn("__c", F.col("__c") - 1)
    at = cells.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("__c").alias("__at"), "__c1", "__f1", "__f2")
    both = found.join(at, [*[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.col("__c") == F.col("__at")])
    beyond = F.when(F.col("__c1") == F.col("__c") + 1, F.col("__f2")).otherwise(F.col("__f1"))
    return both.select(*keys, "__f", F.coalesce("__in", beyond).alias("__to")).where("__to IS NOT NULL")


def spaced(df: DataFrame, keys: list[str], frame: str, rank: list[Column], gap: int = 60, most: int = 2) -> DataFrame:
    """(keys, frame) chosen greedily in the order of ``rank``, then of frames: a frame stays if it is ``gap`` from all kept, ``most`` at most.

    Each choice is an aggregate over all rows that are far enough from what was chosen before, ``most`` frames a key; nulls among keys are equal.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.where(F.col(frame).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c.alias(f"__r{i}") for i, c in enumerate(rank)], F.col(frame).cast("long").alias("__f"))
    item = F.struct(*[f"__r{i}" for i in range(len(rank))], "__f")
    chosen = rows.groupBy(*own).agg(F.array(F.min(item)["__f"]).alias("__kept"))
    for _ in range(most - 1):
        before = chosen.select(*[F.col(k).alias(f"{k}_") for k in own], "__kept")
        x = rows.join(before, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in own])
        free = F.forall("__kept", lambda f: F.abs(f - F.col("__f")) >= gap)
        found = x.groupBy(*own).agg(F.first("__kept").alias("__kept"), F.min(F.when(free, item))["__f"].alias("__next"))
        chosen = found.select(*own, F.when(F.col("__next").isNull(), F.col("__kept")).otherwise(F.concat("__kept", F.array("__next"))).alias("__kept"))
    return chosen.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.explode(F.slice("__kept", 1, most)).alias(frame))


def or_middle(chosen: DataFrame, frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Chosen frames, and the middle between first and last frame of each key that has none."""
    middle = frames.groupBy(*keys).agg(F.floor((F.min(frame) + F.max(frame)) / 2).cast("long").alias(frame))
    return chosen.select(*keys, frame).unionByName(middle.join(chosen.select(*keys).distinct(), keys, "left_anti"))


def bundle(df: DataFrame, keys: list[str], frame: str, span: int, context: int = 15, first: int = 0, last: int | None = None) -> DataFrame:
    """Requests in the same ``span`` frames as one bundle: all triggers kept, with ``context`` frames around, pending review."""
    out = df.groupBy(*keys, F.floor(F.col(frame) / span).cast("long").alias("bundle")).agg(
        F.count("*").alias("triggers"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.min(frame).alias("lo"), F.max(frame).alias("hi"))
    end = F.col("hi") + context if last is None else F.least(F.lit(last), F.col("hi") + context)
    return out.withColumn("start", F.greatest(F.lit(first), F.col("lo") - context)).withColumn("stop", end).withColumn("status", F.lit("pending")).drop("lo", "hi")


def evenly(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each group at evenly spaced places, the first and the last included; all rows of smaller groups."""
    w = W.partitionBy(*keys)
    out = df.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1)
    if k == 1:
        return out.where("__i = 0").drop("__n", "__i")
    # place i is chosen if it is the floor of j * (n - 1) / (k - 1) for some j
    j = F.ceil(F.col("__i") * (k - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    hit = (j < k) & (F.floor(j * (F.col("__n") - 1) / (k - 1)) == F.col("__i"))
    return out.where((F.col("__n") <= k) | hit).drop("__n", "__i")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterator[dict]], schema: StructType | str) -> DataFrame:
    """Folds each group's rows in order with a Python function of dicts; for rules whose state no window can hold.

    Groups are streamed through sorted partitions: a group's rows are never held at once, and many small groups share
    a batch. An empty table gives no rows.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        held: list[dict] = []
        for _, group in groupby(rows, key=lambda r: [r[k] for k in keys]):
            for row in fold(group):
                held.append(row)
                if len(held) >= FOLD_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)
                    held = []
        yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
