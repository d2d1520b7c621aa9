"""Interval operators: nearest seeds, events as of a frame, exclusions, repairs and proofs that other rows are untouched."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.sequences import ordered_fold


def seed_intervals(seeds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seed_frame, start, end): the frames nearest to each seed; the middle goes to the earlier seed. Open ends are null."""
    w = W.partitionBy(*keys).orderBy("seed_frame")
    x = seeds.select(*keys, "seed_frame").distinct()
    before, after = F.lag("seed_frame").over(w), F.lead("seed_frame").over(w)
    half = lambda a, b: F.floor((a + b) / 2).cast("long")
    return x.withColumn("start", half(before, F.col("seed_frame")) + 1).withColumn("end", half(F.col("seed_frame"), after))


def nearest_seed(frames: DataFrame, seeds: DataFrame, keys: list[str], tag: Column | None = None) -> DataFrame:
    """Each frame with its nearest seed's frame; null if its key has no seed. One sort of frames and seeds together, no range join.

    The last seed before and the first one after are carried along the frames of a key; ties go to the earlier.
    """
    columns = frames.columns
    both = frames.withColumn("__s", F.lit(None).cast("long")).unionByName(seeds.select(*keys, F.col("seed_frame").alias("frame_idx"), F.col("seed_frame").cast("long").alias("__s")).distinct(), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("frame_idx").rangeBetween(W.unboundedPreceding, 0)
    v = W.partitionBy(*keys).orderBy(F.desc("frame_idx")).rangeBetween(W.unboundedPreceding, 0)  # running, as a frame to the end would be summed anew for every row
    x = both.withColumn("b", F.max("__s").over(w)).withColumn("a", F.min("__s").over(v)).where("__s IS NULL")
    near = F.when(F.col("a").isNull() | (F.col("frame_idx") - F.col("b") <= F.col("a") - F.col("frame_idx")), F.col("b")).otherwise(F.col("a"))
    return x.select(*columns, near.alias("seed_frame"))


def as_of(frames: DataFrame, events: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each frame with the latest event at or before it: its frame (event_frame) and ``values``; nulls before the first.

    Frames and events are sorted together once; of events at one frame the last by ``values`` counts.
    """
    columns = frames.columns
    e = F.struct(F.col("frame_idx").alias("event_frame"), *values)
    last = events.groupBy(*keys, "frame_idx").agg(F.max(e).alias("__e"))
    both = frames.withColumn("__f", F.lit(1)).unionByName(last.withColumn("__f", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("frame_idx").rangeBetween(W.unboundedPreceding, 0)
    x = both.withColumn("__l", F.max("__e").over(w)).where("__f = 1")
    return x.select(*columns, "__l.event_frame", *[F.col(f"__l.{v}").alias(v) for v in values])


def segments(exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_idx, reason): where the first exclusion by ordinal that holds a frame changes; a null reason where none does.

    Exclusions (keys, start, end, reason, ordinal) are streamed by start; those that hold the current frame are on a heap.
    """

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        heap: list[tuple] = []
        at, key = None, {}
        for r in chain(rows, [None]):
            stop = math.inf if r is None else r["start"]
            while at is not None and at < stop:
                while heap and heap[0][2] < at:
                    heapq.heappop(heap)
                yield {**key, "frame_idx": at, "reason": heap[0][1] if heap else None}
                at = min(heap[0][2] + 1, stop) if heap else None
            if r is not None:
                key = {k: r[k] for k in keys}
                heapq.heappush(heap, (r["ordinal"], r["reason"], r["end"]))
                at = r["start"]

    real = exclusions.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "start", "end"]) + " AND `start` <= `end`")
    rows = real.select(*keys, F.col("start").cast("long"), F.col("end").cast("long"), "reason", F.col("ordinal").cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return ordered_fold(rows, keys, ["start", "ordinal"], fold, f"{kinds}, frame_idx long, reason string")


def excluded(rows: DataFrame, exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the reason of the first exclusion (keys, start, end, reason, ordinal) that holds their frame, null for none.

    Exclusions become segments that don't overlap, and a row takes the reason of the last one before it: one sort, no range join.
    """
    return as_of(rows, segments(exclusions, keys), keys, ["reason"]).drop("event_frame")


def repaired(rows: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Interval repair: from a prompt on, ``visible`` starts a new segment, any other status makes rows unknown until the next prompt.

    Adds segment_start and repaired_visibility: the row's own before the first prompt and within segments, else unknown.
    """
    x = as_of(rows, prompts, keys, ["status"])
    own = F.col("status").isNull() | (F.col("status") == "visible")
    return x.withColumn("segment_start", F.when(F.col("status") == "visible", F.col("event_frame"))).withColumn("repaired_visibility", F.when(own, F.col("visibility")).otherwise("unknown"))


def seams(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose visibility inside an edit (key, start, end) becomes unknown; ``touched`` tells which."""
    x = excluded(rows, edits.withColumn("reason", F.lit("seam")).withColumn("ordinal", F.lit(0)), keys)
    return x.withColumn("touched", F.col("reason").isNotNull()).withColumn("visibility", F.when(F.col("touched"), "unknown").otherwise(F.col("visibility"))).drop("reason")


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], allowed: DataFrame) -> DataFrame:
    """(keys, problem): rows added, lost, or changed in any column though their key isn't among those allowed. Nulls equal nulls."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        return df.select(*keys, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias(name))

    x = digest(before, "b").join(digest(after, "a"), keys, "full")
    problem = F.when(F.col("a").isNull(), "lost").when(F.col("b").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return x.select(*keys, problem.alias("problem")).where("problem IS NOT NULL").join(allowed.select(*keys).distinct(), keys, "left_anti")


def overlaid(parent: DataFrame, windows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The parent's rows with a repaired window's values where it has the key; a key written twice raises."""
    w = windows.groupBy(*keys).agg(F.count("*").alias("__c"), *[F.first(v).alias(f"w_{v}") for v in values])
    x = parent.join(w, keys, "left")
    note = F.concat(F.lit("written twice: "), F.to_json(F.struct(*keys)))
    x = x.where(F.when(F.col("__c") > 1, F.raise_error(note).cast("boolean")).otherwise(True))
    there = F.col("__c").isNotNull()
    for v in values:
        x = x.withColumn(v, F.when(there, F.col(f"w_{v}")).otherwise(F.col(v)))
    return x.drop("__c", *[f"w_{v}" for v in values])


def differing_before(first: DataFrame, other: DataFrame, bounds: DataFrame, keys: list[str], order: str = "frame_idx", ignored: str = "mode") -> DataFrame:
    """Rows of ``first`` before their key's bound (``second``) that ``other`` doesn't have just so, the column ``ignored`` apart."""
    early = lambda df: df.drop(ignored).join(bounds.select(*keys, "second"), keys).where(F.col(order) < F.col("second")).drop("second")
    return early(first).exceptAll(early(other).select(*early(first).columns))


def release(rows: DataFrame) -> DataFrame:
    """The release decision of a row (interval_reason, seed, visible, has_pixels, object_id, and review flags absent, exclude, allow, incomplete).

    Adds decision, in this order: interval_unknown, reviewed_absent unless a seed shows the object, unreliable_excluded, eligible, unresolved, kept;
    and unresolved: whether the object leaves the frame's background unknown.
    """
    visible = F.coalesce("visible", F.lit(False))
    positive, negative = F.col("seed") & visible, F.col("seed") & F.coalesce(~F.col("visible"), F.lit(False))
    usable = F.col("allow") & visible & F.col("has_pixels")
    base = F.col("object_id") < 1000
    open_ = base & ~F.col("absent") & ~negative
    decision = (
        F.when(F.col("interval_reason").isNotNull(), "interval_unknown").when(F.col("absent") & ~positive, "reviewed_absent").when(F.col("exclude"), "unreliable_excluded")
        .when(usable, "eligible").when(F.col("allow") & visible, "unresolved").when(open_, "unresolved").otherwise("kept")
    )
    x = rows.withColumn("decision", decision)
    left = F.when(F.col("decision").isin("interval_unknown", "unreliable_excluded"), base).otherwise(F.col("decision") == "unresolved") | F.col("incomplete")
    return x.withColumn("unresolved", left).withColumn("training_eligible", F.col("decision") == "eligible")


def contradictions(seeds: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): accepted positives that a release hides, and accepted negatives that it shows; the latter must be unknown."""
    x = seeds.select(*keys, F.col("visible").alias("seed_visible")).join(rows.select(*keys, "visible"), keys, "left")
    problem = F.when(F.col("seed_visible") & ~F.coalesce("visible", F.lit(False)), "accepted positive changed").when(~F.col("seed_visible") & F.coalesce("visible", F.lit(False)), "accepted negative discrepancy")
    return x.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def missing_and_extra(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem) of keys that only one side has, each as often as it has it more."""
    e, f = expected.select(*keys), found.select(*keys)
    return e.exceptAll(f).withColumn("problem", F.lit("missing")).unionByName(f.exceptAll(e).withColumn("problem", F.lit("extra")))
