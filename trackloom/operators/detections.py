"""Operators on boxes detected in frames: thresholds, best of a class, ambiguity, collisions, motion.

A frame's key is (episode_id, camera, frame_idx); orders go by frame_idx, never by time. Rows with a null confidence
pass no threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import boxes
from trackloom.operators import stats
from trackloom.operators.tables import remove, shared_dir, written

FRAME = ["episode_id", "camera", "frame_idx"]
STREAM = ["episode_id", "camera"]
BOX = ["x0", "y0", "x1", "y1"]
SWEEP = (0.2, 0.25, 0.3, 0.35, 0.4)
#: Suppression: boxes of a group above which all tasks thin it, and in how many rounds at most; rows of a block, and its rounds over all groups at once.
CROWD, THINNING, BLOCK, ROUNDS = 100_000, 12, 50_000, 64


def at_least(df: DataFrame, floor: float = 0.15, threshold: float = 0.30) -> DataFrame:
    """Detections whose confidence reaches the threshold, which isn't below the floor."""
    if floor > threshold:
        raise ValueError("the floor is above the threshold")
    return df.where(F.col("confidence") >= threshold)


def sweep(df: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Each detection once for every threshold that it reaches; one pass, no join."""
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("confidence") >= t)
    return df.withColumn("threshold", F.explode(reached))


def best(df: DataFrame, ties: list[str]) -> DataFrame:
    """The most confident detection of each object and frame, with the runner-up's confidence and the number of hits."""
    w = W.partitionBy(*FRAME, "object_id")
    o = w.orderBy(F.desc("confidence"), *ties)
    out = df.withColumn("place", F.row_number().over(o)).withColumn("second_confidence", F.lead("confidence").over(o)).withColumn("hits", F.count("*").over(w))
    return out.where("place = 1").drop("place")


def settle(best_: DataFrame, margin: float = 0.06) -> DataFrame:
    """Adds ``reason``: ambiguous where the runner-up is nearer than the margin, else null."""
    close = F.col("confidence") - F.col("second_confidence") < margin
    return best_.withColumn("reason", F.when(close, "ambiguous_multiple_instances"))


def collisions(chosen: DataFrame, rule: str = "overlap") -> DataFrame:
    """(frame, object_id) of objects whose boxes collide with another class in their frame; both sides are named.

    ``overlap``: more than 0.70 of the smaller box. ``identical``: IoU over 0.80, objects 17, 22 and 23 exempt among
    themselves. The self-join is bounded by the frame.
    """
    a, b = chosen.alias("a"), chosen.alias("b")
    pair = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in FRAME] + [F.col("a.object_id") < F.col("b.object_id")])
    left, right = boxes.box("a."), boxes.box("b.")
    if rule == "overlap":
        pair = pair.where(boxes.overlap_smaller(left, right) > 0.70)
    else:
        family = [17, 22, 23]
        pair = pair.where((boxes.iou(left, right) > 0.80) & ~(F.col("a.object_id").isin(family) & F.col("b.object_id").isin(family)))
    named = pair.select(*[F.col(f"a.{k}") for k in FRAME], F.explode(F.array("a.object_id", "b.object_id")).alias("object_id"))
    return named.distinct()


def choose(best_: DataFrame, threshold: float = 0.40, margin: float = 0.06, rule: str = "overlap") -> DataFrame:
    """Best detections with the reason why they are rejected, null for those chosen. Ambiguity is judged before collisions."""
    settled = settle(best_.where(F.col("confidence") >= threshold), margin)
    hit = collisions(settled.where("reason IS NULL"), rule).withColumn("collided", F.lit(True))
    name = "cross_class_box_collision" if rule == "overlap" else "near_identical_cross_class_boxes"
    out = settled.join(hit, [*FRAME, "object_id"], "left")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("collided"), name))).drop("collided")


def skeleton(frames: DataFrame, objects: DataFrame, found: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Every frame with every object of its task, and what was found of it: nulls where nothing was.

    ``objects`` (task_id, object_id) is a small dimension; frames of a task meet its objects only.
    """
    dense = frames.join(objects, "task_id")
    return dense.join(found, on or [*FRAME, "object_id"], "left")


def temporal(dense: DataFrame, width: int = 640, height: int = 360) -> DataFrame:
    """Motion of each object between consecutive processed frames, from dense rows with nullable boxes.

    Adds previous_frame_idx, frame_gap, iou, center_jump, area_ratio, and flags; a stream's first frame has no row.
    """
    w = W.partitionBy(*STREAM, "object_id").orderBy("frame_idx")
    for c in ("frame_idx", "x0", "y0", "x1", "y1"):
        dense = dense.withColumn(f"p_{c}", F.lag(c).over(w))
    dense = dense.where("p_frame_idx IS NOT NULL")
    both = F.col("x0").isNotNull() & F.col("p_x0").isNotNull()
    for name, value in boxes.motion(boxes.box("p_"), boxes.box(), width, height).items():
        dense = dense.withColumn(name, F.when(both, value))
    flags = {
        "low_iou": F.coalesce(F.col("iou") < 0.05, F.lit(False)),
        "center_jumped": F.coalesce(F.col("center_jump") > 0.15, F.lit(False)),
        "area_jumped": F.coalesce(F.col("area_ratio") > 3, F.lit(False)),
        "disappeared": F.col("p_x0").isNotNull() & F.col("x0").isNull(),
        "reappeared": F.col("p_x0").isNull() & F.col("x0").isNotNull(),
    }
    for name, value in flags.items():
        dense = dense.withColumn(name, value)
    some = F.lit(False)
    for name in flags:
        some = some | F.col(name)
    return dense.withColumn("suspicious", some).withColumn("frame_gap", F.col("frame_idx") - F.col("p_frame_idx")).withColumnRenamed("p_frame_idx", "previous_frame_idx")


def by_threshold(frames: DataFrame, objects: DataFrame, detections: DataFrame, ties: list[str], thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Dense rows with ``levels``: for every threshold the number of hits that reach it.

    The best detection is the same at every threshold that it reaches, so it is picked once.
    """
    w = W.partitionBy(*FRAME, "object_id").orderBy(F.desc("confidence"), *ties)
    counts = [F.sum((F.col("confidence") >= t).cast("int")).over(W.partitionBy(*FRAME, "object_id")).alias(f"n{k}") for k, t in enumerate(thresholds)]
    top = detections.select(*FRAME, "object_id", "confidence", "x0", "y0", "x1", "y1", F.row_number().over(w).alias("place"), *counts).where("place = 1").drop("place")
    levels = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"n{k}"), F.lit(0)).alias("hits")) for k, t in enumerate(thresholds)])
    return skeleton(frames, objects, top).withColumn("levels", levels).drop(*[f"n{k}" for k in range(len(thresholds))])


def rollup(dense: DataFrame, width: int = 640, height: int = 360) -> DataFrame:
    """By task, camera, object and threshold: frames, detections, transitions, flags, their shares, and medians and 95th percentiles of IoU, centre jump, area ratio and score."""
    w = W.partitionBy(*STREAM, "object_id").orderBy("frame_idx")
    for c in ("confidence", "x0", "y0", "x1", "y1"):
        dense = dense.withColumn(f"p_{c}", F.lag(c).over(w))
    # rows are multiplied by thresholds after the sort, on their way into the aggregate
    dense = dense.withColumn("later", F.row_number().over(w) > 1).select("*", F.inline("levels"))
    now, before = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False)), F.coalesce(F.col("p_confidence") >= F.col("threshold"), F.lit(False))
    m = {k: F.when(now & before & F.col("later"), v) for k, v in boxes.motion(boxes.box("p_"), boxes.box(), width, height).items()}
    flags = {
        "low_iou": m["iou"] < 0.05,
        "center_jumped": m["center_jump"] > 0.15,
        "area_jumped": m["area_ratio"] > 3,
        "disappeared": F.col("later") & before & ~now,
        "reappeared": F.col("later") & ~before & now,
    }
    dense = dense.select("task_id", "camera", "object_id", "threshold", "hits", "later", now.alias("found"), F.when(now, F.col("confidence")).alias("score"), *[v.alias(k) for k, v in m.items()], *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])
    some = F.lit(False)
    for name in flags:
        some = some | F.col(name)

    def count(c: Column) -> Column:
        return F.sum(c.cast("long"))

    out = dense.withColumn("suspicious", some).groupBy("task_id", "camera", "object_id", "threshold").agg(
        F.count("*").alias("frames"), count(F.col("found")).alias("detected_frames"), count(F.col("hits") > 1).alias("multi_frames"), count(F.col("later")).alias("transitions"),
        *[count(F.col(k)).alias(k) for k in [*flags, "suspicious"]],
    )
    keys = ["task_id", "camera", "object_id", "threshold"]
    spread = stats.quantiles(dense, keys, {"iou": F.col("iou"), "jump": F.col("center_jump"), "ratio": F.col("area_ratio"), "score": F.col("score")}, {"median": 0.5, "p95": 0.95})
    out = stats.joined(out, spread.select(*keys, *[F.round(c, 6).alias(c) for c in spread.columns if c not in keys]), keys)
    return out.withColumn("detected_share", F.round(F.col("detected_frames") / F.col("frames"), 6)).withColumn("suspicious_share", F.round(F.col("suspicious") / F.greatest(F.lit(1), "transitions"), 6))


def invalid(df: DataFrame, width: int, height: int, floor: float) -> DataFrame:
    """Detections that no consumer may take: boxes outside the image, inverted or not finite, confidences outside [floor, 1]."""
    finite = F.lit(True)
    for c in ("x0", "y0", "x1", "y1", "confidence"):
        v = F.col(c)
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & (F.col("x1") <= width) & (F.col("y1") <= height)
    return df.where(~F.coalesce(finite & inside & F.col("confidence").between(floor, 1), F.lit(False)))


def absent(frames: DataFrame, objects: DataFrame, found: DataFrame) -> DataFrame:
    """(frame, object_id) of the task's objects that no detection shows; not detected is not invisible."""
    return frames.join(objects, "task_id").join(found.select(*FRAME, "object_id").distinct(), [*FRAME, "object_id"], "left_anti").select(*FRAME, "object_id")


def supported(keyframes: DataFrame, period: int = 10, least_iou: float = 0.15, strong: float = 0.55) -> DataFrame:
    """Adds ``supported``: another keyframe within period + 1 has the object at IoU ``least_iou``, or the confidence is strong.

    The self-join is bounded: keyframes meet those of their own or a neighbouring bucket of frames.
    """
    size = period + 1
    a = keyframes.withColumn("bucket", F.floor(F.col("frame_idx") / size))
    b = a.select(*STREAM, "object_id", F.col("frame_idx").alias("o_frame"), *[F.col(k).alias(f"o_{k}") for k in ("x0", "y0", "x1", "y1")], F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    near = a.join(b, [*STREAM, "object_id", "bucket"]).where((F.col("frame_idx") != F.col("o_frame")) & (F.abs(F.col("frame_idx") - F.col("o_frame")) <= size))
    near = near.where(boxes.iou(boxes.box(), boxes.box("o_")) >= least_iou).select(*FRAME, "object_id").distinct().withColumn("near", F.lit(True))
    out = keyframes.join(near, [*FRAME, "object_id"], "left")
    return out.withColumn("supported", F.coalesce("near", F.lit(False)) | (F.col("confidence") >= strong)).drop("near")


def misses(dense: DataFrame, found: Column) -> DataFrame:
    """Adds ``misses``: frames since the object was last found in its stream, itself not counted; 0 where it is found."""
    w = W.partitionBy(*STREAM, "object_id").orderBy("frame_idx")
    island = F.sum(found.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    dense = dense.withColumn("island", island)
    own = W.partitionBy(*STREAM, "object_id", "island").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)
    return dense.withColumn("misses", F.sum((~found).cast("int")).over(own).cast("long")).drop("island")


def suppress(df: DataFrame, keys: list[str], ties: list[str], iou: float = 0.5, most: int | None = None, strict: bool = False) -> DataFrame:
    """Greedy suppression within a group: by falling confidence a box stays if it overlaps no kept box by ``iou`` or more (over ``iou`` if strict); ``most`` boxes stay.

    Groups are boxes of one class in one frame, of any number; equal confidences go by ``ties``, then by the box. Pairs of boxes are never written: a group streams through a task in its
    order and meets the boxes kept so far. A group of more than CROWD boxes is thinned by rounds of all tasks first, each of which keeps the boxes that come first in all their cells of a
    grid and drops what they overlap; only what many rounds leave, such as a long chain of boxes each of which overlaps the next, streams through one task. Both give the result of the
    greedy order. Boxes without an extent overlap nothing. ``iou`` is positive.
    """
    if not iou > 0:
        raise ValueError("an overlap above 0")
    columns = [*keys, "confidence", *ties, *BOX]
    order = [F.desc_nulls_first("confidence"), *[F.asc_nulls_first(c) for c in [*ties, *BOX]]]
    rows = df.select(*columns)
    crowds = written(rows.groupBy(*keys).count().where(F.col("count") > CROWD).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias("__g")))
    if crowds.isEmpty():
        return _streamed(rows, keys, order, iou, most, strict)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    few = _streamed(rows.join(F.broadcast(crowds), same, "left_anti"), keys, order, iou, most, strict)
    many = rows.join(F.broadcast(crowds), same).select("__g", *columns)
    many = written(many.orderBy("__g", *order).withColumn("__n", F.monotonically_increasing_id()))
    kept, left = _thinned(many, iou, strict)
    kept = kept.unionByName(_streamed(left, ["__g"], [F.col("__n")], iou, None, strict).select("__n"))
    flat = many.where(~_real()).select("__n")
    kept = many.join(kept.unionByName(flat).withColumnRenamed("__n", "__kept"), F.col("__n") == F.col("__kept"), "left_semi")
    if most is not None:
        kept = kept.withColumn("__m", F.row_number().over(W.partitionBy("__g").orderBy("__n"))).where(F.col("__m") <= most)
    return few.unionByName(kept.select(*columns))


def _side() -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def _real() -> Column:
    """Whether a box has an extent, and a finite one."""
    return F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (_side() < float("inf")) & ~F.isnan(_side()), F.lit(False))


def _levels(iou: float) -> int:
    """Sides of boxes that overlap by ``iou`` differ at most by 1 / iou, and so their levels, the powers of two next above, by this."""
    return math.ceil(math.log2(1 / min(iou, 1.0))) + 1


def _streamed(rows: DataFrame, keys: list[str], order: list[Column], iou: float, most: int | None, strict: bool) -> DataFrame:
    """The rows that stay; each group streams through a task in its order, and its kept boxes are held there."""
    placed = rows.withColumn("__first", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Suppression(iou, most, strict)
        for table in _blocks(batches):
            boxes_ = [table[c].cast(pa.float64()).to_numpy() for c in BOX]
            keep = state.feed(table["__first"].to_numpy(), boxes_)
            yield from table.select(names).take(pa.array(keep)).to_batches()

    return placed.mapInArrow(run, rows.schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to BLOCK rows and more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class Suppression:
    """Greedy suppression of groups of boxes that come one after the other, each in its order.

    In a block of rows, the first undecided box of every group is kept and what it overlaps goes, for all groups at once. After ROUNDS of that, the boxes still undecided
    meet the kept ones in a grid, one by one. A group that goes on in the next block takes its kept boxes along.
    """

    def __init__(self, iou: float, most: int | None, strict: bool) -> None:
        self.iou, self.strict, self.most, self.up = iou, strict, most, _levels(iou)
        self.carried, self.count = [np.zeros(0)] * 4, 0

    def hits(self, a: list, b: list) -> np.ndarray:
        """Whether boxes with an extent overlap enough; a share that isn't a number is the largest, as in SQL."""
        inter = np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        share = np.divide(inter, union, out=np.zeros_like(inter), where=union != 0)
        return ~(share <= self.iou) if self.strict else ~(share < self.iou)

    def feed(self, first: np.ndarray, box: list[np.ndarray]) -> np.ndarray:
        """Indices of a block's rows that stay; ``first`` marks where a group begins."""
        with np.errstate(all="ignore"):
            return self._feed(first, box)

    def _feed(self, first: np.ndarray, box: list[np.ndarray]) -> np.ndarray:
        n, group = len(first), np.cumsum(first)  # group 0 goes on from the last block
        side = np.maximum(box[2] - box[0], box[3] - box[1])
        real = (box[2] > box[0]) & (box[3] > box[1]) & (side < np.inf)
        count = np.zeros(int(group[-1]) + 1, np.int64)
        count[0] = self.count
        kept, alive = np.zeros(n, bool), np.arange(n)
        ahead = int(np.searchsorted(group, 1))  # rows of the group that goes on
        late = np.zeros(0, np.int64)
        if self.most is not None and self.count >= self.most:
            alive = alive[ahead:]
        elif len(self.carried[0]) > ROUNDS:
            alive, late = alive[ahead:], alive[:ahead]
        else:
            for k in zip(*self.carried):
                own = alive[: np.searchsorted(alive, ahead)]
                hit = real[own] & self.hits([c[own] for c in box], list(k))
                alive = np.concatenate([own[~hit], alive[len(own):]])
        for _ in range(ROUNDS):
            if not len(alive):
                break
            mine = group[alive]
            head = np.diff(mine, prepend=-1) != 0
            top = alive[head]
            kept[top] = True
            count[group[top]] += 1
            above = top[np.cumsum(head) - 1]
            gone = real[alive] & real[above] & self.hits([c[alive] for c in box], [c[above] for c in box]) | head
            if self.most is not None:
                gone |= (count >= self.most)[mine]
            alive = alive[~gone]
        self._one_by_one(np.concatenate([late, alive]), group, box, real, side, kept, count)
        last = np.flatnonzero(kept & (group == group[-1]) & real)
        before = self.carried if group[-1] == 0 else [np.zeros(0)] * 4
        self.carried, self.count = [np.concatenate([b, c[last]]) for b, c in zip(before, box)], int(count[-1])
        return np.flatnonzero(kept)

    def _cells(self, box: list[float], level: int) -> list[tuple[int, int, int]]:
        s = 2.0**level
        return [(level, x, y) for x in range(math.floor(box[0] / s), math.floor(box[2] / s) + 1) for y in range(math.floor(box[1] / s), math.floor(box[3] / s) + 1)]

    def _one_by_one(self, rows: np.ndarray, group: np.ndarray, box: list[np.ndarray], real: np.ndarray, side: np.ndarray, kept: np.ndarray, count: np.ndarray) -> None:
        """Decides these rows, in order; they overlap no box that is kept already, but for those of the group that goes on, if these are many."""
        own, large, small = -1, {}, {}

        def enter(b: list[float], level: int) -> None:
            for cell in self._cells(b, level):
                large.setdefault(cell, []).append(b)
            for up in range(1, self.up + 1):
                for cell in self._cells(b, level + up):
                    small.setdefault(cell, []).append(b)

        for i in rows.tolist():
            g = int(group[i])
            if g != own:
                own, large, small = g, {}, {}
                if g == 0 and len(self.carried[0]) > ROUNDS:
                    for b in np.stack(self.carried, axis=1).tolist():
                        enter(b, _level(max(b[2] - b[0], b[3] - b[1])))
            if self.most is not None and count[g] >= self.most:
                continue
            if real[i]:
                b, level = [float(c[i]) for c in box], _level(float(side[i]))
                near = [k for up in range(self.up + 1) for cell in self._cells(b, level + up) for k in large.get(cell, ())]
                near += [k for cell in self._cells(b, level) for k in small.get(cell, ())]
                if near and self.hits(list(np.array(near).T), b).any():
                    continue
                enter(b, level)
            kept[i] = True
            count[g] += 1


def _level(side: float) -> int:
    """The least power of two that isn't below the side."""
    mantissa, power = math.frexp(side)
    return power - 1 if mantissa == 0.5 else power


def _laid(x: DataFrame, levels: Column) -> DataFrame:
    """Boxes (with their __level) in the cells that they cover at these levels, at most two by two of a level: __at, __x and __y."""
    x = x.withColumn("__at", F.explode(levels)).withColumn("__s", F.pow(F.lit(2.0), F.col("__at")))
    for axis in ("x", "y"):
        x = x.withColumn(f"__{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}0") / F.col("__s")), F.floor(F.col(f"{axis}1") / F.col("__s")))))
    return x.drop("__s")


def _thinned(rows: DataFrame, iou: float, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(__n of boxes that stay, boxes still undecided) of groups __g in the order of __n; undecided boxes overlap none that stays.

    A box is laid into cells of its own level and of those above, up to that of the largest box that it may overlap enough, and meets larger boxes in their cells. What comes before all
    that it meets there is kept. Only cells' first boxes are candidates, so that a crowded cell is one row of an aggregate.
    """
    up, cell = _levels(iou), ["__g", "__at", "__x", "__y"]
    spark = rows.sparkSession
    all_levels, own_level = F.sequence(F.col("__level"), F.col("__level") + up), F.array("__level")
    alive = rows.where(_real()).select("__g", "__n", *BOX, F.ceil(F.log2(_side())).cast("int").alias("__level"))
    kept, before = None, None
    for _ in range(THINNING):
        small = _laid(alive, all_levels)
        cells = shared_dir(spark)
        small.groupBy(*cell).agg(F.min("__n").alias("__all"), F.min(F.when(F.col("__level") == F.col("__at"), F.col("__n"))).alias("__large")).write.parquet(cells)
        firsts = spark.read.parquet(cells)
        some = firsts.select(F.col("__large").alias("__c")).where("__c IS NOT NULL").distinct()
        asked = _laid(alive.join(some, F.col("__n") == F.col("__c"), "left_semi"), all_levels).join(firsts, cell)
        ahead = F.when(F.col("__level") == F.col("__at"), F.col("__n") == F.col("__all")).otherwise(F.col("__large").isNull() | (F.col("__n") < F.col("__large")))
        top = written(asked.groupBy("__n").agg(F.bool_and(ahead).alias("ok")).where("ok").select(F.col("__n").alias("__top")).join(alive, F.col("__top") == F.col("__n")).drop("__top"))
        remove(spark, cells)
        kept = top.select("__n") if kept is None else kept.unionByName(top.select("__n"))
        drop = _met(_laid(top, all_levels), _laid(alive, own_level), iou, strict).unionByName(_met(_laid(top, own_level), small, iou, strict)).unionByName(top.select(F.col("__n").alias("__drop")))
        folder = shared_dir(spark)
        alive.join(drop.distinct(), F.col("__n") == F.col("__drop"), "left_anti").write.parquet(folder)
        alive = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
        if alive.groupBy("__g").count().where(F.col("count") > CROWD).isEmpty():
            break
    return kept, alive.select("__g", "__n", *BOX)


def _met(top: DataFrame, laid: DataFrame, iou: float, strict: bool) -> DataFrame:
    """(__drop): boxes that come after a kept one of their cell and overlap it enough."""
    t = top.select(*[F.col(c).alias(f"q_{c}") for c in ("__g", "__at", "__x", "__y", "__n", *BOX)])
    value = boxes.iou(boxes.box(), boxes.box("q_"))
    on = [F.col(c) == F.col(f"q_{c}") for c in ("__g", "__at", "__x", "__y")]
    return laid.join(t, on).where((F.col("__n") > F.col("q___n")) & (value > iou if strict else value >= iou)).select(F.col("__n").alias("__drop"))
