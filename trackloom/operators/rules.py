"""Smaller rules of seeds, labels and backends, as operators of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import boxes

BOX = ("x0", "y0", "x1", "y1")


def confirmed(df: DataFrame, keys: list[str], period: int, least: float, order: str = "frame_idx") -> DataFrame:
    """Adds confirmed: whether the observation before, at most ``period`` frames back, has a box of at least the IoU ``least``.

    A seed that waits for a second observation, and a pending candidate, are confirmed by this rule. The first observation of a key isn't.
    """
    w = W.partitionBy(*keys).orderBy(order)
    x = df.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in (order, *BOX)])
    near = F.coalesce(F.col(order) - F.col(f"p_{order}") <= period, F.lit(False))
    return x.withColumn("confirmed", near & F.coalesce(boxes.iou(boxes.box("p_"), boxes.box()) >= least, F.lit(False))).drop(*[f"p_{c}" for c in (order, *BOX)])


def prompt_valid(points: Column, labels: Column, box: Column, width: int, height: int) -> Column:
    """Whether points with labels 0 or 1, one of them 1 at least, and a box may prompt a mask: all of them inside the image, as many labels as points, a box that isn't inverted."""
    inside = F.forall(points, lambda p: (p[0] >= 0) & (p[0] < width) & (p[1] >= 0) & (p[1] < height))
    marked = F.forall(labels, lambda v: v.isin(0, 1)) & F.exists(labels, lambda v: v == 1) & (F.size(labels) == F.size(points))
    real = (box[0] >= 0) & (box[1] >= 0) & (box[0] < box[2]) & (box[1] < box[3]) & (box[2] <= width) & (box[3] <= height)
    return F.coalesce(inside & marked & real, F.lit(False))


def within(frame: Column, spans: list[tuple[int, int]]) -> Column:
    """Whether a frame lies in one of some intervals, ends included."""
    out = F.lit(False)
    for a, b in spans:
        out = out | frame.between(a, b)
    return F.coalesce(out, F.lit(False))


def scene_visibility(frame: Column, scenes: list[tuple[str, list[tuple[int, int]]]]) -> Column:
    """The first of some states whose intervals hold the frame, else unknown."""
    out = None
    for state, spans in scenes:
        out = F.when(within(frame, spans), state) if out is None else out.when(within(frame, spans), state)
    return F.lit("unknown") if out is None else out.otherwise("unknown")


def assembled(samples: DataFrame, refined: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, source, visibility, confidence): a sample's (key, visibility, iou) proposal from refinement (key, refined) where there is one, else half the IoU of its scene."""
    own = refined.select(F.col(key).alias("__k"), "refined")
    x = samples.join(own, F.col(key) == F.col("__k"), "left")
    source = F.when(F.col("refined").isNotNull(), "refined").when(F.col("visibility") == "unknown", "none").otherwise("scene")
    value = F.when(F.col("refined").isNotNull(), F.col("refined")).when(F.col("visibility") != "unknown", F.round(F.col("iou") / 2, 6))
    return x.select(key, source.alias("source"), "visibility", value.alias("confidence"))


def isolated(rows: DataFrame, evaluation: Column, group: str) -> DataFrame:
    """Rows of groups, such as clips, of which no row is held for evaluation."""
    held = rows.where(evaluation).select(F.col(group).alias("__g")).distinct()
    return rows.join(held, F.col(group).eqNullSafe(F.col("__g")), "left_anti")


def scored_and_excluded(rows: DataFrame, keys: list[str], excluded: Column) -> DataFrame:
    """(keys, scored, excluded): rows that count in a metric, and those left out; a null condition leaves none out."""
    out = F.coalesce(excluded, F.lit(False))
    return rows.groupBy(*keys).agg(F.count_if(~out).alias("scored"), F.count_if(out).alias("excluded"))


def label_origins(rows: DataFrame, visibility: str, assisted: Column) -> DataFrame:
    """(visibility, origin, labels) of imported labels."""
    return rows.groupBy(visibility, F.when(assisted, "assisted").otherwise("manual").alias("origin")).agg(F.count("*").alias("labels"))


def event_counts(events: DataFrame, keys: list[str], action: str = "action") -> DataFrame:
    """(keys, action, n) of rows with an action."""
    return events.where(F.col(action).isNotNull()).groupBy(*keys, action).agg(F.count("*").alias("n"))


def repeated_times(rows: DataFrame, key: str, time: Column, order: list[str]) -> DataFrame:
    """(key, samples, repeated): samples whose time is that of the one before."""
    x = rows.withColumn("__same", time == F.lag(time).over(W.partitionBy(key).orderBy(*order)))
    return x.groupBy(key).agg(F.count("*").alias("samples"), F.count_if("__same").alias("repeated"))


#: Fixed places in a robot's state: seven joints of each arm and a gripper, numbered from 1.
ARMS, JOINTS, GRIPPERS = {"left_arm": 8, "right_arm": 16}, 7, {"left_gripper": 15, "right_gripper": 23}


def joint_motion(states: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """(key, left_arm, right_arm, left_gripper, right_gripper): how far the joints of each arm move in all, and the span of each gripper."""
    x = states.withColumn("__p", F.lag(state).over(W.partitionBy(key).orderBy(order)))

    def moved(first: int) -> Column:
        both = F.zip_with(F.slice(state, first, JOINTS), F.slice("__p", first, JOINTS), lambda a, b: F.abs(a - b))
        return F.round(F.sum(F.aggregate(both, F.lit(0.0), lambda s, d: s + d)), 5)

    def span(k: int) -> Column:
        return F.round(F.max(F.element_at(state, k)) - F.min(F.element_at(state, k)), 5)

    return x.groupBy(key).agg(*[moved(k).alias(n) for n, k in ARMS.items()], *[span(k).alias(n) for n, k in GRIPPERS.items()])


def compared_backends(a: DataFrame, b: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(group, frames, agree, unmatched) of two backends' results (key, group, value): a frame of only one is unmatched; nulls agree with nothing."""
    x = a.select(F.col(key).alias("ka"), F.col(group).alias("ga"), F.col(value).alias("va"))
    y = b.select(F.col(key).alias("kb"), F.col(group).alias("gb"), F.col(value).alias("vb"))
    both = x.join(y, F.col("ka") == F.col("kb"), "full").withColumn(group, F.coalesce("ga", "gb"))
    return both.groupBy(group).agg(F.count("*").alias("frames"), F.count_if(F.col("va") == F.col("vb")).alias("agree"), F.count_if(F.col("ka").isNull() | F.col("kb").isNull()).alias("unmatched"))
