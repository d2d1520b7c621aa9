"""Operators on mask rows: (episode_id, camera, frame_idx, object_id, runs) with the image's height and width as arguments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import runs as R
from trackloom.operators.detections import FRAME, STREAM


def from_spans(spans: DataFrame, pixels: int) -> DataFrame:
    """Mask rows of span rows (key, s, e)."""
    return spans.groupBy(*FRAME, "object_id").agg(R.runs_of_spans(F.collect_list(F.struct("s", "e")), pixels).alias("runs"))


def described(masks: DataFrame, h: int) -> DataFrame:
    """Adds area, box (null if empty), visible and mask_status; an unknown mask has nulls and the status unknown."""
    out = masks.withColumn("b", R.mask_geometry("runs", F.lit(h)))
    out = out.select("*", F.col("b.area").alias("mask_area"), *[F.col(f"b.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")]).drop("b")
    status = F.when(F.col("runs").isNull(), "unknown").when(F.col("mask_area") == 0, "predicted_empty").otherwise("predicted")
    return out.withColumn("visible", F.col("mask_area") > 0).withColumn("mask_status", status)


def touching(a: str = "a.", b: str = "b.") -> Column:
    """Whether two boxes meet: a cheap test before masks are compared."""
    return (F.col(f"{a}x0") < F.col(f"{b}x1")) & (F.col(f"{b}x0") < F.col(f"{a}x1")) & (F.col(f"{a}y0") < F.col(f"{b}y1")) & (F.col(f"{b}y0") < F.col(f"{a}y1"))


def overlaps(described_: DataFrame, over: float) -> DataFrame:
    """(frame, i, j, inter, share) of objects i < j of a frame whose common pixels exceed a share of the smaller mask."""
    a, b = described_.alias("a"), described_.alias("b")
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in FRAME] + [F.col("a.object_id") < F.col("b.object_id")]).where(touching())
    pairs = pairs.withColumn("inter", R.mask_inter(F.col("a.runs"), F.col("b.runs")))
    share = F.col("inter") / F.least("a.mask_area", "b.mask_area")
    return pairs.select(*[F.col(f"a.{k}") for k in FRAME], F.col("a.object_id").alias("i"), F.col("b.object_id").alias("j"), "inter", share.alias("share")).where(F.col("share") > over)


def covered_by(described_: DataFrame, robot: int) -> DataFrame:
    """Adds robot_share: the part of an object's pixels that the robot's mask covers; null without a robot mask. A warning, no cut."""
    other = described_.where(F.col("object_id") == robot).select(*FRAME, F.col("runs").alias("robot_runs"))
    out = described_.where(F.col("object_id") != robot).join(other, FRAME, "left")
    return out.withColumn("robot_share", R.mask_inter("runs", "robot_runs") / F.nullif("mask_area", F.lit(0))).drop("robot_runs")


@dataclass(frozen=True)
class Limits:
    """When a mask's change between frames is flagged; equality never flags."""

    iou: float = 0.05
    ratio: float = 3.0
    overlap: float = 0.30
    jump: float = 0.15
    robot: float = 0.50
    tiny: float = 0.0005


RECOVERY, REPAIR, AUDIT = Limits(), Limits(iou=0.10, overlap=0.20), Limits(overlap=0.10)


def changes(described_: DataFrame, h: int, w: int) -> DataFrame:
    """Each mask with its predecessor in the stream: p_area, change_iou, change_ratio and change_jump, null unless both have pixels."""
    o = W.partitionBy(*STREAM, "object_id").orderBy("frame_idx")
    out = described_
    for c in ("runs", "mask_area", "x0", "y0", "x1", "y1"):
        out = out.withColumn(f"p_{c}", F.lag(c).over(o))
    both = (F.col("mask_area") > 0) & (F.col("p_mask_area") > 0)
    inter = R.mask_inter("runs", "p_runs")
    dx = (F.col("x0") + F.col("x1") - F.col("p_x0") - F.col("p_x1")) / 2
    dy = (F.col("y0") + F.col("y1") - F.col("p_y0") - F.col("p_y1")) / 2
    out = out.withColumn("inter", inter)
    out = out.withColumn("change_iou", F.when(both, R.iou(F.col("inter"), F.col("mask_area"), F.col("p_mask_area"))))
    out = out.withColumn("change_ratio", F.when(both, F.greatest("mask_area", "p_mask_area") / F.least("mask_area", "p_mask_area")))
    return out.withColumn("change_jump", F.when(both, F.sqrt(dx * dx + dy * dy) / F.sqrt(F.lit(float(h * h + w * w))))).drop("p_runs", "inter")


def flags(changed: DataFrame, limits: Limits, h: int, w: int) -> DataFrame:
    """Adds an array of flags of a mask and its change; pairs' overlaps are a table of their own."""
    border = (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == w) | (F.col("y1") == h)
    named = [
        F.when(F.col("mask_area") == 0, "empty_mask"),
        F.when((F.col("mask_area") > 0) & border & (F.col("mask_area") / (h * w) < limits.tiny), "tiny_border_residue"),
        F.when(F.col("change_iou") < limits.iou, "mask_iou_drop"),
        F.when(F.col("change_ratio") > limits.ratio, "mask_area_jump"),
        F.when(F.col("change_jump") > limits.jump, "bbox_center_jump"),
        F.when((F.col("mask_area") > 0) != (F.col("p_mask_area") > 0), "visibility_transition"),
    ]
    return changed.withColumn("flags", F.array_compact(F.array(*named)))


def scored(pairs: DataFrame) -> DataFrame:
    """Adds scores of a prediction (p_runs, p_area) against a label (runs, mask_area): iou and dice are null if both are empty.

    A visible label that is missed scores 0. A null prediction is unknown: nothing is common, its visibility is wrong.
    """
    inter = F.coalesce(R.mask_inter("runs", "p_runs"), F.lit(0))
    area, other = F.coalesce("mask_area", F.lit(0)), F.coalesce("p_area", F.lit(0))
    out = pairs.withColumn("inter", inter).withColumn("union", area + other - F.col("inter"))
    out = out.withColumn("iou", R.iou(F.col("inter"), area, other)).withColumn("dice", R.dice(F.col("inter"), area, other))
    gt, pred = area > 0, F.col("p_area") > 0
    out = out.withColumn("gt_visible", gt).withColumn("visibility_correct", F.coalesce(pred == gt, F.lit(False)))
    return out.withColumn("false_positive", ~gt & F.coalesce(pred, F.lit(False))).withColumn("missed", gt & ~F.coalesce(pred, F.lit(False)))


def summary() -> list[Column]:
    """Aggregates of scored rows: macro over visible labels, micro over all."""
    visible = F.col("gt_visible")
    return [
        F.count("*").alias("labels"), F.count_if(visible).alias("visible"),
        F.round(F.avg(F.when(visible, F.col("iou"))), 6).alias("macro_iou"), F.round(F.avg(F.when(visible, F.col("dice"))), 6).alias("macro_dice"),
        F.round(F.sum("inter") / F.nullif(F.sum("union"), F.lit(0)), 6).alias("micro_iou"),
        F.round(F.avg(F.col("visibility_correct").cast("double")), 6).alias("visibility_accuracy"),
        F.count_if("false_positive").alias("false_positives"), F.count_if("missed").alias("misses"),
    ]


def united(masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, runs, confidence, parts): the union of a group's masks and the least confidence of its visible ones, 0 if none is.

    A group is a frame's parts. Unknown masks are left out; a group of only unknown masks is unknown.
    """
    seen = R.area(F.col("runs")) > 0
    out = masks.groupBy(*keys).agg(F.collect_list("runs").alias("all_"), F.coalesce(F.min(F.when(seen, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count("*").alias("parts"))
    return out.withColumn("runs", R.mask_union("all_")).drop("all_")


def regions(rows: DataFrame, h: int, w: int) -> DataFrame:
    """Per frame: region of interest of the eligible masks, grown by a margin, and what is known: all of it unless an object is unresolved.

    ``rows`` (frame, runs, eligible, unresolved).
    """
    out = rows.groupBy(*FRAME).agg(F.collect_list(F.when(F.col("eligible"), F.col("runs"))).alias("all_"), F.max(F.col("unresolved").cast("int")).alias("open_"))
    merged = F.coalesce(R.mask_union("all_"), F.array(F.lit(h * w).cast("long")))
    out = out.withColumn("roi", R.mask_dilate(merged, F.lit(h), F.lit(R.margin(w))))
    out = out.withColumn("roi_pixels", R.area(F.col("roi"))).withColumn("known_pixels", F.when(F.col("open_") == 1, F.col("roi_pixels")).otherwise(h * w))
    return out.drop("all_", "open_").withColumn("has_reliable_roi", F.col("roi_pixels") > 0)


def pooled(masks: DataFrame, support: int, h: int, rows: int, columns: int) -> DataFrame:
    """Adds cells: the mean of an object's masks in the ``support`` frames up to this one, averaged by area; frames without a mask are unknown and add 0."""
    w = W.partitionBy(*STREAM, "object_id").orderBy("frame_idx").rangeBetween(-(support - 1), 0)
    there = F.collect_list("runs").over(w)
    frames = F.concat(there, F.array_repeat(F.lit(None).cast("array<bigint>"), F.lit(support) - F.size(there)))
    return masks.withColumn("frames_", frames).withColumn("cells", R.mask_pool_frames("frames_", F.lit(h), F.lit(rows), F.lit(columns))).drop("frames_")


def layered(masks: DataFrame, priority: str = "priority") -> DataFrame:
    """Mask rows of a frame without the pixels of masks of higher priority, ties by object; a frame's parts are few and go together."""
    item = F.struct((-F.col(priority)).alias("p"), "object_id", "runs")
    x = masks.groupBy(*FRAME).agg(F.sort_array(F.collect_list(item)).alias("all_"))
    x = x.withColumn("left_", R.mask_layers("all_.runs"))
    return x.select(*FRAME, F.inline(F.arrays_zip(F.col("all_.object_id").alias("object_id"), F.col("left_").alias("runs"))))


def resolved(parts: DataFrame, keys: list[str], unknown: int = 1100, verified: Column | None = None) -> DataFrame:
    """(keys, object_id, runs) of robot parts (keys, object_id, runs) without conflicts.

    Pixels of two parts, and parts that aren't ``verified``, become the unknown part's, of which a frame gets a row always; a named part keeps its row. Null masks are left out.
    A group is the parts of one frame.
    """
    named = (F.col("object_id") != unknown) & (F.lit(True) if verified is None else F.coalesce(verified, F.lit(False)))
    rows = parts.where(F.col("runs").isNotNull()).withColumn("__named", named)
    x = rows.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("__named"), F.struct("object_id", "runs"))).alias("own"), F.collect_list(F.when(~F.col("__named"), F.struct("object_id", "runs"))).alias("others"))
    x = x.withColumn("twice", R.mask_shared("own.runs"))
    nothing = F.filter("own", lambda p: F.lit(False))
    left = x.select(*keys, "twice", "others", F.explode_outer("own").alias("p")).withColumn("runs", F.when(F.col("p").isNotNull(), R.mask_minus(F.col("p.runs"), F.coalesce("twice", F.col("p.runs")))))
    kept = left.where("p IS NOT NULL").select(*keys, F.col("p.object_id").alias("object_id"), "runs")
    emptied = x.select(*keys, F.explode(F.filter("others", lambda p: p["object_id"] != unknown)).alias("p")).select(*keys, F.col("p.object_id").alias("object_id"), R.mask_minus(F.col("p.runs"), F.col("p.runs")).alias("runs"))
    spare = x.select(*keys, R.mask_union(F.concat("others.runs", F.array("twice"))).alias("spare"), F.transform(F.coalesce("own", nothing), lambda p: p["runs"]).alias("own"), "twice")
    rest = R.mask_minus(F.col("spare"), F.col("taken"))
    united = spare.withColumn("all", R.mask_union("own")).withColumn("taken", F.coalesce(R.mask_minus(F.col("all"), F.col("twice")), R.mask_minus(F.col("spare"), F.col("spare"))))
    gone = united.withColumn("none", R.mask_minus(F.col("all"), F.col("all")))
    last = gone.select(*keys, F.lit(unknown).cast("long").alias("object_id"), F.coalesce(rest, F.col("none")).alias("runs"))
    return kept.unionByName(emptied).unionByName(last)
