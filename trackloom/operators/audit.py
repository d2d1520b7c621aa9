"""Operators on human audits: label validity, revisions, visibility metrics, false-positive runs, re-entries, identities.

Visibility has three values: an unknown label isn't scored, an unknown prediction is wrong, a missing one is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.sequences import islands

#: Kinds of visibility, and those that count as visible or not.
VISIBILITY = ["visible", "partial_occlusion", "fully_occluded", "out_of_view", "unknown"]
VISIBLE = ["visible", "partial_occlusion"]
INVISIBLE = ["fully_occluded", "out_of_view"]
#: Sums that differ by less are equal.
TIED = 1e-9


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def matched(labels: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Labels with their predictions; a label without a row of prediction raises when the rows are computed."""
    own = predictions.withColumn("__there", F.lit(True))
    out = labels.join(own, keys, "left")
    note = F.concat(F.lit("no prediction for "), F.to_json(F.struct(*keys)))
    return out.where(F.when(F.col("__there").isNull(), F.raise_error(note).cast("boolean")).otherwise(True)).drop("__there")


def metrics() -> list[Column]:
    """Aggregates of scored samples (gt_visibility, pred_visible, iou, pred_area)."""
    gt, hidden = F.col("gt_visibility").isin(VISIBLE), ~F.col("gt_visibility").isin(VISIBLE)
    out = F.col("gt_visibility") == "out_of_view"
    pred = F.col("pred_visible")

    def share(inside: Column, hit: Column) -> Column:
        return F.round(F.avg(F.when(inside, F.coalesce(hit, F.lit(False)).cast("double"))), 6)

    return [
        F.count("*").alias("labels"), F.count_if(gt).alias("visible_gt"), F.count_if(hidden).alias("invisible_gt"), F.round(F.avg(F.when(gt, F.col("iou"))), 6).alias("mask_iou"),
        share(F.lit(True), pred == gt).alias("visibility_accuracy"), F.count_if(pred.isNull()).alias("abstentions"), share(hidden, pred).alias("invisible_fp_rate"),
        F.count_if(out).alias("out_of_view"), share(out, pred).alias("residue_rate"), F.coalesce(F.sum(F.when(out, F.col("pred_area"))), F.lit(0)).cast("long").alias("residue_pixels"),
    ]


def known(samples: DataFrame) -> DataFrame:
    """Samples whose label isn't unknown."""
    return samples.where(F.col("gt_visibility") != "unknown")


def status(labels: Column, required: Column) -> Column:
    return F.when(labels == 0, "PENDING_HUMAN_GT").when(labels < required, "PARTIAL_HUMAN_AUDIT").otherwise("HUMAN_AUDIT_COMPLETE")


def false_positive_runs(samples: DataFrame, keys: list[str], stride: int = 5) -> DataFrame:
    """(keys, samples, first_frame, last_frame, span_seconds) of runs of visible predictions on invisible labels, each ``stride`` after the last."""
    wrong = F.col("gt_visibility").isin(INVISIBLE) & F.coalesce("pred_visible", F.lit(False))
    runs = islands(samples, keys, "frame_idx", wrong, stride).where("island IS NOT NULL")
    seconds = F.max(micros("ts")) - F.min(micros("ts"))
    return runs.groupBy(*keys, "island").agg(F.count("*").alias("samples"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.round(seconds / 1e6, 3).alias("span_seconds")).drop("island")


def reentries(samples: DataFrame, keys: list[str], stride: int = 5, window: int = 3, least: float = 0.5) -> DataFrame:
    """Re-entries: out of view, then visible one stride later. ``window`` samples decide.

    Adds eligible (samples contiguous and visible, and all there or one a success), success (null if not eligible: censored,
    no failure) and latency_seconds to the first success.
    """
    w = W.partitionBy(*keys).orderBy("frame_idx")
    item = F.struct("frame_idx", "gt_visibility", "iou", micros("ts").alias("us"))
    x = samples.withColumn("before", F.lag("gt_visibility").over(w)).withColumn("gap", F.col("frame_idx") - F.lag("frame_idx").over(w))
    x = x.withColumn("ahead", F.collect_list(item).over(w.rowsBetween(0, window - 1)))
    x = x.where(F.col("gt_visibility").isin(VISIBLE) & (F.col("before") == "out_of_view") & (F.col("gap") == stride))
    ahead = F.col("ahead")
    contiguous = F.forall(F.sequence(F.lit(1), F.size(ahead)), lambda k: F.try_element_at(ahead, k)["frame_idx"] == F.col("frame_idx") + (k - 1) * stride)
    visible = F.forall(ahead, lambda a: a["gt_visibility"].isin(VISIBLE))
    wins = F.filter(ahead, lambda a: a["gt_visibility"].isin(VISIBLE) & (a["iou"] >= least))
    eligible = contiguous & visible & ((F.size(ahead) == window) | (F.size(wins) > 0))
    first = F.try_element_at(wins, F.lit(1))["us"]
    x = x.withColumn("eligible", eligible).withColumn("success", F.when(eligible, F.size(wins) > 0))
    x = x.withColumn("latency_seconds", F.when(F.col("success"), F.round((first - micros("ts")) / 1e6, 3)))
    return x.select(*keys, "frame_idx", "eligible", "success", "latency_seconds")


def matching(weight: list[list[float]]) -> list[int]:
    """The column of each row of a square table of weights in the matching of the largest sum, by shortest augmenting paths.

    Of matchings whose sums are equal but for rounding, the first in order of the rows' columns.
    """
    n = len(weight)
    row_price, price = [0.0] * n, [0.0] * n
    row_of, column_of = [-1] * n, [-1] * n
    for start in range(n):
        least, came, done = [math.inf] * n, [-1] * n, [False] * n
        row, column = start, -1
        while True:
            step, ahead = math.inf, -1
            for j in range(n):
                if not done[j]:
                    slack = -weight[row][j] - row_price[row] - price[j]
                    if slack < least[j]:
                        least[j], came[j] = slack, column
                    if least[j] < step:
                        step, ahead = least[j], j
            row_price[start] += step
            for j in range(n):
                if done[j]:
                    row_price[row_of[j]] += step
                    price[j] -= step
                else:
                    least[j] -= step
            column, done[ahead] = ahead, True
            if row_of[column] < 0:
                break
            row = row_of[column]
        while column >= 0:
            before = came[column]
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    for j, i in enumerate(row_of):
        column_of[i] = j
    # every best matching uses edges without slack only: move each row, in order, to the first column that still allows one
    free = [[j for j in range(n) if -weight[i][j] - row_price[i] - price[j] < TIED] for i in range(n)]

    def moved(i: int, above: int, seen: set[int]) -> bool:
        for j in free[i]:
            if j not in seen and (row_of[j] >= above or row_of[j] < 0):
                seen.add(j)
                if row_of[j] < 0 or moved(row_of[j], above, seen):
                    row_of[j], column_of[i] = i, j
                    return True
        return False

    for i in range(n):
        for j in free[i]:
            if j == column_of[i]:
                break
            if row_of[j] > i:  # give it to this row, and let its own row seek another column
                other, mine, kept = row_of[j], column_of[i], (row_of[:], column_of[:])
                row_of[mine], row_of[j], column_of[i] = -1, i, j
                if moved(other, i + 1, {j}):
                    break
                row_of[:], column_of[:] = kept
    return column_of


def assign(pairs: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """(keys, gt, pred, iou) of the one-to-one matching of a frame with the largest total IoU, pairs of ``least`` or more.

    ``pairs`` (keys, gt, pred, iou). Ties go to the first in order of ids, from the side with fewer of them. Frames are
    streamed through sorted partitions, many in a batch; a frame takes the third power of its objects.
    """

    def solve(rows: list[tuple]) -> list[tuple]:
        gts, preds = sorted({r[-3] for r in rows}), sorted({r[-2] for r in rows})
        flip = len(gts) > len(preds)
        small, large = (preds, gts) if flip else (gts, preds)
        at = {x: k for k, x in enumerate(small)}, {x: k for k, x in enumerate(large)}
        m = [[0.0] * len(large) for _ in large]  # rows beyond the smaller side take what is left
        for *_, g, p, value in rows:
            i, j = at[0][p if flip else g], at[1][g if flip else p]
            m[i][j] = max(m[i][j], value or 0.0)
        best = matching(m)[: len(small)]
        return [(*rows[0][:-3], *((large[j], small[i]) if flip else (small[i], large[j])), m[i][j]) for i, j in enumerate(best) if m[i][j] >= least]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if held and row[:-3] != held[0][:-3]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(solve(held) if held else [], columns=names)

    names = [*keys, "gt", "pred", "iou"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)
    rows = pairs.where("gt IS NOT NULL AND pred IS NOT NULL").select(*keys, F.col("gt").cast("long"), F.col("pred").cast("long"), F.col("iou").cast("double"))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, f"{kinds}, gt long, pred long, iou double")


def id_switches(matches: DataFrame, frames: DataFrame, keys: list[str], stride: int = 5) -> DataFrame:
    """Matches whose track isn't that of the instance's match before; a gap in a clip's frames other than ``stride`` forgets all.

    Adds comparable and switched. ``frames`` (keys, frame_idx) are the clip's audited frames.
    """
    w = W.partitionBy(*keys).orderBy("frame_idx")
    part = F.sum(F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(w) != stride).cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    parts = frames.select(*keys, "frame_idx").distinct().withColumn("part", part)
    x = matches.join(parts, [*keys, "frame_idx"])
    before = F.lag("pred").over(W.partitionBy(*keys, "part", "gt").orderBy("frame_idx"))
    return x.withColumn("before", before).withColumn("comparable", F.col("before").isNotNull()).withColumn("switched", F.coalesce(F.col("before") != F.col("pred"), F.lit(False)))


def current(revisions: DataFrame, key: str = "label_id") -> DataFrame:
    """The row of the largest revision of each key."""
    w = W.partitionBy(key).orderBy(F.desc("revision"))
    return revisions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def revision_violations(revisions: DataFrame, key: str = "label_id") -> DataFrame:
    """Rows of a revision log whose number isn't one more than the row before, by ``turn``."""
    w = W.partitionBy(key).orderBy("turn")
    return revisions.withColumn("before", F.lag("revision").over(w)).where(F.coalesce(F.col("revision") != F.col("before") + 1, F.col("revision") != 1))


def log_disagreements(log: DataFrame, now: DataFrame, key: str = "label_id") -> DataFrame:
    """(key, problem): keys of only one of log and current labels, or whose latest entry isn't the current label."""
    a = current(log, key).select(key, F.col("payload").alias("log_payload"), F.col("revision").alias("log_revision"))
    b = now.select(F.col(key).alias("k"), F.col("payload").alias("now_payload"), F.col("revision").alias("now_revision"))
    x = a.join(b, a[key] == b["k"], "full")
    problem = F.when(F.col("k").isNull(), "not current").when(F.col(key).isNull(), "not logged").when((F.col("log_payload") != F.col("now_payload")) | (F.col("log_revision") != F.col("now_revision")), "differs")
    return x.select(F.coalesce(key, "k").alias(key), problem.alias("problem")).where("problem IS NOT NULL")


def save(log: DataFrame, updates: DataFrame, key: str = "label_id") -> DataFrame:
    """The log with updates appended, numbered on from each key's last revision in order of arrival (``turn``)."""
    last = log.groupBy(key).agg(F.max("revision").alias("last"))
    n = F.row_number().over(W.partitionBy(key).orderBy("turn"))
    new = updates.withColumn("n", n).join(last, key, "left").withColumn("revision", F.coalesce("last", F.lit(0)) + F.col("n")).drop("last", "n")
    return log.unionByName(new.select(*log.columns))


def preferred(proposals: DataFrame, human: DataFrame, key: str) -> DataFrame:
    """Each key's human label where there is one, else its proposal; ``origin`` tells which."""
    a, b = proposals.alias("p"), human.alias("h")
    x = a.join(b, F.col(f"p.{key}") == F.col(f"h.{key}"), "full")
    return x.select(F.coalesce(f"h.{key}", f"p.{key}").alias(key), F.coalesce("h.payload", "p.payload").alias("payload"), F.when(F.col(f"h.{key}").isNotNull(), "human").otherwise("proposal").alias("origin"))


def annotation_violations(rows: DataFrame) -> DataFrame:
    """Adds violations of an annotation (human_confirmed, annotator, visibility, has_mask): a mask goes with visible labels only."""
    bad = F.array_compact(F.array(
        F.when(~F.coalesce("human_confirmed", F.lit(False)), "not human"), F.when(F.coalesce(F.trim("annotator"), F.lit("")) == "", "no annotator"),
        F.when(~F.coalesce(F.col("visibility").isin(VISIBILITY), F.lit(False)), "visibility"), F.when(F.col("visibility").isin(VISIBLE) != F.col("has_mask"), "mask")))
    return rows.withColumn("violations", bad)


def export_summary(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Completeness of an export: labels, required ones, frames whose every object is labelled, and labels outside the manifest."""
    own = labels.select("sample_id", "object_id").distinct().withColumn("there", F.lit(True))
    x = samples.select("sample_id", "object_id").join(own, ["sample_id", "object_id"], "full").join(samples.select("sample_id", "object_id").withColumn("asked", F.lit(True)), ["sample_id", "object_id"], "left")
    frames = x.groupBy("sample_id").agg(F.count("asked").alias("required"), F.count("there").alias("there"), F.count_if(F.col("asked").isNull()).alias("strangers"))
    return frames.agg(F.sum("required").alias("required"), F.sum(F.col("there") - F.col("strangers")).alias("labels"), F.count_if(F.col("there") - F.col("strangers") == F.col("required")).alias("completed_frames"), F.sum("strangers").alias("strangers"))
