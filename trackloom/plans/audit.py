"""Queries over human audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators import audit as A
from trackloom.operators import rules as L
from trackloom.registry import query
from trackloom.sources.fixtures import view

_SEEN = "gt_visibility IN ('visible', 'partial_occlusion')"
_METRICS = f"""count(*) AS labels, count(*) FILTER ({_SEEN}) AS visible_gt, count(*) FILTER (NOT {_SEEN}) AS invisible_gt, round(avg(iou) FILTER ({_SEEN}), 6) AS mask_iou,
 round(avg(CAST(coalesce(pred_visible = ({_SEEN}), false) AS INT)), 6) AS visibility_accuracy, count(*) FILTER (pred_visible IS NULL) AS abstentions, round(avg(CAST(coalesce(pred_visible, false) AS INT)) FILTER (NOT {_SEEN}), 6) AS invisible_fp_rate,
 count(*) FILTER (gt_visibility = 'out_of_view') AS out_of_view, round(avg(CAST(coalesce(pred_visible, false) AS INT)) FILTER (gt_visibility = 'out_of_view'), 6) AS residue_rate, CAST(coalesce(sum(pred_area) FILTER (gt_visibility = 'out_of_view'), 0) AS BIGINT) AS residue_pixels"""
_TAGS = "list_filter([CASE WHEN sample_id % 2 = 0 THEN 'fast_motion' END, CASE WHEN sample_id % 3 = 0 THEN 'occlusion' END, CASE WHEN sample_id % 5 = 0 THEN 'blur' END], lambda t: t IS NOT NULL)"


def tagged(samples: DataFrame) -> DataFrame:
    """Samples by condition; a sample may have several."""
    tags = [F.when(F.col("sample_id") % n == 0, t) for n, t in ((2, "fast_motion"), (3, "occlusion"), (5, "blur"))]
    return samples.withColumn("condition", F.explode(F.array_compact(F.array(*tags))))


@query("a7_audit_metrics", f"SELECT object_id, {_METRICS} FROM v_vis WHERE gt_visibility <> 'unknown' GROUP BY ALL")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return A.known(view(spark, sf, "v_vis")).groupBy("object_id").agg(*A.metrics())


@query("a8_by_camera_and_condition", f"""WITH k AS (SELECT * FROM v_vis WHERE gt_visibility <> 'unknown'), c AS (SELECT *, unnest({_TAGS}) AS condition FROM k)
SELECT 'camera' AS scope, coalesce(camera, 'all') AS name, {_METRICS} FROM k GROUP BY GROUPING SETS ((camera), ()) UNION ALL SELECT 'condition', condition, {_METRICS} FROM c GROUP BY condition""")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.known(view(spark, sf, "v_vis"))
    cameras = rows.rollup("camera").agg(*A.metrics()).select(F.lit("camera").alias("scope"), F.coalesce("camera", F.lit("all")).alias("name"), "*").drop("camera")
    conditions = tagged(rows).groupBy("condition").agg(*A.metrics()).select(F.lit("condition").alias("scope"), F.col("condition").alias("name"), "*").drop("condition")
    return cameras.unionByName(conditions)


@query("a9_condition_coverage", f"SELECT condition, count(*) AS object_frames FROM (SELECT unnest({_TAGS}) AS condition FROM v_vis) AS x GROUP BY ALL")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(view(spark, sf, "v_vis")).groupBy("condition").agg(F.count("*").alias("object_frames"))


@query("a10_audit_status", "SELECT clip_id, CASE WHEN count(*) FILTER (gt_visibility <> 'unknown') = 0 THEN 'PENDING_HUMAN_GT' WHEN count(*) FILTER (gt_visibility <> 'unknown') < count(*) THEN 'PARTIAL_HUMAN_AUDIT' ELSE 'HUMAN_AUDIT_COMPLETE' END AS status FROM v_vis GROUP BY ALL")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_vis").groupBy("clip_id").agg(A.status(F.count_if(F.col("gt_visibility") != "unknown"), F.count("*")).alias("status"))


@query("w7_false_positive_runs", """
WITH f AS (SELECT *, coalesce(gt_visibility IN ('fully_occluded', 'out_of_view') AND pred_visible, false) AS bad FROM v_vis),
b AS (SELECT *, CASE WHEN bad AND NOT (coalesce(lag(bad) OVER w, false) AND coalesce(frame_idx - lag(frame_idx) OVER w = 5, false)) THEN 1 ELSE 0 END AS brk FROM f WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT clip_id, count(*) AS samples, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE, 3) AS span_seconds FROM i WHERE bad GROUP BY clip_id, island""")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return A.false_positive_runs(view(spark, sf, "v_vis"), ["clip_id"])


@query("w8_reentries", f"""
WITH x AS (SELECT *, lag(gt_visibility) OVER w AS before, frame_idx - lag(frame_idx) OVER w AS gap, lead(frame_idx, 1) OVER w AS f1, lead(frame_idx, 2) OVER w AS f2, lead(gt_visibility, 1) OVER w AS g1, lead(gt_visibility, 2) OVER w AS g2, lead(iou, 1) OVER w AS i1, lead(iou, 2) OVER w AS i2, lead(ts, 1) OVER w AS t1, lead(ts, 2) OVER w AS t2 FROM v_vis WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
e AS (SELECT *, (f1 IS NULL OR f1 = frame_idx + 5) AND (f2 IS NULL OR f2 = frame_idx + 10) AS contiguous, coalesce(g1, 'visible') IN ('visible', 'partial_occlusion') AND coalesce(g2, 'visible') IN ('visible', 'partial_occlusion') AS seen,
  CASE WHEN iou >= 0.5 THEN ts WHEN g1 IN ('visible', 'partial_occlusion') AND i1 >= 0.5 THEN t1 WHEN g2 IN ('visible', 'partial_occlusion') AND i2 >= 0.5 THEN t2 END AS won FROM x WHERE {_SEEN} AND before = 'out_of_view' AND gap = 5),
d AS (SELECT *, contiguous AND seen AND (f2 IS NOT NULL OR won IS NOT NULL) AS eligible FROM e)
SELECT clip_id, frame_idx, eligible, CASE WHEN eligible THEN won IS NOT NULL END AS success, CASE WHEN eligible THEN round((epoch_us(won) - epoch_us(ts)) / 1e6::DOUBLE, 3) END AS latency_seconds FROM d""")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return A.reentries(view(spark, sf, "v_vis"), ["clip_id"])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Three instances against three tracks in each sampled frame of a clip, with an IoU that ids determine."""
    frames = view(spark, sf, "v_vis").select("clip_id", "frame_idx", "sample_id")
    trio = spark.range(3)
    x = frames.join(trio.select(F.col("id").alias("gt")).hint("broadcast")).join(trio.select(F.col("id").alias("pred")).hint("broadcast"))
    return x.withColumn("iou", ((F.col("sample_id") * 7 + F.col("gt") * 31 + F.col("pred") * 17 + F.col("gt") * F.col("pred") * 5) % 97) / F.lit(97.0))


_PAIRS = "p AS (SELECT clip_id, frame_idx, sample_id, g.range AS gt, t.range AS pred, ((sample_id * 7 + g.range * 31 + t.range * 17 + g.range * t.range * 5) % 97) / 97::DOUBLE AS iou FROM v_vis, range(3) AS g, range(3) AS t)"
_BEST = f"""{_PAIRS},
tries AS (SELECT a.clip_id, a.frame_idx, a.pred AS p0, b.pred AS p1, c.pred AS p2, a.iou AS i0, b.iou AS i1, c.iou AS i2, row_number() OVER (PARTITION BY a.clip_id, a.frame_idx ORDER BY round(a.iou + b.iou + c.iou, 12) DESC, a.pred, b.pred, c.pred) AS n
  FROM p a JOIN p b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.gt = 0 AND b.gt = 1 AND a.pred <> b.pred JOIN p c ON a.clip_id = c.clip_id AND a.frame_idx = c.frame_idx AND c.gt = 2 AND c.pred NOT IN (a.pred, b.pred)),
m AS (SELECT * FROM (SELECT clip_id, frame_idx, unnest([0, 1, 2]) AS gt, unnest([p0, p1, p2]) AS pred, unnest([i0, i1, i2]) AS iou FROM tries WHERE n = 1) AS z WHERE iou >= 0.1)"""


@query("j21_identity_matching", f"WITH {_BEST} SELECT clip_id, frame_idx, CAST(gt AS BIGINT) AS gt, pred, round(iou, 6) AS iou FROM m")
def j21(spark: SparkSession, sf: str) -> DataFrame:
    return A.assign(_pairs(spark, sf), ["clip_id", "frame_idx"]).withColumn("iou", F.round("iou", 6))


@query("w9_id_switches", f"""WITH {_BEST},
parts AS (SELECT clip_id, frame_idx, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT DISTINCT clip_id, frame_idx, coalesce(frame_idx - lag(frame_idx) OVER (PARTITION BY clip_id ORDER BY frame_idx) <> 5, false) AS brk FROM v_vis) AS q),
x AS (SELECT m.*, lag(pred) OVER (PARTITION BY m.clip_id, part, gt ORDER BY m.frame_idx) AS before FROM m JOIN parts p ON m.clip_id = p.clip_id AND m.frame_idx = p.frame_idx)
SELECT clip_id, count(*) AS matches, count(before) AS comparisons, count(*) FILTER (before <> pred) AS switches, round(count(*) FILTER (before <> pred) / nullif(count(before), 0), 6) AS switch_rate FROM x GROUP BY ALL""")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    out = A.id_switches(A.assign(pairs, ["clip_id", "frame_idx"]), pairs, ["clip_id"])
    n = F.count_if("comparable")
    return out.groupBy("clip_id").agg(F.count("*").alias("matches"), n.alias("comparisons"), F.count_if("switched").alias("switches"), F.round(F.count_if("switched") / F.nullif(n, F.lit(0)), 6).alias("switch_rate"))


@query("w23_current_labels", "SELECT label_id, revision, payload FROM v_revisions QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY revision DESC) = 1")
def w23(spark: SparkSession, sf: str) -> DataFrame:
    return A.current(view(spark, sf, "v_revisions")).select("label_id", "revision", "payload")


@query("w23_revision_violations", "SELECT label_id, revision FROM (SELECT *, lag(revision) OVER (PARTITION BY label_id ORDER BY turn) AS before FROM v_revisions WHERE label_id % 10 <> 3 OR revision <> 2) AS x WHERE coalesce(revision <> before + 1, revision <> 1)")
def w23b(spark: SparkSession, sf: str) -> DataFrame:
    return A.revision_violations(view(spark, sf, "v_revisions").where("label_id % 10 <> 3 OR revision <> 2")).select("label_id", "revision")


@query("j15_log_disagreements", "SELECT label_id, CASE WHEN label_id % 10 = 1 THEN 'not current' WHEN label_id % 10 = 2 THEN 'differs' END AS problem FROM (SELECT DISTINCT label_id FROM v_revisions) AS x WHERE label_id % 10 IN (1, 2)")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "v_revisions")
    now = A.current(log).where("label_id % 10 <> 1").withColumn("payload", F.when(F.col("label_id") % 10 == 2, F.lit("edited")).otherwise(F.col("payload")))
    return A.log_disagreements(log, now)


@query("j20_label_precedence", "WITH c AS (SELECT label_id, payload, role FROM v_revisions QUALIFY row_number() OVER (PARTITION BY label_id, role ORDER BY revision DESC) = 1) SELECT coalesce(h.label_id, p.label_id) AS label_id, coalesce(h.payload, p.payload) AS payload, CASE WHEN h.label_id IS NOT NULL THEN 'human' ELSE 'proposal' END AS origin FROM (SELECT * FROM c WHERE role = 'assistant') p FULL JOIN (SELECT * FROM c WHERE role = 'user' AND label_id % 2 = 0) h ON p.label_id = h.label_id")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_revisions")
    human, machine = A.current(rows.where("role = 'user' AND label_id % 2 = 0")), A.current(rows.where("role = 'assistant'"))
    return A.preferred(machine, human, "label_id")


@query("st14_label_save", "WITH o AS (SELECT * FROM v_revisions WHERE turn % 3 <> 2), n AS (SELECT label_id, turn, row_number() OVER (PARTITION BY label_id ORDER BY turn) AS k FROM v_revisions WHERE turn % 3 = 2), l AS (SELECT label_id, max(revision) AS last FROM o GROUP BY ALL) SELECT label_id, revision, turn FROM o UNION ALL SELECT n.label_id, coalesce(last, 0) + k, turn FROM n LEFT JOIN l ON n.label_id = l.label_id")
def st14(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_revisions")
    return A.save(rows.where("turn % 3 <> 2"), rows.where("turn % 3 = 2")).select("label_id", "revision", "turn")


@query("pf11_annotation_validity", "SELECT gt_visibility, count(*) AS rows_, count(*) FILTER (sample_id % 7 = 0) AS not_human, count(*) FILTER (gt_visibility IN ('visible', 'partial_occlusion') <> (pred_area > 100)) AS mask_errors FROM v_vis GROUP BY ALL")
def pf11(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_vis").select("gt_visibility", F.col("gt_visibility").alias("visibility"), (F.col("sample_id") % 7 != 0).alias("human_confirmed"), F.lit("a").alias("annotator"), (F.col("pred_area") > 100).alias("has_mask"))
    out = A.annotation_violations(rows)
    return out.groupBy("gt_visibility").agg(F.count("*").alias("rows_"), F.count_if(F.array_contains("violations", "not human")).alias("not_human"), F.count_if(F.array_contains("violations", "mask")).alias("mask_errors"))


@query("j4_strict_predictions", "SELECT camera, count(*) AS labels, count(pred_visible) AS known FROM v_vis GROUP BY ALL")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_vis")
    return A.matched(rows.select("sample_id", "camera"), rows.select("sample_id", "pred_visible"), ["sample_id"]).groupBy("camera").agg(F.count("*").alias("labels"), F.count("pred_visible").alias("known"))


@query("snk6_export_summary", """
WITH s AS (SELECT clip_id, object_id, bool_or(gt_visibility <> 'unknown') AS done, clip_id % 7 <> 0 OR object_id % 3 <> 0 AS asked FROM v_vis GROUP BY ALL),
f AS (SELECT clip_id, count(*) FILTER (asked) AS required, count(*) FILTER (done AND asked) AS there, count(*) FILTER (done AND NOT asked) AS strangers FROM s GROUP BY ALL HAVING bool_or(asked OR done))
SELECT CAST(sum(required) AS BIGINT) AS required, CAST(sum(there) AS BIGINT) AS labels, count(*) FILTER (there = required) AS completed_frames, CAST(sum(strangers) AS BIGINT) AS strangers FROM f""")
def snk6(spark: SparkSession, sf: str) -> DataFrame:
    """Labels against a manifest that doesn't ask for some objects of some clips."""
    rows = view(spark, sf, "v_vis").withColumn("sample_id", F.col("clip_id"))
    asked = rows.where("clip_id % 7 <> 0 OR object_id % 3 <> 0")
    return A.export_summary(asked.select("sample_id", "object_id").distinct(), A.known(rows))


@query("a23_import_histogram", "SELECT gt_visibility, CASE WHEN sample_id % 2 = 0 THEN 'assisted' ELSE 'manual' END AS origin, count(*) AS labels FROM v_vis GROUP BY ALL")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return L.label_origins(view(spark, sf, "v_vis"), "gt_visibility", F.col("sample_id") % 2 == 0)


@query("w24_time_order", "SELECT clip_id, count(*) AS samples, count(*) FILTER (ts < before) AS backwards, count(*) FILTER (ts = before) AS repeated FROM (SELECT clip_id, ts, lag(ts) OVER (PARTITION BY clip_id ORDER BY sample_id) AS before FROM v_vis) AS x GROUP BY ALL")
def w24(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "v_vis").withColumn("before", F.lag("ts").over(W.partitionBy("clip_id").orderBy("sample_id")))
    return x.groupBy("clip_id").agg(F.count("*").alias("samples"), F.count_if(F.col("ts") < F.col("before")).alias("backwards"), F.count_if(F.col("ts") == F.col("before")).alias("repeated"))


@query("pf7_evaluation_isolation", "SELECT camera, count(*) AS samples FROM v_vis WHERE clip_id NOT IN (SELECT clip_id FROM v_vis WHERE sample_id % 400 = 0) GROUP BY ALL")
def pf7(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_vis")
    return L.isolated(rows, F.col("sample_id") % 400 == 0, "clip_id").groupBy("camera").agg(F.count("*").alias("samples"))


@query("pf8_metric_exclusions", "SELECT gt_visibility, count(*) FILTER (sample_id % 9 <> 0) AS scored, count(*) FILTER (sample_id % 9 = 0) AS excluded FROM v_vis GROUP BY ALL")
def pf8(spark: SparkSession, sf: str) -> DataFrame:
    return L.scored_and_excluded(view(spark, sf, "v_vis"), ["gt_visibility"], F.col("sample_id") % 9 == 0)
