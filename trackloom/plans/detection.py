"""Queries over detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import boxes
from trackloom.operators import detections as D
from trackloom.registry import query
from trackloom.sources.fixtures import view

TIES = ["t1", "t2", "t3", "t4", "t5", "t6"]


def _sql(a: str, b: str) -> dict[str, str]:
    """SQL of intersection, areas, IoU and overlap of boxes a and b."""
    p = lambda t, k: f"{t}{k}" if t.endswith("_") else f"{t}.{k}"
    i = f"greatest(0, least({p(a, 'x1')}, {p(b, 'x1')}) - greatest({p(a, 'x0')}, {p(b, 'x0')})) * greatest(0, least({p(a, 'y1')}, {p(b, 'y1')}) - greatest({p(a, 'y0')}, {p(b, 'y0')}))"
    sa = f"(({p(a, 'x1')} - {p(a, 'x0')}) * ({p(a, 'y1')} - {p(a, 'y0')}))"
    sb = f"(({p(b, 'x1')} - {p(b, 'x0')}) * ({p(b, 'y1')} - {p(b, 'y0')}))"
    return {"i": i, "a": sa, "b": sb, "iou": f"(({i}) / nullif({sa} + {sb} - ({i}), 0))", "small": f"(({i}) / nullif(least({sa}, {sb}), 0))"}


def objects(spark: SparkSession) -> DataFrame:
    """The five objects of each of the five tasks."""
    return spark.range(5).select(F.col("id").alias("task_id")).crossJoin(spark.range(5).select(F.col("id").alias("object_id"))).hint("broadcast")


OBJECTS = "(SELECT t.range AS task_id, o.range AS object_id FROM range(5) AS t, range(5) AS o)"


@query("pf1_threshold", "SELECT episode_id, camera, object_id, count(*) AS kept, round(min(confidence), 6) AS lowest FROM v_detections WHERE confidence >= 0.30 GROUP BY ALL")
def pf1(spark: SparkSession, sf: str) -> DataFrame:
    return D.at_least(view(spark, sf, "v_detections")).groupBy("episode_id", "camera", "object_id").agg(F.count("*").alias("kept"), F.round(F.min("confidence"), 6).alias("lowest"))


@query("pf2_threshold_sweep", "SELECT t.t AS threshold, camera, object_id, count(*) AS kept FROM v_detections JOIN (VALUES (CAST(0.2 AS DOUBLE)), (0.25), (0.3), (0.35), (0.4)) AS t(t) ON confidence >= t.t GROUP BY ALL")
def pf2(spark: SparkSession, sf: str) -> DataFrame:
    return D.sweep(view(spark, sf, "v_detections")).groupBy("threshold", "camera", "object_id").agg(F.count("*").alias("kept"))


@query("pf3_absent_objects", f"SELECT f.episode_id, f.camera, f.frame_idx, o.object_id FROM v_frames f JOIN {OBJECTS} o ON f.task_id = o.task_id ANTI JOIN (SELECT * FROM v_detections WHERE confidence >= 0.30) d ON d.episode_id = f.episode_id AND d.camera = f.camera AND d.frame_idx = f.frame_idx AND d.object_id = o.object_id")
def pf3(spark: SparkSession, sf: str) -> DataFrame:
    return D.absent(view(spark, sf, "v_frames"), objects(spark), D.at_least(view(spark, sf, "v_detections")))


@query("pf10_invalid_detections", "SELECT camera, object_id, count(*) AS bad, count(*) FILTER (x1 > 640) AS too_wide, count(*) FILTER (confidence < 0.15) AS too_weak FROM v_detections WHERE NOT (x0 >= 0 AND y0 >= 0 AND x0 < x1 AND y0 < y1 AND x1 <= 640 AND y1 <= 360 AND confidence BETWEEN 0.15 AND 1) GROUP BY ALL")
def pf10(spark: SparkSession, sf: str) -> DataFrame:
    bad = D.invalid(view(spark, sf, "v_detections"), 640, 360, 0.15)
    return bad.groupBy("camera", "object_id").agg(F.count("*").alias("bad"), F.count_if(F.col("x1") > 640).alias("too_wide"), F.count_if(F.col("confidence") < 0.15).alias("too_weak"))


@query("w1_best_detection", "SELECT episode_id, camera, frame_idx, object_id, confidence, x0, y0, x1, y1, hits FROM v_top")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return D.best(view(spark, sf, "v_detections"), TIES).select("episode_id", "camera", "frame_idx", "object_id", "confidence", "x0", "y0", "x1", "y1", "hits")


@query("w2_ambiguity", "SELECT camera, object_id, count(*) AS frames, count(*) FILTER (confidence - second_confidence < 0.06) AS ambiguous FROM v_top WHERE confidence >= 0.40 GROUP BY ALL")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    out = D.settle(D.best(view(spark, sf, "v_detections"), TIES).where("confidence >= 0.40"))
    return out.groupBy("camera", "object_id").agg(F.count("*").alias("frames"), F.count("reason").alias("ambiguous"))


_O = _sql("a", "b")
_ON = "a.episode_id = b.episode_id AND a.camera = b.camera AND a.frame_idx = b.frame_idx AND a.object_id < b.object_id"


def _choose_sql(rule: str, name: str) -> str:
    return f"""
WITH strong AS (SELECT * FROM v_top WHERE confidence >= 0.40),
settled AS (SELECT *, CASE WHEN second_confidence >= 0.40 AND confidence - second_confidence < 0.06 THEN 'ambiguous_multiple_instances' END AS why FROM strong),
ok AS (SELECT * FROM settled WHERE why IS NULL),
pairs AS (SELECT a.episode_id, a.camera, a.frame_idx, a.object_id AS i, b.object_id AS j FROM ok a JOIN ok b ON {_ON} AND {rule}),
hit AS (SELECT episode_id, camera, frame_idx, i AS object_id FROM pairs UNION SELECT episode_id, camera, frame_idx, j FROM pairs)
SELECT s.camera, s.object_id, coalesce(why, CASE WHEN h.object_id IS NOT NULL THEN '{name}' ELSE 'chosen' END) AS outcome, count(*) AS frames
FROM settled s LEFT JOIN hit h ON s.episode_id = h.episode_id AND s.camera = h.camera AND s.frame_idx = h.frame_idx AND s.object_id = h.object_id GROUP BY ALL"""


def _choose(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    strong = D.at_least(view(spark, sf, "v_detections"), 0.15, 0.40)
    out = D.choose(D.best(strong, TIES), 0.40, 0.06, rule)
    return out.groupBy("camera", "object_id", F.coalesce("reason", F.lit("chosen")).alias("outcome")).agg(F.count("*").alias("frames"))


@query("j7_box_collision", _choose_sql(f"{_O['small']} > 0.70", "cross_class_box_collision"))
def j7a(spark: SparkSession, sf: str) -> DataFrame:
    return _choose(spark, sf, "overlap")


@query("j7_identical_boxes", _choose_sql(f"{_O['iou']} > 0.80 AND NOT (a.object_id IN (17, 22, 23) AND b.object_id IN (17, 22, 23))", "near_identical_cross_class_boxes"))
def j7b(spark: SparkSession, sf: str) -> DataFrame:
    return _choose(spark, sf, "identical")


@query("j3_dense_skeleton", f"SELECT f.camera, o.object_id, count(*) AS rows_, count(d.confidence) AS initialized, count(*) - count(d.confidence) AS not_initialized FROM v_frames f JOIN {OBJECTS} o ON f.task_id = o.task_id LEFT JOIN v_top d ON d.episode_id = f.episode_id AND d.camera = f.camera AND d.frame_idx = f.frame_idx AND d.object_id = o.object_id GROUP BY ALL")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    dense = D.skeleton(view(spark, sf, "v_frames"), objects(spark), D.best(view(spark, sf, "v_detections"), TIES).drop("task_id"))
    return dense.groupBy("camera", "object_id").agg(F.count("*").alias("rows_"), F.count("confidence").alias("initialized"), (F.count("*") - F.count("confidence")).alias("not_initialized"))


_M = _sql("p_", "")
_M = {k: v.replace(".x", "x").replace(".y", "y") for k, v in _M.items()}
_DENSE = f"""
dense AS (SELECT f.episode_id, f.task_id, f.camera, f.frame_idx, o.object_id, d.x0, d.y0, d.x1, d.y1, d.confidence FROM v_frames f JOIN {OBJECTS} o ON f.task_id = o.task_id
  LEFT JOIN v_top d ON d.episode_id = f.episode_id AND d.camera = f.camera AND d.frame_idx = f.frame_idx AND d.object_id = o.object_id)"""
_JUMP = "sqrt(((x0 + x1 - p_x0 - p_x1) / 2) * ((x0 + x1 - p_x0 - p_x1) / 2) + ((y0 + y1 - p_y0 - p_y1) / 2) * ((y0 + y1 - p_y0 - p_y1) / 2)) / sqrt(CAST(539200 AS DOUBLE))"
_RATIO = f"greatest({_M['a']}, {_M['b']}) / greatest(CAST(1e-9 AS DOUBLE), least({_M['a']}, {_M['b']}))"
_MIOU = f"({_M['i']}) / greatest(CAST(1e-9 AS DOUBLE), {_M['a']} + {_M['b']} - ({_M['i']}))"


@query("w3_temporal_diagnostics", f"""
WITH {_DENSE},
moved AS (SELECT *, lag(frame_idx) OVER w AS p, lag(x0) OVER w AS p_x0, lag(y0) OVER w AS p_y0, lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1 FROM dense WINDOW w AS (PARTITION BY episode_id, camera, object_id ORDER BY frame_idx)),
m AS (SELECT *, CASE WHEN x0 IS NOT NULL AND p_x0 IS NOT NULL THEN {_MIOU} END AS iou, CASE WHEN x0 IS NOT NULL AND p_x0 IS NOT NULL THEN {_JUMP} END AS jump, CASE WHEN x0 IS NOT NULL AND p_x0 IS NOT NULL THEN {_RATIO} END AS ratio FROM moved WHERE p IS NOT NULL)
SELECT episode_id, camera, frame_idx, object_id, p AS previous_frame_idx, frame_idx - p AS frame_gap, round(iou, 6) AS iou, round(jump, 6) AS center_jump, round(ratio, 6) AS area_ratio,
       coalesce(iou < 0.05, false) AS low_iou, coalesce(jump > 0.15, false) AS center_jumped, coalesce(ratio > 3, false) AS area_jumped, p_x0 IS NOT NULL AND x0 IS NULL AS disappeared, p_x0 IS NULL AND x0 IS NOT NULL AS reappeared
FROM m WHERE coalesce(iou < 0.05, false) OR coalesce(jump > 0.15, false) OR coalesce(ratio > 3, false) OR (p_x0 IS NULL) <> (x0 IS NULL)""")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    dense = D.skeleton(view(spark, sf, "v_frames"), objects(spark), D.best(view(spark, sf, "v_detections"), TIES).drop("task_id"))
    out = D.temporal(dense).where("suspicious")
    rounded = [F.round(c, 6).alias(c) for c in ("iou", "center_jump", "area_ratio")]
    return out.select("episode_id", "camera", "frame_idx", "object_id", "previous_frame_idx", "frame_gap", *rounded, "low_iou", "center_jumped", "area_jumped", "disappeared", "reappeared")


@query("temporal_rollup", f"""
WITH levels AS (SELECT * FROM (VALUES (CAST(0.2 AS DOUBLE)), (0.25), (0.3), (0.35), (0.4)) AS t(threshold)),
hits AS (SELECT episode_id, camera, frame_idx, object_id, threshold, count(*) AS hits FROM v_detections JOIN levels ON confidence >= threshold GROUP BY ALL),
dense AS (
  SELECT f.episode_id, f.task_id, f.camera, f.frame_idx, o.object_id, l.threshold, coalesce(h.hits, 0) AS hits, d.x0, d.y0, d.x1, d.y1, d.confidence AS score
  FROM v_frames f JOIN {OBJECTS} o ON f.task_id = o.task_id CROSS JOIN levels l
  LEFT JOIN v_top d ON d.episode_id = f.episode_id AND d.camera = f.camera AND d.frame_idx = f.frame_idx AND d.object_id = o.object_id AND d.confidence >= l.threshold
  LEFT JOIN hits h ON h.episode_id = f.episode_id AND h.camera = f.camera AND h.frame_idx = f.frame_idx AND h.object_id = o.object_id AND h.threshold = l.threshold),
moved AS (SELECT *, row_number() OVER w > 1 AS later, lag(x0) OVER w AS p_x0, lag(y0) OVER w AS p_y0, lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1 FROM dense WINDOW w AS (PARTITION BY episode_id, camera, object_id, threshold ORDER BY frame_idx)),
m AS (SELECT *, CASE WHEN later AND x0 IS NOT NULL AND p_x0 IS NOT NULL THEN {_MIOU} END AS iou, CASE WHEN later AND x0 IS NOT NULL AND p_x0 IS NOT NULL THEN {_JUMP} END AS jump, CASE WHEN later AND x0 IS NOT NULL AND p_x0 IS NOT NULL THEN {_RATIO} END AS ratio FROM moved),
g AS (SELECT *, coalesce(iou < 0.05, false) AS f1, coalesce(jump > 0.15, false) AS f2, coalesce(ratio > 3, false) AS f3, later AND p_x0 IS NOT NULL AND x0 IS NULL AS f4, later AND p_x0 IS NULL AND x0 IS NOT NULL AS f5 FROM m),
r AS (SELECT task_id, camera, object_id, threshold, count(*) AS frames, count(x0) AS detected_frames, count(*) FILTER (hits > 1) AS multi_frames, count(*) FILTER (later) AS transitions,
  count(*) FILTER (f1) AS low_iou, count(*) FILTER (f2) AS center_jumped, count(*) FILTER (f3) AS area_jumped, count(*) FILTER (f4) AS disappeared, count(*) FILTER (f5) AS reappeared, count(*) FILTER (f1 OR f2 OR f3 OR f4 OR f5) AS suspicious,
  round(quantile_cont(iou, 0.5), 6) AS iou_median, round(quantile_cont(iou, 0.95), 6) AS iou_p95, round(quantile_cont(jump, 0.5), 6) AS jump_median, round(quantile_cont(jump, 0.95), 6) AS jump_p95,
  round(quantile_cont(ratio, 0.5), 6) AS ratio_median, round(quantile_cont(ratio, 0.95), 6) AS ratio_p95, round(quantile_cont(score, 0.5), 6) AS score_median, round(quantile_cont(score, 0.95), 6) AS score_p95 FROM g GROUP BY ALL)
SELECT *, round(detected_frames / frames, 6) AS detected_share, round(suspicious / greatest(1, transitions), 6) AS suspicious_share FROM r""")
def temporal_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return D.rollup(D.by_threshold(view(spark, sf, "v_frames"), objects(spark), view(spark, sf, "v_detections"), TIES))


@query("j1_ledger_join", "SELECT d.camera, count(*) AS rows_, count(f.frame_idx) AS in_ledger FROM v_detections d LEFT JOIN v_frames f ON d.episode_id = f.episode_id AND d.camera = f.camera AND d.frame_idx = f.frame_idx AND d.task_id = f.task_id GROUP BY ALL")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    ledger = view(spark, sf, "v_frames").withColumn("known", F.lit(1))
    return view(spark, sf, "v_detections").join(ledger, ["episode_id", "camera", "frame_idx", "task_id"], "left").groupBy("camera").agg(F.count("*").alias("rows_"), F.count("known").alias("in_ledger"))


@query("w21_neighbour_support", f"""
WITH k AS (SELECT * FROM v_top WHERE frame_idx % 10 = 0 AND confidence >= 0.30),
near AS (SELECT DISTINCT a.episode_id, a.camera, a.frame_idx, a.object_id FROM k a JOIN k b ON a.episode_id = b.episode_id AND a.camera = b.camera AND a.object_id = b.object_id AND a.frame_idx <> b.frame_idx AND abs(a.frame_idx - b.frame_idx) <= 11 AND {_O['iou']} >= 0.15)
SELECT k.camera, k.object_id, count(*) AS keyframes, count(*) FILTER (n.frame_idx IS NOT NULL OR k.confidence >= 0.55) AS supported FROM k LEFT JOIN near n ON k.episode_id = n.episode_id AND k.camera = n.camera AND k.frame_idx = n.frame_idx AND k.object_id = n.object_id GROUP BY ALL""")
def w21(spark: SparkSession, sf: str) -> DataFrame:
    keyframes = view(spark, sf, "v_top").where("frame_idx % 10 = 0 AND confidence >= 0.30")
    return D.supported(keyframes).groupBy("camera", "object_id").agg(F.count("*").alias("keyframes"), F.count_if("supported").alias("supported"))


@query("w22_detector_misses", f"""
WITH {_DENSE},
i AS (SELECT *, sum(CASE WHEN confidence >= 0.40 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id, camera, object_id ORDER BY frame_idx) AS island FROM dense),
m AS (SELECT *, sum(CASE WHEN confidence >= 0.40 THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id, camera, object_id, island ORDER BY frame_idx) AS misses FROM i)
SELECT episode_id, camera, object_id, CAST(max(misses) AS BIGINT) AS longest, count(*) FILTER (misses >= 3) AS frames_lost FROM m GROUP BY ALL""")
def w22(spark: SparkSession, sf: str) -> DataFrame:
    dense = D.skeleton(view(spark, sf, "v_frames"), objects(spark), view(spark, sf, "v_top").drop("task_id"))
    out = D.misses(dense, F.coalesce(F.col("confidence") >= 0.40, F.lit(False)))
    return out.groupBy("episode_id", "camera", "object_id").agg(F.max("misses").alias("longest"), F.count_if(F.col("misses") >= 3).alias("frames_lost"))


def _nms_sql(drop: str, most: str = "true") -> str:
    box, kept = "{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}", _sql("k", "o")["iou"]
    key = "episode_id camera frame_idx object_id".split()
    return f"""
WITH RECURSIVE o AS (SELECT {", ".join(key)}, x0, y0, x1, y1, row_number() OVER (PARTITION BY {", ".join(key)} ORDER BY confidence DESC, t1, t2, t3, t4, t5, t6) AS n FROM v_detections),
fold AS (SELECT {", ".join("o." + k for k in key)}, n, [{box}] AS kept FROM o WHERE n = 1
 UNION ALL SELECT {", ".join("o." + k for k in key)}, o.n, CASE WHEN {most} AND len(list_filter(f.kept, lambda k: {kept} {drop})) = 0 THEN list_append(f.kept, {box}) ELSE f.kept END
  FROM fold f JOIN o ON {" AND ".join(f"f.{k} = o.{k}" for k in key)} AND o.n = f.n + 1),
last AS (SELECT {", ".join(key)}, arg_max(len(kept), n) AS kept FROM fold GROUP BY ALL)
SELECT camera, object_id, CAST(sum(kept) AS BIGINT) AS kept FROM last GROUP BY ALL"""


@query("w27_class_nms", _nms_sql("> 0.5"))
def w27(spark: SparkSession, sf: str) -> DataFrame:
    out = D.suppress(view(spark, sf, "v_detections"), [*D.FRAME, "object_id"], TIES, iou=0.5, strict=True)
    return out.groupBy("camera", "object_id").agg(F.count("*").alias("kept"))


@query("w28_robot_nms", _nms_sql(">= 0.65", "len(f.kept) < 4"))
def w28(spark: SparkSession, sf: str) -> DataFrame:
    out = D.suppress(view(spark, sf, "v_detections"), [*D.FRAME, "object_id"], TIES, iou=0.65, most=4)
    return out.groupBy("camera", "object_id").agg(F.count("*").alias("kept"))


@query("f10_crop_boxes", """
WITH c AS (SELECT *, greatest(2, CAST(round_even(0.04::DOUBLE * greatest(x1 - x0, y1 - y0), 0) AS INT)) AS pad FROM v_top)
SELECT camera, object_id, CAST(sum(greatest(0, x0 - pad)) AS DOUBLE) AS sx0, CAST(sum(greatest(0, y0 - pad)) AS DOUBLE) AS sy0, CAST(sum(least(640, x1 + pad)) AS DOUBLE) AS sx1, CAST(sum(least(360, y1 + pad)) AS DOUBLE) AS sy1,
       CAST(sum(greatest(0, trunc(x0 - 0.04::DOUBLE * (x1 - x0)))) AS BIGINT) AS ax0, CAST(sum(least(640, trunc(x1 + 0.04::DOUBLE * (x1 - x0)))) AS BIGINT) AS ax1,
       CAST(sum(greatest(0, trunc(y0 - 0.04::DOUBLE * (y1 - y0)))) AS BIGINT) AS ay0, CAST(sum(least(360, trunc(y1 + 0.04::DOUBLE * (y1 - y0)))) AS BIGINT) AS ay1,
       round(avg(x0) * (426.0::DOUBLE / 640), 3) AS rx0, round(max(x1 * (426.0::DOUBLE / 640)), 3) AS rx1, round(max(y1 * (240.0::DOUBLE / 360)), 3) AS ry1
FROM c GROUP BY ALL""")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    top = view(spark, sf, "v_top")
    c, a, r = boxes.crop(boxes.box(), 640, 360), boxes.appearance_crop(boxes.box(), 640, 360), boxes.rescale(boxes.box(), (640, 360), (426, 240))
    names = ("sx0", "sy0", "sx1", "sy1")
    return top.groupBy("camera", "object_id").agg(*[F.sum(v).cast("double").alias(n) for n, v in zip(names, c)], F.sum(a[0]).cast("long").alias("ax0"), F.sum(a[2]).cast("long").alias("ax1"), F.sum(a[1]).cast("long").alias("ay0"), F.sum(a[3]).cast("long").alias("ay1"), F.round(F.avg("x0") * (426.0 / 640), 3).alias("rx0"), F.round(F.max(r[2]), 3).alias("rx1"), F.round(F.max(r[3]), 3).alias("ry1"))


@query("r13_best_per_review", "SELECT object_id, frame_idx, max(confidence) AS confidence, count(*) AS candidates FROM v_detections WHERE confidence >= 0.15 GROUP BY ALL")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_detections").where("confidence >= 0.15").groupBy("object_id", "frame_idx").agg(F.max("confidence").alias("confidence"), F.count("*").alias("candidates"))


@query("src5_frame_stride", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, camera ORDER BY frame_idx) AS n FROM v_frames WHERE frame_idx % 5 = 0) SELECT episode_id, camera, frame_idx FROM r WHERE n <= 12")
def src5(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.sources.episodes import stride

    return stride(view(spark, sf, "v_frames"), 5, 12).select("episode_id", "camera", "frame_idx")


@query("st1_chunks", "WITH c AS (SELECT episode_id, camera, frame_idx, (row_number() OVER (PARTITION BY episode_id, camera ORDER BY frame_idx) - 1) // 24 AS chunk FROM v_frames), s AS (SELECT *, false AS shared FROM c UNION ALL SELECT episode_id, camera, frame_idx, chunk + 1, true FROM c QUALIFY row_number() OVER (PARTITION BY episode_id, camera, chunk ORDER BY frame_idx DESC) = 1 AND chunk < max(chunk) OVER (PARTITION BY episode_id, camera)) SELECT episode_id, camera, chunk, count(*) AS frames, count(*) FILTER (NOT shared) AS emitted, min(frame_idx) AS first, max(frame_idx) AS last FROM s GROUP BY ALL")
def st1(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators.sequences import chunk

    out = chunk(view(spark, sf, "v_frames"), 24)
    return out.groupBy("episode_id", "camera", "chunk").agg(F.count("*").alias("frames"), F.count_if(~F.col("shared")).alias("emitted"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))


@query("st2_keyframes", "WITH c AS (SELECT episode_id, camera, frame_idx, row_number() OVER (PARTITION BY episode_id, camera ORDER BY frame_idx) - 1 AS n FROM v_frames), k AS (SELECT *, n % 24 AS inner_, n // 24 AS chunk FROM c) SELECT episode_id, camera, frame_idx, inner_ % 10 = 0 OR inner_ = max(inner_) OVER (PARTITION BY episode_id, camera, chunk) AS keyframe FROM k")
def st2(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.operators.sequences import keyframes

    return keyframes(view(spark, sf, "v_frames"), 24, 10).select("episode_id", "camera", "frame_idx", "keyframe")
