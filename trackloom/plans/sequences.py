"""Queries over state machines and streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import boxes
from trackloom.operators import machines as M
from trackloom.operators import rules as L
from trackloom.plans.detection import _sql
from trackloom.registry import query
from trackloom.sources.fixtures import view

KEYS = ["clip_id", "object_id"]


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """What a track's driver sees at each sample."""
    i = F.col("sample_id")
    x = view(spark, sf, "v_vis")
    return x.select(
        "clip_id", "object_id", "frame_idx", "sample_id", F.coalesce("pred_visible", F.lit(False)).alias("candidate"), F.coalesce("pred_visible", F.lit(False)).alias("hit"),
        (i % 13 == 0).alias("tiny"), (F.col("iou") < 0.05).alias("severe"), ((i % 97) / 97).alias("presence"), F.col("gt_visibility").isin("fully_occluded", "out_of_view").alias("empty"),
        F.when(i % 7 != 0, F.col("iou")).alias("agreement"), F.col("iou").alias("confirm"), F.col("iou").alias("confidence"), (F.col("frame_idx") % 10 == 0).alias("keyframe"), (F.col("frame_idx") < 5).alias("first"),
        (F.coalesce("pred_visible", F.lit(False)) & (F.col("iou") >= 0.3)).alias("admitted"), F.when(i % 9 == 0, F.when(i % 2 == 0, "visible").otherwise("not_visible")).alias("prompt"))


@query("st3_termination", """
WITH o AS (SELECT *, coalesce(pred_visible, false) AS hit, gt_visibility IN ('fully_occluded', 'out_of_view') AS empty_ FROM v_vis),
i AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN empty_ THEN 0 ELSE 1 END) OVER w AS b FROM o WINDOW w AS (PARTITION BY clip_id, object_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, object_id, a ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS misses, sum(CASE WHEN empty_ THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, object_id, b ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS empties FROM i)
SELECT sample_id, CASE WHEN misses >= 3 THEN CASE WHEN empties >= 3 THEN 'lost_empty_no_detector_support' WHEN sample_id % 13 = 0 THEN 'suspected_out_of_view_residue' WHEN iou < 0.05 AND (sample_id % 97) / 97 < 0.5 THEN 'lost_unreliable_no_detector_support' END END AS reason FROM m""")
def st3(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy(*KEYS).orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)
    x = observations(spark, sf).withColumn("a", F.sum(F.col("hit").cast("int")).over(w)).withColumn("b", F.sum((~F.col("empty")).cast("int")).over(w))

    def streak(c: Column, island: str) -> Column:
        return F.sum(c.cast("int")).over(W.partitionBy(*KEYS, island).orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0))

    reason = M.termination(streak(~F.col("hit"), "a"), streak(F.col("empty"), "b"), F.col("tiny"), F.col("severe"), F.col("presence"))
    return x.select("sample_id", reason.alias("reason"))


@query("st4_check_schedule", "SELECT sample_id, CASE WHEN frame_idx = 0 THEN 'initial' WHEN frame_idx % 5 <> 0 OR sample_id % 31 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN frame_idx % 15 = 0 THEN 'periodic_identity_check' END, CASE WHEN pred_visible IS NULL THEN 'unseeded_or_terminated_search' END, CASE WHEN iou < 0.05 THEN 'temporal_or_overlap_warning' END], lambda r: r IS NOT NULL), ',') END AS reasons FROM v_vis")
def st4a(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "v_vis")
    due = M.check_due(F.col("frame_idx"), F.col("sample_id") % 31 == 0, F.col("pred_visible").isNull(), F.col("iou") < 0.05)
    return x.select("sample_id", F.array_join(due, ",").alias("reasons"))


@query("st4_recovery_loop")
def st4(spark: SparkSession, sf: str) -> DataFrame:
    return M.run(observations(spark, sf), KEYS, M.recover)


@query("st6_guarded_replace")
def st6a(spark: SparkSession, sf: str) -> DataFrame:
    return M.run(observations(spark, sf), KEYS, partial(M.guard, mode="guarded_replace"))


@query("st6_guarded_all")
def st6b(spark: SparkSession, sf: str) -> DataFrame:
    return M.run(observations(spark, sf), KEYS, partial(M.guard, mode="guarded_all"))


@query("st6_assisted", "SELECT clip_id, object_id, frame_idx, CASE WHEN sample_id % 9 <> 0 THEN 'keep' WHEN sample_id % 2 = 0 THEN 'seed' ELSE 'clear_unknown' END AS action FROM v_vis")
def st6c(spark: SparkSession, sf: str) -> DataFrame:
    return M.run(observations(spark, sf), KEYS, partial(M.guard, mode="assisted")).select(*KEYS, "frame_idx", "action")


@query("st7_dense_driver", """
WITH RECURSIVE o AS (
  SELECT clip_id, object_id, frame_idx, coalesce(pred_visible, false) AS hit, sample_id % 13 = 0 AS tiny, coalesce(iou < 0.05, false) OR sample_id % 13 = 0 AS odd,
    (sample_id % 97) / 97 < 0.5 AS low, coalesce(iou >= 0.5, false) AS sure, frame_idx % 10 = 0 AS keyframe FROM v_vis),
s AS (SELECT *, sum(CASE WHEN keyframe AND hit THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, object_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS streak FROM o),
m AS (SELECT *, sum(CASE WHEN keyframe AND NOT hit THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, object_id, streak ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) >= 3 AND tiny AND low AS ends FROM s),
asked AS (SELECT clip_id, frame_idx, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS n FROM (SELECT DISTINCT clip_id, frame_idx FROM m WHERE odd AND NOT ends AND NOT keyframe) AS d),
fold AS (
  SELECT clip_id, frame_idx, n, frame_idx AS last, true AS look FROM asked WHERE n = 1
  UNION ALL
  SELECT a.clip_id, a.frame_idx, a.n, CASE WHEN a.frame_idx - f.last >= 10 THEN a.frame_idx ELSE f.last END, a.frame_idx - f.last >= 10
  FROM fold f JOIN asked a ON f.clip_id = a.clip_id AND a.n = f.n + 1),
acts AS (
  SELECT m.*, CASE WHEN ends THEN 'terminate' WHEN look AND odd AND hit AND sure THEN 'seed' ELSE 'keep' END AS action,
    CASE WHEN ends THEN 'low_presence_border_residue_termination' WHEN look AND odd AND hit AND sure THEN 'redetect_reseed' WHEN look AND odd THEN 'anomaly_without_candidate' ELSE 'tracked' END AS reason
  FROM m LEFT JOIN (SELECT clip_id, frame_idx, true AS look FROM fold WHERE look) AS l ON m.clip_id = l.clip_id AND m.frame_idx = l.frame_idx)
SELECT clip_id, object_id, frame_idx, action, reason, coalesce(last_value(CASE action WHEN 'seed' THEN true WHEN 'terminate' THEN false END IGNORE NULLS) OVER w, false) AS active,
  CAST(sum(CASE WHEN action = 'seed' THEN 1 ELSE 0 END) OVER w AS INT) AS segment
FROM acts WINDOW w AS (PARTITION BY clip_id, object_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)""")
def st7(spark: SparkSession, sf: str) -> DataFrame:
    return M.dense(observations(spark, sf), ["clip_id"])


@query("st8_two_arm_trial")
def st8(spark: SparkSession, sf: str) -> DataFrame:
    return M.trial(observations(spark, sf), ["clip_id"])


_P = {k: v.replace("p_.", "p_") for k, v in _sql("p_", "").items()}
_PREV = "SELECT *, lag(frame_idx) OVER w AS p_frame, lag(x0) OVER w AS p_x0, lag(y0) OVER w AS p_y0, lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1 FROM v_top WHERE confidence >= 0.3 WINDOW w AS (PARTITION BY episode_id, camera, object_id ORDER BY frame_idx)"


def _confirmed(spark: SparkSession, sf: str, period: int, least: float) -> DataFrame:
    x = L.confirmed(view(spark, sf, "v_top").where("confidence >= 0.3"), ["episode_id", "camera", "object_id"], period, least)
    return x.groupBy("camera", "object_id").agg(F.count("*").alias("observations"), F.count_if("confirmed").alias("confirmed"))


def _confirm_sql(period: int, least: float) -> str:
    iou = _P["iou"].replace(".x", "x").replace(".y", "y")
    return f"WITH p AS ({_PREV}) SELECT camera, object_id, count(*) AS observations, count(*) FILTER (frame_idx - p_frame <= {period} AND {iou} >= {least}) AS confirmed FROM p GROUP BY ALL"


@query("w19_two_observations", _confirm_sql(15, 0.30))
def w19(spark: SparkSession, sf: str) -> DataFrame:
    return _confirmed(spark, sf, 15, 0.30)


@query("w20_pending_confirmation", _confirm_sql(3, 0.25))
def w20(spark: SparkSession, sf: str) -> DataFrame:
    return _confirmed(spark, sf, 3, 0.25)


@query("a26_repeated_times", "SELECT user_id AS clip_id, count(*) AS samples, count(*) FILTER (d = 0) AS repeated FROM (SELECT user_id, date_trunc('hour', ts) - lag(date_trunc('hour', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) = INTERVAL 0 HOUR AS z, epoch_us(date_trunc('hour', ts)) - lag(epoch_us(date_trunc('hour', ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) AS x GROUP BY ALL")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return L.repeated_times(view(spark, sf, "events").withColumnRenamed("user_id", "clip_id"), "clip_id", F.date_trunc("hour", "ts"), ["ts", "event_id"])


@query("a28_joint_motion", "WITH e AS (SELECT vec_id % 20 AS episode_id, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT episode_id, v, lag(v) OVER (PARTITION BY episode_id ORDER BY vec_id) AS p FROM e) SELECT episode_id, round(sum(list_sum(list_transform(range(8, 15), lambda k: abs(v[k] - p[k])))), 5) AS left_arm, round(sum(list_sum(list_transform(range(16, 23), lambda k: abs(v[k] - p[k])))), 5) AS right_arm, round(max(v[15]) - min(v[15]), 5) AS left_gripper, round(max(v[23]) - min(v[23]), 5) AS right_gripper FROM d GROUP BY ALL")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("episode_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return L.joint_motion(x, "episode_id", "vec_id", "v")


@query("pf9_prompt_validity", "SELECT sample_id, (sample_id % 640 < 600) AND (sample_id % 3 <> 0) AND (sample_id % 11 < 9) AS valid FROM v_vis")
def pf9(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("sample_id")
    x = view(spark, sf, "v_vis").select("sample_id", F.array(F.array(i % 640, i % 360), F.array(F.lit(5), F.lit(6)).cast("array<bigint>")).alias("points"), F.array(F.when(i % 3 != 0, 1).otherwise(0), F.lit(0)).alias("labels"), F.array(i % 11, F.lit(1), F.lit(9), F.lit(20)).alias("box"))
    return x.select("sample_id", L.prompt_valid(F.col("points"), F.col("labels"), F.col("box"), 600, 360).alias("valid"))


@query("f19_scene_intervals", "SELECT sample_id, CASE WHEN frame_idx BETWEEN 30 AND 60 THEN 'partial_occlusion' WHEN frame_idx BETWEEN 0 AND 100 OR frame_idx BETWEEN 150 AND 200 THEN 'visible' ELSE 'unknown' END AS visibility FROM v_vis")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    scenes = [("partial_occlusion", [(30, 60)]), ("visible", [(0, 100), (150, 200)])]
    return view(spark, sf, "v_vis").select("sample_id", L.scene_visibility(F.col("frame_idx"), scenes).alias("visibility"))


@query("r10_priority_layers", "SELECT episode_id, camera, frame_idx, CAST(arg_max(object_id, (priority, object_id)) AS BIGINT) AS owner, count(*) AS claims FROM (SELECT *, (object_id * 3) % 5 AS priority FROM v_top) AS x GROUP BY ALL")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "v_top").withColumn("priority", F.col("object_id") * 3 % 5)
    return x.groupBy("episode_id", "camera", "frame_idx").agg(F.max_by("object_id", F.struct("priority", "object_id")).cast("long").alias("owner"), F.count("*").alias("claims"))


@query("f21_confidence_product", "SELECT sample_id, round(iou * ((sample_id % 97) / 97::DOUBLE), 6) AS confidence FROM v_vis")
def f21(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_vis").select("sample_id", F.round(F.col("iou") * ((F.col("sample_id") % 97) / 97), 6).alias("confidence"))


@query("stream_bundles", "SELECT user_id AS clip_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS triggers FROM events WHERE value < 50 GROUP BY ALL")
def stream_bundles(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.streaming.events import bundles

    return bundles(spark, sf)


@query("stream_sessions", "WITH f AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE event_type IN ('purchase', 'error') AND value >= 50), i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id AS clip_id, epoch_us(min(ts)) AS start_us, count(*) AS samples FROM i GROUP BY user_id, island")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.streaming.events import sessions

    return sessions(spark, sf)


@query("stream_recovery")
def stream_recovery(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.streaming.events import recovery

    return recovery(spark, sf)
