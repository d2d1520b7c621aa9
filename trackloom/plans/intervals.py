"""Queries over seeds, events, exclusions and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators import intervals as I
from trackloom.operators import rules as L
from trackloom.registry import query
from trackloom.sources.fixtures import view

KEYS = ["clip_id", "object_id"]


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_events").select("clip_id", "object_id", "frame_idx", "sample_id", F.col("gt_visibility").alias("visibility"), "pred_visible", "action")


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).where("action = 'seed'").withColumn("seed_frame", F.col("frame_idx"))


@query("j9_seed_intervals", """WITH s AS (SELECT DISTINCT clip_id, object_id, frame_idx AS f FROM v_events WHERE action = 'seed')
SELECT clip_id, object_id, f AS seed_frame, CAST(floor((lag(f) OVER w + f) / 2) AS BIGINT) + 1 AS "start", CAST(floor((f + lead(f) OVER w) / 2) AS BIGINT) AS "end" FROM s WINDOW w AS (PARTITION BY clip_id, object_id ORDER BY f)""")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    return I.seed_intervals(seeds(spark, sf), KEYS)


@query("j10_nearest_seed", """WITH s AS (SELECT DISTINCT clip_id, object_id, frame_idx AS f FROM v_events WHERE action = 'seed')
SELECT e.sample_id, (SELECT s.f FROM s WHERE s.clip_id = e.clip_id AND s.object_id = e.object_id ORDER BY abs(s.f - e.frame_idx), s.f LIMIT 1) AS seed_frame FROM v_events e""")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    return I.nearest_seed(frames(spark, sf), seeds(spark, sf), KEYS).select("sample_id", "seed_frame")


@query("j11_event_as_of", "SELECT sample_id, last_value(CASE WHEN action IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER w AS event_frame, last_value(action IGNORE NULLS) OVER w AS action FROM v_events WINDOW w AS (PARTITION BY clip_id, object_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf)
    return I.as_of(x.drop("action"), x.where("action IS NOT NULL"), KEYS, ["action"]).select("sample_id", "event_frame", "action")


_EXCLUSIONS = "ex AS (SELECT c.range AS clip_id, o.range AS object_id, 20 * k.range AS s, 20 * k.range + 25 AS e, 'r' || k.range AS reason, k.range AS ordinal FROM range(150) AS c, range(5) AS o, range(3) AS k WHERE (c.range + o.range) % 4 = k.range)"


def exclusions(spark: SparkSession) -> DataFrame:
    x = spark.range(150).select(F.col("id").alias("clip_id")).join(spark.range(5).select(F.col("id").alias("object_id")).hint("broadcast")).join(spark.range(3).select(F.col("id").alias("ordinal")).hint("broadcast"))
    x = x.where((F.col("clip_id") + F.col("object_id")) % 4 == F.col("ordinal"))
    return x.select("clip_id", "object_id", (20 * F.col("ordinal")).alias("start"), (20 * F.col("ordinal") + 25).alias("end"), F.concat(F.lit("r"), F.col("ordinal")).alias("reason"), "ordinal")


@query("j12_exclusions", f"WITH {_EXCLUSIONS} SELECT v.sample_id, arg_min(ex.reason, ex.ordinal) AS reason FROM v_events v LEFT JOIN ex ON v.clip_id = ex.clip_id AND v.object_id = ex.object_id AND v.frame_idx BETWEEN ex.s AND ex.e GROUP BY ALL")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    return I.excluded(frames(spark, sf), exclusions(spark), KEYS).select("sample_id", "reason")


_REPAIR = "SELECT sample_id, CASE WHEN status = 'visible' THEN event_frame END AS segment_start, CASE WHEN status IS NULL OR status = 'visible' THEN gt_visibility ELSE 'unknown' END AS repaired_visibility FROM (SELECT *, last_value(CASE WHEN action IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER w AS event_frame, last_value(CASE action WHEN 'seed' THEN 'visible' WHEN 'clear' THEN 'not_visible' END IGNORE NULLS) OVER w AS status FROM v_events WINDOW w AS (PARTITION BY clip_id, object_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)) AS x"


def repaired(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf)
    prompts = x.where("action IS NOT NULL").withColumn("status", F.when(F.col("action") == "seed", "visible").otherwise("not_visible"))
    return I.repaired(x.drop("action"), prompts, KEYS)


@query("st9_interval_repair", _REPAIR)
def st9(spark: SparkSession, sf: str) -> DataFrame:
    return repaired(spark, sf).select("sample_id", "segment_start", "repaired_visibility")


@query("st10_seam_edits", f"WITH {_EXCLUSIONS} SELECT v.sample_id, CASE WHEN count(ex.reason) > 0 THEN 'unknown' ELSE v.gt_visibility END AS visibility, count(ex.reason) > 0 AS touched FROM v_events v LEFT JOIN ex ON v.clip_id = ex.clip_id AND v.object_id = ex.object_id AND v.frame_idx BETWEEN ex.s AND ex.e GROUP BY v.sample_id, v.gt_visibility")
def st10(spark: SparkSession, sf: str) -> DataFrame:
    return I.seams(frames(spark, sf), exclusions(spark).drop("reason", "ordinal"), KEYS).select("sample_id", "visibility", "touched")


@query("st11_repair_overlay", "SELECT sample_id, CASE WHEN clip_id % 5 = 2 AND frame_idx BETWEEN 50 AND 120 THEN 'visible' ELSE gt_visibility END AS visibility FROM v_events")
def st11(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).drop("action")
    window = x.where("clip_id % 5 = 2 AND frame_idx BETWEEN 50 AND 120").withColumn("visibility", F.lit("visible"))
    return I.overlaid(x, window, ["sample_id"], ["visibility"]).select("sample_id", "visibility")


@query("j17_untouched_rows", "SELECT sample_id, 'changed' AS problem FROM v_events WHERE sample_id % 50 = 7 AND clip_id % 5 <> 2 AND gt_visibility <> 'visible'")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf)
    after = x.withColumn("visibility", F.when(F.col("sample_id") % 50 == 7, "visible").otherwise(F.col("visibility")))
    return I.changed_rows(x, after, ["sample_id"], x.where("clip_id % 5 = 2"))


@query("j18_equal_before_second_seed", """
WITH s AS (SELECT clip_id, object_id, min(frame_idx) FILTER (n = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, object_id ORDER BY frame_idx) AS n FROM v_events WHERE action = 'seed') AS q GROUP BY ALL),
single AS (SELECT sample_id, clip_id, object_id, frame_idx, gt_visibility FROM v_events),
multi AS (SELECT sample_id, clip_id, object_id, frame_idx, CASE WHEN sample_id % 40 = 11 THEN 'fully_occluded' ELSE gt_visibility END AS gt_visibility FROM v_events WHERE sample_id % 50 <> 13)
SELECT a.clip_id, a.object_id, count(*) FILTER (b.gt_visibility = a.gt_visibility) AS equal, count(*) FILTER (b.gt_visibility IS DISTINCT FROM a.gt_visibility) AS differing
FROM single a JOIN s ON a.clip_id = s.clip_id AND a.object_id = s.object_id AND a.frame_idx < s.second LEFT JOIN multi b ON a.sample_id = b.sample_id GROUP BY ALL""")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of one clip must agree before the second seed, but for the mode; the second run here lacks rows and has others changed."""
    x = frames(spark, sf)
    n = F.row_number().over(W.partitionBy(*KEYS).orderBy("frame_idx"))
    second = x.where("action = 'seed'").withColumn("n", n).where("n = 2").select(*KEYS, F.col("frame_idx").alias("second"))
    single = x.select("sample_id", *KEYS, "frame_idx", "visibility", F.lit("single").alias("mode"))
    changed = F.when(F.col("sample_id") % 40 == 11, "fully_occluded").otherwise(F.col("visibility"))
    multi = single.where("sample_id % 50 <> 13").withColumn("visibility", changed).withColumn("mode", F.lit("multi"))
    differ = I.differing_before(single, multi, second, KEYS)
    early = single.join(second, KEYS).where("frame_idx < second").join(differ.select("sample_id", F.lit(1).alias("d")), "sample_id", "left")
    return early.groupBy(*KEYS).agg(F.count_if(F.col("d").isNull()).alias("equal"), F.count("d").alias("differing"))


_LADDER = """WITH r AS (SELECT doc_id, reliable, excluded, reviewed, doc_id % 1200 AS object_id, doc_id % 17 = 0 AS seed, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 <> 1 END AS visible, n_chars > 300 AS has_pixels, doc_id % 13 = 0 AS held, doc_id % 11 = 3 AS absent, doc_id % 29 = 5 AS incomplete FROM v_review),
d AS (SELECT *, CASE WHEN held THEN 'interval_unknown' WHEN absent AND NOT (seed AND coalesce(visible, false)) THEN 'reviewed_absent' WHEN coalesce(excluded, false) THEN 'unreliable_excluded'
  WHEN coalesce(reliable, false) AND coalesce(visible, false) AND has_pixels THEN 'eligible' WHEN coalesce(reliable, false) AND coalesce(visible, false) THEN 'unresolved'
  WHEN object_id < 1000 AND NOT absent AND NOT (seed AND coalesce(NOT visible, false)) THEN 'unresolved' ELSE 'kept' END AS decision FROM r),
u AS (SELECT *, CASE WHEN decision IN ('interval_unknown', 'unreliable_excluded') THEN object_id < 1000 ELSE decision = 'unresolved' END OR incomplete AS unresolved FROM d)"""


def ladder(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    x = view(spark, sf, "v_review").select(
        "doc_id", "lang", (i % 1200).alias("object_id"), (i % 17 == 0).alias("seed"), F.when(i % 5 != 0, i % 5 != 1).alias("visible"), (F.col("n_chars") > 300).alias("has_pixels"),
        F.when(i % 13 == 0, "held").alias("interval_reason"), (i % 11 == 3).alias("absent"), F.coalesce("excluded", F.lit(False)).alias("exclude"), F.coalesce("reliable", F.lit(False)).alias("allow"), (i % 29 == 5).alias("incomplete"))
    return I.release(x)


@query("r6_release_ladder", f"{_LADDER} SELECT doc_id, decision, unresolved, decision = 'eligible' AS training_eligible FROM u")
def r6(spark: SparkSession, sf: str) -> DataFrame:
    return ladder(spark, sf).select("doc_id", "decision", "unresolved", "training_eligible")


@query("a22_release_counters", f"{_LADDER} SELECT doc_id % 64 AS clip_id, count(*) AS rows_, count(*) FILTER (decision = 'eligible') AS eligible, count(*) FILTER (unresolved) AS unresolved FROM u GROUP BY ALL")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    return ladder(spark, sf).groupBy((F.col("doc_id") % 64).alias("clip_id")).agg(F.count("*").alias("rows_"), F.count_if("training_eligible").alias("eligible"), F.count_if("unresolved").alias("unresolved"))


@query("a21_split_counters", "SELECT lang, source, count(*) AS clips FROM documents GROUP BY ALL")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("clips"))


@query("r8_accepted_positives", "SELECT sample_id, CASE WHEN gt_visibility IN ('visible', 'partial_occlusion') THEN 'accepted positive changed' ELSE 'accepted negative discrepancy' END AS problem FROM v_events WHERE action IS NOT NULL AND gt_visibility <> 'unknown' AND coalesce(pred_visible, false) <> (gt_visibility IN ('visible', 'partial_occlusion'))")
def r8(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf)
    s = x.where("action IS NOT NULL AND visibility <> 'unknown'").select("sample_id", F.col("visibility").isin("visible", "partial_occlusion").alias("visible"))
    return I.contradictions(s, x.select("sample_id", F.col("pred_visible").alias("visible")), ["sample_id"])


@query("j16_expected_keys", "SELECT sample_id, 'missing' AS problem FROM v_events WHERE sample_id % 100 = 1 UNION ALL SELECT sample_id, 'extra' FROM v_events WHERE sample_id % 100 = 2")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).select("sample_id")
    return I.missing_and_extra(x.where("sample_id % 100 <> 2"), x.where("sample_id % 100 <> 1"), ["sample_id"])


@query("j22_prompt_coverage", "SELECT clip_id, object_id FROM (SELECT DISTINCT clip_id, object_id FROM v_events) AS a WHERE NOT EXISTS (SELECT 1 FROM v_events s WHERE s.clip_id = a.clip_id AND s.object_id = a.object_id AND s.action = 'seed' AND s.sample_id % 2 = 0)")
def j22(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf)
    return x.select(*KEYS).distinct().join(x.where("action = 'seed' AND sample_id % 2 = 0").select(*KEYS), KEYS, "left_anti")


@query("set1_key_sets", """
WITH e AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), f AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 10 <> 4)
SELECT (SELECT count(*) FROM e WHERE h NOT IN (SELECT h FROM f)) AS missing, (SELECT count(*) FROM f WHERE h NOT IN (SELECT h FROM e)) AS extra, (SELECT count(*) FROM e) AS keys""")
def set1(spark: SparkSession, sf: str) -> DataFrame:
    """Expected keys lack a tenth of the documents, those found another tenth; equal texts make some keys of both appear all the same."""
    x = view(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    expected, found = x.where("doc_id % 10 <> 3").select("h").distinct(), x.where("doc_id % 10 <> 4").select("h").distinct()
    both = I.missing_and_extra(expected, found, ["h"])
    counts = both.agg(F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem") == "extra").alias("extra"))
    return expected.agg(F.count("*").alias("keys")).join(counts.hint("broadcast"))


@query("set2_duplicates", "SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def set2(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies")).where("copies > 1")


@query("set3_mode_union", "SELECT mode, gt_visibility, count(*) AS rows_ FROM (SELECT 'a' AS mode, gt_visibility FROM v_events WHERE sample_id % 2 = 0 UNION ALL SELECT 'b', gt_visibility FROM v_events WHERE sample_id % 3 = 0) AS x GROUP BY ALL")
def set3(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf)
    a, b = x.where("sample_id % 2 = 0").withColumn("mode", F.lit("a")), x.where("sample_id % 3 = 0").withColumn("mode", F.lit("b")).drop("action")
    return a.unionByName(b, allowMissingColumns=True).groupBy("mode", F.col("visibility").alias("gt_visibility")).agg(F.count("*").alias("rows_"))


@query("set4_subsets", "SELECT clip_id, count(DISTINCT object_id) FILTER (action = 'seed') AS seeded, count(DISTINCT object_id) FILTER (action = 'seed') = count(DISTINCT object_id) AS complete FROM v_events GROUP BY ALL")
def set4(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).groupBy("clip_id").agg(F.collect_set("object_id").alias("every"), F.collect_set(F.when(F.col("action") == "seed", F.col("object_id"))).alias("seeded"))
    return x.select("clip_id", F.size("seeded").cast("long").alias("seeded"), (F.size(F.array_except("every", "seeded")) == 0).alias("complete"))


@query("set5_reference_precedence", "WITH c AS (SELECT object_id, max(frame_idx) AS f FROM v_events WHERE action = 'clear' AND object_id < 4 GROUP BY ALL), r AS (SELECT object_id, min(frame_idx) AS f FROM v_events WHERE action = 'seed' AND object_id > 1 GROUP BY ALL) SELECT coalesce(r.object_id, c.object_id) AS object_id, coalesce(r.f, c.f) AS frame_idx FROM c FULL JOIN r ON c.object_id = r.object_id")
def set5(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf)
    c = x.where("action = 'clear' AND object_id < 4").groupBy("object_id").agg(F.max("frame_idx").alias("c"))
    r = x.where("action = 'seed' AND object_id > 1").groupBy("object_id").agg(F.min("frame_idx").alias("r"))
    return c.join(r, "object_id", "full").select("object_id", F.coalesce("r", "c").alias("frame_idx"))


@query("f13_content_hashes", "SELECT doc_id AS path, CASE WHEN doc_id % 20 = 1 THEN 'changed' WHEN doc_id % 20 = 2 THEN 'missing' ELSE 'unlisted' END AS problem FROM documents WHERE doc_id % 20 IN (1, 2, 3)")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.sources.episodes import hash_mismatches

    x = view(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    listed = x.where("path % 20 <> 3").withColumn("sha256", F.when(F.col("path") % 20 == 1, "0").otherwise(F.col("sha256")))
    return hash_mismatches(listed, x.where("path % 20 <> 2"))


@query("j19_backend_comparison", """
WITH a AS (SELECT sample_id, gt_visibility, pred_visible FROM v_events WHERE sample_id % 10 <> 1), b AS (SELECT sample_id, gt_visibility, iou >= 0.5 AS pred_visible FROM v_events WHERE sample_id % 10 <> 2)
SELECT coalesce(a.gt_visibility, b.gt_visibility) AS gt_visibility, count(*) AS frames, count(*) FILTER (a.pred_visible = b.pred_visible) AS agree, count(*) FILTER (a.sample_id IS NULL OR b.sample_id IS NULL) AS unmatched
FROM a FULL JOIN b ON a.sample_id = b.sample_id GROUP BY ALL""")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    """Each of two backends lacks a tenth of the frames; a frame of only one is unmatched."""
    x = view(spark, sf, "v_events")
    a = x.where("sample_id % 10 <> 1").select("sample_id", "gt_visibility", "pred_visible")
    b = x.where("sample_id % 10 <> 2").select("sample_id", "gt_visibility", (F.col("iou") >= 0.5).alias("pred_visible"))
    return L.compared_backends(a, b, "sample_id", "gt_visibility", "pred_visible")


@query("a15_event_counter", "SELECT camera, action, gt_visibility AS reason, count(*) AS n FROM (SELECT e.*, v.camera FROM v_events e JOIN v_vis v ON e.sample_id = v.sample_id) AS x WHERE action IS NOT NULL GROUP BY ALL")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).join(view(spark, sf, "v_vis").select("sample_id", "camera"), "sample_id")
    return L.event_counts(x.withColumn("reason", F.col("visibility")), ["camera", "reason"])


@query("a14_canary_summary", "SELECT object_id, count(*) AS frames, count(*) FILTER (pred_visible IS NULL) AS unknown, round(avg(CAST(pred_visible = (gt_visibility IN ('visible', 'partial_occlusion')) AS INT)), 6) AS presence_accuracy FROM v_events WHERE gt_visibility <> 'unknown' GROUP BY ALL")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    x = frames(spark, sf).where("visibility <> 'unknown'")
    right = (F.col("pred_visible") == F.col("visibility").isin("visible", "partial_occlusion")).cast("double")
    return x.groupBy("object_id").agg(F.count("*").alias("frames"), F.count_if(F.col("pred_visible").isNull()).alias("unknown"), F.round(F.avg(right), 6).alias("presence_accuracy"))


@query("src11_clip_violations", "SELECT clip_id, 'too many frames' AS violation FROM v_events GROUP BY clip_id HAVING count(*) > 64 UNION ALL SELECT DISTINCT clip_id, 'path escapes' FROM v_events WHERE sample_id % 1000 = 5")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.sources.episodes import clip_violations

    n = F.row_number().over(W.partitionBy("clip_id").orderBy("frame_idx")) - 1
    image = F.when(F.col("sample_id") % 1000 == 5, "../x.png").otherwise("rgb/x.png")
    x = frames(spark, sf).select("clip_id", n.alias("local_frame_idx"), F.col("frame_idx").alias("source_frame_idx"), image.alias("image"))
    return clip_violations(x, 64)


@query("src12_seed_violations", "SELECT clip_id, object_id, frame_idx AS local_frame_idx, unnest(list_filter([CASE WHEN sample_id % 4 = 0 THEN 'not reviewed' END, CASE WHEN sample_id % 7 = 0 THEN 'image hash' END, CASE WHEN pred_area <= 30 THEN 'empty mask' END], lambda v: v IS NOT NULL)) AS violation FROM (SELECT e.*, greatest(0, v.pred_area - 30) AS a, v.pred_area FROM v_events e JOIN v_vis v ON e.sample_id = v.sample_id WHERE action = 'seed') AS x")
def src12(spark: SparkSession, sf: str) -> DataFrame:
    from trackloom.sources.episodes import seed_violations

    x = frames(spark, sf).join(view(spark, sf, "v_vis").select("sample_id", "pred_area"), "sample_id")
    own = x.select("clip_id", F.col("frame_idx").alias("local_frame_idx"), F.col("frame_idx").alias("source_frame_idx"), F.lit("a").alias("image_sha256"))
    s = x.where("action = 'seed'").select(
        "clip_id", "object_id", F.col("frame_idx").alias("local_frame_idx"), F.col("frame_idx").alias("source_frame_idx"), (F.col("sample_id") % 4 != 0).alias("reviewed"),
        F.when(F.col("sample_id") % 7 == 0, "b").otherwise("a").alias("source_image_sha256"), F.greatest(F.lit(0), F.col("pred_area") - 30).alias("mask_area"))
    return seed_violations(s, own)
