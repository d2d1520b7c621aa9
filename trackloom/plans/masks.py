"""Queries over masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions import runs as R
from trackloom.operators import masks as M
from trackloom.operators.stats import joined, quantiles
from trackloom.registry import query
from trackloom.sources.fixtures import view

H, WIDTH = 36, 64
KEY = "episode_id, camera, frame_idx, object_id"
_AREA = f"area AS (SELECT {KEY}, CAST(sum(e - s) AS BIGINT) AS a, min(s // 36) AS x0, min(s % 36) AS y0, max((e - 1) // 36) + 1 AS x1, max((e - 1) % 36) + 1 AS y1 FROM v_spans GROUP BY ALL)"


def _same(a: str, b: str, keys: str = "episode_id camera frame_idx") -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split())


_PAIRS = f"""pairs AS (
  SELECT a.episode_id, a.camera, a.frame_idx, a.object_id AS i, b.object_id AS j, CAST(sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS BIGINT) AS inter
  FROM v_spans a JOIN v_spans b ON {_same('a', 'b')} AND a.object_id < b.object_id AND a.s // 36 = b.s // 36 GROUP BY ALL)"""
_CHANGE = f"""
ordered AS (SELECT *, lag(frame_idx) OVER w AS p_frame, lag(a) OVER w AS pa, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM area WINDOW w AS (PARTITION BY episode_id, camera, object_id ORDER BY frame_idx)),
common AS (SELECT o.episode_id, o.camera, o.frame_idx, o.object_id, CAST(sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS BIGINT) AS inter FROM ordered o
  JOIN v_spans a ON {_same('o', 'a')} AND o.object_id = a.object_id JOIN v_spans b ON o.episode_id = b.episode_id AND o.camera = b.camera AND o.p_frame = b.frame_idx AND o.object_id = b.object_id AND a.s // 36 = b.s // 36 GROUP BY ALL),
changed AS (SELECT o.*, coalesce(c.inter, 0) AS inter, coalesce(c.inter, 0) / (o.a + o.pa - coalesce(c.inter, 0)) AS iou, greatest(o.a, o.pa) / least(o.a, o.pa) AS ratio,
  sqrt(((x0 + x1 - px0 - px1) / 2) * ((x0 + x1 - px0 - px1) / 2) + ((y0 + y1 - py0 - py1) / 2) * ((y0 + y1 - py0 - py1) / 2)) / sqrt(CAST(5392 AS DOUBLE)) AS jump
  FROM ordered o LEFT JOIN common c ON {_same('o', 'c')} AND o.object_id = c.object_id)"""


def mask_rows(spark: SparkSession, sf: str) -> DataFrame:
    return M.described(M.from_spans(view(spark, sf, "v_spans"), H * WIDTH), H)


@query("f2_mask_geometry", f"WITH {_AREA} SELECT {KEY}, a AS mask_area, x0, y0, x1, y1 FROM area")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return mask_rows(spark, sf).select("episode_id", "camera", "frame_idx", "object_id", "mask_area", "x0", "y0", "x1", "y1")


@query("pf12_mask_record", f"WITH {_AREA} SELECT camera, object_id, count(*) AS rows_, count(*) FILTER (a > 0) AS visible, sum(a)::BIGINT AS pixels FROM area GROUP BY ALL")
def pf12(spark: SparkSession, sf: str) -> DataFrame:
    return mask_rows(spark, sf).groupBy("camera", "object_id").agg(F.count("*").alias("rows_"), F.count_if("visible").alias("visible"), F.sum("mask_area").alias("pixels"))


@query("f1_run_codec", f"WITH {_AREA} SELECT camera, count(*) AS masks, count(*) AS equal, sum(a)::BIGINT AS pixels FROM area GROUP BY ALL")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.from_spans(view(spark, sf, "v_spans"), H * WIDTH).withColumn("counts", R.rle_encode("runs")).withColumn("back", R.rle_decode("counts"))
    return rows.groupBy("camera").agg(F.count("*").alias("masks"), F.count_if(F.col("runs") == F.col("back")).alias("equal"), F.sum(R.area(F.col("back"))).alias("pixels"))


@query("f6_mask_metrics", f"""WITH {_AREA}, {_PAIRS}
SELECT p.camera, i, j, count(*) AS pairs, round(avg(p.inter / (a.a + b.a - p.inter)), 6) AS iou, round(avg(2 * p.inter / (a.a + b.a)), 6) AS dice, round(avg(p.inter / a.a), 6) AS precision_, round(avg(p.inter / b.a), 6) AS recall_
FROM pairs p JOIN area a ON {_same('p', 'a')} AND p.i = a.object_id JOIN area b ON {_same('p', 'b')} AND p.j = b.object_id WHERE inter > 0 GROUP BY ALL""")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    rows = mask_rows(spark, sf)
    a, b = rows.select("episode_id", "camera", "frame_idx", F.col("object_id").alias("i"), F.col("mask_area").alias("ai")), rows.select("episode_id", "camera", "frame_idx", F.col("object_id").alias("j"), F.col("mask_area").alias("aj"))
    pairs = M.overlaps(rows, 0.0).join(a, ["episode_id", "camera", "frame_idx", "i"]).join(b, ["episode_id", "camera", "frame_idx", "j"])
    n = F.col("inter")
    return pairs.groupBy("camera", "i", "j").agg(
        F.count("*").alias("pairs"), F.round(F.avg(R.iou(n, F.col("ai"), F.col("aj"))), 6).alias("iou"), F.round(F.avg(R.dice(n, F.col("ai"), F.col("aj"))), 6).alias("dice"),
        F.round(F.avg(n / F.col("ai")), 6).alias("precision_"), F.round(F.avg(n / F.col("aj")), 6).alias("recall_"))


def _overlap_sql(over: str) -> str:
    return f"""WITH {_AREA}, {_PAIRS}
SELECT p.episode_id, p.camera, p.frame_idx, i, j, inter, round(inter / least(a.a, b.a), 6) AS share FROM pairs p JOIN area a ON {_same('p', 'a')} AND p.i = a.object_id JOIN area b ON {_same('p', 'b')} AND p.j = b.object_id WHERE inter / least(a.a, b.a) > {over}"""


@query("j6_object_overlap", _overlap_sql("0.30"))
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return M.overlaps(mask_rows(spark, sf), M.RECOVERY.overlap).withColumn("share", F.round("share", 6))


@query("j6_audit_overlap", _overlap_sql("0.10"))
def j6b(spark: SparkSession, sf: str) -> DataFrame:
    return M.overlaps(mask_rows(spark, sf), M.AUDIT.overlap).withColumn("share", F.round("share", 6))


@query("j8_robot_overlap", f"""WITH {_AREA}, {_PAIRS}
SELECT a.camera, a.object_id, count(*) AS frames, count(r.a) AS with_robot, count(*) FILTER (coalesce(p.inter, 0) / a.a > 0.5) AS warned FROM area a LEFT JOIN area r ON {_same('a', 'r')} AND r.object_id = 4 LEFT JOIN pairs p ON {_same('a', 'p')} AND p.i = a.object_id AND p.j = 4 WHERE a.object_id <> 4 GROUP BY ALL""")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    out = M.covered_by(mask_rows(spark, sf), 4)
    return out.groupBy("camera", "object_id").agg(F.count("*").alias("frames"), F.count("robot_share").alias("with_robot"), F.count_if(F.col("robot_share") > M.RECOVERY.robot).alias("warned"))


def _flag_sql(iou: str, ratio: str = "3") -> str:
    return f"""WITH {_AREA}, {_CHANGE}
SELECT camera, object_id, count(*) AS frames, count(pa) AS transitions, count(*) FILTER (iou < {iou}) AS iou_drops, count(*) FILTER (ratio > {ratio}) AS area_jumps, count(*) FILTER (jump > 0.15) AS center_jumps,
  count(*) FILTER ((x0 = 0 OR y0 = 0 OR x1 = 64 OR y1 = 36) AND a / 2304 < 0.0005) AS residue FROM changed GROUP BY ALL"""


def _flags(spark: SparkSession, sf: str, limits: M.Limits) -> DataFrame:
    out = M.flags(M.changes(mask_rows(spark, sf), H, WIDTH), limits, H, WIDTH)

    def has(name: str) -> Column:
        return F.count_if(F.array_contains("flags", name))

    return out.groupBy("camera", "object_id").agg(F.count("*").alias("frames"), F.count("p_mask_area").alias("transitions"), has("mask_iou_drop").alias("iou_drops"), has("mask_area_jump").alias("area_jumps"), has("bbox_center_jump").alias("center_jumps"), has("tiny_border_residue").alias("residue"))


@query("w4_mask_diagnostics", _flag_sql("0.05"))
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf, M.RECOVERY)


@query("w5_repair_flags", _flag_sql("0.10"))
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf, M.REPAIR)


@query("w6_audit_flags", f"""WITH {_AREA}, {_CHANGE}, {_PAIRS},
over_ AS (SELECT p.episode_id, p.camera, p.frame_idx, unnest([i, j]) AS object_id FROM pairs p JOIN area a ON {_same('p', 'a')} AND p.i = a.object_id JOIN area b ON {_same('p', 'b')} AND p.j = b.object_id WHERE inter / least(a.a, b.a) > 0.10)
SELECT c.camera, c.object_id, count(*) AS frames, count(*) FILTER (iou < 0.05) AS iou_drops, count(*) FILTER (ratio > 3) AS area_jumps, count(*) FILTER (o.object_id IS NOT NULL) AS overlapped
FROM changed c LEFT JOIN (SELECT DISTINCT * FROM over_) o ON {_same('c', 'o')} AND c.object_id = o.object_id GROUP BY ALL""")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    rows = mask_rows(spark, sf)
    over = M.overlaps(rows, M.AUDIT.overlap).select("episode_id", "camera", "frame_idx", F.explode(F.array("i", "j")).alias("object_id")).distinct().withColumn("over_", F.lit(True))
    out = M.flags(M.changes(rows, H, WIDTH), M.AUDIT, H, WIDTH).join(over, ["episode_id", "camera", "frame_idx", "object_id"], "left")
    return out.groupBy("camera", "object_id").agg(F.count("*").alias("frames"), F.count_if(F.array_contains("flags", "mask_iou_drop")).alias("iou_drops"), F.count_if(F.array_contains("flags", "mask_area_jump")).alias("area_jumps"), F.count("over_").alias("overlapped"))


@query("a16_mask_quality", f"""WITH {_AREA}, {_CHANGE}, {_PAIRS}, best AS (
 SELECT episode_id, camera, frame_idx, object_id, max(share) AS share FROM (SELECT p.episode_id, p.camera, p.frame_idx, unnest([i, j]) AS object_id, inter / least(a.a, b.a) AS share FROM pairs p JOIN area a ON {_same('p', 'a')} AND p.i = a.object_id JOIN area b ON {_same('p', 'b')} AND p.j = b.object_id) AS x WHERE share > 0 GROUP BY ALL)
SELECT c.camera, c.object_id, count(*) AS rows_, count(*) FILTER (a > 0) AS visible, count(*) FILTER (share > 0.10) AS overlapped, round(quantile_cont(share, 0.5), 6) AS share_median, round(max(share), 6) AS share_max, round(quantile_cont(iou, 0.5), 6) AS iou_median, count(*) FILTER (ratio > 3) AS jumps, count(pa) AS transitions
FROM changed c LEFT JOIN best b ON {_same('c', 'b')} AND c.object_id = b.object_id GROUP BY ALL""")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    rows = mask_rows(spark, sf)
    over = M.overlaps(rows, 0.0).select("episode_id", "camera", "frame_idx", "share", F.explode(F.array("i", "j")).alias("object_id")).groupBy("episode_id", "camera", "frame_idx", "object_id").agg(F.max("share").alias("share"))
    out = M.changes(rows, H, WIDTH).join(over, ["episode_id", "camera", "frame_idx", "object_id"], "left")
    keys = ["camera", "object_id"]
    spread = quantiles(out, keys, {"share": F.col("share"), "iou": F.col("change_iou")}, {"median": 0.5}).select(*keys, F.round("share_median", 6).alias("share_median"), F.round("iou_median", 6).alias("iou_median"))
    counts = out.groupBy(*keys).agg(
        F.count("*").alias("rows_"), F.count_if("visible").alias("visible"), F.count_if(F.col("share") > 0.10).alias("overlapped"), F.round(F.max("share"), 6).alias("share_max"),
        F.count_if(F.col("change_ratio") > 3).alias("jumps"), F.count("p_mask_area").alias("transitions"))
    return joined(counts, spread, keys)


_SCORED = f"""WITH {_AREA}, {_CHANGE},
scored AS (SELECT c.*, CASE WHEN object_id < 3 THEN 'objects' ELSE 'robot' END AS grp FROM changed c),
numbers AS (SELECT *, a > 0 AS gt, coalesce(pa > 0, false) AS pred, a + coalesce(pa, 0) - coalesce(inter, 0) AS un, coalesce(inter, 0) AS it FROM scored)"""
_SUMMARY = "count(*) AS labels, count(*) FILTER (gt) AS visible, round(avg(it / un) FILTER (gt), 6) AS macro_iou, round(avg(2 * it / (a + coalesce(pa, 0))) FILTER (gt), 6) AS macro_dice, round(sum(it) / sum(un), 6) AS micro_iou, round(avg(CAST(pa IS NOT NULL AND pred = gt AS INT)), 6) AS visibility_accuracy, count(*) FILTER (NOT gt AND pred) AS false_positives, count(*) FILTER (gt AND NOT pred) AS misses"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Masks as labels, each stream's mask before as its prediction."""
    o = W.partitionBy("episode_id", "camera", "object_id").orderBy("frame_idx")
    rows = mask_rows(spark, sf)
    rows = rows.withColumn("p_runs", F.lag("runs").over(o)).withColumn("p_area", F.lag("mask_area").over(o))
    return M.scored(rows).withColumn("grp", F.when(F.col("object_id") < 3, "objects").otherwise("robot"))


@query("a4_label_scores", f"{_SCORED} SELECT {KEY}, it AS inter, un AS union_, round(it / un, 6) AS iou, round(2 * it / (a + coalesce(pa, 0)), 6) AS dice, pa IS NOT NULL AND pred = gt AS visibility_correct FROM numbers")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    out = _scored(spark, sf)
    return out.select("episode_id", "camera", "frame_idx", "object_id", "inter", F.col("union").alias("union_"), F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"), "visibility_correct")


@query("a5_macro_micro", f"{_SCORED} SELECT object_id, {_SUMMARY} FROM numbers GROUP BY ALL")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("object_id").agg(*M.summary())


@query("a6_by_camera_and_layer", f"{_SCORED} SELECT coalesce(camera, 'all') AS camera, grp, {_SUMMARY} FROM numbers GROUP BY GROUPING SETS ((camera, grp), (grp))")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    out = _scored(spark, sf).groupingSets([["camera", "grp"], ["grp"]], "camera", "grp").agg(*M.summary())
    return out.withColumn("camera", F.coalesce("camera", F.lit("all")))


@query("a19_union_masks", """
WITH edges AS (SELECT episode_id, camera, frame_idx, s AS p, 1 AS d FROM v_spans UNION ALL SELECT episode_id, camera, frame_idx, e, -1 FROM v_spans),
sums AS (SELECT episode_id, camera, frame_idx, p, sum(d) AS d FROM edges GROUP BY ALL),
open_ AS (SELECT *, sum(d) OVER w AS depth, lead(p) OVER w AS nxt FROM sums WINDOW w AS (PARTITION BY episode_id, camera, frame_idx ORDER BY p))
SELECT episode_id, camera, frame_idx, CAST(sum(CASE WHEN depth > 0 THEN nxt - p ELSE 0 END) AS BIGINT) AS pixels FROM open_ GROUP BY ALL""")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.from_spans(view(spark, sf, "v_spans"), H * WIDTH).withColumn("confidence", F.lit(1.0))
    return M.united(rows, ["episode_id", "camera", "frame_idx"]).select("episode_id", "camera", "frame_idx", R.area(F.col("runs")).alias("pixels"))


@query("a20_union_confidence", "SELECT episode_id, camera, frame_idx, coalesce(min(CASE WHEN confidence >= 0.2 THEN confidence END), 0) AS confidence FROM v_top WHERE object_id >= 3 GROUP BY ALL")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    parts = view(spark, sf, "v_top").where("object_id >= 3")
    return parts.groupBy("episode_id", "camera", "frame_idx").agg(F.coalesce(F.min(F.when(F.col("confidence") >= 0.2, F.col("confidence"))), F.lit(0.0)).alias("confidence"))


@query("a27_part_conflicts", f"WITH {_PAIRS} SELECT camera, i, j, count(*) AS frames, CAST(sum(inter) AS BIGINT) AS pixels FROM pairs WHERE inter > 0 AND i >= 2 GROUP BY ALL")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return M.overlaps(mask_rows(spark, sf).where("object_id >= 2"), 0.0).groupBy("camera", "i", "j").agg(F.count("*").alias("frames"), F.sum("inter").alias("pixels"))


@query("set6_mask_algebra", f"""WITH {_AREA}, {_PAIRS}
SELECT a.camera, count(*) AS pairs, CAST(sum(coalesce(p.inter, 0)) AS BIGINT) AS both_, CAST(sum(a.a + b.a - coalesce(p.inter, 0)) AS BIGINT) AS either_, CAST(sum(a.a - coalesce(p.inter, 0)) AS BIGINT) AS first_only
FROM area a JOIN area b ON {_same('a', 'b')} AND a.object_id + 1 = b.object_id LEFT JOIN pairs p ON {_same('a', 'p')} AND p.i = a.object_id AND p.j = b.object_id GROUP BY ALL""")
def set6(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.from_spans(view(spark, sf, "v_spans"), H * WIDTH)
    other = rows.select("episode_id", "camera", "frame_idx", (F.col("object_id") - 1).alias("object_id"), F.col("runs").alias("other"))
    x = rows.join(other, ["episode_id", "camera", "frame_idx", "object_id"])
    return x.groupBy("camera").agg(F.count("*").alias("pairs"), F.sum(R.area(R.mask_and("runs", "other"))).alias("both_"), F.sum(R.area(R.mask_or("runs", "other"))).alias("either_"), F.sum(R.area(R.mask_minus("runs", "other"))).alias("first_only"))


@query("pf13_point_in_mask", f"SELECT s.episode_id, s.camera, s.frame_idx, s.object_id, count(*) FILTER (p.pos >= s.s AND p.pos < s.e) > 0 AS inside FROM v_spans s JOIN (SELECT {KEY}, least(63, CAST(floor((x0 + x1) / 20) AS BIGINT)) * 36 + least(35, CAST(floor((y0 + y1) / 20) AS BIGINT)) AS pos FROM v_top) p ON {_same('s', 'p')} AND s.object_id = p.object_id GROUP BY ALL")
def pf13(spark: SparkSession, sf: str) -> DataFrame:
    at = F.least(F.lit(63), F.floor((F.col("x0") + F.col("x1")) / 20)) * 36 + F.least(F.lit(35), F.floor((F.col("y0") + F.col("y1")) / 20))
    prompts = view(spark, sf, "v_top").select("episode_id", "camera", "frame_idx", "object_id", at.cast("long").alias("pos"))
    rows = M.from_spans(view(spark, sf, "v_spans"), H * WIDTH).join(prompts, ["episode_id", "camera", "frame_idx", "object_id"])
    return rows.select("episode_id", "camera", "frame_idx", "object_id", R.covers(F.col("runs"), F.col("pos")).alias("inside"))


_CELLS = "s // 36 AS x, unnest(range(s % 36, (e - 1) % 36 + 1)) AS y"
_GROWN = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy) WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 35"
_REGIONS = f"""
px AS (SELECT DISTINCT episode_id, camera, frame_idx, {_CELLS} FROM v_spans WHERE object_id < 3),
grown AS (SELECT DISTINCT episode_id, camera, frame_idx, x + dx AS x, y + dy AS y FROM px, {_GROWN}),
sizes AS (SELECT episode_id, camera, frame_idx, count(*) AS n FROM grown GROUP BY ALL),
f AS (SELECT episode_id, camera, frame_idx, bool_or(object_id = 4) AS unresolved FROM v_spans GROUP BY ALL),
regions AS (SELECT f.episode_id, f.camera, f.frame_idx, coalesce(n, 0) AS roi_pixels, CASE WHEN unresolved THEN coalesce(n, 0) ELSE 2304 END AS known_pixels, coalesce(n, 0) > 0 AS has_reliable_roi FROM f LEFT JOIN sizes s ON {_same('f', 's')})"""


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.from_spans(view(spark, sf, "v_spans"), H * WIDTH).withColumn("eligible", F.col("object_id") < 3).withColumn("unresolved", F.col("object_id") == 4)
    return M.regions(rows, H, WIDTH)


@query("r7_regions", f"WITH {_REGIONS} SELECT * FROM regions")
def r7(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf).select("episode_id", "camera", "frame_idx", "roi_pixels", "known_pixels", "has_reliable_roi")


@query("snk5_region_runs", f"WITH {_REGIONS} SELECT episode_id, camera, frame_idx, roi_pixels, known_pixels FROM regions")
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and what is known of them, written as runs and read back."""
    from trackloom.sources import sinks
    from trackloom.streaming.events import folder

    path = folder(spark)
    sinks.write_regions(_regions(spark, sf), path, H * WIDTH)
    back = spark.read.parquet(path)
    return back.select("episode_id", "camera", "frame_idx", R.area(F.col("roi")).alias("roi_pixels"), R.area(F.col("known")).alias("known_pixels"))


@query("f17_mask_pool", f"""WITH {_AREA}
SELECT {KEY}, round(sum(a) OVER (PARTITION BY episode_id, camera, object_id ORDER BY frame_idx RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) / 48, 6) AS mass, 144 AS cells FROM area""")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame's mask and those of the two frames before it, pooled; a frame without a mask is unknown and adds nothing."""
    pooled = M.pooled(M.from_spans(view(spark, sf, "v_spans"), H * WIDTH), 3, H, 9, 16)
    return pooled.select("episode_id", "camera", "frame_idx", "object_id", F.round(F.aggregate("cells", F.lit(0.0), lambda s, x: s + x), 6).alias("mass"), F.size("cells").alias("cells"))


@query("r10_layered_masks", f"""
WITH px AS (SELECT episode_id, camera, frame_idx, object_id, (object_id * 3) % 5 AS priority, {_CELLS} FROM v_spans),
owned AS (SELECT episode_id, camera, frame_idx, x, y, arg_max(object_id, priority) AS object_id FROM px GROUP BY ALL),
n AS (SELECT episode_id, camera, frame_idx, object_id, count(*) AS pixels FROM owned GROUP BY ALL)
SELECT v.episode_id, v.camera, v.frame_idx, v.object_id, coalesce(pixels, 0) AS pixels FROM (SELECT DISTINCT episode_id, camera, frame_idx, object_id FROM v_spans) v LEFT JOIN n ON {_same('v', 'n')} AND v.object_id = n.object_id""")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of a frame without the pixels that a mask of higher priority has."""
    rows = M.from_spans(view(spark, sf, "v_spans"), H * WIDTH).withColumn("priority", F.col("object_id") * 3 % 5)
    return M.layered(rows).select("episode_id", "camera", "frame_idx", "object_id", R.area(F.col("runs")).alias("pixels"))
