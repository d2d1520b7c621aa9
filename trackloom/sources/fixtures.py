"""Annotation-track views over the star-schema tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_CAMERA = "CASE {} % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'left_wrist' ELSE 'right_wrist' END"

VIEWS = {
    # boxes detected in frames; one row of lineitem each
    "v_detections": f"""
SELECT *, x0 + 30 + CAST(1.5 AS DOUBLE) * q AS x1, y0 + 20 + q AS y1 FROM (
  SELECT l_orderkey % 20 AS episode_id, (l_orderkey % 20) % 5 AS task_id, {_CAMERA.format("l_linenumber")} AS camera,
         l_partkey % 100 AS frame_idx, l_suppkey % 5 AS object_id,
         (CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000) / CAST(1000 AS DOUBLE) AS confidence,
         CAST((l_suppkey % 5) * 100 + 3 * l_linenumber + CASE WHEN l_discount > CAST(0.085 AS DOUBLE) THEN 150 ELSE 0 END AS DOUBLE) AS x0,
         CAST(40 + 2 * l_linenumber AS DOUBLE) AS y0, CAST(floor(l_quantity) AS DOUBLE) AS q,
         l_orderkey AS t1, l_linenumber AS t2, l_partkey AS t3, l_suppkey AS t4, l_extendedprice AS t5, l_shipdate AS t6
  FROM lineitem) AS raw""",
    # processed frames, with or without detections
    "v_frames": "SELECT DISTINCT episode_id, task_id, camera, frame_idx FROM v_detections",
    # the best detection of an object in a frame
    "v_top": """
SELECT episode_id, task_id, camera, frame_idx, object_id, confidence, x0, y0, x1, y1, second_confidence, hits FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id, camera, frame_idx, object_id ORDER BY confidence DESC, t1, t2, t3, t4, t5, t6) AS place,
         lead(confidence) OVER (PARTITION BY episode_id, camera, frame_idx, object_id ORDER BY confidence DESC, t1, t2, t3, t4, t5, t6) AS second_confidence,
         count(*) OVER (PARTITION BY episode_id, camera, frame_idx, object_id) AS hits
  FROM v_detections) AS ranked WHERE place = 1""",
    # runs of foreground pixels in a 36 x 64 raster, column-major; a box is one run a column
    "v_spans": """
SELECT episode_id, camera, frame_idx, object_id, x * 36 + CAST(floor(y0 / 10) AS BIGINT) AS s, x * 36 + least(36, CAST(floor(y1 / 10) AS BIGINT) + 1) AS e FROM (
  SELECT episode_id, camera, frame_idx, object_id, y0, y1, {explode} AS x FROM v_top WHERE floor(x0 / 10) < 64) AS columns_""",
    # audited samples of a clip
    "v_vis": """
SELECT user_id AS clip_id, event_id AS sample_id, event_id % 5 AS object_id, CASE user_id % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'left_wrist' ELSE 'right_wrist' END AS camera,
       5 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS frame_idx, ts,
       CASE event_type WHEN 'view' THEN 'visible' WHEN 'click' THEN 'partial_occlusion' WHEN 'purchase' THEN 'out_of_view' WHEN 'error' THEN 'fully_occluded' ELSE 'unknown' END AS gt_visibility,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value >= 50 END AS pred_visible,
       (event_id % 100) / CAST(100 AS DOUBLE) AS iou, event_id % 700 AS pred_area
FROM events""",
    # exemplars and queries of an identity bank
    "v_bank": f"""
SELECT vec_id, label AS object_id, vec_id % 20 AS episode_id, {_CAMERA.format("vec_id")} AS camera, embedding, (vec_id * 7) % 1000 AS frame_idx,
       CASE WHEN vec_id % 13 = 0 THEN 'excluded' ELSE 'active' END AS bank_status, (vec_id % 100) / CAST(100 AS DOUBLE) AS detector_score, (vec_id * 37) % 60000 AS mask_area
FROM embeddings""",
    # revisions of a human label
    "v_revisions": "SELECT conv_id AS label_id, turn + 1 AS revision, role, sha256_(text) AS payload, turn FROM conversations",
    # jobs of a work queue
    "v_jobs": """
SELECT o_orderkey AS job_id, o_custkey % 30 AS task_id, o_custkey AS episode_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_totalprice / 1000 AS seconds, o_orderdate AS updated
FROM orders""",
    # reviewed clips: reliable, excluded or not looked at
    "v_review": "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality = 1 AS reliable, l.toxic = 1 AS excluded, l.doc_id IS NOT NULL AS reviewed FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id",
    # tracked objects of a clip: what happens to them, by frame
    "v_events": """
SELECT clip_id, object_id, frame_idx, gt_visibility, pred_visible, iou, sample_id, CASE WHEN sample_id % 9 = 0 THEN CASE WHEN gt_visibility IN ('out_of_view', 'fully_occluded') THEN 'clear' ELSE 'seed' END END AS action
FROM v_vis""",
}

_ORDER = list(VIEWS)
_NEEDS = {name: [v for v in [*_ORDER, *TABLES] if re.search(rf"\b{v}\b", sql)] for name, sql in VIEWS.items()}


def _text(name: str, engine: str) -> str:
    columns = "CAST(floor(x0 / 10) AS BIGINT), least(CAST(63 AS BIGINT), CAST(floor(x1 / 10) AS BIGINT))"
    explode = {"spark": f"explode(sequence({columns}))", "duck": f"unnest(range({columns} + 1))"}[engine]
    return VIEWS[name].replace("{explode}", explode).replace("sha256_(text)", {"spark": "sha2(text, 256)", "duck": "sha256(text)"}[engine])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder or a view over it."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {v: view(spark, sf_dir, v) for v in _NEEDS[name]}
    text = _text(name, "spark")
    for v in needs:
        text = re.sub(rf"\b{v}\b", "{" + v + "}", text)
    return spark.sql(text, **needs)


def duck(body: str) -> str:
    """DuckDB SQL: ``body`` below the views that it names."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in _ORDER:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(body)
    parts = ",\n".join(f"{v} AS ({_text(v, 'duck')})" for v in need)
    if not parts:
        return body
    inner = body.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if inner.startswith(start):
            return f"{start}{parts},\n{inner[len(start):]}"
    return f"WITH {parts}\n{inner}"
