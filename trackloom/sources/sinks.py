"""Sinks: versioned tables, JSON lines, CSV, reports, completion markers. Spark's commit protocol replaces partial files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.sources.episodes import fail_on


def no_nan(df: DataFrame) -> DataFrame:
    """The rows, or an error when they are computed if a float is NaN or infinite."""
    bad = F.lit(False)
    for f in df.schema:
        if f.dataType.typeName() in ("double", "float"):
            bad = bad | F.coalesce(F.isnan(f.name) | (F.abs(f.name) == float("inf")), F.lit(False))
    return df.where(F.when(bad, F.raise_error(F.lit("a number that isn't finite")).cast("boolean")).otherwise(True))


def write_rows(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, order: list[str] | None = None) -> None:
    """A new version of a table; an existing folder is an error. JSON is gzipped, CSV has a header."""
    out = no_nan(df)
    if order:
        out = out.sortWithinPartitions(*(by or []), *order)
    w = out.write.mode("errorifexists")
    w = w.partitionBy(*by) if by else w
    {"parquet": w.parquet, "json": lambda p: w.option("compression", "gzip").json(p), "csv": lambda p: w.option("header", "true").csv(p)}[kind](path)


def write_streams(labels: DataFrame, path: str) -> None:
    """Labels by task, episode and camera, each stream in order of frame and object; one shuffle, so a stream is one file."""
    keys = ["task_id", "episode_id", "camera"]
    write_rows(labels.repartition(*keys), path, by=keys, order=["frame_idx", "object_id"])


def write_regions(regions: DataFrame, path: str, pixels: int) -> None:
    """Regions of interest (episode_id, camera, frame_idx, roi, known_pixels) as runs: ``roi``, and ``known``, which is all of the image or the region."""
    whole = F.array(F.lit(0), F.lit(pixels)).cast("array<bigint>")
    known = F.when(F.col("known_pixels") == pixels, whole).otherwise(F.col("roi"))
    write_rows(regions.select("episode_id", "camera", "frame_idx", "roi", known.alias("known")), path)


def complete_marker(df: DataFrame, keys: list[str]) -> DataFrame:
    """What a finished stream's marker says: rows and an order-free digest of its content."""
    digest = F.sum(F.xxhash64(F.to_json(F.struct(*sorted(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"})) % 1_000_000_007)
    return df.groupBy(*keys).agg(F.count("*").alias("rows_"), digest.alias("digest"))


def verify_marker(df: DataFrame, marker: DataFrame, keys: list[str]) -> None:
    """Raises if the rows aren't those that the marker describes."""
    now = complete_marker(df, keys)
    fail_on(now.exceptAll(marker.select(*now.columns)).unionByName(marker.select(*now.columns).exceptAll(now)), "rows differ from their marker")


def shown(value: Column, digits: int = 3) -> Column:
    """A number for a report; N/A where it is unmeasured."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", value))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A summary of at most ``most`` rows as a Markdown table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is for summaries")
    text = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(text, r)) + " |" for r in rows)])
