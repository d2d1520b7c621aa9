"""Sources: episode manifests, image folders, frame ledgers, JSON lines, layers, seeds and accepted labels."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.boxes import natural_key

CAMERAS = ["head", "left_wrist", "right_wrist"]
#: Camera names of a robot dataset's features.
ALIASES = {"head": "head", "left": "left_wrist", "right": "right_wrist"}
MASK_ROW = """clip_id string, episode_id string, task_id int, camera string, frame_idx int, timestamp double, layer string, object_id int, object_name string,
 class_name string, mode string, image_h int, image_w int, counts string, mask_area long, x0 int, y0 int, x1 int, y1 int, visible boolean, visibility string, mask_status string,
 confidence double, human_confirmed boolean, training_eligible boolean, seed_frame int, suspicious_flags array<string>, provenance string"""
MANIFEST = "episode_id string, task_id int, fps double, frames int, cameras map<string, struct<video: string, images: array<string>, timestamp_column: string, timestamps: array<double>>>"


def fail_on(df: DataFrame, message: str) -> None:
    """Raises if the violation query has rows; shows a few."""
    if bad := df.limit(3).collect():
        raise ValueError(f"{message}: {bad}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of a JSON manifest (an array, or a document with ``episodes``), one row an episode; exactly the three cameras."""
    raw = spark.read.schema(f"episodes array<struct<{_inner(MANIFEST)}>>, {MANIFEST}").json(path, multiLine=True)
    out = raw.select(F.explode(F.coalesce("episodes", F.array(F.struct(*[F.col(c) for c in ("episode_id", "task_id", "fps", "frames", "cameras")])))).alias("e")).select("e.*")
    fail_on(out.where(~F.coalesce(F.array_sort(F.map_keys("cameras")) == F.array(*map(F.lit, CAMERAS)), F.lit(False))), "an episode without just the three cameras")
    fail_on(out.groupBy("episode_id", "task_id").count().where("count > 1"), "an episode twice")
    return out


def _inner(ddl: str) -> str:
    """A schema's fields as those of a struct."""
    fields, now, depth = [], "", 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            fields.append(now)
            now = ""
        else:
            now += ch
    return ", ".join(f"{f.strip().split(' ', 1)[0]}: {f.strip().split(' ', 1)[1]}" for f in [*fields, now])


def chunked_paths(episodes: DataFrame, template: str = "data/chunk-%03d/episode_%06d.parquet", chunks_size: int = 1000) -> DataFrame:
    """Adds chunk and path of an episode's index: files come in folders of ``chunks_size`` episodes."""
    chunk = F.floor(F.col("episode_index") / chunks_size).cast("long")
    return episodes.withColumn("chunk", chunk).withColumn("path", F.format_string(template, "chunk", "episode_index"))


def camera_of(name: Column) -> Column:
    """head, left_wrist or right_wrist by the word in a feature's name, else null."""
    out = F.lit(None).cast("string")
    for word, camera in ALIASES.items():
        out = F.when(F.lower(name).contains(word), camera).otherwise(out)
    return out


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """(task_id, episode_id, camera, frame_idx, path) of images below task_N/episode/camera/, in natural order of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(root).select("path")
    return image_rows(files)


def image_rows(files: DataFrame) -> DataFrame:
    """Frames of a column ``path`` of image files."""
    pattern = r"task_(\d+)/([^/]+)/([^/]+)/([^/]+)$"
    out = files.where(F.col("path").rlike(pattern)).select(
        F.regexp_extract("path", pattern, 1).cast("int").alias("task_id"), F.regexp_extract("path", pattern, 2).alias("episode_id"),
        F.regexp_extract("path", pattern, 3).alias("camera"), F.regexp_extract("path", pattern, 4).alias("name"), "path")
    w = W.partitionBy("task_id", "episode_id", "camera").orderBy(natural_key(F.col("name")), "name")
    return out.withColumn("frame_idx", F.row_number().over(w) - 1)


def timestamps(spark: SparkSession, path: str, column: str = "timestamp", start: float = 0.0, frames: int | None = None) -> DataFrame:
    """(frame_idx, timestamp) from one column of a Parquet file; as many as the frames announced."""
    out = spark.read.parquet(path).select("frame_index", (F.col(column).cast("double") + start).alias("timestamp")).withColumnRenamed("frame_index", "frame_idx")
    if frames is not None and (n := out.count()) != frames:
        raise ValueError(f"{n} timestamps for {frames} frames")
    fail_on(out.where(F.col("timestamp").isNull() | F.isnan("timestamp") | (F.abs("timestamp") == float("inf"))), "a time that isn't finite")
    return out


def clip_times(files: DataFrame, clips: DataFrame, column: str = "timestamp") -> DataFrame:
    """(episode_id, frame_idx, timestamp) of many clips' files, read as one table (episode_id, frame_index, ``column``).

    ``clips`` (episode_id, start, frames) has each clip's start, which is added, and the frames it announces. Raises if a clip has more or fewer times, or one
    that is null or not finite; files of clips that aren't listed raise too.
    """
    times = files.select("episode_id", F.col("frame_index").alias("frame_idx"), F.col(column).cast("double").alias("__t"))
    real = F.coalesce(~F.isnan("__t") & (F.abs("__t") < float("inf")), F.lit(False))
    got = times.groupBy(F.col("episode_id").alias("__e")).agg(F.count("*").alias("n"), F.count_if(~real).alias("unreal"))
    both = clips.join(got, F.col("episode_id") == F.col("__e"), "full")
    uneven = ~F.coalesce(F.col("n"), F.lit(0)).eqNullSafe(F.coalesce(F.col("frames"), F.lit(-1)))
    wrong = both.withColumn("wrong", F.when(uneven, "a clip with more or fewer times than frames").when(F.col("unreal") > 0, "a time that isn't finite")).where("wrong IS NOT NULL")
    if bad := wrong.orderBy("wrong").limit(3).collect():  # one pass for both
        raise ValueError(f"{bad[0]['wrong']}: {bad}")
    own = clips.select(F.col("episode_id").alias("__e"), "start")
    return times.join(own, F.col("episode_id") == F.col("__e")).select("episode_id", "frame_idx", (F.col("__t") + F.col("start")).alias("timestamp"))


def stride(frames: DataFrame, step: int = 1, most: int = 0) -> DataFrame:
    """Each stream's frames whose index divides by ``step``; the first ``most`` of them, 0 for all."""
    if step < 1 or most < 0:
        raise ValueError("a stride below 1 or a negative limit")
    out = frames.where(F.col("frame_idx") % step == 0)
    if most:
        w = W.partitionBy("episode_id", "camera").orderBy("frame_idx")
        out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return out


def stream_errors(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_id, camera, error): streams that are empty, truncated, longer than announced, or have gaps.

    ``episodes`` (episode_id, camera, frames) says how many frames to expect.
    """
    got = frames.groupBy("episode_id", "camera").agg(F.count("*").alias("n"), F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"), F.count_distinct("frame_idx").alias("d"))
    out = episodes.join(got, ["episode_id", "camera"], "left")
    error = (
        F.when(F.col("n").isNull(), "empty stream").when(F.col("n") != F.col("d"), "repeated frame").when(F.col("n") < F.col("frames"), "truncated stream")
        .when(F.col("n") > F.col("frames"), "count mismatch").when((F.col("lo") != 0) | (F.col("hi") != F.col("frames") - 1), "gap")
    )
    return out.withColumn("error", error).where("error IS NOT NULL").select("episode_id", "camera", "error")


def mask_rows(spark: SparkSession, path: str, schema: str = MASK_ROW) -> DataFrame:
    """Rows of JSON lines, gzipped or not, by an explicit schema; malformed lines are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def layer_slice(rows: DataFrame, start: int, end: int, layer: str) -> DataFrame:
    """Rows of a layer within [start, end], whose every frame must be there."""
    out = rows.where(F.col("frame_idx").between(start, end) & (F.col("layer") == layer))
    missing = rows.sparkSession.range(start, end + 1).select(F.col("id").alias("frame_idx")).join(out.select("frame_idx").distinct(), "frame_idx", "left_anti")
    fail_on(missing, f"layer {layer} lacks frames")
    return out


def baseline(objects: DataFrame, robot: DataFrame, start: int, end: int, expected: dict[str, str] | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Two layers' slices in one table; with ``expected``, the sources' recorded hashes must agree."""
    if expected and hashes is not None:
        want = hashes.sparkSession.createDataFrame(list(expected.items()), "path string, sha256 string")
        fail_on(want.join(hashes, ["path", "sha256"], "left_anti"), "a source changed")
    one = objects.where(F.col("frame_idx").between(start, end)).withColumn("layer", F.lit("objects"))
    two = robot.where(F.col("frame_idx").between(start, end)).withColumn("layer", F.lit("robot"))
    return one.unionByName(two, allowMissingColumns=True)


def clip_violations(frames: DataFrame, most: int = 128) -> DataFrame:
    """(clip_id, violation) of clip manifests (clip_id, local_frame_idx, source_frame_idx, image): local indexes from 0 without gaps,
    source indexes rising, paths that stay inside, no more than ``most`` frames."""
    w = W.partitionBy("clip_id").orderBy("local_frame_idx")
    x = frames.withColumn("want", F.row_number().over(w) - 1).withColumn("before", F.lag("source_frame_idx").over(w)).withColumn("n", F.count("*").over(W.partitionBy("clip_id")))
    bad = F.array_compact(F.array(
        F.when(~F.col("local_frame_idx").eqNullSafe(F.col("want")), F.lit("local index")), F.when(F.col("source_frame_idx") <= F.col("before"), F.lit("source order")),
        F.when(~safe_path(F.col("image")), F.lit("path escapes")), F.when(F.col("n") > most, F.lit("too many frames"))))
    return x.select("clip_id", F.explode(bad).alias("violation")).distinct()


def safe_path(path: Column) -> Column:
    """A relative path without parent steps."""
    return F.coalesce(~(path.rlike(r"^(/|[A-Za-z]:)") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | (path == "")), F.lit(False))


def safe_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"), F.lit(False))


def seed_violations(seeds: DataFrame, frames: DataFrame) -> DataFrame:
    """(clip_id, object_id, local_frame_idx, violation) of seeds that no clip may take: unreviewed, doubled, unbound, wrong image, empty mask."""
    n = F.count("*").over(W.partitionBy("clip_id", "object_id", "local_frame_idx"))
    own = frames.select("clip_id", "local_frame_idx", F.col("source_frame_idx").alias("f_source"), F.col("image_sha256").alias("f_sha"))
    x = seeds.withColumn("n", n).join(own, ["clip_id", "local_frame_idx"], "left")
    bad = F.array_compact(F.array(
        F.when(~F.coalesce("reviewed", F.lit(False)), F.lit("not reviewed")), F.when(F.col("n") > 1, F.lit("doubled")), F.when(F.col("f_source").isNull(), F.lit("no such frame")),
        F.when(F.col("f_source") != F.col("source_frame_idx"), F.lit("source index")), F.when(F.col("f_sha") != F.col("source_image_sha256"), F.lit("image hash")),
        F.when(F.coalesce(F.col("mask_area"), F.lit(0)) <= 0, F.lit("empty mask"))))
    return x.select("clip_id", "object_id", "local_frame_idx", F.explode(bad).alias("violation"))


def accepted(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Accepted labels of several sources with ``source_set``; doubled keys and unconfirmed rows are errors."""
    out = None
    for name, df in sources:
        rows = df.withColumn("source_set", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    key = ["episode_id", "camera", "frame_idx", "object_id"]
    fail_on(out.groupBy(*key).count().where("count > 1"), "an identity twice in a frame")
    fail_on(out.where(~F.coalesce("human_confirmed", F.lit(False))), "an unconfirmed label")
    return out


def dataset_inventory(entries: DataFrame) -> DataFrame:
    """Adds what an HDF5 entry (key, shape, dtype) may be by its name: image, state, action, time, depth or mask; else null."""
    words = {"image": "rgb|image|camera", "depth": "depth", "mask": "mask|seg", "action": "action|command", "state": "state|qpos|joint", "time": "time|stamp"}
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(words.items()):
        kind = F.when(F.lower("key").rlike(pattern), name).otherwise(kind)
    return entries.withColumn("candidate", kind)


def clip_rows(spark: SparkSession, start: int, count: int, step: int) -> DataFrame:
    """(local_frame_idx, source_frame_idx) of a clip of 1 to 128 rows."""
    if not 1 <= count <= 128 or step < 1 or start < 0:
        raise ValueError("a clip has 1 to 128 rows, from 0 on")
    return spark.range(count).select(F.col("id").alias("local_frame_idx"), (F.lit(start) + F.col("id") * step).alias("source_frame_idx"))


def rows_of_clips(clips: DataFrame, most: int = 128) -> DataFrame:
    """(clip_id, local_frame_idx, source_frame_idx) of many clips (clip_id, start, frames, step), each of 1 to ``most`` rows."""
    bad = ~F.coalesce(F.col("frames").between(1, most) & (F.col("step") >= 1) & (F.col("start") >= 0), F.lit(False))
    fail_on(clips.where(bad), f"a clip has 1 to {most} rows, from 0 on")
    local = clips.select("clip_id", "start", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1)).alias("local_frame_idx"))
    return local.select("clip_id", "local_frame_idx", (F.col("start") + F.col("local_frame_idx") * F.col("step")).cast("long").alias("source_frame_idx"))


def hash_mismatches(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files listed but missing, found but unlisted, or with another hash; both tables are (path, sha256)."""
    x = listed.alias("l").join(found.alias("f"), F.col("l.path") == F.col("f.path"), "full")
    problem = F.when(F.col("f.path").isNull(), "missing").when(F.col("l.path").isNull(), "unlisted").when(F.col("l.sha256") != F.col("f.sha256"), "changed")
    return x.select(F.coalesce("l.path", "f.path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


ENTRY = "bundle string, path string, bytes long, sha256 string, intact boolean, link boolean"


def archive_entries(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, path, bytes, sha256, intact, link) of every entry of the ZIP bundles below a folder, each bundle read by one task.

    ``intact`` tells whether an entry's bytes have its checksum; a link or a damaged entry has no hash. A file that is no ZIP archive raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for e in z.infolist():
                        if e.is_dir():
                            continue
                        link, sha, ok = e.external_attr >> 28 == 0o12, None, True
                        if not link:
                            try:
                                sha = hashlib.sha256(z.read(e)).hexdigest()
                            except zipfile.BadZipFile:
                                ok = False
                        rows.append({"bundle": bundle, "path": e.filename, "bytes": e.file_size, "sha256": sha, "intact": ok, "link": link})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([("bundle", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("intact", pa.bool_()), ("link", pa.bool_())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInArrow(run, ENTRY)


def archive_violations(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(bundle, path, violation): repeated names, paths that escape, links, damaged entries, and differences from the listed (bundle, path, sha256)."""
    bad = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.lit("repeated name")), F.when(~safe_path(F.col("path")), F.lit("path escapes")),
        F.when(F.col("link"), F.lit("link")), F.when(~F.col("intact"), F.lit("damaged"))))
    named = entries.withColumn("n", F.count("*").over(W.partitionBy("bundle", "path")))
    own = named.select("bundle", "path", F.explode(bad).alias("violation")).distinct()
    a, b = listed.select("bundle", "path", F.col("sha256").alias("want")), entries.select("bundle", "path", "sha256", F.lit(1).alias("there")).dropDuplicates(["bundle", "path"])
    x = a.withColumn("asked", F.lit(1)).join(b, ["bundle", "path"], "full")
    other = F.when(F.col("there").isNull(), "missing").when(F.col("asked").isNull(), "unlisted").when(F.col("want") != F.col("sha256"), "changed")
    return own.unionByName(x.select("bundle", "path", other.alias("violation")).where("violation IS NOT NULL"))
