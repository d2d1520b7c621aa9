"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from trackloom.sources import episodes, sinks


def write(path, value):
    path.write_text(json.dumps(value))
    return f"file://{path}"


def test_manifest(spark, tmp_path):
    cams = {c: {"video": f"{c}.mp4"} for c in episodes.CAMERAS}
    e = {"episode_id": "e1", "task_id": 3, "fps": 30.0, "frames": 10, "cameras": cams}
    assert episodes.manifest(spark, write(tmp_path / "a.json", {"episodes": [e]})).first()["cameras"]["head"]["video"] == "head.mp4"
    with pytest.raises(ValueError, match="three cameras"):
        episodes.manifest(spark, write(tmp_path / "b.json", {"episodes": [{**e, "cameras": {"head": {}}}]}))
    with pytest.raises(ValueError, match="twice"):
        episodes.manifest(spark, write(tmp_path / "c.json", {"episodes": [e, e]}))


def test_image_rows_in_natural_order(spark):
    paths = [(f"/d/task_2/ep/head/{n}.png",) for n in ("10", "2", "1")] + [("/d/other.png",)]
    got = episodes.image_rows(spark.createDataFrame(paths, "path string")).orderBy("frame_idx").collect()
    assert [r["name"] for r in got] == ["1.png", "2.png", "10.png"] and got[0]["task_id"] == 2


def test_timestamps(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(4).select(F.col("id").alias("frame_index"), (F.col("id") / 2).alias("timestamp"), F.lit(1).alias("state")).write.parquet(path)
    got = episodes.timestamps(spark, path, start=100.0, frames=4)
    assert [r["timestamp"] for r in got.orderBy("frame_idx").collect()] == [100.0, 100.5, 101.0, 101.5]
    with pytest.raises(ValueError, match="4 timestamps for 5 frames"):
        episodes.timestamps(spark, path, frames=5)


def test_stride_and_stream_errors(spark):
    frames = spark.createDataFrame([("e", "head", f) for f in (0, 1, 2, 3, 10)], "episode_id string, camera string, frame_idx long")
    assert [r["frame_idx"] for r in episodes.stride(frames, 2).orderBy("frame_idx").collect()] == [0, 2, 10]
    want = spark.createDataFrame([("e", "head", 5), ("e", "left_wrist", 3), ("f", "head", 6)], "episode_id string, camera string, frames long")
    more = frames.union(spark.createDataFrame([("f", "head", 0)], frames.schema))
    assert {(r[0], r[1]): r[2] for r in episodes.stream_errors(more, want).collect()} == {("e", "head"): "gap", ("e", "left_wrist"): "empty stream", ("f", "head"): "truncated stream"}


def test_clip_violations(spark):
    rows = [("a", 0, 5, "x.png"), ("a", 1, 9, "x.png"), ("b", 0, 5, "x.png"), ("b", 2, 4, "../x.png"), ("c", 0, 0, "/abs.png")]
    df = spark.createDataFrame(rows, "clip_id string, local_frame_idx long, source_frame_idx long, image string")
    assert {tuple(r) for r in episodes.clip_violations(df).collect()} == {("b", "local index"), ("b", "source order"), ("b", "path escapes"), ("c", "path escapes")}


def test_accepted_refuses(spark):
    df = spark.createDataFrame([("e", "head", 1, 2, True)], "episode_id string, camera string, frame_idx long, object_id long, human_confirmed boolean")
    assert episodes.accepted(("one", df)).first()["source_set"] == "one"
    with pytest.raises(ValueError, match="twice"):
        episodes.accepted(("one", df), ("two", df))
    with pytest.raises(ValueError, match="unconfirmed"):
        episodes.accepted(("one", df.withColumn("human_confirmed", F.lit(None).cast("boolean"))))


def test_layers_and_inventory(spark):
    rows = spark.createDataFrame([(f, "objects") for f in (3, 4, 6)], "frame_idx long, layer string")
    assert episodes.layer_slice(rows, 3, 4, "objects").count() == 2
    with pytest.raises(ValueError, match="lacks frames"):
        episodes.layer_slice(rows, 3, 6, "objects")
    keys = spark.createDataFrame([("/obs/rgb_head",), ("/action/joint",), ("/x",)], "key string")
    assert [r["candidate"] for r in episodes.dataset_inventory(keys).collect()] == ["image", "action", None]
    assert [tuple(r) for r in episodes.clip_rows(spark, 10, 3, 5).collect()] == [(0, 10), (1, 15), (2, 20)]
    with pytest.raises(ValueError):
        episodes.clip_rows(spark, 0, 129, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "e", "head", 5, 2, 0.5), (1, "e", "head", 4, 3, None)], "task_id long, episode_id string, camera string, frame_idx long, object_id long, confidence double")
    path = f"file://{tmp_path}/labels"
    sinks.write_streams(df, path)
    assert [r["frame_idx"] for r in spark.read.parquet(path).collect()] == [4, 5]
    with pytest.raises(Exception, match="exists"):
        sinks.write_streams(df, path)
    marker = sinks.complete_marker(df, ["episode_id"])
    sinks.verify_marker(df, marker, ["episode_id"])
    with pytest.raises(ValueError, match="differ"):
        sinks.verify_marker(df.limit(1), marker, ["episode_id"])
    with pytest.raises(Exception, match="finite"):
        sinks.no_nan(df.withColumn("confidence", F.lit(float("nan")))).collect()
    assert sinks.markdown(df.select("frame_idx", "confidence")).splitlines()[-1] == "| 4 | N/A |"
    for kind in ("json", "csv"):
        sinks.write_rows(df, f"file://{tmp_path}/{kind}", kind)
    assert episodes.mask_rows(spark, f"file://{tmp_path}/json", "frame_idx long, confidence double").count() == 2


def test_archives_are_checked(spark, tmp_path):
    import hashlib
    import warnings
    import zipfile

    from trackloom.sources import episodes

    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("masks/a.png", b"one")
        z.writestr("masks/b.png", b"two")
    with zipfile.ZipFile(bad, "w") as z, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        z.writestr("../x", b"out")
        z.writestr("twice", b"1")
        z.writestr("twice", b"1")
        z.writestr("broken", b"abcdefgh" * 4)
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "target")
    raw = bad.read_bytes()
    bad.write_bytes(raw.replace(b"abcdefgh" * 4, b"abcdefgX" * 4, 1))
    entries = episodes.archive_entries(spark, f"file://{tmp_path}").withColumn("bundle", F.element_at(F.split("bundle", "/"), -1))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("good.zip", "masks/a.png", sha(b"one")), ("good.zip", "masks/b.png", sha(b"2")), ("good.zip", "masks/c.png", "0"), ("bad.zip", "twice", sha(b"1"))], "bundle string, path string, sha256 string")
    got = {tuple(r) for r in episodes.archive_violations(entries, listed).collect()}
    assert {x for x in got if x[0] == "good.zip"} == {("good.zip", "masks/b.png", "changed"), ("good.zip", "masks/c.png", "missing")}
    assert {x for x in got if x[0] == "bad.zip" and x[2] != "unlisted"} == {("bad.zip", "../x", "path escapes"), ("bad.zip", "twice", "repeated name"), ("bad.zip", "broken", "damaged"), ("bad.zip", "link", "link")}


def test_baseline_checks_its_sources(spark):
    from trackloom.sources import episodes

    rows = spark.range(5).select(F.col("id").alias("frame_idx"))
    hashes = spark.createDataFrame([("o", "1"), ("r", "2")], "path string, sha256 string")
    assert episodes.baseline(rows, rows, 1, 3, {"o": "1"}, hashes).groupBy("layer").count().collect() != []
    with pytest.raises(ValueError, match="a source changed"):
        episodes.baseline(rows, rows, 1, 3, {"o": "9"}, hashes)


def test_image_folders_are_read_in_natural_order(spark, tmp_path):
    for name in ("task_3/ep7/head/f10.png", "task_3/ep7/head/f2.jpg", "task_3/ep7/left_wrist/1.png", "task_3/ep7/head/notes.txt", "other/f1.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = {(r["task_id"], r["episode_id"], r["camera"], r["frame_idx"], r["name"]) for r in episodes.image_folder(spark, f"file://{tmp_path}").collect()}
    assert got == {(3, "ep7", "head", 0, "f2.jpg"), (3, "ep7", "head", 1, "f10.png"), (3, "ep7", "left_wrist", 0, "1.png")}


def test_times_and_rows_of_many_clips(spark):
    files = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.75), (2, 0, 1.0)], "episode_id long, frame_index long, t double")
    clips = spark.createDataFrame([(1, 10.0, 2), (2, 20.0, 1)], "episode_id long, start double, frames long")
    assert sorted(tuple(r) for r in episodes.clip_times(files, clips, "t").collect()) == [(1, 0, 10.5), (1, 1, 10.75), (2, 0, 21.0)]
    for bad, what in (([(1, 10.0, 3), (2, 20.0, 1)], "more or fewer"), ([(1, 10.0, 2)], "more or fewer"), ([(1, 10.0, 2), (2, 20.0, 1), (3, 0.0, 1)], "more or fewer")):
        with pytest.raises(ValueError, match=what):
            episodes.clip_times(files, spark.createDataFrame(bad, clips.schema), "t")
    with pytest.raises(ValueError, match="finite"):
        episodes.clip_times(files.withColumn("t", F.when(F.col("frame_index") == 0, F.lit(float("nan"))).otherwise(F.col("t"))), clips, "t")
    asked = "clip_id long, start long, frames long, step long"
    got = episodes.rows_of_clips(spark.createDataFrame([(7, 10, 3, 5), (8, 0, 1, 1)], asked)).collect()
    assert sorted(map(tuple, got)) == [(7, 0, 10), (7, 1, 15), (7, 2, 20), (8, 0, 0)]
    for clip in ((1, 0, 129, 1), (1, -1, 1, 1), (1, 0, 0, 1), (1, 0, 5, 0), (1, None, 5, 1)):
        with pytest.raises(ValueError, match="1 to 128"):
            episodes.rows_of_clips(spark.createDataFrame([clip], asked))


def test_times_of_many_clips_are_few_files(spark, tmp_path, monkeypatch):
    """Files hold many clips, each clip is whole in one; a clip with a wrong number of times is found among many."""
    from pyspark.sql import functions as F

    import trackloom.registry  # noqa: F401  queries are imported by way of it
    from trackloom.plans import more

    events = spark.range(3000).selectExpr("id AS event_id", "TIMESTAMP '2026-01-01' + make_dt_interval(0, 0, 0, CAST(7 * id % 3000 AS DECIMAL(18, 6))) AS ts", "id % 300 AS user_id", "'view' AS event_type", "1D AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    path = f"file://{tmp_path}/files"
    monkeypatch.setattr(more, "folder", lambda _: path)
    got = more.src4(spark, str(tmp_path)).collect()
    assert sorted((r.episode_id, r.frame_idx) for r in got) == [(k, n) for k in range(300) for n in range(10)]
    files = spark.read.parquet(path).withColumn("file", F.input_file_name())
    assert len(list((tmp_path / "files").rglob("*.parquet"))) <= 20 and files.groupBy("episode_id").agg(F.count_distinct("file").alias("n")).where("n > 1").isEmpty()
    clips = spark.range(300).selectExpr("id AS episode_id", "0 AS start", "IF(id = 7, 11, 10) AS frames")
    with pytest.raises(ValueError, match="more or fewer"):
        episodes.clip_times(files, clips, "time")
