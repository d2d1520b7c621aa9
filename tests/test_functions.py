"""Boxes and masks: hand-made cases, and the codec against rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import boxes, runs


def rows(spark, boxes_):
    return spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in boxes_], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")


def test_box_overlaps(spark):
    df = rows(spark, [((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 10, 10), (20, 20, 30, 30)), ((0, 0, 10, 10), (2, 2, 4, 4)), ((0, 0, 0, 0), (0, 0, 0, 0))])
    got = df.select(boxes.iou(boxes.box("a"), boxes.box("b")), boxes.overlap_smaller(boxes.box("a"), boxes.box("b"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 0.0), (0.04, 1.0), (0.0, 0.0)]
    missing = df.withColumn("bx0", F.lit(None).cast("double")).select(boxes.iou(boxes.box("a"), boxes.box("b"))).first()
    assert missing[0] == 0.0


def test_motion_of_a_jump(spark):
    got = rows(spark, [((0, 0, 10, 10), (60, 60, 90, 90))]).select(*[v.alias(k) for k, v in boxes.motion(boxes.box("a"), boxes.box("b"), 100, 100).items()]).first()
    assert got["iou"] < 0.05 and got["center_jump"] > 0.15 and got["area_ratio"] == 9


def test_crop_rounds_half_to_even(spark):
    df = rows(spark, [((100, 100, 162.5, 150), (0, 0, 1, 1)), ((0, 0, 5, 5), (0, 0, 1, 1))])
    got = df.select(*boxes.crop(boxes.box("a"), 640, 360)).collect()
    assert got[0][0] == 98 and got[1][0] == 0 and got[1][2] == 7  # 2.5 becomes 2; at least 2 pixels


def test_rank_score(spark):
    x = spark.createDataFrame([(0.4, None, None), (0.4, 0.8, None), (0.4, 0.8, -0.1)], "d double, s double, m double")
    assert [round(r[0], 6) for r in x.select(boxes.rank_score(F.col("d"), F.col("s"), F.col("m"))).collect()] == [0.4, 0.7, 0.675]


def test_natural_order(spark):
    names = spark.createDataFrame([("f10",), ("f2",), ("F1",)], "n string")
    assert [r[0] for r in names.orderBy(boxes.natural_key(F.col("n"))).collect()] == ["F1", "f2", "f10"]


def test_codec_round_trip():
    r = np.random.default_rng(1)
    for h, w in ((1, 1), (11, 17), (17, 11), (36, 64)):
        for density in (0, 0.1, 0.5, 0.9, 1):
            image = r.random((h, w)) < density
            own = runs.of_raster(image)
            assert own.sum() == h * w and (runs.raster(own, h) == image).all()
            assert runs.decode(runs.encode(own)) == own.tolist()
            y, x = np.nonzero(image)
            assert runs.box(own, h) == ([x.min(), y.min(), x.max() + 1, y.max() + 1] if len(x) else None)


def test_codec_of_a_known_string():
    assert runs.decode("PPQ7") == [360 * 640]
    assert runs.encode([360 * 640]) == "PPQ7"


@pytest.mark.parametrize("bad", [[], [4, 1], [-1, 5], [True, 3], [2.0, 2], [1, 0, 3]])
def test_bad_runs(bad):
    with pytest.raises(ValueError):
        runs.check_runs(bad, 4)
    with pytest.raises(ValueError):
        runs.decode("P")


def test_algebra_on_runs():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.random((5, 7)) < r.random(), r.random((5, 7)) < r.random()
        x, y = runs.of_raster(a), runs.of_raster(b)
        for how, want in (("and", a & b), ("or", a | b), ("minus", a & ~b)):
            assert runs.combine(x, y, how).tolist() == runs.of_raster(want).tolist()
        assert runs.shared(x, y) == (a & b).sum()


def test_columns_agree_with_kernels(spark):
    r = np.random.default_rng(3)
    images = [r.random((9, 13)) < d for d in (0, 0.05, 0.3, 0.9, 1)]
    df = spark.createDataFrame([(k, [int(v) for v in runs.of_raster(m)]) for k, m in enumerate(images)] + [(9, None)], "k long, runs array<long>")
    got = df.select("k", runs.area(F.col("runs")).alias("a"), runs.bounds(F.col("runs"), 9).alias("b"), runs.rle_decode(runs.rle_encode("runs")).alias("back"), "runs", runs.mask_inter("runs", "runs").alias("i"), runs.mask_geometry("runs", F.lit(9)).alias("g")).collect()
    for row in got:
        if row["k"] == 9:
            assert list(row["g"]) == [None] * 5 and row["a"] is None and row["b"] is None and row["back"] is None and row["i"] is None
        else:
            m = images[row["k"]]
            assert list(row["g"]) == [m.sum(), *(runs.box(np.array(row["runs"]), 9) or [None] * 4)]
            assert row["a"] == row["i"] == m.sum() and (list(row["b"]) if row["b"] else None) == runs.box(np.array(row["runs"]), 9) and row["back"] == row["runs"]


def test_dilation_and_pooling():
    image = np.zeros((9, 9), bool)
    image[4, 4] = True
    grown = runs.dilate(image, 2)
    assert grown[2, 4] and grown[4, 6] and not grown[2, 2] and grown.sum() == 17
    assert runs.margin(640) == 4 and runs.margin(64) == 1
    pooled = runs.pool(np.ones((2, 6, 8), bool), np.stack([np.ones((6, 8), bool), np.zeros((6, 8), bool)]), 3, 4)
    assert np.allclose(pooled, 0.5)
    assert np.allclose(runs.pool(np.eye(5, dtype=bool)[None], np.ones((1, 5, 5), bool), 2, 2).mean(), 0.2)
    with pytest.raises(ValueError):
        runs.pool(np.ones((1, 4, 4), bool), np.ones((1, 4, 4), bool), 8, 2)


def test_robot_parts():
    a, b = np.zeros((4, 4), bool), np.zeros((4, 4), bool)
    a[:2], b[1:3] = True, True
    out = runs.resolve({1101: a, 1103: b})
    assert out[1101].sum() == 4 and out[1103].sum() == 4 and out[1100].sum() == 4
    moved = runs.resolve({1101: a, 1103: b}, verified={1101})
    assert not moved[1103].any() and moved[1100].sum() == 4 and moved[1101].sum() == 8
    split = runs.flange(np.ones((4, 9), bool), (4, 0), (1, 0), 1)
    assert split["unknown"].sum() == 12 and split["arm"].sum() == 12 and split["effector"].sum() == 12


def random_masks(n, h, w, seed):
    r = np.random.default_rng(seed)
    return [None if k % 7 == 3 else r.random((h, w)) < r.choice([0, 0.05, 0.5, 1]) for k in range(n)]


def as_runs(image):
    return None if image is None else [int(v) for v in runs.of_raster(image)]


def test_batches_agree_with_rasters(spark):
    a, b = random_masks(60, 7, 11, 1), random_masks(60, 7, 11, 2)
    a[5], b[6] = None, None
    df = spark.createDataFrame([(k, as_runs(x), as_runs(y)) for k, (x, y) in enumerate(zip(a, b))], "k long, a array<long>, b array<long>").coalesce(1)
    got = df.select(
        "k", runs.mask_inter("a", "b").alias("inter"), runs.mask_and("a", "b").alias("both"), runs.mask_or("a", "b").alias("either"), runs.mask_minus("a", "b").alias("minus"), runs.mask_spans("a").alias("spans"),
        runs.mask_union(F.array("a", "b")).alias("union"), runs.mask_dilate("a", F.lit(7), F.lit(2)).alias("grown"), runs.mask_pool("a", F.lit(7), F.lit(3), F.lit(4)).alias("cells"), runs.rle_encode("a").alias("text"),
        runs.runs_of_spans(runs.mask_spans("a"), 77).alias("again"), runs.mask_pool_frames(F.array("a", "b"), F.lit(7), F.lit(3), F.lit(4)).alias("mean")).collect()
    for r in got:
        x, y = a[r["k"]], b[r["k"]]
        if x is None or y is None:
            assert r["inter"] is r["both"] is r["either"] is r["minus"] is None
        else:
            assert r["inter"] == (x & y).sum() and r["both"] == as_runs(x & y) and r["either"] == as_runs(x | y) and r["minus"] == as_runs(x & ~y)
        known = [m for m in (x, y) if m is not None]
        assert r["union"] == (as_runs(np.logical_or.reduce(known)) if known else None)
        zero = np.zeros((7, 11), bool)
        mean = runs.pool(np.stack([zero if m is None else m for m in (x, y)]), np.ones((2, 7, 11), bool), 3, 4)
        assert np.allclose(r["mean"], mean.ravel())
        if x is None:
            assert r["spans"] is r["grown"] is r["cells"] is r["text"] is r["again"] is None
        else:
            assert r["grown"] == as_runs(runs.dilate(x, 2)) and np.allclose(r["cells"], runs.pool(x[None], np.ones_like(x)[None], 3, 4).ravel())
            assert runs.decode(r["text"]) == as_runs(x) == r["again"]
            on = {p for s in r["spans"] for p in range(s["s"], s["e"])}
            assert on == set(np.flatnonzero(x.T.ravel()).tolist())
    assert df.limit(0).select(runs.mask_or("a", "b"), runs.mask_dilate("a", F.lit(7), F.lit(2)), runs.rle_encode("a")).count() == 0


def test_spans_that_overlap_or_touch(spark):
    df = spark.createDataFrame([(1, [(5, 9), (2, 5), (8, 12), (20, 24)]), (2, []), (3, None), (4, [(0, 24)])], "k long, spans array<struct<s:long,e:long>>")
    got = {r["k"]: r["runs"] for r in df.select("k", runs.runs_of_spans(F.col("spans"), 24).alias("runs")).collect()}
    assert got == {1: [2, 10, 8, 4], 2: [24], 3: None, 4: [0, 24]}


def test_functions_by_name(spark):
    runs.register(spark)
    spark.createDataFrame([(1, [2, 3, 5]), (1, [4, 4, 2]), (1, None), (2, [10])], "g long, m array<long>").createOrReplaceTempView("masks_by_name")
    got = {r["g"]: r for r in spark.sql("SELECT g, mask_union_agg(m) AS u FROM masks_by_name GROUP BY g").collect()}
    assert got[1]["u"] == [2, 6, 2] and got[2]["u"] == [10]
    one = spark.sql("SELECT mask_inter(m, array(0L, 10L)) AS n, mask_spans(m) AS s, rle_decode(rle_encode(m)) AS back, mask_union(array(m, array(10L))) AS u, mask_and(m, m) AS same, mask_minus(m, m) AS none, mask_or(m, m) AS too FROM masks_by_name WHERE m[0] = 2").first()
    assert one["n"] == 3 and [tuple(x) for x in one["s"]] == [(2, 5)] and one["back"] == one["u"] == one["same"] == one["too"] == [2, 3, 5] and one["none"] == [10]
    assert spark.sql("SELECT mask_dilate(array(4L, 1L, 4L), 3, 1) AS g, mask_pool(array(0L, 9L), 3, 1, 1) AS p").first()["p"] == [1.0]


def test_flange_and_conflicts_on_columns(spark):
    """Arrow kernels against the rules for one image."""
    from pyspark.sql import functions as F

    from trackloom.operators import masks

    r = np.random.default_rng(21)
    h, w = 9, 12
    images = r.random((12, h, w)) < 0.5
    lines = [(6.0, 4.0, 1.0, 0.0, 1.0), (3.0, 3.0, 1.0, 2.0, 0.5)]
    rows = [(k, runs.of_raster(images[k]).tolist(), *lines[k % 2]) for k in range(12)] + [(99, None, *lines[0])]
    df = spark.createDataFrame(rows, "k int, runs array<long>, x double, y double, nx double, ny double, band double")
    for got in df.select("k", runs.mask_flange("runs", F.lit(h), "x", "y", "nx", "ny", "band").alias("p")).collect():
        if got.k == 99:
            assert got.p is None
            continue
        x, y, nx, ny, band = lines[got.k % 2]
        want = runs.flange(images[got.k], (x, y), (nx, ny), band)
        assert all((runs.raster(np.array(p), h) == want[side]).all() for side, p in zip(runs.SIDES, got.p))
    ids = {0: [1101, 1102, 1103], 1: [1100, 1101, 1105], 2: [1100], 3: [1107], 4: [1101, 1102]}
    parts = [(f, o, runs.of_raster(images[(3 * f + n) % 12]).tolist()) for f, own in ids.items() for n, o in enumerate(own)] + [(4, 1109, None)]
    df = spark.createDataFrame(parts, "f int, object_id long, runs array<long>")
    for verified in (None, {1101, 1105}):
        out = masks.resolved(df, ["f"], verified=None if verified is None else F.col("object_id").isin(*verified)).collect()
        got = {(x.f, x.object_id): runs.raster(np.array(x.runs), h) for x in out}
        assert len(got) == len(out)
        for f, own in ids.items():
            want = runs.resolve({o: images[(3 * f + n) % 12] for n, o in enumerate(own)}, verified=verified)
            assert {o for g, o in got if g == f} == set(want)
            for o, image in want.items():
                assert (got[f, o] == image).all(), (f, o, verified)
