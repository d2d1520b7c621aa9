"""Registration against planted transforms and pixel by pixel."""

import numpy as np
import pytest

from trackloom.functions import registration as G
from trackloom.functions import runs as R
from trackloom.operators import registration


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5])
def test_planted_outliers(share):
    r = np.random.default_rng(int(share * 10))
    for n in (20, 200):
        source = r.uniform(0, 600, n) + 1j * r.uniform(0, 300, n)
        a, b = 1.2 * np.exp(0.3j), 20 - 15j
        wrong = np.arange(n) < share * n
        target = a * source + b + np.where(wrong, r.uniform(-400, 400, n) + 1j * r.uniform(50, 300, n), r.normal(0, 0.5, n) + 1j * r.normal(0, 0.5, n))
        p, q, inside = G.similarity(source, target, 5)
        assert abs(p - a) < 0.02 and abs(q - b) < 8 and (inside[~wrong]).all() and inside[wrong].sum() <= 0.1 * n
        assert G.refusal(source, p, q, inside, "wrist", 640) is None
        again = G.similarity(source, target, 5)
        assert again[0] == p and (again[2] == inside).all()
    assert G.similarity(source[:1], target[:1], 1) is None and G.similarity(np.zeros(9, complex), np.ones(9, complex), 1) is None


def test_gates():
    source = np.array([x + 1j * y for x in (0, 30, 60, 90) for y in (0, 20)])
    every = np.ones(8, bool)
    assert G.refusal(source, 1 + 0j, 0j, every, None, 640) is None
    assert G.refusal(source, 1 + 0j, 0j, np.arange(8) < 6, None, 640) == "few_inliers"
    assert G.refusal(np.tile(source, 2), 1 + 0j, 0j, np.arange(16) < 7, None, 640) == "few_inliers"
    assert G.refusal(source, 0.65 + 0j, 0j, every, None, 640) == G.refusal(source, 1.55 + 0j, 0j, every, None, 640) == "scale"
    assert G.refusal(source, 1 + 0j, 141 + 0j, every, "head", 640) == "posture" and G.refusal(source, 1 + 0j, 141 + 0j, every, "wrist", 640) is None
    assert G.refusal(source, np.exp(1j), 0j, every, "head", 640) == "posture"
    assert G.refusal(source / 4, 1 + 0j, 0j, every, None, 640) == "extent"


def test_moved_masks_pixel_by_pixel(spark):
    r = np.random.default_rng(3)
    h, w = 18, 25
    images = r.random((5, h, w)) < 0.4
    a = np.array([1, 1.3 * np.exp(0.4j), 0.7j, 1, np.exp(-2j)])
    b = np.array([3 - 2j, 1 + 1j, 12 + 3j, 100, 20 + 10j])
    rows = [(k, R.of_raster(images[k]).tolist(), h, *(float(c) for c in (a[k].real, a[k].imag, b[k].real, b[k].imag))) for k in range(5)] + [(9, None, h, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, runs array<long>, h int, ax double, ay double, bx double, by double")
    got = {x.k: x.m for x in df.select("k", G.mask_moved("runs", "h", "ax", "ay", "bx", "by").alias("m")).collect()}
    assert got[9] is None
    for k in range(5):
        want = np.zeros((h, w), bool)
        for y in range(h):
            for x in range(w):
                z = (x + 1j * y - b[k]) / a[k]
                u, v = int(np.floor(z.real + 0.5)), int(np.floor(z.imag + 0.5))
                want[y, x] = 0 <= u < w and 0 <= v < h and images[k, v, u]
        assert (R.raster(np.array(got[k]), h) == want).all()


def test_references_are_taken_over(spark):
    """Two references in one image, one that leaves it, one that is refused."""
    r = np.random.default_rng(4)
    rows = []
    for ref, (a, b) in {1: (1 + 0j, 2 + 1j), 2: (1 + 0j, 0j), 3: (1 + 0j, 500 + 0j), 4: (3 + 0j, 0j)}.items():
        for z in r.uniform(0, 60, 20) + 1j * r.uniform(0, 60, 20):
            t = a * z + b
            rows.append((7, ref, "wrist", *(float(c) for c in (z.real, z.imag, t.real, t.imag))))
    rows += [(7, 1, "wrist", None, 1.0, 1.0, 1.0), (7, 1, "wrist", float("nan"), 1.0, 1.0, 1.0), (8, 1, "wrist", 1.0, 1.0, 1.0, 1.0)]
    schema = "image_id long, reference long, camera string, source_x double, source_y double, target_x double, target_y double"
    found = registration.located(spark.createDataFrame(rows, schema).repartition(5))
    got = {x.reference: x for x in found.collect()}
    assert set(got) == {1, 2, 3, 4} and [got[k].refusal for k in (1, 2, 3, 4)] == [None, None, None, "scale"] and got[1].matches == got[1].inliers == 20
    h, w = 12, 16
    square = np.zeros((h, w), bool)
    square[2:5, 3:6] = True
    mask = R.of_raster(square).tolist()
    masks = spark.createDataFrame([(1, 50, mask), (2, 50, mask), (3, 50, mask), (3, 1100, mask), (4, 50, mask)], "reference long, object_id long, runs array<long>")
    (row,) = registration.taken_over(found, masks, h).collect()
    want = square.copy()
    want[3:6, 5:8] = True
    assert (row.image_id, row.object_id) == (7, 50) and (R.raster(np.array(row.runs), h) == want).all()
    assert registration.located(spark.createDataFrame([], schema)).count() == 0
