"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from trackloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, similarity=0.95):
    """n_links and smallest reachable id by id; ids are unique."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(good)
    links = {i: set() for i, _ in rows}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = good[i], good[j]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= similarity:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen) if i is not None else None)
    return out


def planted(n=900, dims=16, seed=3):
    """Random vectors, some with copies at all angles around the threshold, chains and equal or scaled vectors."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims))
    for i in range(0, n - 4, 5):
        z = r.standard_normal(dims)
        z -= z @ x[i] / (x[i] @ x[i]) * x[i]
        z *= np.linalg.norm(x[i]) / np.linalg.norm(z)
        for j, c in enumerate(r.uniform(0.9, 1, 2), 1):
            x[i + j] = c * x[i] + math.sqrt(1 - c * c) * z
        x[i + 3] = x[i] * (2 if i % 2 else 1)
    centre = r.standard_normal(dims)
    x[: n // 10] = centre + 0.2 * r.standard_normal((n // 10, dims))
    return x.astype(np.float32)


def table(spark, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"cell": 4, "entries": 16, "queries": 20, "recall": 1.0}])
def test_links_equal_all_pairs(spark, options):
    x = planted()
    want = brute([(i, v.tolist()) for i, v in enumerate(x)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(table(spark, x), **options).collect()}
    assert got == want and sum(n > 0 for n, _ in want.values()) > 300


@pytest.mark.parametrize("codes", [1, 4, 16])
def test_recall_of_the_index(codes):
    """Of pairs at the threshold at least the target is found, in directions of the data too; with a recall of 1 all are."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.standard_normal((1500, 64)), r.standard_normal((10, 64)).repeat(150, 0) + 0.3 * r.standard_normal((1500, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for recall, targets in ((1.0, (1, 1)), (0.999, (0.997, 0.98)), (0.98, (0.97, 0.75))):
        index = neighbours.MultiIndex(x, codes, 0.95, recall)
        for direction, least in zip((r.standard_normal(x.shape), x[r.permutation(len(x))]), targets):
            z = direction - (direction * x).sum(1, keepdims=True) * x
            norm = np.linalg.norm(z, axis=1, keepdims=True)
            y = 0.95 * x + math.sqrt(1 - 0.95**2) * np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-9)
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            (cx, rx, tx), (cy, ry, ty) = index.visits(x), index.visits(y)
            met = set(zip(rx.tolist(), tx.tolist())), set(zip(ry.tolist(), ty.tolist()))
            found = [a == b or (i, b) in met[0] or (i, a) in met[1] for i, (a, b) in enumerate(zip(cx.tolist(), cy.tolist()))]
            assert np.mean(found) >= least
    visited = np.bincount(index.visits(x)[1], minlength=len(x))
    assert codes < 16 or visited.mean() < codes * codes / 8


def test_visits_go_from_near_to_far():
    x = np.random.default_rng(7).standard_normal((400, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.MultiIndex(x, 6, 0.8, 1.0)
    cell, row, to = index.visits(x)
    own, ways = index.ways(x)
    assert (own == cell).all()
    sums = ways[0][:, :, None] + ways[1][:, None, :]
    for i in range(len(x)):
        flat = sums[i].ravel()
        mine = to[row == i]
        assert set(mine.tolist()) == {c for c in range(36) if flat[c] <= index.bound and c > cell[i]} and (np.diff(flat[mine]) >= 0).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 0.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.1], 1),
        (10, [1.0, 0.0, 0.0], 1), (11, [0.0, 1.0], 1), (12, [-1.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [1e-38, 1e-39], 2), (15, [3e38, 3e38], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", lit_(1)).withColumn("u", lit_(2)).withColumn("cell", lit_(3))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert got == brute([r[:2] for r in rows]) and got[9] == (3, 1) and got[11] == (1, 11)
    repeated = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (None, [1.0, 0.0], 0), (None, None, None)], SCHEMA)
    got = sorted((tuple(r) for r in neighbours.near_duplicates(repeated).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 0, None), (None, 0, None)], key=str)
    assert neighbours.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in neighbours.near_duplicates(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect()] == [(1, 0, 1)]


def lit_(value):
    from pyspark.sql import functions as F

    return F.lit(value)
