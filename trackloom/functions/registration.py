"""Registration of images by point matches: similarity transforms from samples of pairs, and masks moved by them.

A transform is a pair of complex numbers (a, b): a point z = x + iy goes to a z + b, so |a| is the scale and the argument of a the turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.runs import MASK, _lists, _placed, _rows, _stacks, of_rasters

#: Fixed values of the rule: distance of an inlier, least matches and inliers, least share of inliers, bounds of the scale, least extent of the inliers,
#: and for a head camera the largest move of the matches' centre as a share of the width, and the least share of the scale that isn't turned away.
REACH, LEAST, SHARE, SCALES, EXTENT, HEAD_MOVE, UPRIGHT = 3.0, 7, 0.50, (0.65, 1.55), 35.0, 0.22, 0.6
TRIALS = 500


def fitted(source: np.ndarray, target: np.ndarray) -> tuple[complex, complex]:
    """The transform of least squares."""
    ms, mt = source.mean(), target.mean()
    spread = (np.abs(source - ms) ** 2).sum()
    a = complex((np.conj(source - ms) * (target - mt)).sum() / spread) if spread > 0 else 1 + 0j
    return a, complex(mt - a * ms)


def similarity(source: np.ndarray, target: np.ndarray, seed: int, trials: int = TRIALS) -> tuple[complex, complex, np.ndarray] | None:
    """(a, b, inliers) of the transform that most matches agree with, refitted to them; None without two different points.

    Each trial takes the transform of two matches, drawn by ``seed``. The same matches in the same order give the same result.
    """
    n = len(source)
    if n < 2:
        return None
    r = np.random.default_rng(seed)
    i = r.integers(0, n, trials)
    j = (i + r.integers(1, n, trials)) % n
    use = np.abs(source[j] - source[i]) > 1e-9
    if not use.any():
        return None
    i, j = i[use], j[use]
    a = (target[j] - target[i]) / (source[j] - source[i])
    b = target[i] - a * source[i]
    hits = np.array([int((np.abs(p * source + q - target) <= REACH).sum()) for p, q in zip(a, b)])
    best = int(hits.argmax())
    inside = np.abs(a[best] * source + b[best] - target) <= REACH
    for _ in range(10):
        p, q = fitted(source[inside], target[inside])
        new = np.abs(p * source + q - target) <= REACH
        if new.sum() < inside.sum() or (new == inside).all():
            break
        inside = new
    p, q = fitted(source[inside], target[inside])
    return p, q, inside


def refusal(source: np.ndarray, a: complex, b: complex, inside: np.ndarray, camera: str | None, width: int) -> str | None:
    """Why a transform isn't taken over, null if it is: it must be supported, about of the reference's size, and spread out; at the head camera also near its place and upright."""
    n, scale = int(inside.sum()), abs(a)
    own = source[inside]
    extent = np.hypot(np.ptp(own.real), np.ptp(own.imag)) if n else 0.0
    centre = source.mean()
    if n < LEAST or n < SHARE * len(source):
        return "few_inliers"
    if not SCALES[0] < scale < SCALES[1]:
        return "scale"
    if camera == "head" and (abs((a * centre + b - centre).real) > HEAD_MOVE * width or a.real < UPRIGHT * scale):
        return "posture"
    return "extent" if extent < EXTENT else None


def moved(images: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A stack of images, each moved by its own transform: a pixel shows the nearest one that comes to it, or nothing from outside."""
    n, h, w = images.shape
    y, x = np.mgrid[:h, :w]
    out = np.zeros_like(images)
    for k in range(n):
        if a[k] != 0:
            z = (x + 1j * y - b[k]) / a[k]
            u, v = np.floor(z.real + 0.5).astype(np.int64), np.floor(z.imag + 0.5).astype(np.int64)
            real = (u >= 0) & (u < w) & (v >= 0) & (v < h)
            out[k][real] = images[k][v[real], u[real]]
    return out


@F.arrow_udf(MASK)
def mask_moved(runs: pa.Array, h: pa.Array, ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
    """Masks moved by similarity transforms."""
    values, sizes, ok = _rows(runs)
    a, b = (np.asarray(p.fill_null(0.0)) + 1j * np.asarray(q.fill_null(0.0)) for p, q in ((ax, ay), (bx, by)))
    heights = np.asarray(h.fill_null(1)).astype(np.int64)[:, None]
    parts = [(rows, *of_rasters(moved(images, a[rows], b[rows]))) for rows, _, images in _stacks(values, sizes, heights)]
    return _lists(*_placed(parts, len(sizes), np.int64), ok, pa.int64())


def turned(ax: Column, ay: Column) -> tuple[Column, Column]:
    """(scale, degrees) of a transform."""
    return F.hypot(ax, ay), F.degrees(F.atan2(ay, ax))
