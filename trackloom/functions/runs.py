"""Run-length masks: column-major runs that begin with background. Built-in expressions where they reach, Arrow functions for set algebra.

A mask is an array of run lengths whose sum is height times width; null stands for an unknown mask, never for an empty one.

The Arrow functions work on a batch at once: the masks of a batch are laid end to end on one line, a pixel of background between
them, and a single sort and running sum over the edges of all spans gives every row's result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels of masks that are drawn at once.
DRAWN = 1 << 24
MASK = T.ArrayType(T.LongType())


def check_runs(runs: list[int], pixels: int) -> np.ndarray:
    """The runs as an array; a ValueError if they aren't whole numbers that fill the image, zeros only at the start."""
    if not runs or any(isinstance(x, bool) or not isinstance(x, (int, np.integer)) for x in runs):
        raise ValueError("runs must be whole numbers")
    out = np.array(runs, np.int64)
    if (out < 0).any() or (out[1:] == 0).any() or out.sum() != pixels:
        raise ValueError("runs must be positive and fill the image")
    return out


# kernels on lists: all values of a batch end to end, and the sizes of its rows


def _numbers(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each row."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _owners(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def encode_all(values: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Compressed strings of runs. The format is a fixed one, the common compressed form of run-length masks: from the fourth run on
    the difference to the run before last, five bits a character from the lowest, sign-extended, a sixth bit where more follow."""
    place = _numbers(sizes)
    x = values.astype(np.int64)
    late = np.flatnonzero(place > 2)
    x[late] -= values[late - 2]
    groups, limit = np.ones(len(x), np.int64), 16
    while (wide := (x >= limit) | (x < -limit)).any():
        groups += wide
        limit <<= 5
    first = np.cumsum(groups) - groups
    out = np.zeros(int(groups.sum()), np.uint8)
    for g in range(int(groups.max(initial=0))):
        at = groups > g
        out[first[at] + g] = 48 + ((x[at] >> (5 * g)) & 31) + np.where(groups[at] > g + 1, 32, 0)
    text = out.tobytes().decode("ascii")
    ends = np.cumsum(np.bincount(_owners(sizes), groups, len(sizes)).astype(np.int64)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def decode_all(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, sizes) of compressed strings, given as bytes."""
    c = data.astype(np.int64) - 48
    if ((c < 0) | (c > 63)).any():
        raise ValueError("not a compressed mask")
    last = c & 32 == 0
    row = _owners(sizes)
    if not last[(np.cumsum(sizes) - 1)[sizes > 0]].all():
        raise ValueError("a cut string")
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    width = ends - starts + 1
    shift = 5 * _numbers(width)
    x = np.add.reduceat((c & 31) << shift, starts) if len(starts) else np.zeros(0, np.int64)
    x = np.where(c[ends] & 16, x - (np.int64(1) << (5 * width)), x)
    counts = np.bincount(row[ends], minlength=len(sizes)) if len(ends) else np.zeros(len(sizes), np.int64)
    # two chains of differences a row: runs 1, 3, 5 ... and 2, 4, 6 ...; run 0 stands alone
    place = _numbers(counts)
    for start in (1, 2):
        chain = np.flatnonzero((place >= start) & ((place - start) % 2 == 0))
        if len(chain):
            total = np.cumsum(x[chain])
            heads = np.flatnonzero(place[chain] == start)
            before = np.repeat(np.where(heads > 0, total[heads - 1], 0), np.diff(np.append(heads, len(chain))))
            x[chain] = total - before
    return x, counts


def encode(runs: list[int] | np.ndarray) -> str:
    """The compressed string of runs."""
    return encode_all(np.asarray(runs, np.int64), np.array([len(runs)]))[0]


def decode(text: str) -> list[int]:
    """The runs of a compressed string."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return decode_all(raw, np.array([len(raw)]))[0].tolist()


def pixels_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pixels of each mask."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def laid(values: np.ndarray, sizes: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the foreground of masks that begin at ``bases`` on a line."""
    row = _owners(sizes)
    total = np.cumsum(values)
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    ends = total - before[row] + bases[row]
    on = _numbers(sizes) % 2 == 1
    return (ends - values)[on], ends[on]


def sweep(edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions, depths): how many spans of each side lie on the line from each position to the next."""
    at = np.concatenate([x for side in edges for x in side])
    order = np.argsort(at, kind="stable")
    at = at[order]
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
    depths, n = [], 0
    for starts, ends in edges:
        step = np.zeros(len(order), np.int32)
        step[n : n + len(starts)] = 1
        step[n + len(starts) : n + len(starts) + len(ends)] = -1
        n += len(starts) + len(ends)
        depths.append(np.cumsum(step[order])[last])
    return at[last], depths


def to_runs(at: np.ndarray, on: np.ndarray, bases: np.ndarray, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, sizes) of the masks whose foreground is where ``on`` holds on the line."""
    change = np.diff(np.concatenate([[0], on.astype(np.int8)]))
    starts, ends = at[change == 1], at[change == -1]
    row = np.searchsorted(bases, starts, side="right") - 1
    counts = np.bincount(row, minlength=len(bases))
    first = np.cumsum(2 * counts + 1) - (2 * counts + 1)
    edge = np.empty(2 * len(starts) + len(bases), np.int64)
    place = first[row] + 2 * _numbers(counts)
    edge[place], edge[place + 1], edge[first + 2 * counts] = starts, ends, bases + pixels
    before = np.concatenate([[0], edge[:-1]])
    before[first] = bases
    out, sizes = edge - before, 2 * counts + 1
    full = (out[first + 2 * counts] == 0) & (counts > 0)  # foreground up to the last pixel
    keep = np.ones(len(out), bool)
    keep[(first + 2 * counts)[full]] = False
    return out[keep], sizes - full


def line(pixels: np.ndarray) -> np.ndarray:
    """Where masks of so many pixels begin, a pixel apart."""
    return np.cumsum(pixels + 1) - (pixels + 1)


HOW = {"and": lambda a, b: (a > 0) & (b > 0), "or": lambda a, b: (a > 0) | (b > 0), "minus": lambda a, b: (a > 0) & (b <= 0)}


def combine(a: np.ndarray, b: np.ndarray, how: str) -> np.ndarray:
    """Runs of a AND b, a OR b, or a without b."""
    base = np.zeros(1, np.int64)
    at, (x, y) = sweep([laid(np.asarray(m, np.int64), np.array([len(m)]), base) for m in (a, b)])
    return to_runs(at, HOW[how](x, y), base, np.array([int(np.sum(a))]))[0]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Pixels in both masks."""
    return int(combine(a, b, "and")[1::2].sum())


def raster(runs: np.ndarray, h: int) -> np.ndarray:
    """The mask as a boolean image."""
    return np.repeat(np.arange(len(runs)) % 2 == 1, runs).reshape(-1, h).T


def of_raster(image: np.ndarray) -> np.ndarray:
    return of_rasters(image[None])[0]


def of_rasters(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs, sizes) of a stack of images."""
    n, h, w = images.shape
    flat = np.zeros((n, h * w + 1), np.int8)
    flat[:, :-1] = images.transpose(0, 2, 1).reshape(n, -1)
    flat = flat.ravel()
    at = np.flatnonzero(np.diff(np.concatenate([[0], flat])))
    pixels = np.full(n, h * w, np.int64)
    return to_runs(at, flat[at] > 0, line(pixels), pixels)


def box(runs: np.ndarray, h: int) -> list[int] | None:
    """The tight box, right and bottom excluded, without drawing the mask; None if it is empty."""
    s, e = laid(np.asarray(runs, np.int64), np.array([len(runs)]), np.zeros(1, np.int64))
    if not len(s):
        return None
    e = e - 1
    wide = s // h != e // h
    return [int((s // h).min()), 0 if wide.any() else int((s % h).min()), int((e // h).max()) + 1, h if wide.any() else int((e % h).max()) + 1]


def ellipse(radius: int) -> list[tuple[int, int]]:
    """(dy, half width) of the rows of an elliptic kernel of this radius."""
    return [(dy, round(math.sqrt(radius * radius - dy * dy))) for dy in range(-radius, radius + 1)]


def dilate(images: np.ndarray, radius: int) -> np.ndarray:
    """An image, or a stack of images, grown by an elliptic kernel; nothing enters from outside."""
    h, w = images.shape[-2:]
    sums = np.concatenate([np.zeros((*images.shape[:-1], 1), np.int32), np.cumsum(images, axis=-1, dtype=np.int32)], axis=-1)
    out = np.zeros_like(images)
    x = np.arange(w)
    for dy, half in ellipse(radius):
        grown = sums[..., np.minimum(x + half + 1, w)] - sums[..., np.maximum(x - half, 0)] > 0
        if dy >= 0:
            out[..., dy:, :] |= grown[..., : max(h - dy, 0), :]
        else:
            out[..., :dy, :] |= grown[..., -dy:, :]
    return out


def margin(width: int) -> int:
    """The radius by which a region of interest is grown."""
    return max(1, round(4 * width / 640))


def _weights(size: int, target: int) -> np.ndarray:
    edges = np.linspace(0, size, target + 1)
    i = np.arange(size)
    return np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, 1) * target / size


def cells(images: np.ndarray, h: int, w: int) -> np.ndarray:
    """Images averaged by area into h x w cells."""
    if h > images.shape[-2] or w > images.shape[-1]:
        raise ValueError("pooling only makes masks smaller")
    return _weights(images.shape[-2], h) @ images @ _weights(images.shape[-1], w).T


def pool(images: np.ndarray, known: np.ndarray, h: int, w: int) -> np.ndarray:
    """The mean of frames, unknown pixels as 0, averaged by area into h x w cells."""
    return cells((images & known).mean(axis=0), h, w)


def flange(image: np.ndarray, point: tuple[float, float], normal: tuple[float, float], band: float) -> dict[str, np.ndarray]:
    """A mask split by signed distance from a line: near side, far side, and the uncertain band between."""
    y, x = np.nonzero(image)
    length = math.hypot(*normal)
    distance = ((x - point[0]) * normal[0] + (y - point[1]) * normal[1]) / length
    out = {k: np.zeros_like(image) for k in ("arm", "effector", "unknown")}
    out["arm"][y[distance < -band], x[distance < -band]] = True
    out["effector"][y[distance > band], x[distance > band]] = True
    middle = abs(distance) <= band
    out["unknown"][y[middle], x[middle]] = True
    return out


def resolve(parts: dict[int, np.ndarray], unknown: int = 1100, verified: set[int] | None = None) -> dict[int, np.ndarray]:
    """Robot parts without conflicts: pixels of two parts, and parts not among ``verified``, become the unknown part's.

    Objects aren't given here: the robot never takes pixels from them.
    """
    if not parts:
        return {}
    shape = next(iter(parts.values())).shape
    rest = parts.get(unknown, np.zeros(shape, bool)).copy()
    named = {k: v.copy() for k, v in parts.items() if k != unknown}
    if verified is not None:
        for k in set(named) - verified:
            rest |= named[k]
            named[k][:] = False
    twice = sum(v.astype(np.int8) for v in named.values()) > 1 if named else np.zeros(shape, bool)
    rest |= twice
    for v in named.values():
        v &= ~twice
        rest &= ~v
    return named | {unknown: rest}


# columns


def area(runs: Column) -> Column:
    """Foreground pixels of a mask column."""
    return F.aggregate(F.filter(runs, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)


def bounds(runs: Column, h: Column | int) -> Column:
    """A struct of the tight box, in one pass over the runs; null if the mask is empty or null."""
    h = F.lit(h).cast("long") if isinstance(h, int) else h.cast("long")
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).alias("i"), none.alias("x0"), none.alias("y0"), none.alias("x1"), none.alias("y1"))

    def step(s: Column, n: Column) -> Column:
        end = s["p"] + n
        on = (s["i"] % 2 == 1) & (n > 0)
        first, last = F.floor(s["p"] / h).cast("long"), F.floor((end - 1) / h).cast("long")
        wide = first != last
        top, bottom = F.when(wide, F.lit(0)).otherwise(s["p"] % h), F.when(wide, h).otherwise((end - 1) % h + 1)
        return F.struct(
            end.alias("p"), (s["i"] + 1).alias("i"),
            F.when(on, F.least(s["x0"], first)).otherwise(s["x0"]).alias("x0"), F.when(on, F.least(s["y0"], top)).otherwise(s["y0"]).alias("y0"),
            F.when(on, F.greatest(s["x1"], last + 1)).otherwise(s["x1"]).alias("x1"), F.when(on, F.greatest(s["y1"], bottom)).otherwise(s["y1"]).alias("y1"))

    got = F.aggregate(runs, start, step, lambda s: F.struct(s["x0"].alias("x0"), s["y0"].alias("y0"), s["x1"].alias("x1"), s["y1"].alias("y1")))
    return F.when(got["x0"].isNotNull(), got)


def covers(runs: Column, position: Column) -> Column:
    """Whether a mask has the pixel at a column-major position."""
    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).alias("i"), F.lit(False).alias("hit"))
    got = F.aggregate(runs, start, lambda s, n: F.struct((s["p"] + n).alias("p"), (s["i"] + 1).alias("i"), (s["hit"] | ((s["i"] % 2 == 1) & (position >= s["p"]) & (position < s["p"] + n))).alias("hit")))
    return got["hit"]


# Arrow batches


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, sizes, which rows aren't null) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes, np.asarray(column.is_valid())


def _lists(values: np.ndarray, sizes: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column; rows that aren't valid are null."""
    if not valid.all():
        values, sizes = values[np.repeat(valid, sizes)], np.where(valid, sizes, 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind), mask=pa.array(~valid))


def _met(a: pa.Array, b: pa.Array) -> tuple:
    """(positions, depths of both, bases, pixels, which rows have both masks) of two columns of masks on one line."""
    (va, na, ok), (vb, nb, there) = _rows(a), _rows(b)
    pixels = np.maximum(pixels_of(va, na), pixels_of(vb, nb))
    bases = line(pixels)
    at, (x, y) = sweep([laid(va, na, bases), laid(vb, nb, bases)])
    return at, x, y, bases, pixels, ok & there


@F.arrow_udf(T.LongType())
def mask_inter(a: pa.Array, b: pa.Array) -> pa.Array:
    """Pixels in both masks; null if one is unknown."""
    at, x, y, bases, _, ok = _met(a, b)
    on = np.flatnonzero((x > 0) & (y > 0))
    out = np.bincount(np.searchsorted(bases, at[on], side="right") - 1, at[on + 1] - at[on], len(bases)) if len(on) else np.zeros(len(bases))
    return pa.array(out.astype(np.int64), mask=~ok)


def _combined(how: str):  # noqa: ANN202
    @F.arrow_udf(MASK)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        at, x, y, bases, pixels, ok = _met(a, b)
        return _lists(*to_runs(at, HOW[how](x, y), bases, pixels), ok, pa.int64())

    return run


mask_and, mask_or, mask_minus = _combined("and"), _combined("or"), _combined("minus")


def _united(inner: pa.Array, sizes: np.ndarray, least: int = 1) -> pa.Array:
    """The pixels that ``least`` masks or more of a group hold, ``sizes`` masks a group; null where a group has none but unknown ones."""
    values, own, valid = _rows(inner)
    group = _owners(sizes)
    pixels = np.zeros(len(sizes), np.int64)
    np.maximum.at(pixels, group, pixels_of(values, own))
    bases = line(pixels)
    at, (depth,) = sweep([laid(values, own, bases[group])])
    return _lists(*to_runs(at, depth >= least, bases, pixels), np.bincount(group, valid, len(sizes)) > 0, pa.int64())


@F.arrow_udf(MASK)
def mask_union(masks: pa.Array) -> pa.Array:
    """The union of an array of masks; nulls among them are left out, and none at all gives null."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(masks), 0)).astype(np.int64)
    return _united(masks.flatten(), sizes)


@F.arrow_udf(MASK)
def mask_shared(masks: pa.Array) -> pa.Array:
    """The pixels that two or more of an array of masks hold; nulls among them are left out, and none at all gives null."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(masks), 0)).astype(np.int64)
    return _united(masks.flatten(), sizes, 2)


#: Sides of a line through a robot's flange.
SIDES = ("arm", "effector", "unknown")


@F.arrow_udf(T.ArrayType(MASK))
def mask_flange(runs: pa.Array, h: pa.Array, x: pa.Array, y: pa.Array, nx: pa.Array, ny: pa.Array, band: pa.Array) -> pa.Array:
    """A mask's three parts by signed distance from the line through (x, y) with the normal (nx, ny): before the band, beyond it, and in the band itself."""
    values, sizes, ok = _rows(runs)
    lines = np.column_stack([np.asarray(c.fill_null(0)).astype(float) for c in (x, y, nx, ny, band)])
    parts = []
    for rows, _, images in _stacks(values, sizes, _keys(h)):
        v, u = np.mgrid[: images.shape[1], : images.shape[2]]
        own, which = np.unique(lines[rows], axis=0, return_inverse=True)
        for k, (px, py, ax, ay, wide) in enumerate(own):
            at = rows[which.ravel() == k]
            distance = ((u - px) * ax + (v - py) * ay) / math.hypot(ax, ay)
            for n, side in enumerate((distance < -wide, distance > wide, np.abs(distance) <= wide)):
                parts.append((3 * at + n, *of_rasters(images[which.ravel() == k] & side)))
    inner = _lists(*_placed(parts, 3 * len(sizes), np.int64), np.repeat(ok, 3), pa.int64())
    return pa.ListArray.from_arrays(pa.array(3 * np.arange(len(sizes) + 1), pa.int32()), inner, mask=pa.array(~ok))


@F.arrow_udf(T.ArrayType(MASK))
def mask_layers(masks: pa.Array) -> pa.Array:
    """An array of masks, each without the pixels of those before it; unknown masks stay unknown and take nothing."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(masks), 0)).astype(np.int64)
    values, sizes, valid = _rows(masks.flatten())
    first, begin, pixels = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes, np.zeros(len(counts), np.int64)
    np.maximum.at(pixels, _owners(counts), pixels_of(values, sizes))
    bases, taken, parts = line(pixels), (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
    for k in range(int(counts.max(initial=0))):  # the k-th masks of all rows at once
        rows = np.flatnonzero(counts > k)
        own = first[rows] + k
        at = np.repeat(begin[own], sizes[own]) + _numbers(sizes[own])
        at_, (mine, before) = sweep([laid(values[at], sizes[own], bases[rows]), taken])
        got, n = to_runs(at_, (mine > 0) & (before <= 0), bases, pixels)
        keep = np.zeros(len(counts), bool)
        keep[rows[valid[own]]] = True
        parts.append((first[keep] + k, got[np.repeat(keep, n)], n[keep]))
        on = np.diff(np.concatenate([[0], ((mine > 0) | (before > 0)).astype(np.int8)]))
        taken = at_[on == 1], at_[on == -1]
    inner = _lists(*_placed(parts, len(sizes), np.int64), valid, pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), inner, mask=pa.array(~np.asarray(masks.is_valid())))


@F.pandas_udf(MASK)
def mask_union_agg(masks: pd.Series) -> np.ndarray:
    """The union of a group's masks, as an aggregate; for groups such as a frame's parts."""
    got = _united(pa.array(list(masks), pa.list_(pa.int64())), np.array([len(masks)]))
    return got[0].as_py()


@F.arrow_udf(T.ArrayType(T.StructType().add("s", "long").add("e", "long")))
def mask_spans(runs: pa.Array) -> pa.Array:
    """The foreground of a mask as spans [s, e) of pixels; an empty mask has none."""
    values, sizes, ok = _rows(runs)
    starts, ends = laid(values, sizes, np.zeros(len(sizes), np.int64))
    counts = sizes // 2
    spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["s", "e"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans, mask=pa.array(~ok))


@F.arrow_udf(T.StructType().add("area", "long").add("x0", "long").add("y0", "long").add("x1", "long").add("y1", "long"))
def mask_geometry(runs: pa.Array, h: pa.Array) -> pa.Array:
    """Foreground pixels and the tight box of a mask of height ``h``, all null if it is unknown; an empty mask has no box."""
    values, sizes, ok = _rows(runs)
    height, row = np.asarray(pc.fill_null(h, 1)).astype(np.int64), _owners(sizes // 2)
    starts, ends = laid(values, sizes, np.zeros(len(sizes), np.int64))
    real = ends > starts
    starts, ends, row = starts[real], ends[real] - 1, row[real]
    first, last = starts // height[row], ends // height[row]
    wide = first != last
    far = np.iinfo(np.int64).max
    low, high = np.full((2, len(sizes)), far), np.full((2, len(sizes)), -1)
    for k, x in enumerate((first, np.where(wide, 0, starts % height[row]))):
        np.minimum.at(low[k], row, x)
    for k, x in enumerate((last + 1, np.where(wide, height[row], ends % height[row] + 1))):
        np.maximum.at(high[k], row, x)
    pixels = np.bincount(row, ends + 1 - starts, len(sizes)).astype(np.int64)
    none = ~ok | (pixels == 0)
    return pa.StructArray.from_arrays([pa.array(pixels, mask=~ok), *(pa.array(x, mask=none) for x in (low[0], low[1], high[0], high[1]))], names=["area", "x0", "y0", "x1", "y1"])


def runs_of_spans(spans_: Column, pixels: int) -> Column:
    """Runs of an array of structs (s, e), sorted or not, that may overlap."""

    @F.arrow_udf(MASK)
    def run(spans: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(spans), 0)).astype(np.int64)
        flat, size = spans.flatten(), np.full(len(sizes), pixels, np.int64)
        bases = line(size)
        shift = bases[_owners(sizes)]
        at, (depth,) = sweep([tuple(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + shift for k in (0, 1))])
        return _lists(*to_runs(at, depth > 0, bases, size), np.asarray(spans.is_valid()), pa.int64())

    return run(spans_)


@F.arrow_udf(T.StringType())
def rle_encode(runs: pa.Array) -> pa.Array:
    """Compressed strings of masks."""
    values, sizes, ok = _rows(runs)
    return pa.array(encode_all(values, sizes), pa.string(), mask=~ok)


@F.arrow_udf(MASK)
def rle_decode(text: pa.Array) -> pa.Array:
    """Masks of compressed strings."""
    raw = pc.fill_null(text, "").cast(pa.binary())
    sizes = np.asarray(pc.binary_length(raw)).astype(np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    return _lists(*decode_all(data, sizes), np.asarray(text.is_valid()), pa.int64())


def _stacks(values: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, tuple, np.ndarray]]:
    """(rows, key, images) of masks drawn together: those of equal keys, whose first part is the height, and equal size."""
    pixels = pixels_of(values, sizes)
    shape = np.column_stack([keys, pixels])
    first = np.cumsum(sizes) - sizes
    for key in np.unique(shape[sizes > 0], axis=0):
        every = np.flatnonzero((shape == key).all(axis=1) & (sizes > 0))
        step = max(1, DRAWN // max(int(key[-1]), 1))
        for a in range(0, len(every), step):
            rows = every[a : a + step]
            at = np.repeat(first[rows], sizes[rows]) + _numbers(sizes[rows])
            on = np.repeat(_numbers(sizes[rows]) % 2 == 1, values[at])
            yield rows, tuple(int(k) for k in key[:-1]), on.reshape(len(rows), -1, int(key[0])).transpose(0, 2, 1)


def _placed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of rows that came in parts (rows, values, sizes)."""
    sizes = np.zeros(n, np.int64)
    for rows, _, own in parts:
        sizes[rows] = own
    first, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), kind)
    for rows, values, own in parts:
        out[np.repeat(first[rows], own) + _numbers(own)] = values
    return out, sizes


def _keys(*columns: pa.Array) -> np.ndarray:
    return np.column_stack([np.asarray(pc.fill_null(c, 1)).astype(np.int64) for c in columns])


@F.arrow_udf(MASK)
def mask_dilate(runs: pa.Array, h: pa.Array, radius: pa.Array) -> pa.Array:
    """Masks grown by an elliptic kernel."""
    values, sizes, ok = _rows(runs)
    parts = [(rows, *of_rasters(dilate(images, key[1]))) for rows, key, images in _stacks(values, sizes, _keys(h, radius))]
    return _lists(*_placed(parts, len(sizes), np.int64), ok, pa.int64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def mask_pool(runs: pa.Array, h: pa.Array, rows: pa.Array, columns: pa.Array) -> pa.Array:
    """A mask averaged by area into rows x columns cells, row by row."""
    values, sizes, ok = _rows(runs)
    parts = []
    for which, (_, a, b), images in _stacks(values, sizes, _keys(h, rows, columns)):
        parts.append((which, cells(images.astype(float), a, b).ravel(), np.full(len(which), a * b)))
    return _lists(*_placed(parts, len(sizes), float), ok, pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def mask_pool_frames(masks: pa.Array, h: pa.Array, rows: pa.Array, columns: pa.Array) -> pa.Array:
    """The mean over an array of masks, the frames of a support, averaged by area into rows x columns cells; an unknown mask counts as 0."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(masks), 0)).astype(np.int64)
    keys = _keys(h, rows, columns)
    group = _owners(counts)
    values, sizes, _ = _rows(masks.flatten())
    wide = keys[:, 1] * keys[:, 2]
    first, out = np.cumsum(wide) - wide, np.zeros(int(wide.sum()))
    for which, (_, a, b), images in _stacks(values, sizes, keys[group]):
        own = cells(images.astype(float), a, b).reshape(len(which), -1) / counts[group[which]][:, None]
        np.add.at(out, first[group[which]][:, None] + np.arange(a * b), own)
    return _lists(out, wide, counts > 0, pa.float64())


def iou(inter: Column, a: Column, b: Column) -> Column:
    """Intersection over union of areas; null if both masks are empty."""
    return F.try_divide(inter, F.nullif(a + b - inter, F.lit(0)))


def dice(inter: Column, a: Column, b: Column) -> Column:
    return F.try_divide(2 * inter, F.nullif(a + b, F.lit(0)))


def register(spark: SparkSession) -> None:
    """The functions by name, for SQL."""
    every = {
        "mask_inter": mask_inter, "mask_and": mask_and, "mask_or": mask_or, "mask_minus": mask_minus, "mask_union": mask_union, "mask_shared": mask_shared, "mask_flange": mask_flange, "mask_union_agg": mask_union_agg,
        "mask_spans": mask_spans, "rle_encode": rle_encode, "rle_decode": rle_decode, "mask_dilate": mask_dilate, "mask_pool": mask_pool}
    for name, f in every.items():
        spark.udf.register(name, f)
