"""Vectorised byte and word hashing shared by the text operators.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.
Every byte of a non-ASCII code point belongs to a word, so the class is decided byte by byte.
Hashes have 64 bits; two different strings share one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = True
IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_OTHER = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=U64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


class _Powers:
    """Powers of the base and of its inverse, grown when a longer chunk comes, and kept up to MOST of them."""

    MOST = 1 << 21

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.MOST:  # of a very long text; not worth the memory when it is done
            return powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
        if len(self.up) < n:
            size = min(max(n, 2 * len(self.up)), self.MOST)
            self.up, self.down = powers(_BASE, size), powers(pow(_BASE, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, nulls as empty; the data is not copied."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer text comes alone."""
    data, offsets = flat(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a chunk of texts: 64-bit ``hash``, ``doc`` (row in the chunk), byte ``start`` and ``end``."""

    __slots__ = ("hash", "doc", "start", "end", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD, fold: np.ndarray | None = LOWER) -> None:
        """``is_word`` says of each folded byte whether words hold it; ``fold`` None leaves bytes as they are."""
        n = len(data)
        low = data if fold is None else fold[data]
        inside = is_word[low]
        before = np.empty(n, dtype=bool)
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        if n:
            before[0] = False
            before[heads] = False
        after = np.empty(n, dtype=bool)
        after[:-1] = inside[1:]
        if n:
            after[-1] = False
            tails = offsets[1:-1] - 1
            after[tails[tails >= 0]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        up, down = _POWERS.get(n + 1)
        sums = np.empty(n + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(_RANDOM[low] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        #: index of the first word of each row, and the number of words at the end
        self.first = np.searchsorted(self.start, offsets)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of ``data`` from ``start`` to ``end``, which are ordered and don't overlap, as binary values."""
    edges = np.empty(2 * len(start), np.int32)
    edges[0::2], edges[1::2] = start, end
    both = pa.Array.from_buffers(pa.binary(), max(len(edges) - 1, 0), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return both.take(pa.array(np.arange(0, len(both), 2)))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a text of fewer words, but not none, has one of all its words."""
    h, n = words.hash, len(words.hash)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = np.zeros(max(n - size + 1, 0), dtype=U64)
    for j in range(size):
        out = out * U64(0x100000001B3) + h[j : j + len(out)]
    keep = words.doc[: len(out)] == words.doc[size - 1 : size - 1 + len(out)]
    value, row = mix(out[keep]), words.doc[: len(out)][keep]
    if len(short):
        extra = np.zeros(len(short), dtype=U64)
        for j in range(size - 1):  # the j-th word of each text that has one
            own = counts[short] > j
            extra[own] = extra[own] * U64(0x100000001B3) + h[words.first[short[own]] + j]
        value = np.concatenate([value, mix(extra ^ counts[short].astype(U64))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    return value, row


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` bytes, by its start; runs that cross texts are the caller's to drop."""
    n = len(data)
    if n < size:
        return np.zeros(0, U64)
    up, down = _POWERS.get(n + 1)
    sums = np.empty(n + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_RANDOM[data] * up[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def hashes_at(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the runs of ``size`` bytes at ``starts``, 128 bits together."""
    up, down = _POWERS.get(len(data) + 1)
    out = []
    for table in (_RANDOM, _OTHER):
        sums = np.empty(len(data) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(table[data] * up[: len(data)], out=sums[1:])
        out.append(mix((sums[starts + size] - sums[starts]) * down[starts]))
    return out[0], out[1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
