"""Suffix-array dedup: maximal repeats of at least ``LENGTH`` bytes with all occurrences.

A suffix array of a whole corpus doesn't fit a task, so it is sparse and cut by content. Each run of LENGTH bytes picks
its leftmost least K-byte hash as its anchor: equal runs pick the same one. Suffixes begin at anchors; those with equal first K bytes
lie in one shard, with as many bytes to the left as a run can reach. A shard sorts its distinct suffixes, takes the
common prefixes of neighbours, and scans them with a stack for the intervals of the common-prefix tree. In each interval
left contexts are compared the same way: a repeat is maximal where both its ends are diverse.

Passes: blocks of documents tell which anchors they have; shards answer which of them occur elsewhere; blocks send
the suffixes of those, each distinct one once; shards build the tree, take the maximal repeats with all their occurrences, and answer per
suffix how far the repeats of smaller documents go; blocks apply the answers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.bytesops import U64, flat, hashes_at, sliding_min, window_hashes
from trackloom.llm.common import block_count, block_of, checkpointed, docs_table, text_bytes

LENGTH, K = 50, 16
#: Bytes that a run can have left of its anchor.
LEFT = LENGTH - K
WIDTH = LENGTH + LEFT + 2
#: Occurrences from which an anchor is hot: its suffixes could be too many for a shard, so its runs are compared one by one, see Suffixes.
HOT = 50_000
#: Bytes that are searched for anchors at once, and bits of a place in them.
PIECE, PLACE_BITS = 1 << 19, 20
NO_ID = np.iinfo(np.int64).min


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the intervals of a common-prefix tree with a depth of ``least`` or more, inner ones first.

    ``lcp[i]`` is the common prefix of suffixes i and i+1 of the sorted array.
    """
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while depth < stack[-1][0]:
            top, first = stack.pop()
            if top >= least:
                yield top, first, i
        if depth > stack[-1][0]:
            stack.append((depth, first))


def common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbouring rows of bytes, whose own lengths are ``sizes``."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]).astype(np.int64))


class Block:
    """The documents of a block, end to end, with their anchors."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.data, self.offsets = flat(texts)
        at, hashes = [], []
        n, row = len(self.data), 0
        while row < len(ids):
            end = max(int(np.searchsorted(self.offsets, self.offsets[row] + PIECE, side="right")) - 1, row + 1)
            a, b = int(self.offsets[row]), int(self.offsets[end])
            for start in range(a, max(b - LENGTH + 1, a), PIECE):  # a long text comes in pieces that overlap
                stop = min(start + PIECE + LENGTH - 1, b) if end == row + 1 else b
                p, h = self._anchors(self.data[start:stop], self.offsets[row : end + 1] - start)
                at.append(p + start)
                hashes.append(h)
                if stop == b:
                    break
            row = end
        self.at = np.concatenate([np.zeros(0, np.int64), *at])
        self.hash = np.concatenate([np.zeros(0, U64), *hashes])
        if len(self.at) > 1:  # pieces may share an anchor
            order = np.argsort(self.at, kind="stable")
            self.at, self.hash = self.at[order], self.hash[order]
            keep = np.concatenate([[True], np.diff(self.at) > 0])
            self.at, self.hash = self.at[keep], self.hash[keep]
        self.doc = np.searchsorted(self.offsets, self.at, side="right") - 1

    @staticmethod
    def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of the runs within texts, whose ends are ``offsets``."""
        h = window_hashes(data, K)
        if len(h) < LEFT + 1:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        low = U64((1 << PLACE_BITS) - 1)  # the same bits in every piece, so that equal runs settle ties alike
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=U64), LEFT + 1)
        whole = np.ones(len(least), bool)
        for end in offsets[1:-1].tolist():
            if 0 < end < len(data):
                whole[max(end - LENGTH + 1, 0) : end] = False
        least = least[whole]
        # neighbouring runs mostly share their anchor
        least = least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least
        at = np.unique((least & low).astype(np.int64))
        return at, h[at]

    def contexts(self, use: np.ndarray) -> np.ndarray:
        """A row for each anchor of ``use``: bytes to the right, bytes to the left from the nearest, and both lengths."""
        at, doc = self.at[use], self.doc[use]
        right = np.minimum(self.offsets[doc + 1] - at, LENGTH)
        left = np.minimum(at - self.offsets[doc], LEFT)
        out = np.zeros((len(at), WIDTH), np.uint8)
        padded = np.concatenate([self.data, np.zeros(LENGTH, np.uint8)])
        for j in range(LENGTH):
            out[:, j] = np.where(j < right, padded[at + j], 0)
        for j in range(LEFT):
            out[:, LENGTH + j] = np.where(j < left, padded[at - 1 - j], 0)
        out[:, -2], out[:, -1] = right, left
        return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes % U64(shards)).astype(np.int64)


def short(hashes: np.ndarray) -> np.ndarray:
    """40 bits of each hash, as five bytes."""
    return np.ascontiguousarray((hashes >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def long(raw: bytes) -> np.ndarray:
    """The numbers that short() gave."""
    five = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel()


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of runs of a sorted array."""
    if len(shard):
        heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(shard)]):
            yield int(shard[a]), a, b


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def offer(t: pa.Table, shards: int, inside: bool = False) -> pa.Table:
    """First pass: a block's distinct anchors by shard, those of several of its documents first; or of several places, if repeats inside a document count."""
    block = Block(t["k"].to_pylist(), t["t"].combine_chunks() if isinstance(t["t"], pa.ChunkedArray) else t["t"])
    order = np.lexsort((block.ids[block.doc], block.hash))
    h, d = block.hash[order], block.ids[block.doc][order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(h)) - 1
    counts = np.minimum(ends - heads + 1, 65_535).astype("<u2")
    h, several = h[heads], (ends > heads if inside else d[heads] != d[ends]) if len(h) else np.zeros(0, bool)
    shard = shard_of(h, shards)
    order = np.lexsort((h, ~several, shard))
    h, several, shard, counts = h[order], several[order], shard[order], counts[order]
    name = t["block"][0].as_py()
    rows = [(s, name, int(several[a:b].sum()), short(h[a:b]).tobytes(), _sparse(counts[a:b])) for s, a, b in _by_shard(shard)]
    return _table(rows, shard=pa.int32(), block=pa.int32(), several=pa.int32(), anchors=pa.binary(), counts=pa.binary())


def _sparse(counts: np.ndarray) -> bytes:
    """Counts other than 1, with their places."""
    at = np.flatnonzero(counts != 1)
    return np.stack([at, counts[at]]).astype("<u4").tobytes()


def _dense(raw: bytes, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    at, counts = np.frombuffer(raw, "<u4").reshape(2, -1)
    out[at] = counts
    return out


def repeated(t: pa.Table, hot: int | None = HOT) -> pa.Table:
    """Second pass: for each block of a shard its anchors that occur in several documents or blocks, and which of them are hot."""
    blocks, several = t["block"].to_pylist(), t["several"].to_pylist()
    parts = [long(x) for x in t["anchors"].to_pylist()]
    every = np.concatenate(parts)
    flag = np.concatenate([np.arange(len(p)) < s for p, s in zip(parts, several)])
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(every, kind="stable")
    v = every[order]
    heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    counts = np.diff(np.append(heads, len(v)))
    good = np.repeat((counts > 1) | np.maximum.reduceat(flag[order].astype(np.int8), heads).astype(bool), counts)
    places = np.concatenate([_dense(x, len(p)) for x, p in zip(t["counts"].to_pylist(), parts)])[order]
    busy = np.repeat(np.add.reduceat(places, heads) >= hot, counts) if hot else np.zeros(len(v), bool)
    rows = []
    own, v, busy = owner[order][good], v[good], busy[good]
    order = np.argsort(own, kind="stable")
    own, v, busy = own[order], v[order], busy[order]
    for k, a, b in _by_shard(own):
        some = v[a:b][busy[a:b]]
        rows.append((blocks[k], t["shard"][0].as_py(), short(v[a:b][~busy[a:b]] << U64(24)).tobytes(), short(some << U64(24)).tobytes() if len(some) else None))
    return _table(rows, block=pa.int32(), shard=pa.int32(), anchors=pa.binary(), hot=pa.binary())


class Suffixes:
    """A block's suffixes at repeated anchors: distinct ones in order of shard and content, and each occurrence's number.

    Runs at hot anchors (``at``, their starts) aren't suffixes. A passage of very many documents ends in as many different ways, so
    the suffixes at its edges are as many; its runs of LENGTH bytes, dealt to shards by 128-bit hashes, are each a key of its own.
    """

    def __init__(self, left: pa.Table, right: pa.Table, shards: int) -> None:
        texts = left["t"].combine_chunks() if isinstance(left["t"], pa.ChunkedArray) else left["t"]
        self.block = Block(left["k"].to_pylist(), texts)
        shard = shard_of(self.block.hash, shards)
        mask, busy = np.zeros(len(shard), bool), np.zeros(len(shard), bool)
        order = np.argsort(shard, kind="stable")
        runs = {s: order[a:b] for s, a, b in _by_shard(shard[order])}
        for s, raw, hot in zip(right["shard"].to_pylist(), right["anchors"].to_pylist(), right["hot"].to_pylist()):
            if s in runs:
                mask[runs[s]] = np.isin(self.block.hash[runs[s]] >> U64(24), long(raw))
                if hot:
                    busy[runs[s]] = np.isin(self.block.hash[runs[s]] >> U64(24), long(hot))
        self.use = np.flatnonzero(mask)
        self._runs(np.flatnonzero(busy), shards)
        rows = self.block.contexts(self.use)
        shard = shard[self.use]
        keyed = np.concatenate([shard.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
        seen = np.ascontiguousarray(keyed).view(f"V{WIDTH + 4}").ravel()
        order = np.argsort(seen, kind="stable")
        seen = seen[order]
        new = np.concatenate([[True], seen[1:] != seen[:-1]]) if len(seen) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        self.number = np.empty(len(order), np.int64)
        self.number[order] = number
        heads = np.flatnonzero(new)
        self.shard, self.rows = shard[order][heads], rows[order][heads]
        docs = self.block.ids[self.block.doc[self.use]]
        self.least = np.minimum.reduceat(docs[order], heads) if len(heads) else docs
        self.docs = docs

    def _runs(self, busy: np.ndarray, shards: int) -> None:
        """Starts of the runs around hot anchors, and the distinct runs in order of shard and hash, each with its least document."""
        block = self.block
        self.at = self.run_number = self.run_shard = self.run_least = np.zeros(0, np.int64)
        self.run_keys = np.zeros((0, 2), U64)
        if not len(busy):
            return
        anchor, doc = block.at[busy], block.doc[busy]
        starts = anchor[:, None] - np.arange(LEFT + 1)
        inside = (starts >= block.offsets[doc][:, None]) & (starts + LENGTH <= block.offsets[doc + 1][:, None])
        self.at = np.unique(starts[inside])
        if not len(self.at):
            return
        keys = np.stack(hashes_at(block.data, self.at, LENGTH), axis=1)
        shard = shard_of(keys[:, 0], shards)
        order = np.lexsort((keys[:, 1], keys[:, 0], shard))
        keys = keys[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        self.run_number = np.empty(len(order), np.int64)
        self.run_number[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.run_docs = block.ids[np.searchsorted(block.offsets, self.at, side="right") - 1]
        self.run_keys, self.run_shard, self.run_least = keys[heads], shard[order][heads], np.minimum.reduceat(self.run_docs[order], heads)

    def send(self, name: int) -> pa.Table:
        """Third pass: distinct suffixes and distinct runs by shard, each with the least document that has it."""
        rows = [(s, name, zstandard.compress(self.rows[a:b].tobytes(), 1), self.least[a:b].astype("<i8").tobytes(), None, None) for s, a, b in _by_shard(self.shard)]
        rows += [(s, name, None, None, self.run_keys[a:b].tobytes(), self.run_least[a:b].astype("<i8").tobytes()) for s, a, b in _by_shard(self.run_shard)]
        return _table(rows, shard=pa.int32(), block=pa.int32(), suffixes=pa.binary(), least=pa.binary(), runs=pa.binary(), run_least=pa.binary())


class Shard:
    """The sorted distinct suffixes of a shard, with common prefixes and least documents."""

    def __init__(self, t: pa.Table) -> None:
        self.blocks = t["block"].to_pylist()
        parts = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(-1, WIDTH) for x in t["suffixes"].to_pylist()]
        least = np.concatenate([np.frombuffer(x, "<i8") for x in t["least"].to_pylist()])
        self.sizes = [len(p) for p in parts]
        rows = np.concatenate(parts)
        seen = np.ascontiguousarray(rows).view(f"V{WIDTH}").ravel()
        order = np.argsort(seen, kind="stable")
        seen = seen[order]
        new = np.concatenate([[True], seen[1:] != seen[:-1]])
        heads = np.flatnonzero(new)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.own = least
        self.rows = rows[order][heads]
        self.least = np.minimum.reduceat(least[order], heads)
        self.right, self.left = self.rows[:, -2].astype(np.int64), self.rows[:, -1].astype(np.int64)
        self.lcp = common(self.rows[:, :LENGTH], self.right)

    def _groups(self) -> Iterator[tuple[int, int]]:
        """Runs of two suffixes or more whose first K bytes are equal."""
        cut = np.flatnonzero(self.lcp < K) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(self.rows)]])
        many = ends - starts > 1
        return zip(starts[many].tolist(), ends[many].tolist())

    def _lefts(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members in order of their left contexts, and the common prefixes of those."""
        contexts = self.rows[members, LENGTH : LENGTH + LEFT]
        order = np.argsort(np.ascontiguousarray(contexts).view(f"V{LEFT}").ravel(), kind="stable")
        return members[order], common(contexts[order], self.left[members[order]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, first suffix) of the maximal repeats of anchors that just two suffixes share, all at once."""
        a = np.array([a for a, b in self._groups() if b - a == 2], np.int64)
        differ = self.rows[a, LENGTH : LENGTH + LEFT] != self.rows[a + 1, LENGTH : LENGTH + LEFT]
        left = np.where(differ.any(axis=1), differ.argmax(axis=1), LEFT)
        left = np.minimum(left, np.minimum(self.left[a], self.left[a + 1]))
        good = left + self.lcp[a] >= LENGTH
        return left[good], self.lcp[a][good], a[good]

    def nested(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(left, right, suffixes) of the maximal repeats of anchors that more suffixes share.

        Each interval of the common-prefix tree is scanned by left contexts in turn; a repeat is left-diverse where an interval of those
        ends, and right-diverse if its members' common prefix is the interval's, not a longer one.
        """
        for a, b in self._groups():
            if b - a == 2:
                continue
            for depth, first, last in intervals(self.lcp[a : b - 1].tolist(), K):
                members, lcp = self._lefts(np.arange(a + first, a + last + 1))
                least = max(LENGTH - depth, 0)
                found = list(intervals(lcp.tolist(), max(least, 1)))
                if not least and not lcp.min():
                    found.append((0, 0, len(members) - 1))
                for left, x, y in found:
                    own = np.sort(members[x : y + 1])
                    if int(self.lcp[own[0] : own[-1]].min()) == depth:
                        yield left, depth, own

    def groups(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(left, right, suffixes) of all maximal repeats: suffixes that share just so many bytes on both sides, and each suffix as
        a whole, for occurrences that are equal as far as it goes."""
        for k in range(len(self.rows)):
            yield int(self.left[k]), int(self.right[k]), np.array([k])
        for left, right, a in zip(*(x.tolist() for x in self.pairs())):
            yield left, right, np.array([a, a + 1])
        yield from self.nested()

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix how far left and right the maximal repeats go in which a document of smaller id takes part."""
        far_left, far_right = np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), np.int64)
        left, right, a = self.pairs()
        uneven = self.least[a] != self.least[a + 1]
        later = np.where(self.least[a] > self.least[a + 1], a, a + 1)[uneven]
        far_left[later], far_right[later] = left[uneven], right[uneven]
        for left, right, own in self.nested():
            later = own[self.least[own] > self.least[own].min()]
            far_left[later] = np.maximum(far_left[later], left)
            far_right[later] = np.maximum(far_right[later], right)
        return far_left, far_right

    def answer(self) -> pa.Table:
        """Fourth pass: for each block and suffix how far it is covered, and whether its least document is the least of all."""
        far_left, far_right = self.reach()
        rows, at = [], 0
        for name, n in zip(self.blocks, self.sizes):
            number = self.number[at : at + n]
            first = self.own[at : at + n] == self.least[number]
            rows.append((name, np.stack([far_left[number], far_right[number], first]).astype(np.uint8).tobytes()))
            at += n
        return _table(rows, block=pa.int32(), answers=pa.binary())


def answers(t: pa.Table) -> pa.Table:
    """A shard's answers: for suffixes by the tree, for runs at hot anchors the least document of each."""
    name, trees, runs = t["shard"][0].as_py(), t.filter(t["suffixes"].is_valid()), t.filter(t["runs"].is_valid())
    rows = []
    if len(trees):
        out = Shard(trees).answer()
        rows += [(b, a, name, None) for b, a in zip(out["block"].to_pylist(), out["answers"].to_pylist())]
    if len(runs):
        parts = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in runs["runs"].to_pylist()]
        keys, least = np.concatenate(parts), np.concatenate([np.frombuffer(x, "<i8") for x in runs["run_least"].to_pylist()])
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        sorted_ = keys[order]
        new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)])
        best = np.minimum.reduceat(least[order], np.flatnonzero(new))
        found = np.empty(len(order), np.int64)
        found[order] = best[np.cumsum(new) - 1]
        ends = np.cumsum([len(p) for p in parts])
        rows += [(b, None, name, found[e - len(p) : e].astype("<i8").tobytes()) for b, p, e in zip(runs["block"].to_pylist(), parts, ends)]
    return _table(rows, block=pa.int32(), answers=pa.binary(), shard=pa.int32(), run_answers=pa.binary())


def covered(own: Suffixes, right: pa.Table) -> np.ndarray:
    """The bytes of a block that repeat a document of smaller id."""
    block = own.block
    far = np.zeros((3, len(own.rows)), np.uint8)
    got = {s: x for s, x in zip(right["shard"].to_pylist(), right["answers"].to_pylist()) if x is not None}
    for s, a, b in _by_shard(own.shard):
        far[:, a:b] = np.frombuffer(got[s], np.uint8).reshape(3, -1)
    n = own.number
    first = (far[2, n] > 0) & (own.docs == own.least[n])
    to_left = np.where(first, far[0, n], own.rows[n, -1]).astype(np.int64)
    to_right = np.where(first, far[1, n], own.rows[n, -2]).astype(np.int64)
    at, hit = block.at[own.use], to_right > 0
    edges = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edges, (at - to_left)[hit], 1)
    np.add.at(edges, (at + to_right)[hit], -1)
    if len(own.at):
        least = np.empty(len(own.run_shard), np.int64)
        got = {s: x for s, x in zip(right["shard"].to_pylist(), right["run_answers"].to_pylist()) if x is not None}
        for s, a, b in _by_shard(own.run_shard):
            least[a:b] = np.frombuffer(got[s], "<i8")
        later = own.at[least[own.run_number] < own.run_docs]
        np.add.at(edges, later, 1)
        np.add.at(edges, later + LENGTH, -1)
    return np.cumsum(edges[:-1]) > 0


def cut(own: Suffixes, mask: np.ndarray, ids: list) -> pa.Table:
    """Documents without their covered bytes."""
    data, offsets = own.block.data, own.block.offsets
    gone = np.concatenate([[0], np.cumsum(mask)])
    starts = mask.copy()
    starts[1:] &= ~mask[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = mask[heads]
    spans = np.concatenate([[0], np.cumsum(starts)])
    rows = []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        left = data[a:b][~mask[a:b]] if gone[b] > gone[a] else data[a:b]
        rows.append((ids[k], b - a, int(gone[b] - gone[a]), int(spans[b] - spans[a]), left.tobytes()))
    return _table(rows, k=pa.int64(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept=pa.binary())


def _suffixes(df: DataFrame, id_col: str, text_col: str, blocks: int, inside: bool = False, hot: int | None = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents by block, repeated anchors by block, suffixes by shard)."""
    docs = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).withColumn("block", block_of(blocks, F.col("k"), F.col("t")))
    anchors = docs.groupBy("block").applyInArrow(lambda t: offer(t, blocks, inside), "shard int, block int, several int, anchors binary, counts binary")
    known = anchors.groupBy("shard").applyInArrow(lambda t: repeated(t, hot), "block int, shard int, anchors binary, hot binary")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([], shard=pa.int32(), block=pa.int32(), suffixes=pa.binary(), least=pa.binary(), runs=pa.binary(), run_least=pa.binary())
        return Suffixes(left, right, blocks).send(left["block"][0].as_py())

    sent = docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send, "shard int, block int, suffixes binary, least binary, runs binary, run_least binary")
    return docs, known, sent


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, hot: int | None = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): each text's bytes without those that repeat a smaller document.

    A byte goes if some LENGTH bytes that cover it also start in a document of smaller id. ``kept`` is
    binary, since a cut may fall into a code point. Null and empty texts keep nothing and lose nothing. Rows that
    share an id don't count against each other; a null id is the smallest, ids are whole numbers. Other columns aren't read. Runs around anchors
    of ``hot`` occurrences or more are looked up one by one instead of in the tree, so that no shard gets all of a passage's ends.
    """
    blocks = blocks or block_count(text_bytes(df, text_col))
    docs, known, sent = _suffixes(df, id_col, text_col, blocks, hot=hot)
    told = sent.groupBy("shard").applyInArrow(answers, "block int, answers binary, shard int, run_answers binary")
    mixed = known.unionByName(told, allowMissingColumns=True)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([], k=pa.int64(), n_bytes=pa.int64(), n_removed=pa.int64(), n_spans=pa.int64(), kept=pa.binary())
        own = Suffixes(left, right.filter(right["anchors"].is_valid()), blocks)
        return cut(own, covered(own, right.filter(right["anchors"].is_null())), left["k"].to_pylist())

    out = docs.groupBy("block").cogroup(mixed.groupBy("block")).applyInArrow(apply, "k long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("k", id_col)


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(repeat, length, id, start): maximal repeats of LENGTH bytes or more with every occurrence, ``start`` in bytes.

    A repeat has two occurrences or more, in different documents or in one. Within an anchor's context, LEFT bytes before and LENGTH bytes from the
    anchor on, maximal repeats come from the tree; those of neighbouring anchors that have the same occurrences, shifted, are one
    longer repeat, of any length. So a repeat of which a long inner part occurs in more places comes as two, up to and from that
    part, beside the part with all its places. ``repeat`` names a repeat by its first occurrence. Rows that
    share an id are one document if their texts are equal; null and empty texts have no repeats, a null id is the smallest.
    """
    blocks = blocks or block_count(text_bytes(df, text_col))
    docs, known, sent = _suffixes(df, id_col, text_col, blocks, inside=True, hot=None)

    def name(t: pa.Table) -> pa.Table:
        shard = Shard(t)
        by_suffix: dict[int, list] = {}
        for left, right, members in shard.groups():
            row = shard.rows[members[0]]
            content = hashlib.blake2b(bytes(row[LENGTH : LENGTH + left][::-1]) + bytes(row[:right]), digest_size=16).digest()
            for m in members.tolist():
                by_suffix.setdefault(m, []).append((content, left, left + right))
        rows, at = [], 0
        for b, n in zip(shard.blocks, shard.sizes):
            for k, m in enumerate(shard.number[at : at + n].tolist()):
                rows += [(b, t["shard"][0].as_py(), k, *x) for x in by_suffix[m] if x[2] >= LENGTH]
            at += n
        return _table(rows, block=pa.int32(), shard=pa.int32(), suffix=pa.int32(), content=pa.binary(), to_left=pa.int32(), length=pa.int32())

    named = sent.groupBy("shard").applyInArrow(name, "block int, shard int, suffix int, content binary, to_left int, length int")
    empty = {"anchors": "binary", "hot": "binary", "suffix": "int", "content": "binary", "to_left": "int", "length": "int"}

    def widened(d: DataFrame) -> DataFrame:
        return d.select("block", "shard", *[F.col(c) if c in d.columns else F.lit(None).cast(k).alias(c) for c, k in empty.items()])

    mixed = widened(known).unionByName(widened(named))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(left):
            own = Suffixes(left, right.filter(right["anchors"].is_valid()), blocks)
            told = right.filter(right["content"].is_valid()).to_pylist()
            first = {s: a for s, a, _ in _by_shard(own.shard)}
            where: dict[int, list[int]] = {}
            for k, n in enumerate(own.number.tolist()):
                where.setdefault(n, []).append(k)
            for r in told:
                for k in where[first[r["shard"]] + r["suffix"]]:
                    d = int(own.block.doc[own.use[k]])
                    rows.append((r["content"], r["length"], int(own.block.ids[d]), int(own.block.at[own.use[k]] - r["to_left"] - own.block.offsets[d])))
        return _table(rows, content=pa.binary(), length=pa.int32(), k=pa.int64(), start=pa.int64())

    found = docs.groupBy("block").cogroup(mixed.groupBy("block")).applyInArrow(place, "content binary, length int, k long, start long").distinct()
    return _joined(checkpointed(found)).select("repeat", "length", F.nullif("k", F.lit(NO_ID)).alias(id_col), "start")


def _joined(found: DataFrame) -> DataFrame:
    """(repeat, length, k, start): repeats (content, length, k, start) whose occurrences are the same but for a shift, and which overlap, as one.

    A repeat's shape is the sum of hashes of its occurrences, as seen from the first of them.
    """
    first = found.groupBy("content", "length").agg(F.min(F.struct("k", "start")).alias("o"), F.count("*").alias("places")).where("places > 1")
    seen = found.join(first, ["content", "length"]).select("content", "length", "o", "places", "k", (F.col("start") - F.col("o.start")).alias("shift"))
    part = lambda salt: F.sum(F.xxhash64("k", "shift", F.lit(salt)).cast("decimal(20,0)"))
    shapes = seen.groupBy("content", "length", "o", "places").agg(part(0).alias("s0"), part(1).alias("s1"))
    own = W.partitionBy("o.k", "places", "s0", "s1").orderBy("o.start", "length")
    end = F.col("o.start") + F.col("length")
    before = F.max(end).over(own.rowsBetween(W.unboundedPreceding, -1))
    numbered = shapes.withColumn("end", end).withColumn("new", F.coalesce(F.col("o.start") > before, F.lit(True)).cast("int")).withColumn("chain", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    chains = numbered.groupBy("o.k", "places", "s0", "s1", "chain").agg(F.min("o.start").alias("from"), F.max("end").alias("to"), F.min(F.struct("o.start", "content", "length")).alias("head"))
    named = chains.select("head.content", F.col("head.length").alias("part"), F.sha2(F.concat_ws("/", "k", "from", "to", "s0", "s1"), 256).alias("repeat"), (F.col("to") - F.col("from")).cast("int").alias("length"))
    return found.withColumnRenamed("length", "part").join(named, ["content", "part"]).select("repeat", "length", "k", "start")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of the bytes that stay."""
    return dedup(docs_table(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
