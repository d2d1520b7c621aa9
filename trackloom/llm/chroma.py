"""Audio columns: chroma fingerprints, their index and the alignment of recordings.

PCM is cut into overlapping frames; each frame's spectrum is folded into twelve pitch classes. Filters over the
chroma image, evaluated on its integral image, compare sums of rectangles; each gives two bits, and a frame's bits make one
packed integer. Two recordings are aligned at the offsets at which enough of their bits, or of slices of their integers, agree, and judged by the share of
unequal bits at the best of these.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, checkpointed, table

RATE, FRAME, HOP = 4000, 1024, 256
#: Frames whose spectra are taken at once.
SPECTRA = 1024
LOWEST_HZ, HIGHEST_HZ = 110.0, 1760.0
#: (kind, first class, classes, frames): kinds compare halves of a rectangle in time, in pitch, its middle third, or its quarters.
FILTERS = [(kind, c, n, w) for (kind, n, w), starts in {("time", 4, 8): (0, 4, 8), ("pitch", 4, 4): (0, 4, 8), ("middle", 12, 12): (0,), ("cross", 6, 8): (0, 6), ("pitch", 12, 2): (0,), ("time", 6, 16): (0, 6)}.items() for c in starts]
SPAN = max(w for *_, w in FILTERS)
#: Two bits a filter from its value, Gray-coded so that neighbouring levels differ in one.
LEVELS, GRAY = np.array([-0.1, 0.0, 0.1]), np.array([0, 1, 3, 2], np.int64)
#: Bits of a frame, bits of a slice of them, and slices; more slices than a frame of a match may have unequal bits.
BITS, SLICE = 2 * len(FILTERS), 3
SLICES = BITS // SLICE
#: Largest share of unequal bits of a match, least frames of overlap.
MAX_BIT_ERRORS, MIN_OVERLAP = 0.20, 16
#: Queries and classes that a task compares; offsets in histograms, and frames whose bits are compared, at once.
QUERY_BLOCK, BUCKET, BINS, FRAMES = 4096, 2000, 1 << 17, 1 << 21
#: Frames up to which fingerprints are correlated by their spectra; queries and targets at once.
LONG, ASKED, TARGETS = 256, 32, 2048
NOTES = np.array([220.0 * 2 ** (k / 12) for k in range(24)])


@functools.lru_cache(maxsize=4)
def _bins(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(spectrum bins in the range of pitch, their classes)."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ))
    return use, np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12


def chroma(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energies of twelve pitch classes by frame, each frame of unit length; silence gives zeros."""
    pcm = np.asarray(pcm, np.float32)
    if len(pcm) < FRAME:
        pcm = np.concatenate([pcm, np.zeros(FRAME - len(pcm), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP]
    use, kinds = _bins(rate)
    fold, window = np.zeros((len(use), 12)), np.hanning(FRAME).astype(np.float32)
    fold[np.arange(len(use)), kinds] = 1
    out = np.empty((len(frames), 12))
    for a in range(0, len(frames), SPECTRA):  # a long recording's spectra are never there at once
        out[a : a + SPECTRA] = np.abs(np.fft.rfft(frames[a : a + SPECTRA] * window, axis=1)[:, use]) ** 2 @ fold
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed integers, two bits a filter, of a chroma image; an image shorter than SPAN frames gives one of the padded image."""
    if len(image) < SPAN:
        image = np.concatenate([image, np.zeros((SPAN - len(image), 12))])
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    n = len(image) - SPAN + 1
    t = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[t + t1, c1] - total[t + t0, c1] - total[t + t1, c0] + total[t + t0, c0]

    out = np.zeros(n, np.int64)
    for kind, c, k, w in FILTERS:
        if kind == "time":
            a, b = area(0, w // 2, c, c + k), area(w // 2, w, c, c + k)
        elif kind == "pitch":
            a, b = area(0, w, c, c + k // 2), area(0, w, c + k // 2, c + k)
        elif kind == "middle":
            b = area(w // 3, 2 * w // 3, c, c + k)
            a = (area(0, w, c, c + k) - b) / 2
        else:
            a = area(0, w // 2, c, c + k // 2) + area(w // 2, w, c + k // 2, c + k)
            b = area(0, w // 2, c + k // 2, c + k) + area(w // 2, w, c, c + k // 2)
        value = np.log1p(a) - np.log1p(b)
        out = out << 2 | GRAY[np.searchsorted(LEVELS, value, side="right")]
    return out


def bit_errors(a: np.ndarray, b: np.ndarray) -> float:
    """Share of unequal bits of two fingerprints of equal length."""
    return float(np.bitwise_count(a ^ b).sum()) / (2 * len(FILTERS) * max(len(a), 1))


def _overlaps(m: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, offset, first query frame, overlap) of every offset of fingerprints of these lengths below one of m frames, target by target."""
    size = lengths + m - 1
    target = np.repeat(np.arange(len(lengths)), size)
    offset = np.arange(len(target)) - np.repeat(np.cumsum(size) - size, size) - lengths[target] + 1
    start = np.maximum(offset, 0)
    return target, offset, start, np.minimum(m, lengths[target] + offset) - start


def _histogram(query: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Votes for each offset of each target: one for every slice of bits that a query frame and a target frame share.

    ``held`` has a row for each slice and each value of it, with ones at the offsets of the target frames that have it at query frame 0; another frame shifts them.
    """
    votes, part, used = np.zeros(held.shape[1], np.int32), np.zeros(held.shape[1], np.uint8), 0
    for frame, bits in enumerate(query.tolist()):
        for s in range(SLICES):
            part[frame:] += held[s << SLICE | bits >> SLICE * s & 2**SLICE - 1, : len(part) - frame]
        used += SLICES
        if used + SLICES > 255:  # what a byte holds
            votes += part
            part[:], used = 0, 0
    return votes + part


def _unequal(query: np.ndarray, frames: np.ndarray, at: np.ndarray, start: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Unequal bits of stretches of ``overlap`` frames, from ``start`` of the query and ``at`` of ``frames``."""
    out = np.zeros(len(at), np.int64)
    ends = np.cumsum(overlap)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + FRAMES, side="right")))
        n = overlap[a:b]
        heads = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(heads, n)
        bits = np.bitwise_count(query[np.repeat(start[a:b], n) + within] ^ frames[np.repeat(at[a:b], n) + within])
        out[a:b] = np.add.reduceat(bits.astype(np.int64), heads)
        a = b
    return out


def _by_histogram(queries: list[np.ndarray], targets: list[np.ndarray], some: np.ndarray, there: np.ndarray) -> Iterator[tuple]:
    """What align() gives, of queries ``some`` of one length, query by query; a histogram counts equal slices of bits by offset.

    Among n frames that match, at most MAX_BIT_ERRORS of the bits differ and spoil as many slices, so that a match has at least the other slices' votes: bit errors
    are compared at the offsets that have them, and no match is lost.
    """
    m = len(queries[some[0]])
    sizes = np.array([len(targets[k]) for k in there], np.int64) + m - 1
    part = np.cumsum(sizes) // BINS
    for number in np.unique(part).tolist():
        own = there[part == number]
        lengths = np.array([len(targets[k]) for k in own], np.int64)
        frames = np.concatenate([targets[k] for k in own])
        first = np.cumsum(lengths) - lengths
        target, offset, start, overlap = _overlaps(m, lengths)
        place = np.repeat(np.cumsum(lengths + m - 1) - m, lengths) - (np.arange(len(frames)) - np.repeat(first, lengths))
        held = np.zeros((SLICES << SLICE, len(overlap)), np.uint8)
        for s in range(SLICES):
            held[s << SLICE | frames >> SLICE * s & 2**SLICE - 1, place] = 1
        need = np.where(overlap >= np.minimum(MIN_OVERLAP, np.minimum(m, lengths))[target], SLICES * overlap - _most(overlap), SLICES * m + 1)
        for q in some.tolist():
            at = np.flatnonzero(_histogram(queries[q], held) >= need)
            unequal = _unequal(queries[q], frames, first[target[at]] + start[at] - offset[at], start[at], overlap[at])
            yield _best(np.full(len(at), q), own[target[at]], offset[at], overlap[at], unequal)


def _most(overlap: np.ndarray) -> np.ndarray:
    """Unequal bits that a match of so many frames may have."""
    return np.floor(MAX_BIT_ERRORS * (BITS * overlap) + 1e-9).astype(np.int64)


def _best(q: np.ndarray, target: np.ndarray, offset: np.ndarray, overlap: np.ndarray, unequal: np.ndarray) -> tuple:
    """(query, target, offset, overlap, bit errors) at the best offset of each pair, of offsets with so many unequal bits."""
    good = unequal <= _most(overlap)
    q, target, offset, overlap, share = q[good], target[good], offset[good], overlap[good], unequal[good] / (BITS * overlap[good])
    order = np.lexsort((offset, -overlap, share, target, q))
    first = (np.diff(q[order], prepend=-1) != 0) | (np.diff(target[order], prepend=-1) != 0)
    return tuple(x[order[first]] for x in (q, target, offset, overlap, share))


def _spectra(prints: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts (frequency, fingerprint, bit) of the bits, as 1 and -1, over n frames, of which those after a fingerprint's end are 0."""
    size, f = np.array([len(x) for x in prints]), n // 2 + 1
    padded = np.zeros((len(prints), int(size.max())), np.int64)
    there = np.arange(padded.shape[1]) < size[:, None]
    padded[there] = np.concatenate(prints)
    signs = np.where(there[:, None, :], 2 * (padded[:, None, :] >> np.arange(BITS)[:, None] & 1) - 1, 0).astype(np.float32)
    angle = 2 * np.pi / n * (np.outer(np.arange(padded.shape[1]), np.arange(f)) % n)
    waves = np.concatenate([np.cos(angle), -np.sin(angle)], axis=1).astype(np.float32)
    out = (signs.reshape(-1, padded.shape[1]) @ waves).reshape(len(prints), BITS, 2 * f).transpose(2, 0, 1)
    return out[:f], out[f:]


def _by_spectra(queries: list[np.ndarray], targets: list[np.ndarray], some: np.ndarray, there: np.ndarray) -> Iterator[tuple]:
    """What align() gives, of queries ``some`` of one length, block by block: equal less unequal bits at every offset are a correlation, and many of these are a product of matrices.

    The products only choose offsets, a bit more than may match; their bits are compared as integers.
    """
    m = len(queries[some[0]])
    size = np.array([len(targets[k]) for k in there], np.int64)
    by_size = np.argsort(size, kind="stable")
    room = {}
    for a in range(0, len(there), TARGETS):
        own, lengths = there[by_size[a : a + TARGETS]], size[by_size[a : a + TARGETS]]
        least = np.minimum(MIN_OVERLAP, np.minimum(m, lengths))
        frames, first = np.concatenate([targets[k] for k in own]), np.cumsum(lengths) - lengths
        # offsets that overlap by fewer frames may fall together
        n, far = int(m + lengths.max() - least.min()), int(max(m, lengths.max()) - least.min())
        real, imaginary = _spectra([targets[k] for k in own], n)
        held = np.ascontiguousarray(np.concatenate([real, imaginary], axis=2).transpose(0, 2, 1))
        shift = np.arange(far + 1)
        angle = 2 * np.pi / n * (np.outer(shift, np.arange(n // 2 + 1)) % n)
        weight = np.where((np.arange(n // 2 + 1) == 0) | (2 * np.arange(n // 2 + 1) == n), 1, 2) / n
        even, odd = (np.cos(angle) * weight).astype(np.float32), (np.sin(angle) * weight).astype(np.float32)
        need = []
        for sign in (1, -1):
            offset = sign * shift[:, None]
            overlap = np.minimum(m, lengths + offset) - np.maximum(offset, 0)
            need.append(np.where(overlap >= least, BITS * overlap - 2 * _most(np.maximum(overlap, 0)) - 1, 2 * BITS * m).astype(np.float32)[:, None, :])
        for b in range(0, len(some), ASKED):
            block = some[b : b + ASKED]
            shape = (len(block), len(own))
            real, imaginary = _spectra([queries[k] for k in block], n)
            if room.get("of") != (shape, n, far):
                room = {"of": (shape, n, far), "f": np.empty((2, n // 2 + 1, *shape), np.float32), "t": np.empty((3, far + 1, shape[0] * shape[1]), np.float32)}
            f, t = room["f"], room["t"]
            np.matmul(np.concatenate([real, imaginary], axis=2), held, out=f[0])
            np.matmul(np.concatenate([imaginary, -real], axis=2), held, out=f[1])
            np.matmul(even, f[0].reshape(n // 2 + 1, -1), out=t[0])
            np.matmul(odd, f[1].reshape(n // 2 + 1, -1), out=t[1])
            found = []
            for sign, put, least_sum in ((1, np.subtract, need[0]), (-1, np.add, need[1])):
                put(t[0], t[1], out=t[2])
                at = np.flatnonzero(t[2].reshape(far + 1, *shape) >= least_sum)
                d, pair = np.divmod(at, shape[0] * shape[1])
                found.append((sign * d, pair)) if sign > 0 else found.append((-d[d > 0], pair[d > 0]))
            offset, pair = (np.concatenate(x) for x in zip(*found))
            q, target = np.divmod(pair, shape[1])
            start = np.maximum(offset, 0)
            overlap = np.minimum(m, lengths[target] + offset) - start
            unequal = _unequal(np.concatenate([queries[k] for k in block]), frames, first[target] + start - offset, q * m + start, overlap)
            yield _best(block[q], own[target], offset, overlap, unequal)


def align(queries: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, target, offset, overlap, bit errors), arrays with the best offset of each pair that matches.

    Frame t of a target lies at t + offset of the query. All offsets are looked at: of fingerprints up to LONG frames by the correlation of their bits, of longer ones by a histogram of
    offsets; bit errors are compared at those that either leaves, and no match is lost. An overlap has MIN_OVERLAP frames or the shorter fingerprint's;
    the least share of unequal bits wins, then the longest overlap, then the least offset.
    """
    kinds = (np.int64, np.int64, np.int32, np.int32, np.float64)
    out = [tuple(np.zeros(0, kind) for kind in kinds)]
    asked, size = (np.array([len(x) for x in side], np.int64) for side in (queries, targets))
    for m in np.unique(asked[asked > 0]).tolist():
        some = np.flatnonzero(asked == m)
        short = np.flatnonzero((size > 0) & (size <= LONG)) if m <= LONG else np.zeros(0, np.int64)
        rest = np.flatnonzero(size > (LONG if m <= LONG else 0))
        if len(short):
            out += _by_spectra(queries, targets, some, short)
        if len(rest):
            out += _by_histogram(queries, targets, some, rest)
    return tuple(np.concatenate(x).astype(kind) for x, kind in zip(zip(*out), kinds))


class Index:
    """Several fingerprints to be searched."""

    def __init__(self, prints: list[np.ndarray]) -> None:
        self.prints = prints

    def matches(self, query: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(fingerprint, offset, overlap, bit errors) of those that match, each at its best offset."""
        _, k, offset, overlap, errors = align([query], self.prints)
        order = np.argsort(k)
        yield from zip(k[order].tolist(), offset[order].tolist(), overlap[order].tolist(), errors[order].tolist())


def render(vector: np.ndarray, rate: int = RATE, seconds: float = 0.08) -> np.ndarray:
    """A melody with a note for each number of a vector: the pitch is the number's bin between -0.3 and 0.3, in 24 half tones."""
    notes = np.clip(((np.nan_to_num(np.asarray(vector, float)) + 0.3) / 0.6 * 24).astype(int), 0, 23)
    size = int(rate * seconds)
    phase = np.cumsum(np.repeat(NOTES[notes], size) * 2 * np.pi / rate)
    return (np.sin(phase) + 0.3 * np.sin(2 * phase)).astype(np.float32)


def fingerprints(df: DataFrame, id_col: str, pcm_col: str, rate: int = RATE) -> DataFrame:
    """(k, prints): the packed integers of a column of PCM, 16-bit little-endian samples; null and empty audio gives none.

    A last odd byte is half a sample and is left out. Ids are whole numbers. Other columns aren't read; a null id and repeated rows stay.
    """
    src = df.select(F.col(id_col).cast("long").alias("k"), F.col(pcm_col).alias("pcm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(chroma(np.frombuffer(x, "<i2", len(x) // 2) / np.float32(32768), rate)) if x and len(x) > 1 else np.zeros(0, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["k", "prints"])

    return src.mapInArrow(run, "k long, prints array<long>")


def recordings(embeddings: DataFrame) -> DataFrame:
    """(vec_id, pcm): a synthetic recording of each embedding.

    Of ten ids in a row the second, third and fourth are a late, a noisy and a cut copy of the first one's recording, where the table has it.
    """
    kind = F.pmod("vec_id", F.lit(10)).cast("int")
    src = embeddings.select("vec_id", F.col("embedding").cast("array<float>").alias("v"), kind.alias("kind"))
    first = src.where("kind = 0").groupBy(F.col("vec_id").alias("first")).agg(F.first("v").alias("of"))
    # only the copies meet their originals, each of which has few
    copies = src.where("kind BETWEEN 1 AND 3").withColumn("first", F.col("vec_id") - F.col("kind")).join(first, "first", "left")
    copies = copies.select("vec_id", F.coalesce("of", "v").alias("v"), F.when(F.col("of").isNotNull(), F.col("kind")).otherwise(0).alias("kind"))
    src = src.where("kind IS NULL OR kind NOT BETWEEN 1 AND 3").select("vec_id", "v", F.lit(0).alias("kind")).unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                ids, vectors, kinds = (c.slice(a, 100).to_pylist() for c in batch.columns)
                rows = [None if v is None else (changed(render(np.array(v, float)), kind, i or 0) / 2 * 32767).astype("<i2").tobytes() for i, v, kind in zip(ids, vectors, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 100), pa.array(rows, pa.binary())], names=["vec_id", "pcm"])

    return src.mapInArrow(run, "vec_id long, pcm binary")


def changed(pcm: np.ndarray, kind: int, seed: int) -> np.ndarray:
    """A recording as it is (0), late by some frames of noise (1), noisy (2), or without its first and last third of a second (3)."""
    r = np.random.default_rng(abs(seed))
    if kind == 1:
        return np.concatenate([r.normal(0, 0.05, HOP * int(r.integers(3, 12))), pcm])
    if kind == 2:
        return np.clip(pcm + r.normal(0, 0.1, len(pcm)), -1.9, 1.9)
    return pcm[RATE // 3 : -(RATE // 3)] if kind == 3 else pcm


def _classed(prints: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their code, classes of equal fingerprints: code, class_id, the smallest query in it, prints)."""
    keyed = prints.withColumn("code", F.sha2(F.array_join("prints", ","), 256))
    classes = keyed.groupBy("code").agg(F.min("k").alias("class_id"), F.min(F.when(F.col("k") % every == 0, F.col("k"))).alias("query"), F.first("prints").alias("prints"))
    return keyed, checkpointed(classes)


def _found(classes: DataFrame) -> DataFrame:
    """(code, query, offset, overlap, bit_errors): every match of a class of queries with a class."""
    asked, total = classes.agg(F.count("query"), F.count("*")).first()
    parts, buckets = max(1, -(-asked // QUERY_BLOCK)), max(1, -(-total // BUCKET))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # a stated set of queries against all classes, in blocks
    queries = classes.where("query is not null and size(prints) > 0").select("query", F.col("prints").alias("own"), F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int").alias("part"), numbers(buckets).alias("bucket"))
    targets = classes.where("size(prints) > 0").select("code", "prints", F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int").alias("bucket"), numbers(parts).alias("part"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, code = right["query"].to_numpy(), left["code"].combine_chunks()
        q, t, *rest = align(*([np.array(p, np.int64) for p in side.to_pylist()] for side in (right["own"], left["prints"])))
        return pa.table([code.take(pa.array(t)), pa.array(ids[q]), *map(pa.array, rest)], names=["code", "query", "offset", "overlap", "bit_errors"])

    return targets.groupBy("bucket", "part").cogroup(queries.groupBy("bucket", "part")).applyInArrow(compare, "code string, query long, offset int, overlap int, bit_errors double")


def search(prints: DataFrame, every: int = 100) -> DataFrame:
    """(k, class_id, query, offset, overlap, bit_errors): for each recording the query that it matches best.

    The matches are those of search_all(); the fewest errors win, then the smallest query, and every recording gets its
    class's result. A recording without a match, or without frames, has nulls. Repeated rows stay repeated.
    """
    keyed, classes = _classed(prints, every)
    best = _found(classes).groupBy("code").agg(F.min(F.struct("bit_errors", "query", "offset", "overlap")).alias("m")).select("code", "m.*")
    result = classes.select("code", "class_id").join(best, "code", "left")
    return keyed.select("k", "code").join(result, "code").select("k", "class_id", "query", "offset", "overlap", "bit_errors")


def search_all(prints: DataFrame, every: int = 100) -> DataFrame:
    """(k, class_id, query, offset, overlap, bit_errors): each recording's class, and every match of a class.

    Queries are the recordings whose id is divisible by ``every``, all against all rows. Equal fingerprints are one class, whose
    id is its smallest; classes are compared, blocks of queries with buckets of classes. The representative, whose id is
    the class's, has a row for each class of queries that the class matches, ``query`` being the smallest query there; the
    other recordings of a class have one row, with nulls, and its matches by class_id. A match overlaps by MIN_OVERLAP
    frames (or the shorter recording) and has at most MAX_BIT_ERRORS unequal bits at some offset; none is lost. A class
    without a match, or without frames, has nulls; a row with a null id is no query. Repeated rows stay repeated.
    """
    keyed, classes = _classed(prints, every)
    found = _found(classes).withColumn("rep", F.lit(True))
    members = keyed.select("k", "code").join(classes.select("code", "class_id"), "code").withColumn("rep", F.col("k").eqNullSafe(F.col("class_id")))
    return members.join(found, ["code", "rep"], "left").select("k", "class_id", "query", "offset", "overlap", "bit_errors")


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recording of an embedding its class, and per class, at its smallest id, every matching query."""
    arrow_batches(spark)
    prints = checkpointed(fingerprints(recordings(table(spark, sf_dir, "embeddings")), "vec_id", "pcm"))
    out = search_all(prints)
    return out.select(F.col("k").alias("vec_id"), "class_id", "query", "offset", "overlap", "bit_errors")
