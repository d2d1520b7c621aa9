"""A byte-level convolutional network in numpy that scores quality.

Bytes are embedded and convolved with learned filters over chunks that overlap by the filters' width less one, so
that each window of the whole text lies in one chunk. Each filter is max-pooled in every chunk; the largest and
the mean of a document's chunks feed one logistic output. Folded into tables, a convolution is a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.bytesops import chunks
from trackloom.llm.common import arrow_batches, docs_table, table

#: Bound of the training sample: labelled rows, taken in the order of a hash of their ids.
TRAIN_ROWS = 2000
#: What a text of that sample teaches: so many stretches of so many bytes, spread evenly from its beginning to its end, or all of a shorter one.
STRETCHES, STRETCH_BYTES = 16, 2048
FOLDS = 5
THRESHOLD = 0.3


class ByteNet:
    """Filters, their training and scoring; always one score in (0, 1), for an empty text too."""

    WIDTH, FILTERS, EMBED, CHUNK = 6, 12, 6, 256
    #: Chunks that are expanded at once, however long a text is.
    SLICE = 64
    LOWEST = np.float32(-1e9)

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, self.EMBED)),
            "filter": r.normal(0, 0.4, (self.WIDTH, self.EMBED, self.FILTERS)),
            "bias": np.zeros(self.FILTERS),
            "out": r.normal(0, 0.1, 2 * self.FILTERS),
            "base": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def layout(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each chunk, where it begins in it, first chunk of each text); an empty text has one chunk."""
        counts = -(-np.maximum(np.diff(offsets), 1) // self.CHUNK)
        first = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(counts)), counts)
        return doc, (np.arange(len(doc)) - first[doc]) * self.CHUNK, first

    @staticmethod
    def bytes_at(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bytes at places of texts, 0 beyond their ends."""
        real = place < np.diff(offsets)[doc]
        at = np.where(real, place + offsets[doc], 0)
        return np.where(real, data[at], 0).astype(np.intp) if len(data) else np.zeros(at.shape, np.intp)

    def slices(self, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first chunk, bytes by chunk, valid window starts by chunk) of SLICE chunks at a time."""
        for a in range(0, len(doc), self.SLICE):
            own, start = doc[a : a + self.SLICE], inside[a : a + self.SLICE]
            raw = self.bytes_at(data, offsets, own[:, None], start[:, None] + np.arange(self.CHUNK + self.WIDTH - 1))
            left = np.maximum(np.diff(offsets), 1)[own] - start
            yield a, raw, np.arange(self.CHUNK) < left[:, None]

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.p["embed"], self.p["filter"]).astype(np.float32)

    def convolve(self, raw: np.ndarray, valid: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Filter outputs (chunk, start, filter)."""
        out = tables[0][raw[:, : self.CHUNK]]
        for j in range(1, self.WIDTH):
            out += tables[j][raw[:, j : j + self.CHUNK]]
        out[~valid] = self.LOWEST
        return out

    def _features(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(first, len(pooled)))
        return np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / counts[:, None].astype(np.float32)], axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        tables, out = self.tables(), []
        for _, data, offsets in chunks(texts, 1 << 17):
            doc, inside, first = self.layout(offsets)
            pooled = np.empty((len(doc), self.FILTERS), np.float32)
            for at, raw, valid in self.slices(data, offsets, doc, inside):
                pooled[at : at + len(raw)] = self.convolve(raw, valid, tables).max(axis=1)
            pooled = np.maximum(pooled + self.p["bias"], 0)
            z = self._features(pooled, first) @ self.p["out"] + self.p["base"]
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 16, rate: float = 0.01, seed: int = 5) -> ByteNet:
        """Adam on the log loss; gradients flow through the windows that won each maximum."""
        r = np.random.default_rng(seed)
        if not len(texts) or len(np.unique(labels)) < 2:
            share = (float(np.sum(labels)) + 1) / (len(labels) + 2)
            self.p["out"][:] = 0
            self.p["base"][:] = np.log(share / (1 - share))
            return self
        self.p["base"][:] = np.log(labels.mean() / (1 - labels.mean()))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        groups = [np.flatnonzero(labels == c) for c in (0, 1)]
        for step in range(1, steps + 1):
            # half of each class a step, weighed back to the classes' shares
            rows = np.concatenate([r.choice(g, batch // 2) for g in groups])
            weight = np.concatenate([np.full(batch // 2, 2 * len(g) / len(labels)) for g in groups]).astype(np.float32)
            got = self._gradient([texts[k] for k in rows], labels[rows].astype(np.float32), weight / batch)
            for k, g in got.items():
                g = g + 1e-4 * self.p[k] * (k in ("out", "filter"))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        doc, inside, first = self.layout(offsets)
        n, tables = len(doc), self.tables()
        won, best = np.empty((n, self.FILTERS), np.intp), np.empty((n, self.FILTERS), np.float32)
        for at, raw, valid in self.slices(data, offsets, doc, inside):
            acc = self.convolve(raw, valid, tables)
            won[at : at + len(raw)] = acc.argmax(axis=1)
            best[at : at + len(raw)] = np.take_along_axis(acc, won[at : at + len(raw), None, :], axis=1)[:, 0]
        live = best + self.p["bias"] > 0
        pooled = np.where(live, best + self.p["bias"], 0).astype(np.float32)
        counts = np.diff(np.append(first, n))
        x = self._features(pooled, first)
        z = np.clip(x @ self.p["out"] + self.p["base"], -30, 30)
        dz = (1 / (1 + np.exp(-z)) - y) * weight
        dx = dz[:, None] * self.p["out"]
        top = pooled == x[doc, : self.FILTERS]
        ties = np.add.reduceat(top.astype(np.float32), first)
        dpool = (dx[doc, : self.FILTERS] * top / ties[doc] + dx[doc, self.FILTERS :] / counts[doc][:, None]) * live
        chunk, which = np.nonzero(dpool)
        g = dpool[chunk, which]
        seen = self.bytes_at(data, offsets, doc[chunk, None], (inside[chunk] + won[chunk, which])[:, None] + np.arange(self.WIDTH))
        dfilter, dembed = np.zeros_like(self.p["filter"]), np.zeros_like(self.p["embed"])
        for j in range(self.WIDTH):
            e = self.p["embed"][seen[:, j]] * g[:, None]
            np.add.at(dfilter[j].T, which, e)
            np.add.at(dembed, seen[:, j], g[:, None] * self.p["filter"][j].T[which])
        return {"embed": dembed, "filter": dfilter, "bias": dpool.sum(axis=0), "out": x.T @ dz, "base": np.array([dz.sum()], np.float32)}


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def stretches(text: Column) -> Column:
    """At most STRETCHES * STRETCH_BYTES bytes of a text, end to end; all of it, if it has no more."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    starts = F.sequence(F.lit(0), F.lit(STRETCHES - 1))
    parts = F.transform(starts, lambda i: F.substring(data, F.floor(i * (size - STRETCH_BYTES) / (STRETCHES - 1)).cast("int") + 1, F.lit(STRETCH_BYTES)))
    return F.when(size <= STRETCHES * STRETCH_BYTES, data).otherwise(F.reduce(parts, F.lit(b""), lambda a, x: F.concat(a, x)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ByteNet:
    """A net fitted to at most ``rows`` labelled rows outside the held-out fold; long texts teach by stretches from all their parts.

    Rows without a label, or without a document, teach nothing; a null text is an empty one.
    """
    own = labels.where(fold(F.col("doc_id")) != 0).where("quality is not null").select(F.col("doc_id").alias("labelled"), "quality")
    first = own.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(rows)
    sample = docs.join(first, docs["doc_id"] == first["labelled"]).select("labelled", "quality", stretches(docs["text"]).alias("t"))
    got = sorted((r[0], r[1], bytes(r[2])) for r in sample.collect())
    return ByteNet().fit([t for *_, t in got], np.array([int(q > 0) for _, q, _ in got]))


def score(df: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score), a row per row; null texts are empty ones. Other columns aren't read."""
    src = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], names=[id_col, "score"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema['k'].dataType.simpleString()}, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted."""
    arrow_batches(spark)
    docs = docs_table(spark, sf_dir)
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
