"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0 (clean) to 3 are ordered: P(grade > k) = sigmoid(w.x - threshold_k), one weight vector for all thresholds. The
labels tell clean from toxic only; a toxic training row's grade is the third, by its sum of marker features, to
which it belongs among the toxic rows. So severity says how dense marks of toxicity are, not how bad a reader finds them. Features are words and beginnings of words; a feature's value is
log(1 + occurrences in SCALE words), so that it tells how dense it is in the whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, docs_table, table

#: Bound of the training sample: labelled rows, taken in the order of a hash of their ids.
TRAIN_ROWS = 4000
GRADES = 4
#: Least log likelihood ratio of a feature: what one in a thousand features without any tie to the labels reaches.
STRENGTH = 10.8
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 200_000
SCALE = 100


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def density(count: int, words: int) -> float:
    return math.log1p(SCALE * count / max(words, 1))


class OrdinalModel:
    """Weights by feature, and thresholds in increasing order."""

    def __init__(self, features: list[str], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.index = {f: k for k, f in enumerate(features)}
        self.weights, self.thresholds = weights, thresholds

    def logit(self, text: str | None, cache: dict[str, tuple[int, ...]] | None = None) -> float:
        """w.x of a whole text; 0 for a null or an empty one. ``cache`` keeps the features of words that came before."""
        counts: Counter[int] = Counter()
        cache = {} if cache is None else cache
        get = cache.get
        words = WORD.findall((text or "").lower())
        for word in words:
            own = get(word)
            if own is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                own = cache[word] = tuple(k for f in word_features(word) if (k := self.index.get(f)) is not None)
            if own:
                counts.update(own)
        return float(sum(self.weights[k] * density(n, len(words)) for k, n in counts.items()))

    def grades(self, logits: np.ndarray) -> np.ndarray:
        """Probabilities of the grades, by row."""
        above = 1 / (1 + np.exp(-np.clip(logits[:, None] - self.thresholds, -40, 40)))
        edges = np.concatenate([np.ones((len(logits), 1)), above, np.zeros((len(logits), 1))], axis=1)
        return edges[:, :-1] - edges[:, 1:]


Bag = tuple[int, dict[str, int]]


def bag(text: str | None) -> Bag:
    """(words, occurrences of each feature) of a text."""
    words = WORD.findall((text or "").lower())
    return len(words), of_words(Counter(words))


def of_words(counts: dict[str, int]) -> dict[str, int]:
    """Occurrences of each feature of words that occur so often."""
    out: Counter[str] = Counter()
    for w, n in counts.items():
        for f in word_features(w):
            out[f] += n
    return out


def fit(bags: list[Bag], toxic: np.ndarray, steps: int = 300, l2: float = 2e-4) -> OrdinalModel:
    """The model of labelled bags; without both labels it calls no text toxic (or every one, if all are)."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return OrdinalModel([], np.zeros(0), np.arange(GRADES - 1) + (5.0 if not n1 else -9.0))
    yes, no = Counter(), Counter()
    for (_, b), y in zip(bags, toxic):
        (yes if y else no).update(b.keys())
    # association: log likelihood ratio of presence by label
    seen = sorted(yes.keys() | no.keys())
    a, b = np.array([yes[f] for f in seen], float), np.array([no[f] for f in seen], float)
    total = n1 + n0

    def part(got: np.ndarray, rows: int, both: np.ndarray) -> np.ndarray:
        expected = both * rows / total
        return np.where(got > 0, got * np.log(np.maximum(got, 1e-9) / np.maximum(expected, 1e-9)), 0)

    strength = 2 * (part(a, n1, a + b) + part(b, n0, a + b) + part(n1 - a, n1, total - a - b) + part(n0 - b, n0, total - a - b))
    strong = np.flatnonzero(strength > STRENGTH)
    names = [seen[k] for k in strong]
    index = {f: k for k, f in enumerate(names)}
    cells = [(r, k, density(c, n)) for r, (n, own) in enumerate(bags) for f, c in own.items() if (k := index.get(f)) is not None]
    row, column = (np.array([c[k] for c in cells], np.int64) for k in (0, 1))
    x = Sparse(row, column, np.array([c[2] for c in cells], float), len(bags), len(names))
    marker = (a / n1 > 5 * (b + 0.5) / n0)[strong]
    load = x.times(marker.astype(float))
    grade = np.zeros(len(bags), int)
    cuts = np.quantile(load[toxic > 0], [1 / 3, 2 / 3])
    grade[toxic > 0] = 1 + (load[toxic > 0, None] > cuts).sum(axis=1)
    return OrdinalModel(names, *_descend(x, grade, steps, l2))


class Sparse:
    """A matrix of bags by features, as its cells."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int) -> None:
        self.row, self.column, self.value, self.shape = row, column, value, (rows, columns)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed(self, z: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * z[self.row], self.shape[1])


def _descend(x: Sparse, grade: np.ndarray, steps: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the likelihood; thresholds are the first one and positive gaps, so they stay in order."""
    k, n = GRADES - 1, x.shape[0]
    w, t = np.zeros(x.shape[1]), np.array([2.0, *([0.0] * (k - 1))])
    m = v = np.zeros(len(w) + k)
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        z = x.times(w)
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = edges * (1 - edges)
        rows = np.arange(n)
        p = np.maximum(edges[rows, grade] - edges[rows, grade + 1], 1e-9)
        dz = -(slope[rows, grade] - slope[rows, grade + 1]) / p / n
        dtheta = np.zeros(k)
        for j in range(k):
            dtheta[j] = (slope[:, j + 1] * ((grade == j + 1) / p - (grade == j) / p)).sum() / n
        dt = np.array([dtheta.sum(), *(dtheta[j:].sum() * np.exp(t[j]) for j in range(1, k))])
        g = np.concatenate([x.transposed(dz) + l2 * w, dt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fits a model to at most ``rows`` labelled documents; tasks count their words, and only those counts come to the driver.

    Rows without a label, or without a document, teach nothing; a null text is an empty one.
    """
    own = labels.where("toxic is not null").select(F.col("doc_id").alias("labelled"), "toxic")
    first = own.orderBy(F.xxhash64("labelled"), "labelled", "toxic").limit(rows)
    sample = docs.join(first, docs["doc_id"] == first["labelled"]).select(F.col("labelled").cast("long"), F.col("toxic").cast("int"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Counter(WORD.findall((t or "").lower())) for t in batch.column(2).to_pylist()]
            columns = [pa.array([list(c) for c in own], pa.list_(pa.string())), pa.array([list(c.values()) for c in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["labelled", "toxic", "words", "counts"])

    got = sample.mapInArrow(run, "labelled long, toxic int, words array<string>, counts array<long>").toArrow().sort_by([("labelled", "ascending"), ("toxic", "ascending")])
    bags = [(sum(c), of_words(dict(zip(w, c)))) for w, c in zip(got["words"].to_pylist(), got["counts"].to_pylist())]
    return fit(bags, np.array([int(y > 0) for y in got["toxic"].to_pylist()], int))


def score(df: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``df`` with p_toxic (chance of a grade over 0), severity (expected grade) and grade (the likeliest).

    One row per row, no shuffle. Null and empty texts have no features: they get the thresholds' own chances. Columns
    with the results' names are replaced; the others are carried as they are.
    """
    carried = [c for c in df.columns if c not in ("p_toxic", "severity", "grade")]
    src = df.select(*[F.col(f"`{c}`") for c in carried])
    at = carried.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            p = own.grades(np.array([own.logit(t, cache) for t in batch.column(at).to_pylist()], float))
            more = [pa.array(1 - p[:, 0], pa.float64()), pa.array(p @ np.arange(GRADES), pa.float64()), pa.array(p.argmax(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*carried, "p_toxic", "severity", "grade"])

    return src.mapInArrow(run, f"{fields}, p_toxic double, severity double, grade int")


def rejects() -> Column:
    """The filter: toxic more likely than not."""
    return F.col("p_toxic") >= 0.5


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: p_toxic, severity, grade, toxic (whether a filter rejects it)."""
    arrow_batches(spark)
    docs = docs_table(spark, sf_dir)
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "p_toxic", "severity", "grade", rejects().alias("toxic"))
