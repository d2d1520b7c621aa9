"""An inverted file over vectors: cells around coarse centres, and bounds on the products with what a cell holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors a cell by which their number is chosen, and most cells; vectors that the centres are fitted to, those of the smallest hashes.
CELL, MOST_CELLS, SAMPLE = 1024, 4096, 20_000


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Directions around which a sample's vectors lie; the same for the same sample."""
    x = _units(sample)
    c = x[np.random.default_rng(3).permutation(len(x))[np.arange(cells) % len(x)]]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        held = np.linalg.norm(sums, axis=1) > 1e-12
        c[held] = _units(sums[held])
    return c


class Cells:
    """Centres, and for each the widest angle, the greatest norm and the number of the vectors in its cell."""

    def __init__(self, directions: np.ndarray) -> None:
        self.directions = directions
        self.angle, self.norm, self.size = (np.zeros(len(directions)) for _ in range(3))

    @classmethod
    def of(cls, vectors: DataFrame, key: str, column: str) -> tuple[Cells, DataFrame]:
        """The cells of all vectors and the rows with their ``cell``. At most SAMPLE vectors and a row a cell pass the driver."""
        n = vectors.count()
        first = vectors.select(column).orderBy(F.xxhash64(key), key).limit(SAMPLE).toArrow()[column].combine_chunks()
        own = cls(centres(matrix(first), min(max(-(-n // CELL), 1), MOST_CELLS)) if len(first) else np.ones((1, 1)))
        placed = own.placed(vectors, column)
        for r in placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect():
            own.angle[r.cell], own.norm[r.cell], own.size[r.cell] = r.angle, r.norm, r.n
        return own, placed.drop("angle", "norm")

    def placed(self, vectors: DataFrame, column: str) -> DataFrame:
        at = vectors.columns.index(column)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(at))
                cos = _units(x) @ self.directions.T if len(x) else np.zeros((0, 1))
                cell = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(x)), cell], -1, 1))
                more = [pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(np.linalg.norm(x, axis=1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "angle", "norm"])

        return vectors.mapInArrow(run, f"{kinds}, cell int, angle double, norm double")

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The greatest product that each row can have with a vector of each cell; -inf for empty cells.

        A vector of a cell lies within the cell's angle of its centre, so no nearer to x than x is to the centre, less that angle.
        """
        if not self.size.any():
            return np.full((len(x), len(self.size)), -np.inf)
        norm = np.linalg.norm(x, axis=1)
        between = np.arccos(np.clip(_units(x) @ self.directions.T, -1, 1)) - self.angle - 1e-9
        top = np.maximum(np.cos(np.clip(between, 0, np.pi)), 0) * self.norm * norm[:, None]
        return np.where(self.size > 0, top, -np.inf)

    def first(self, x: np.ndarray, least: int) -> list[np.ndarray]:
        """For each row the cells of the greatest bounds that hold ``least`` vectors together."""
        bounds = self.bounds(x)
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        go = (before < least) & np.isfinite(np.take_along_axis(bounds, order, 1))
        return [o[g] for o, g in zip(order, go)]
