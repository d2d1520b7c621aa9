"""Plug points for models that aren't part of this library: detector, segmenter, encoder, propagator.

A factory is called once in each Python worker and returns the model; rows reach it in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from trackloom.operators.sequences import ordered_fold

Model = Callable[[list[dict]], list[dict]]

DETECTION = "episode_id long, camera string, frame_idx long, object_id long, confidence double, x0 double, y0 double, x1 double, y1 double"


def apply(rows: DataFrame, factory: Callable[[], Model], schema: str) -> DataFrame:
    """The rows that a model makes of batches of rows: any number for each, in any order."""
    out = rows.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            yield pa.RecordBatch.from_pylist(model(batch.to_pylist()), schema=kinds)

    return rows.mapInArrow(run, out)


def detect(frames: DataFrame, factory: Callable[[], Model]) -> DataFrame:
    """Detections of frames."""
    return apply(frames, factory, DETECTION)


def propagate(intervals: DataFrame, factory: Callable[[], Callable[[Iterator[dict]], Iterator[dict]]], schema: str) -> DataFrame:
    """Masks of each clip, object and seed interval: the model sees the interval's frames in order, seed rows among them, and yields rows."""

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        yield from factory()(rows)

    return ordered_fold(intervals, ["clip_id", "object_id", "seed_frame"], ["frame_idx"], fold, schema)
