"""Structured Streaming over live frame events: bundles by window, runs by session, and track recovery with keyed state.

Each reads what is there (trigger availableNow) and gives the result as a table in the shared folder, so a batch query
over the same events gives the same rows. State is by clip, so it is spread by key; the watermark bounds it on a live stream.
"""

from __future__ import annotations

import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.machines import new_track, recover

LATE = "10 minutes"
#: Event time after which a silent clip's track is given up.
IDLE_MS = 366 * 24 * 3600 * 1000


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/trackloom-stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, files_a_batch: int = 1) -> DataFrame:
    """Events as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    stream = reader.option("pathGlobFilter", os.path.basename(path)).parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's rows when it has read all: the last state in complete mode, every row in append mode."""
    out = folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{out}/rows") if mode == "complete" else spark.read.schema(stream.schema).parquet(f"{out}/rows/batch=*")
    return rows.select(*stream.columns)


def bundles(spark: SparkSession, sf_dir: str, span: str = "1 day") -> DataFrame:
    """Review requests of a clip in the same window."""
    asked = source(spark, sf_dir).where("value < 50").withWatermark("ts", LATE)
    out = asked.groupBy(F.window("ts", span), "user_id").agg(F.count("*").alias("triggers"))
    return finished(spark, out.select(F.col("user_id").alias("clip_id"), F.unix_micros("window.start").alias("start_us"), "triggers"), "complete")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "1 day") -> DataFrame:
    """Runs of false positives of a clip: samples less than a gap apart."""
    wrong = source(spark, sf_dir).where("event_type IN ('purchase', 'error') AND value >= 50").withWatermark("ts", LATE)
    out = wrong.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("samples"))
    return finished(spark, out.select(F.col("user_id").alias("clip_id"), F.unix_micros("session_window.start").alias("start_us"), "samples"), "complete")


def observed(events: DataFrame, *more: str) -> DataFrame:
    """Events as a track's observations, in order of time, with ``more`` columns of theirs."""
    i = F.col("event_id")
    hit = F.coalesce(F.col("value") >= 50, F.lit(False)) & (i % 11 != 0)
    return events.select(
        F.col("user_id").alias("clip_id"), F.unix_micros("ts").alias("at"), hit.alias("candidate"), (i % 13 == 0).alias("tiny"), (i % 100 < 5).alias("severe"), ((i % 97) / 97).alias("presence"),
        F.col("event_type").isin("purchase", "error").alias("empty"), F.when(i % 7 != 0, (i % 100) / 100).alias("agreement"), *more)


def stepper(step: Callable = recover, idle_ms: int = IDLE_MS) -> Callable:
    """A grouped stateful function: each batch's observations of a key in order, the state carried on.

    A key that has been idle for ``idle_ms`` of event time, by the watermark, gives up its state; its next observation begins a new track.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # type: ignore[attr-defined]
            state.remove()  # type: ignore[attr-defined]
            return
        t = pickle.loads(state.get[0]) if state.exists else new_track()  # type: ignore[attr-defined]
        rows = pd.concat(list(batches)).sort_values("at", kind="stable").drop(columns="ts")
        out = []
        for o in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            t, action, reason = step(t, o)
            out.append((key[0], o["at"], action, reason, bool(t["active"]), int(t["segment"])))
        state.update((pickle.dumps(t),))  # type: ignore[attr-defined]
        state.setTimeoutTimestamp(max(int(rows["at"].max()) // 1000, state.getCurrentWatermarkMs()) + idle_ms)  # type: ignore[attr-defined]
        yield pd.DataFrame(out, columns=["clip_id", "at", "action", "reason", "active", "segment"])

    return run


def recovered(events: DataFrame, late: str = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """Actions of the recovery loop on a stream of events, keyed by clip.

    Observations of a micro-batch are taken in order of time, micro-batches as they come; one older than the watermark is dropped, since the
    track has gone on without it. The watermark also bounds the state, see stepper().
    """
    rows = observed(events, "ts").withWatermark("ts", late)
    kinds = "clip_id long, at long, action string, reason string, active boolean, segment int"
    return rows.groupBy("clip_id").applyInPandasWithState(stepper(idle_ms=idle_ms), kinds, "track binary", "append", "EventTimeTimeout")


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recovery loop on the events of a folder."""
    return finished(spark, recovered(source(spark, sf_dir)), "append")
