"""Reading the tables, sizing blocks and packing rows; used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch for tables of long texts, where the session has Spark's default.
TEXT_ROWS = 1000
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def arrow_batches(spark: SparkSession) -> None:
    """Keeps an Arrow batch of texts to some MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "trackloom-checkpoints")
    return f"{base.rstrip('/')}/trackloom-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: the lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Returns memory that earlier tasks of this Python worker have freed to the system, before a task that needs much."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one aggregate over one column."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, math.ceil(total_bytes / block_bytes))


def block_of(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one buffer: the length, then each array's bytes."""
    return b"".join([np.int64(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds: object) -> list[np.ndarray]:
    """What pack() got, by the arrays' dtypes."""
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * kind.itemsize
    return out
