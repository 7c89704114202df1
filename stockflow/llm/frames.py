"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below spark.checkpoint.dir and read back, so that lost executors do not undo it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.Array, size: int) -> Iterator[pa.Array]:
    """A batch of strings or lists in slices of some ``size`` bytes or members (one row at least), to hold less at a time."""
    if len(batch):
        lengths = pc.list_value_length(batch) if pa.types.is_list(batch.type) else pc.binary_length(batch)
        share = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        ends = [*(np.flatnonzero(np.diff(share)) + 1).tolist(), len(batch)]
        for a, b in zip([0, *ends], ends):
            yield batch.slice(a, b - a)


def aligned(batch: pa.Array, other: pa.Array, size: int) -> Iterator[pa.Array]:
    """``other``, as long as ``batch``, in the slices that ``batch`` has."""
    done = 0
    for part in slices(batch, size):
        yield other.slice(done, len(part))
        done += len(part)


def shipped(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` stay within ``limit``; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if rows <= limit else df
