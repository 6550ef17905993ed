"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A word of the contracts: a run of anything but space and the ASCII controls 9 to 13.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def words(text) -> F.Column:
    """Words of a text column; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lost executors cost nothing
    that was computed before, and a table used twice is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:4]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, about, for which a task of its own pays.
TASK_ROWS = 4096


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for frames of about ``rows`` rows: their number follows the rows, not the session's shuffle partitions,
    and is never below its cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: hand at most ``BATCH_ROWS`` of them to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def slowly(*columns: pa.Array, step: int = 256):
    """Rows of Arrow columns as Python values, a few at a time: a batch of texts is never held twice."""
    for at in range(0, len(columns[0]), step):
        yield from zip(*(c.slice(at, step).to_pylist() for c in columns))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser over an array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
