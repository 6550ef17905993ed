"""Sinks with a stable column order."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import BOM


def flat(df: DataFrame, sep: str = ";") -> DataFrame:
    """Lists become joined text; maps and structs become JSON: a text file has no nesting."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.MapType, T.ArrayType)):
            cols.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), sep).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, bom: bool = False) -> None:
    """CSV with header. With ``bom`` the first header name carries the byte-order mark."""
    out = flat(df.select(*(columns or df.columns)))
    if bom:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    out.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("errorifexists").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), columns: Sequence[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """``name: value`` lines of a one-row summary."""
    cells = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
    df.select(F.array_join(cells, "\n").alias("value")).write.mode("errorifexists").text(path)


def append_results(df: DataFrame, path: str, partition_by: Sequence[str] = ("representation", "algorithm")) -> None:
    """Append one job's batch; readers see all batches as one table. A batch that is sent again is there twice:
    ``commit_batch`` is for batches that may be."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def commit_batch(df: DataFrame, path: str, batch: str, attempt: str | None = None) -> str:
    """Write the result of job ``batch`` as an attempt of its own and then its commit record; returns the attempt.

    A run that is lost before the record leaves files that no reader sees. A batch sent again, by a retry or by
    another worker, is a further attempt, of which ``read_batches`` takes one.
    """
    attempt = attempt or uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{path}/data/batch={quote(batch, safe='')}/attempt={attempt}")
    record = df.sparkSession.createDataFrame([(batch, attempt)], "batch string, attempt string")
    record = record.withColumn("committed_at", F.current_timestamp())
    record.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return attempt


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt, committed_at): the first committed attempt of each batch."""
    records = spark.read.schema("batch string, attempt string, committed_at timestamp").parquet(f"{path}/commits")
    first = F.min(F.struct("committed_at", "attempt")).alias("c")
    return records.groupBy("batch").agg(first).select("batch", "c.attempt", "c.committed_at")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All committed batches as one table of ``schema`` plus ``batch``, each batch once."""
    kept = committed_batches(spark, path).select("batch", "attempt")
    names = T.StructType([*schema.fields, T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(names).option("basePath", f"{path}/data").parquet(f"{path}/data")
    # One row per job of the plan on the right; folders of other attempts are not read.
    return rows.join(F.broadcast(kept), ["batch", "attempt"], "left_semi").drop("attempt")
