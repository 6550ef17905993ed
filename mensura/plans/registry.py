"""Registered queries: a Spark callable and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazily read input tables of one scale folder: ``t.orders``, ``t.lineitem``, …"""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str = "documents", key: str = "doc_id") -> DataFrame:
        """A text table for work on whole texts, spread over the cores."""
        return spread(getattr(self, name), key)

    def measurements(self) -> DataFrame:
        """Order lines read as measurements: part = entity, supplier = source, nation = collection,
        brand = group, log unit price = value, ship year = year. Suppliers and parts are joined by
        key; Spark sends a side to all executors only by its measured size."""
        lines = self.lineitem.select(
            F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("source"),
            F.log10(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"),
            F.year("l_shipdate").alias("year"), F.col("l_orderkey").alias("record"),
            F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
        )
        suppliers = self.supplier.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("collection"))
        parts = self.part.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("group"))
        return lines.join(suppliers, "source").join(parts, "entity")


# The same view for statements: put in front with ``WITH``.
MEASUREMENTS = """m AS (
  SELECT l_partkey AS entity, l_suppkey AS source, log10(l_extendedprice / l_quantity) AS value,
         CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey AS record, l_linenumber AS line,
         l_returnflag AS flag, s_nationkey AS collection, p_brand AS "group"
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return wrap


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})
