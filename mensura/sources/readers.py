"""Landed files to DataFrames: CSV, JSON lines, JSON documents, keyed JSON, side arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BOM = "\ufeff"
CORRUPT = "_corrupt_record"


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header whose columns are matched by name, with or without a byte-order mark.

    Columns are read as text in file order, so a changed order or an extra column is no
    error; absent ones become NULL and each cell is converted to its stated type. Files of one
    path share one header: a file with another one stops the read, it is never read shifted.
    """
    if spark.read.text(path).first() is None:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    raw = reader.csv(path)
    # A column without a name gets one that no header holds, so the headers cannot be compared then.
    nameless = any(c == f"_c{i}" for i, c in enumerate(raw.columns))
    raw = reader.option("enforceSchema", nameless).schema(raw.schema).csv(path)
    at = {c.lstrip(BOM).strip(): c for c in raw.columns}
    cells = [
        (F.col(f"`{at[f.name]}`").try_cast(f.dataType) if f.name in at else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return raw.select(*cells)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line keeps its text in ``_corrupt_record``.

    A line that is valid JSON but no object is bad too.
    """
    return parsed_lines(spark.read.text(path), schema)


def parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines (``value``), read at once or as a stream, by the rules of ``read_jsonl``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = lines.where(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value"
    )
    not_object = ~F.ltrim("value").startswith("{")
    fields = [F.when(~not_object, F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields]
    return parsed.select(*fields, F.when(not_object, F.col("value")).otherwise(F.col(f"r.{CORRUPT}")).alias(CORRUPT))


def locate_bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """File and 1-based line number of every bad line.

    A scan task knows the order of its own lines; numbers of earlier splits of the same
    file are added from a table with one row per split.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    bad = lines.where(F.trim("value") != "").where(
        parsed[CORRUPT].isNotNull() | ~F.ltrim("value").startswith("{")
    )
    return bad.join(splits, ["file", "block"]).select(
        "file", (F.col("id") - F.col("first_id") + F.col("offset") + 1).alias("line"), F.col("value").alias("text")
    )


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``read_jsonl``, but any bad line stops the read with its file and line number."""
    bad = locate_bad_lines(spark, path, schema).orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}, line {bad[0]['line']}: not a JSON object")
    return read_jsonl(spark, path, schema).drop(CORRUPT)


def read_json_doc(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per file."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def explode_keyed_json(text: Column, record: T.DataType, key: str, value: str) -> list[Column]:
    """``{"id": {…}, …}`` to key/value rows: use in one ``select``."""
    return [F.explode(F.from_json(text, T.MapType(T.StringType(), record))).alias(key, value)]


def read_keyed_json(spark: SparkSession, path: str, record: T.StructType, key: str = "id") -> DataFrame:
    """Files that hold one object of objects, one output row per inner object."""
    docs = spark.read.text(path, wholetext=True)
    return docs.select(*explode_keyed_json(F.col("value"), record, key, "r")).select(key, "r.*")


def property_rows(text: Column, record: T.StructType) -> Column:
    """A JSON value that may be missing, one object, or a list of objects, as an array."""
    head = F.ltrim(text)
    one = F.array(F.from_json(text, record))
    many = F.from_json(text, T.ArrayType(record))
    return F.when(head.startswith("["), many).when(head.startswith("{"), one)


def attach_arrays(rows: DataFrame, arrays: DataFrame, key: str, column: str) -> DataFrame:
    """Join an array side table by key; never by position."""
    return rows.join(arrays.select(key, column), key)
