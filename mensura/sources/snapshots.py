"""Snapshots: data plus a manifest of counts and file hashes, a completion marker, versions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expect import counts_match, enforce, row_rules

COMPLETE, FAILED = "complete", "failed"
#: Bytes of a file that a task holds while it hashes.
HASH_BLOCK = 1 << 20
#: Schemes of paths that tasks open themselves, and the names under which they do.
BLOCK_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def latest_complete(versions: DataFrame, version: str, path: str) -> DataFrame:
    """Newest version with a complete and without a failed marker: one row, one small aggregate."""
    ok = versions.where(F.col(COMPLETE) & ~F.coalesce(F.col(FAILED), F.lit(False)))
    return ok.agg(F.max(version).alias(version), F.max_by(path, version).alias(path))


def group_counts(df: DataFrame, key: str, count: str = "n_records") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(count))


def manifest(df: DataFrame, key: str, **facts) -> DataFrame:
    """One row: total, number of groups, and the counts per group as a sorted map.

    The map has one entry per group; use it for group keys of moderate number, and the
    ``group_counts`` table otherwise.
    """
    counts = group_counts(df, key)
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), "n_records")))
    return counts.agg(
        F.sum("n_records").alias("n_records"),
        F.count(F.lit(1)).alias("n_groups"),
        F.map_from_entries(entries).alias("counts"),
    ).select(*[F.lit(v).alias(k) for k, v in facts.items()], "*")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file below a path, hashed on the executors; files are named relative to the path.

    A task opens its files itself and feeds blocks of ``HASH_BLOCK`` bytes to the digest, so files may have any size.
    In a store that only Spark can open (a scheme not in ``BLOCK_SCHEMES``) Spark's reader hands over whole files,
    which it does up to 2 GB. Spark lists no empty files, so they have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString() + "/"
    below = F.when(F.col("path").startswith(root), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
    if root.partition(":")[0] not in BLOCK_SCHEMES:
        return files.select(below.alias("file"), F.sha2("content", 256).alias("sha256"))
    # Without its content column the reader only lists files.
    return files.select(below.alias("file"), "path").mapInPandas(_digests, "file string, sha256 string")


def _digests(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"file": frame["file"], "sha256": [_digest(p) for p in frame["path"]]})


def _digest(path: str) -> str:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        store, place = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        # The path is plain text; only an address needs escapes.
        store, place = fs.FileSystem.from_uri(f"{BLOCK_SCHEMES[scheme]}:{quote(rest, safe='/=:@')}")
    digest = hashlib.sha256()
    with store.open_input_stream(place) as stream:
        while block := stream.read(HASH_BLOCK):
            digest.update(block)
    return digest.hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _mark(spark: SparkSession, path: str, version: str, complete: bool, mode: str) -> None:
    marker = spark.createDataFrame([(version, complete, not complete)], f"version string, {COMPLETE} boolean, {FAILED} boolean")
    marker.write.mode(mode).json(f"{path}/marker")


def write_snapshot(df: DataFrame, path: str, key: str, version: str) -> None:
    """Data, per-group counts, file hashes, and last the marker row.

    Spark's file commit makes each write all-or-nothing; a snapshot without its marker is
    unfinished and never chosen. A run that breaks leaves a failed marker and raises what broke it; a folder
    that was there before keeps its own marker.
    """
    spark = df.sparkSession
    fresh = not _exists(spark, path)
    try:
        df.write.mode("errorifexists").parquet(f"{path}/data")
        written = spark.read.parquet(f"{path}/data")
        group_counts(written, key).write.mode("errorifexists").parquet(f"{path}/counts")
        file_hashes(spark, f"{path}/data", "*.parquet").write.mode("errorifexists").parquet(f"{path}/hashes")
        _mark(spark, path, version, True, "errorifexists")
    except Exception:
        if fresh:
            _mark(spark, path, version, False, "overwrite")
        raise


def verify_snapshot(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Expectation report of a snapshot: counts per group and file hashes."""
    data = spark.read.parquet(f"{path}/data")
    counts = counts_match(group_counts(data, key), spark.read.parquet(f"{path}/counts"), key, "n_records")
    hashes = hashes_match(file_hashes(spark, f"{path}/data", "*.parquet"), spark.read.parquet(f"{path}/hashes"))
    return counts.unionByName(hashes)


def hashes_match(actual: DataFrame, expected: DataFrame) -> DataFrame:
    a = actual.select("file", F.col("sha256").alias("a"))
    e = expected.select("file", F.col("sha256").alias("e"))
    return row_rules(
        a.join(e, "file", "full_outer"),
        {"file_missing": F.col("a").isNull(), "file_extra": F.col("e").isNull(), "hash_differs": F.col("a") != F.col("e")},
        F.col("file"),
    )


def read_snapshot(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The data of a finished snapshot after its checks passed."""
    enforce(verify_snapshot(spark, path, key))
    return spark.read.parquet(f"{path}/data")


def snapshot_versions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Marker rows of several snapshot folders; a folder without marker is incomplete."""
    rows = []
    for path in paths:
        if not _exists(spark, f"{path}/marker/_SUCCESS"):
            rows.append((path, None, False, False))
            continue
        mark = spark.read.json(f"{path}/marker").first()
        rows.append((path, mark["version"], bool(mark[COMPLETE]), bool(mark[FAILED])))
    return spark.createDataFrame(rows, f"path string, version string, {COMPLETE} boolean, {FAILED} boolean")


def run_metadata(df: DataFrame, facts: dict, **labels) -> DataFrame:
    """One-row run summary: computed facts plus constants, with a canonical JSON copy."""
    row = df.agg(*[c.alias(k) for k, c in facts.items()])
    out = row.select(*[F.lit(v).alias(k) for k, v in labels.items()], *facts)
    return out.withColumn("as_json", F.to_json(F.struct(*sorted(out.columns))))
