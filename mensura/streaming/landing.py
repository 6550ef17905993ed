"""Landed JSON lines as a stream: the paged intake with its duplicate-key guard.

New files are picked up as they land; a record key that comes again within the watermark is
dropped, bad lines are set aside by ``bad_lines``, and records get their censoring and remark flags with the
same expressions as in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.overview import Roles, classify
from ..sources.readers import CORRUPT, parsed_lines


def landed_lines(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Stream of parsed lines; bad ones (no JSON, or no object) keep their text in ``_corrupt_record``."""
    return parsed_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder), schema)


def bad_lines(lines: DataFrame) -> DataFrame:
    """Texts of the lines that ``landed_records`` leaves out: a stream to be written beside it."""
    return lines.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("value"))


def landed_records(lines: DataFrame, wanted: str, landed_at: str, delay: str = "1 hour", roles: Roles = Roles()) -> DataFrame:
    """Flagged records, each key once within the watermark; state is bounded by the delay."""
    good = lines.where(F.col(CORRUPT).isNull() & F.col(roles.record).isNotNull()).drop(CORRUPT)
    once = good.withWatermark(landed_at, delay).dropDuplicatesWithinWatermark([roles.record])
    return classify(once, wanted, roles)


def append(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has landed so far and stop; the checkpoint makes the next run continue there."""
    return (
        records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
