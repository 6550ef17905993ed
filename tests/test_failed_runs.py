"""A snapshot run that breaks is marked as failed and never chosen."""

import pytest
from pyspark.sql import functions as F

from mensura.sources import snapshots


def test_a_broken_run_leaves_a_failed_marker(spark, tmp_path):
    good, broken, later = (str(tmp_path / n) for n in ("v1", "v2", "v3"))
    rows = spark.createDataFrame([(k, k % 3) for k in range(30)], "k long, g long")
    snapshots.write_snapshot(rows, good, "g", "v1")
    bad = rows.withColumn("x", F.when(F.col("k") == 17, F.raise_error(F.lit("unreadable row"))).otherwise(F.lit("ok")))
    with pytest.raises(Exception, match="unreadable row"):
        snapshots.write_snapshot(bad, broken, "g", "v2")
    with pytest.raises(Exception, match="no_such_column"):  # breaks after the data are written
        snapshots.write_snapshot(rows, later, "no_such_column", "v3")
    marks = snapshots.snapshot_versions(spark, [good, broken, later, str(tmp_path / "none")])
    found = {r.path: (r.version, r.complete, r.failed) for r in marks.collect()}
    assert found == {good: ("v1", True, False), broken: ("v2", False, True), later: ("v3", False, True), str(tmp_path / "none"): (None, False, False)}
    assert snapshots.latest_complete(marks, "version", "path").first().path == good
    # Writing over a finished snapshot is refused and leaves it as it was.
    with pytest.raises(Exception):
        snapshots.write_snapshot(rows, good, "g", "v4")
    again = snapshots.snapshot_versions(spark, [good]).first()
    assert (again.version, again.complete, again.failed) == ("v1", True, False)
