"""Ordering operators give one answer on both sides of their size switches, for any type; fold checks, draws and batches."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mensura.operators import expect, metrics, ordering
from mensura.sources import sinks

NAN, INF = float("nan"), float("inf")
day = datetime.date(2020, 1, 1)
VALUES = {
    "string": [None, "", "a", "ab", "abcdefgh", "abcdefgi", "b", "b", "é", "zz", "日本"] * 3,
    "date": [None] + [day + datetime.timedelta(days=d % 7) for d in range(25)],
    "timestamp": [None] + [datetime.datetime(2020, 1, 1, 0, 0, d % 9, d) for d in range(25)],
    "timestamp_ntz": [None] + [datetime.datetime(1960, 1, 1, d % 5) for d in range(25)],
    "decimal(20,2)": [None] + [Decimal(d % 6) - Decimal("2.50") for d in range(25)],
    "bigint": [None, 2**62, -(2**62)] + [d % 4 for d in range(25)],
    "boolean": [None, True, False] * 8,
    "double": [None, NAN, INF, INF, -INF, 0.0, -0.0, 1e300, -1e300] + [d % 5 / 2 for d in range(25)],
}


def rows_of(spark, kind):
    data = [(i, f"g{i % 3}" if i % 7 else None, v) for i, v in enumerate(VALUES[kind])]
    return spark.createDataFrame(data, f"i long, g string, v {kind}").repartition(3)


def plain(rows):
    """Rows as comparable text; zeros of either sign are equal."""
    return sorted(repr(tuple(x + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_switches_do_not_change_answers(spark, monkeypatch, kind, keys):
    df = rows_of(spark, kind)

    def answers():
        out = [ordering.value_ranks(df, "v", keys).collect(), ordering.positions(df, "v", ["i"], keys, "p").collect()]
        if kind in ("double", "bigint", "decimal(20,2)"):
            wanted = {"lo": 0.0, "a": 0.025, "q": 0.25, "m": 0.5, "z": 0.975, "hi": 1.0}
            out.append(ordering.percentiles(df, "v", keys, wanted).collect())
        return [plain(r) for r in out]

    small = answers()
    monkeypatch.setattr(ordering, "WINDOW_ROWS", 1)
    monkeypatch.setattr(ordering, "PERCENTILE_ROWS", 1)
    assert answers() == small


def test_percentiles_between_infinities(spark, monkeypatch):
    df = spark.createDataFrame([(1.0,), (INF,), (INF,), (-INF,)], "v double")
    for limit in (1, 1000):
        monkeypatch.setattr(ordering, "PERCENTILE_ROWS", limit)
        row = ordering.percentiles(df, "v", [], {"lo": 0.1, "m": 0.5, "hi": 0.9}).first()
        assert (row.lo, row.m, row.hi) == (-INF, INF, INF)


def test_missing_folds_are_counted_per_partition(spark):
    def bad(rows, n_folds):
        df = spark.createDataFrame(rows, "partition int, k long, g string, fold int")
        return {r.check: r.n_bad for r in expect.no_leakage(df, "k", "g", n_folds).collect()}

    surplus = [(0, 1, "a", 0), (0, 2, "b", 1), (0, 3, "c", 2), (1, 1, "a", 0), (1, 2, "b", 0), (1, 3, "c", 0)]
    assert bad(surplus, 2) == {"group_in_two_folds": 0, "row_not_placed_once": 1, "empty_fold": 1}
    assert bad([(0, 1, "a", -1), (0, 2, "b", None)], 2) == {"group_in_two_folds": 0, "row_not_placed_once": 2, "empty_fold": 2}
    assert bad([(0, 1, "a", 0), (0, 2, "b", 1)], 2) == {"group_in_two_folds": 0, "row_not_placed_once": 0, "empty_fold": 0}


def test_auc_draws_do_not_depend_on_slots(spark):
    df = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("l"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 7).alias("s"))
    one, many = (metrics.bootstrap_auc(df, "l", "s", replicates=50, slot_rows=n).first() for n in (50_000, 10))
    assert tuple(one) == tuple(many)


def test_batches_are_read_once_and_only_when_committed(spark, tmp_path):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    first = sinks.commit_batch(df, path, "job 1/a=b")
    sinks.commit_batch(df, path, "job 1/a=b")
    sinks.commit_batch(df.where("a = 2"), path, "007")
    df.write.parquet(f"{path}/data/batch=half/attempt=lost")
    got = sinks.read_batches(spark, path, df.schema)
    assert sorted(map(tuple, got.select("batch", "a", "b").collect())) == [("007", 2, "y"), ("job 1/a=b", 1, "x"), ("job 1/a=b", 2, "y")]
    assert {r.batch: r.attempt for r in sinks.committed_batches(spark, path).collect()}["job 1/a=b"] == first
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.commit_batch(df, path, "job 1/a=b", first)
