"""Data contracts: every expectation is a DataFrame ``(check, n_bad, sample)``.

Row-level rules of one table share a single aggregation; ``enforce`` raises when any
reports a bad row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



class ExpectationError(RuntimeError):
    """At least one expectation found bad rows."""


def enforce(*reports: DataFrame) -> None:
    """Raise when any report counts bad rows. Reports hold one row per check."""
    failed = []
    for report in reports:
        failed += [r for r in report.where(F.col("n_bad") > 0).collect()]
    if failed:
        raise ExpectationError("; ".join(f"{r['check']}: {r['n_bad']} bad, e.g. {r['sample']}" for r in failed))


def _report(df: DataFrame, check: str, bad: Column, shown: Column) -> DataFrame:
    return row_rules(df, {check: bad}, shown)


def row_rules(df: DataFrame, rules: Mapping[str, Column], shown: Column) -> DataFrame:
    """One pass over ``df``: per rule the number of rows for which it is TRUE and the smallest
    offender as an example."""
    aggs = []
    for i, bad in enumerate(rules.values()):
        hit = F.coalesce(bad, F.lit(False))
        aggs += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, shown.cast("string"))).alias(f"s{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("n_bad"), F.col(f"s{i}").alias("sample"))
            for i, name in enumerate(rules)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def parseable(df: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    return _report(df, "parseable", F.col(corrupt).isNotNull(), F.col(corrupt))


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Schema check: decided on the driver, no data is read."""
    absent = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(
        [("required_columns", len(absent), ",".join(absent) or None)], "check string, n_bad long, sample string"
    )


def non_blank(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rules = {f"{k}_blank": F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys}
    return row_rules(df, rules, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def unique_key(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """Number of key values that occur more than once (counted before the shuffle)."""
    shown = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return _report(counts, name, F.col("__n") > 1, shown)


def domain(df: DataFrame, column: str, expected: object, optional: bool = False) -> DataFrame:
    """All rows have the expected value; an optional column may also be blank."""
    col = F.col(column)
    bad = ~F.coalesce(col == F.lit(expected), F.lit(False))
    if optional:
        bad = bad & col.isNotNull() & (F.trim(col.cast("string")) != "")
    return _report(df, f"{column}_domain", bad, col)


def counts_match(actual: DataFrame, expected: DataFrame, key: str, count: str) -> DataFrame:
    """Per-group counts against a manifest: missing, extra and differing groups."""
    a = actual.select(key, F.col(count).alias("__a"))
    e = expected.select(key, F.col(count).alias("__e"))
    both = a.join(e, key, "full_outer")
    return row_rules(
        both,
        {
            "missing_group": F.col("__a").isNull(),
            "extra_group": F.col("__e").isNull(),
            "count_differs": F.col("__a") != F.col("__e"),
        },
        F.col(key),
    )


def constant_version(*rows: DataFrame, column: str = "version") -> DataFrame:
    """A version read at start and end must be one and the same."""
    merged = rows[0].select(column)
    for other in rows[1:]:
        merged = merged.unionByName(other.select(column))
    n = merged.agg(
        F.countDistinct(column).alias("n"), F.max(column).cast("string").alias("sample"),
        F.count_if(F.col(column).isNull()).alias("nulls"),
    )
    return n.select(
        F.lit("constant_version").alias("check"),
        (F.greatest(F.col("n") - 1, F.lit(0)) + F.col("nulls")).alias("n_bad"),
        F.when((F.col("n") > 1) | (F.col("nulls") > 0), F.col("sample")).alias("sample"),
    )


def split_rows(
    df: DataFrame, drop_when: Mapping[str, Column], warn_when: Mapping[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows to keep (with a ``warnings`` list) and rejected rows (with their ``reasons``)."""
    def names(rules: Mapping[str, Column]) -> Column:
        return F.concat_ws(";", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])

    marked = df.withColumn("reasons", names(drop_when)).withColumn("warnings", names(warn_when or {}))
    kept = marked.where(F.col("reasons") == "").drop("reasons")
    return kept, marked.where(F.col("reasons") != "").drop("warnings")


def array_quality(df: DataFrame, column: str, size: int, key: str) -> DataFrame:
    col = F.col(column)
    number = F.transform(col, lambda x: x.cast("double"))
    finite = F.forall(number, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = F.aggregate(number, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return row_rules(
        df,
        {
            "wrong_size": F.coalesce(F.size(col), F.lit(-1)) != size,
            "not_finite": ~F.coalesce(finite, F.lit(False)),
            "empty": F.coalesce(total, F.lit(0.0)) == 0,
        },
        F.col(key),
    )


def no_leakage(folds: DataFrame, key: str, group: str, n_folds: int, partition: str = "partition", fold: str = "fold") -> DataFrame:
    """No group in two folds, no row placed other than once in a fold 0 … n_folds - 1, no empty fold - per partition.

    Fold numbers without rows are counted one by one for each partition, so a surplus in one does not hide a lack in
    another; a row in any other fold is not placed.
    """
    known = F.when(F.col(fold).between(0, n_folds - 1), F.col(fold))
    leaks = (
        folds.groupBy(partition, group).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
        .agg(F.count_if(F.col("lo") != F.col("hi")).alias("n_bad"),
             F.min(F.when(F.col("lo") != F.col("hi"), F.col(group).cast("string"))).alias("sample"))
    )
    placed = (
        folds.groupBy(partition, key).agg(F.count(F.lit(1)).alias("n"), F.count(known).alias("m"))
        .agg(F.count_if((F.col("n") != 1) | (F.col("m") != 1)).alias("n_bad"),
             F.min(F.when((F.col("n") != 1) | (F.col("m") != 1), F.col(key).cast("string"))).alias("sample"))
    )
    sizes = folds.groupBy(partition).agg(F.countDistinct(known).alias("k"))
    empty = sizes.agg(
        F.coalesce(F.sum(F.lit(n_folds) - F.col("k")), F.lit(0)).alias("n_bad"),
        F.min(F.when(F.col("k") < n_folds, F.col(partition).cast("string"))).alias("sample"),
    )
    out = None
    for name, part in (("group_in_two_folds", leaks), ("row_not_placed_once", placed), ("empty_fold", empty)):
        one = part.select(F.lit(name).alias("check"), F.col("n_bad").cast("long").alias("n_bad"), "sample")
        out = one if out is None else out.unionByName(one)
    return out


def predictions_complete(oof: DataFrame, keys: DataFrame, key: str, prediction: str) -> DataFrame:
    """Every expected key has exactly one finite prediction."""
    col = F.col(prediction)
    got = oof.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(col.isNull() | F.isnan(col) | (F.abs(col) == float("inf"))).alias("bad"),
    )
    joined = keys.select(key).distinct().join(got, key, "full_outer")
    return row_rules(
        joined,
        {
            "missing_prediction": F.col("n").isNull(),
            "repeated_prediction": F.col("n") > 1,
            "not_finite": F.col("bad") > 0,
        },
        F.col(key),
    )


def group_labels_present(df: DataFrame, group: str, shown: str) -> DataFrame:
    text = F.lower(F.trim(F.col(group).cast("string")))
    bad = F.col(group).isNull() | text.isin("", "nan", "none")
    return _report(df, "group_label_blank", bad, F.col(shown))


def schema_of_report() -> T.StructType:
    return T.StructType(
        [T.StructField("check", T.StringType()), T.StructField("n_bad", T.LongType()), T.StructField("sample", T.StringType())]
    )
