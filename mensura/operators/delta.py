"""Comparison of two releases of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_text, delta_size_verdict, identity_key, largest_component, nan_to_null
from ..session import cut_lineage
from .aggregate import describe_delta
from .joins import outer_with_indicator, without
from .ordering import keep_one

TOLERANCE = 1e-10


def delta_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key once with ``status`` new / removed / overlap."""
    both = outer_with_indicator(old.select(key).distinct(), new.select(key).distinct(), [key], ("", ""))
    status = (
        F.when(F.col("side") == "both", "overlap").when(F.col("side") == "left_only", "removed").otherwise("new")
    )
    return both.select(key, status.alias("status"))


def delta_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    s = F.col("status")
    return delta_keys(old, new, key).agg(
        F.count_if(s != "new").alias("n_old"),
        F.count_if(s != "removed").alias("n_new_release"),
        F.count_if(s == "overlap").alias("n_overlap"),
        F.count_if(s == "new").alias("n_new"),
        F.count_if(s == "removed").alias("n_removed"),
    )


def value_changed(old: Column, new: Column, tolerance: float = TOLERANCE) -> Column:
    """Missing on both sides is equal, on one side a change."""
    a, b = nan_to_null(old), nan_to_null(new)
    return ~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))


def delta_values(
    old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], carry: Sequence[str] = (), tolerance: float = TOLERANCE
) -> DataFrame:
    """Side-by-side values with ``<c>_changed`` and ``any_change``; only columns of both releases."""
    common = [c for c in columns if c in old.columns and c in new.columns]
    joined = outer_with_indicator(
        old.select(key, *[c for c in carry if c in old.columns], *common),
        new.select(key, *[c for c in carry if c in new.columns], *common),
        [key], ("_old", "_new"),
    )
    changed = {f"{c}_changed": value_changed(F.col(f"{c}_old"), F.col(f"{c}_new"), tolerance) for c in common}
    out = joined.withColumns(changed)
    anything = F.lit(False)
    for name in changed:
        anything = anything | F.col(name)
    return out.withColumn("any_change", anything)


def changed_overlap(values: DataFrame) -> DataFrame:
    return values.where((F.col("side") == "both") & F.col("any_change"))


def delta_report(values: DataFrame, columns: Sequence[str], count: str, median: str) -> DataFrame:
    """One row: changed per column, direction of the counts, size classes of the value delta."""
    # Read by four aggregations below.
    both = cut_lineage(
        values.where(F.col("side") == "both").withColumn("__d", F.col(f"{median}_new") - F.col(f"{median}_old"))
    )
    old, new = F.col(f"{count}_old"), F.col(f"{count}_new")
    flags = both.agg(
        *[F.count_if(F.col(f"{c}_changed")).alias(f"{c}_changed") for c in columns],
        F.count_if("any_change").alias("any_change"),
        F.count_if(new > old).alias("increased"),
        F.count_if(new < old).alias("decreased"),
        F.count_if(new == old).alias("unchanged"),
    )
    stats = describe_delta(both, "__d")
    return flags.withColumn("__k", F.lit(1)).join(stats.withColumn("__k", F.lit(1)), "__k").drop("__k")


def recent_records(df: DataFrame, year: str, since: int, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.where(F.col(year) >= since).select(*columns).distinct().orderBy(*order)


def verdict(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: new keys, changed keys, and what that makes of the release."""
    values = delta_values(old, new, key, columns)
    counts = values.agg(
        F.count_if(F.col("side") == "right_only").alias("n_new"),
        F.count_if(F.col("side") == "left_only").alias("n_removed"),
        F.count_if((F.col("side") == "both") & F.col("any_change")).alias("n_changed"),
    )
    label = F.when(F.col("n_new") > 0, "new_entities").when(F.col("n_changed") > 0, "changed_values").otherwise("identical")
    return counts.select("*", label.alias("verdict"), delta_size_verdict(F.col("n_new")).alias("holdout"))


def clean_negatives(
    df: DataFrame, text: str, references: Sequence[tuple[DataFrame, str]], order: Sequence[str], nfkc: bool = True
) -> DataFrame:
    """Standardise, drop failures, drop collisions with the reference sets, keep one per key."""
    keyed = df.withColumn("std_text", largest_component(F.col(text)))
    out = keyed.withColumn("entity_key", identity_key("std_text", nfkc)).where(F.col("entity_key").isNotNull())
    # One row per key first: copies are merged before the shuffle, and no key is hot afterwards.
    out = keep_one(out, ["entity_key"], order)
    for table, column in references:
        keys = table.select(identity_key(largest_component(F.col(column)), nfkc).alias("entity_key"))
        out = without(out, keys.where(F.col("entity_key").isNotNull()).distinct(), ["entity_key"])
    return out


def negatives_report(df: DataFrame, text: str, references: Sequence[tuple[DataFrame, str]], nfkc: bool = True) -> DataFrame:
    """Rows lost at each step, as one row; each text row is keyed once and only keys are joined."""
    def keyed(table: DataFrame, column: str) -> DataFrame:
        return table.select(identity_key(largest_component(F.col(column)), nfkc).alias("entity_key"))

    copies = keyed(df, text).groupBy("entity_key").agg(F.count(F.lit(1)).alias("n"))
    for i, (table, column) in enumerate(references):
        hit = keyed(table, column).where(F.col("entity_key").isNotNull()).distinct().withColumn(f"r{i}", F.lit(True))
        copies = copies.join(hit, "entity_key", "left")
    n, failed = F.col("n"), F.col("entity_key").isNull()
    earlier, steps = failed, []
    for i in range(len(references)):
        here = ~earlier & F.col(f"r{i}").isNotNull()
        steps.append(F.coalesce(F.sum(F.when(here, n)), F.lit(0)).alias(f"n_collisions_{i + 1}"))
        earlier = earlier | F.col(f"r{i}").isNotNull()
    kept = ~earlier
    return copies.agg(
        F.sum("n").alias("n_input"),
        F.coalesce(F.sum(F.when(failed, n)), F.lit(0)).alias("n_failed"),
        *steps,
        F.coalesce(F.sum(F.when(kept, n - 1)), F.lit(0)).alias("n_duplicates"),
        F.count_if(kept).alias("n_clean"),
    ).withColumn("ratio", F.try_divide(F.col("n_input").cast("double"), F.col("n_clean").cast("double")))


def entity_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows with a usable key only."""
    return df.withColumn(key, clean_text(key)).where(F.col(key).isNotNull())


def new_set_summary(old: DataFrame, new: DataFrame, key: str, median: str, count: str, year: str) -> DataFrame:
    """Facts about the entities that only the new release has."""
    fresh = without(new, old, [key])
    return fresh.agg(
        F.count(F.lit(1)).alias("n_new"),
        F.min(median).alias("median_min"),
        F.max(median).alias("median_max"),
        F.avg(median).alias("median_mean"),
        F.min(year).alias("year_min"),
        F.max(year).alias("year_max"),
        F.count_if(F.col(count) >= 2).alias("n_repeated"),
    )
