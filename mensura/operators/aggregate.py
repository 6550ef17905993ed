"""Roll-ups of measurements to entities, sources, signatures and whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import clean_text, information_level, is_present, nan_to_null
from .joins import distinct_over_members
from .ordering import percentiles


def entity_aggregate(
    df: DataFrame,
    entity: str,
    value: str,
    year: str | None = None,
    collection: str | None = None,
    source: str | None = None,
    representatives: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """One row per entity: value statistics, years, distinct collections and sources.

    Representatives are the first non-missing values in the stated order. The median comes
    from ranked values, so a hot entity is no single task's burden. NaN and text that is no number
    are missing values.
    """
    df = df.withColumn(value, nan_to_null(value))
    v = F.col(value)
    aggs = [
        *[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c)
          for c in representatives],
        F.min(v).alias("value_min"),
        F.max(v).alias("value_max"),
        F.stddev_samp(v).alias("value_sd"),
        F.count(v).alias("n_measurements"),
    ]
    if year:
        aggs += [F.min(year).alias("year_min"), F.max(year).alias("year_max")]
    if collection:
        aggs.append(F.countDistinct(collection).alias("n_collections"))
    if source:
        aggs.append(F.countDistinct(source).alias("n_sources"))
    rows = df.where(F.col(entity).isNotNull())
    # The median stays out of the aggregate with distinct counts, which multiplies its rows.
    return rows.groupBy(entity).agg(*aggs).join(percentiles(rows, value, [entity], {"value_median": 0.5}), entity, "left")


def join_unique(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], sep: str = ";") -> DataFrame:
    """Sorted distinct non-blank values per group, joined; one output per entry of ``columns``.

    The distinct values are found by a shuffle on (group, value) before they are listed, so
    a frequent value travels once. The list itself is the result.
    """
    items = F.explode(
        F.array_compact(
            F.array(*[
                F.when(clean_text(c).isNotNull(), F.struct(F.lit(o).alias("name"), clean_text(c).alias("item")))
                for o, c in columns.items()
            ])
        )
    )
    distinct = df.select(*keys, items.alias("i")).select(*keys, "i.name", "i.item").distinct()
    listed = [
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("name") == o, F.col("item")))), sep).alias(o)
        for o in columns
    ]
    return distinct.groupBy(*keys).agg(*listed)


def source_aggregate(
    df: DataFrame,
    source: str,
    entity: str,
    value: str | None = None,
    year: str | None = None,
    distinct: Mapping[str, str] | None = None,
    lists: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per source: rows, entities, optional distinct counts, lists, value and year facts.

    NaN and text that is no number are missing values.
    """
    rows = df.where(F.col(source).isNotNull())
    if value:
        rows = rows.withColumn(value, nan_to_null(value))
    aggs = [F.count(F.lit(1)).alias("n_measurements"), F.countDistinct(entity).alias("n_entities")]
    aggs += [F.countDistinct(c).alias(o) for o, c in (distinct or {}).items()]
    if value:
        aggs += [
            F.count(value).alias("value_n"),
            F.min(value).alias("value_min"),
            F.max(value).alias("value_max"),
            F.avg(value).alias("value_mean"),
            F.stddev_samp(value).alias("value_sd"),
        ]
    if year:
        aggs += [F.min(year).alias("year_min"), F.max(year).alias("year_max")]
        lists = {**(lists or {}), "years": year}
    out = rows.groupBy(source).agg(*aggs)
    if value:
        out = out.join(percentiles(rows, value, [source], {"value_median": 0.5}), source, "left")
    if lists:
        found = join_unique(rows, [source], lists)
        out = out.join(found, source, "left").withColumns({o: F.coalesce(F.col(o), F.lit("")) for o in lists})
    return out


def conditional_counts(df: DataFrame, source: str, entity: str, flags: Sequence[str]) -> DataFrame:
    return df.where(F.col(source).isNotNull()).groupBy(source).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct(entity).alias("n_entities"),
        *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags],
    )


def long_value_counts(df: DataFrame, columns: Mapping[str, str], flags: Sequence[str] = (), missing: str = "<MISSING>") -> DataFrame:
    """Value counts of several columns and flag totals as one long table, from one scan."""
    cells = [
        F.struct(F.lit(g).alias("group"), F.coalesce(clean_text(c, False), F.lit(missing)).alias("value"), F.lit(1).alias("hit"))
        for g, c in columns.items()
    ] + [
        F.struct(F.lit("flag").alias("group"), F.lit(f).alias("value"), F.coalesce(F.col(f), F.lit(False)).cast("int").alias("hit"))
        for f in flags
    ]
    return df.select(F.inline(F.array(*cells))).groupBy("group", "value").agg(F.sum("hit").alias("n_records"))


def field_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Present and missing cells per column: one aggregation, then turned to rows."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    counted = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(is_present(c, types[c])).alias(f"__p{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"__p{i}").alias("n_present")) for i, c in enumerate(columns)])
    return _coverage(counted.select("__n", F.inline(rows)), "__n", "n_missing")


def _coverage(df: DataFrame, total: str, missing: str | None) -> DataFrame:
    cols = [F.col("field"), F.col("n_present")]
    if missing:
        cols.append((F.col(total) - F.col("n_present")).alias(missing))
    else:
        cols.append(F.col(total).alias("n_property_rows"))
    share = F.round(F.try_divide(F.col("n_present") * 100.0, F.col(total)), 3)
    return df.select(*cols, share.alias("coverage_percent"))


def nested_field_coverage(df: DataFrame, properties: str) -> DataFrame:
    """Coverage of the fields of ``array<map>`` or ``array<struct>`` rows; the denominator is
    the number of property rows."""
    dtype = df.schema[properties].dataType
    item = F.explode(F.col(properties)).alias("p")
    rows = df.select(item).where(F.col("p").isNotNull())
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return _coverage(
            field_coverage(rows.select("p.*")).withColumn("n_property_rows", F.col("n_present") + F.col("n_missing")),
            "n_property_rows", None,
        )
    present = rows.select(F.explode("p").alias("field", "v")).groupBy("field").agg(
        F.count_if(is_present("v")).alias("n_present")
    )
    total = rows.select(F.count(F.lit(1)).alias("t")).scalar()
    return _coverage(present.withColumn("__n", total), "__n", None)


def flag_coverage(
    sources: DataFrame, records: DataFrame, source: str, entity: str, flags: Sequence[str], size: str, rows: str
) -> DataFrame:
    """Per flag: sources, summed sizes, distinct entities over the union, and rows.

    Flags become rows once; one distinct count serves all of them.
    """
    raised = sources.select(
        source, size, rows,
        F.explode(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))).alias("category"),
    )
    per_flag = raised.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.sum(F.coalesce(F.col(size), F.lit(0))).alias("sum_entity_counts"),
        F.sum(F.coalesce(F.col(rows), F.lit(0))).alias("n_measurements"),
    )
    union = distinct_over_members(records, raised.select(source, "category"), source, "category", entity, "entities_union")
    every = sources.sparkSession.createDataFrame([(f,) for f in flags], "category string")
    out = every.join(per_flag, "category", "left").join(union, "category", "left")
    counts = ["n_sources", "sum_entity_counts", "n_measurements", "entities_union"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})


def signature_families(
    sources: DataFrame,
    records: DataFrame,
    signature: str,
    source: str,
    entity: str,
    collection: str,
    size: str,
    n_known: str,
) -> DataFrame:
    """One row per signature with its members; a family is never verified automatically."""
    named = sources.where(F.col(signature).isNotNull())
    families = named.groupBy(signature).agg(
        F.count(source).alias("n_sources"),
        F.array_sort(F.collect_list(source)).alias("members"),
        F.sum(size).alias("sum_entities"),
        F.countDistinct(collection).alias("n_collections"),
        F.max(n_known).alias("n_known_fields"),
    )
    unique = distinct_over_members(records, named.select(source, signature), source, signature, entity, "unique_entities")
    return (
        families.join(unique, signature, "left")
        .withColumn("unique_entities", F.coalesce("unique_entities", F.lit(0)).cast("long"))
        .withColumn("information", information_level(F.col("n_known_fields")))
        .withColumn("verified", F.lit(False))
    )


def median_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return percentiles(df, value, keys, {out: 0.5})


def sized_medians(df: DataFrame, key: str, value: str, minimum: int = 20) -> DataFrame:
    """Median and count of every group with at least ``minimum`` values."""
    df = df.withColumn(value, nan_to_null(value))
    big = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(value).alias("n")).where(F.col("n") >= minimum)
    return big.join(percentiles(df, value, [key], {"median": 0.5}), key)


def median_range(df: DataFrame, key: str, value: str, minimum: int = 20) -> DataFrame:
    """Spread of group medians; describes, does not explain."""
    return sized_medians(df, key, value, minimum).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("median").alias("median_min"),
        F.max("median").alias("median_max"),
        (F.max("median") - F.min("median")).alias("median_range"),
    )


def describe_delta(df: DataFrame, delta: str, thresholds: Sequence[float] = (0.01, 0.10, 0.50)) -> DataFrame:
    df = df.withColumn(delta, nan_to_null(delta))
    d = F.col(delta)
    stats = df.agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.min(d).alias("min"),
        F.max(d).alias("max"),
        *[F.count_if(F.abs(d) > t).alias(f"n_abs_gt_{int(round(t * 100)):03d}") for t in thresholds],
    )
    quart = percentiles(df.withColumn("__all", F.lit(1)), delta, ["__all"], {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return stats.withColumn("__all", F.lit(1)).join(quart, "__all", "left").drop("__all")


def direction_counts(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(new) > F.col(old)).alias("increased"),
        F.count_if(F.col(new) < F.col(old)).alias("decreased"),
        F.count_if(F.col(new) == F.col(old)).alias("unchanged"),
    )


def replicate_counts(df: DataFrame, entity: str, source: str) -> DataFrame:
    """Rows per (entity, source) and whether there are several; counted before the shuffle."""
    return df.groupBy(entity, source).agg(F.count(F.lit(1)).alias("n_replicates")).withColumn(
        "is_replicated", F.col("n_replicates") > 1
    )


def with_replicate_counts(df: DataFrame, entity: str, source: str) -> DataFrame:
    """The counts attached to every record; records of a hot pair are not gathered."""
    from .joins import hot_key_lookup

    return hot_key_lookup(df, replicate_counts(df, entity, source), [entity, source], "left")


def multi_source_range(df: DataFrame, entity: str, source: str, value: str) -> DataFrame:
    """Entities measured by several sources and the median spread within them; NaN is missing."""
    df = df.withColumn(value, nan_to_null(value))
    spread = df.groupBy(entity).agg(
        F.countDistinct(source).alias("k"), (F.max(value) - F.min(value)).alias("spread")
    ).where(F.col("k") >= 2)
    n = spread.agg(F.count(F.lit(1)).alias("n_entities"), F.max("spread").alias("max_range")).withColumn("__all", F.lit(1))
    mid = percentiles(spread.withColumn("__all", F.lit(1)), "spread", ["__all"], {"median_range": 0.5})
    return n.join(mid, "__all", "left").drop("__all")


def global_coverage(df: DataFrame, present: Sequence[str], distinct: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(c).alias(f"n_{c}") for c in present],
        *[F.countDistinct(c).alias(f"u_{c}") for c in distinct],
    )


def role_rollup(df: DataFrame, role: str, size: Column | str) -> DataFrame:
    return df.groupBy(role).agg(F.count(F.lit(1)).alias("n_sources"), F.sum(size).alias("sum_entities"))
