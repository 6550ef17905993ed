"""Paired contrasts between sources that share entities, with cluster-aware statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import clean_text
from ..functions.quantiles import signed_rank_p_value, t_half_width_factor
from ..session import cut_lineage
from .aggregate import median_by
from .joins import hot_key_lookup, near_signature_pairs
from .metrics import PERCENT_HIGH, PERCENT_LOW, spearman
from .ordering import percentiles, value_ranks

PAIR = ["source_a", "source_b"]


def pair_deltas(
    pairs: DataFrame, records: DataFrame, source: str, entity: str, value: str, group: str | None = None, collection: str | None = None
) -> DataFrame:
    """One row per pair and shared entity: both medians and their difference B − A.

    Where ``pairs`` say the ``collection`` of both sources, sources may meet on collection and entity and are
    then looked up among the pairs; otherwise each pair is joined to all entities of A. The way with fewer rows
    is taken, by counting both.
    """
    rows = records.where(F.col(value).isNotNull() & F.col(entity).isNotNull())
    named = pairs.select(*PAIR, *([collection] if collection else []))
    sources = named.select(F.explode(F.array(*PAIR)).alias(source)).distinct()
    medians = cut_lineage(median_by(rows.join(sources, source, "left_semi"), [source, entity], value, "m"))
    a = medians.select(F.col(source).alias("source_a"), entity, F.col("m").alias("value_a"))
    b = medians.select(F.col(source).alias("source_b"), entity, F.col("m").alias("value_b"))
    if collection and _meetings(named, medians, source, entity, collection):
        members = [named.select(x, collection).distinct() for x in PAIR]
        met = a.join(members[0], "source_a").join(b.join(members[1], "source_b"), [collection, entity]).where("source_a < source_b")
        out = named.join(met, [*PAIR, collection]).drop(collection)
    else:
        out = named.select(*PAIR).join(a, "source_a").join(b, ["source_b", entity])
    if group:
        groups = rows.where(clean_text(group).isNotNull()).groupBy(entity).agg(F.min(group).alias("group"))
        out = out.join(groups, entity, "left")
    return out.withColumn("delta", F.col("value_b") - F.col("value_a"))


def _meetings(named: DataFrame, medians: DataFrame, source: str, entity: str, collection: str) -> bool:
    """Whether fewer rows meet on collection and entity than pairs have entities of A."""
    sizes = medians.groupBy(F.col(source).alias("source_a")).agg(F.count(F.lit(1)).alias("n"))
    walked = named.join(sizes, "source_a").agg(F.sum("n")).first()[0] or 0
    members = named.select(collection, F.explode(F.array(*PAIR)).alias(source)).distinct()
    crowds = medians.join(members, source).groupBy(collection, entity).agg(F.count(F.lit(1)).cast("double").alias("n"))
    met = crowds.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    return met < walked


def paired_summary(deltas: DataFrame, keys: Sequence[str] = PAIR, delta: str = "delta") -> DataFrame:
    """n, mean, median, sd, sign consistency, dominant direction, share of large differences.

    A zero difference counts as not positive; an even split points to B.
    """
    d = F.col(delta)
    positive = F.avg((d > 0).cast("double"))
    facts = deltas.groupBy(*keys).agg(
        F.count(d).alias("n_entities"),
        F.avg(d).alias("delta_mean"),
        F.stddev_samp(d).alias("delta_sd"),
        F.greatest(positive, 1 - positive).alias("sign_consistency"),
        F.when(positive >= 0.5, "B_higher").otherwise("A_higher").alias("dominant_direction"),
        F.avg((F.abs(d) > 0.5).cast("double")).alias("share_abs_gt_05"),
    )
    return facts.join(percentiles(deltas, delta, keys, {"delta_median": 0.5}), list(keys), "left")


def cluster_medians(deltas: DataFrame, keys: Sequence[str] = PAIR, group: str = "group", delta: str = "delta") -> DataFrame:
    """One median per pair and group; rows without a group take no part."""
    return percentiles(deltas.where(F.col(group).isNotNull()), delta, [*keys, group], {"group_median": 0.5})


def cluster_summary(medians: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    v = F.col("group_median")
    facts = medians.groupBy(*keys).agg(
        F.count(v).alias("n_groups"), F.avg(v).alias("group_mean"), F.stddev_samp(v).alias("group_sd")
    )
    return facts.join(percentiles(medians, "group_median", keys, {"group_median_median": 0.5}), list(keys), "left")


def t_interval(n: Column, mean: Column, sd: Column) -> tuple[Column, Column]:
    """95 % interval of a mean; needs more than two units."""
    half = t_half_width_factor(F.when(n > 2, n - 1).cast("double")) * sd / F.sqrt(n.cast("double"))
    return mean - half, mean + half


def signed_rank(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Signed-rank statistic: zeros dropped, ties share ranks, tie term collected.

    |Δ| is ranked on distinct values that carry their number of positive signs, so no rank
    has to be joined back to rows.
    """
    zero = df.where(F.col(delta).isNotNull()).groupBy(*keys).agg(F.count_if(F.col(delta) == 0).alias("n_zero"))
    moved = df.where(F.col(delta) != 0).withColumn("__abs", F.abs(delta))
    ranked = value_ranks(moved, "__abs", keys, extra={"n_pos": F.count_if(F.col(delta) > 0)})
    n = F.col("n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("n_pos") * F.col("avg_rank")).alias("w_plus"),
        F.sum("n").alias("n_nonzero"),
        F.sum(n * n * n - n).alias("tie_term"),
    )
    joined = zero.join(sums, list(keys), "left")
    return joined.withColumn("p_value", signed_rank_p_value("w_plus", "n_nonzero", "tie_term", "n_zero"))


_DRAW_CHUNK = 10_000


def _count_pairs(spots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if k > 2_000_000_000:
        return np.unique(spots, axis=0, return_counts=True)
    codes, times = np.unique(spots[:, 0] * k + spots[:, 1], return_counts=True)
    return np.column_stack([codes // k, codes % k]), times


def bootstrap_median(
    units: DataFrame, keys: Sequence[str], value: str, replicates: int = 10_000, seed: int = 42, minimum: int = 3
) -> DataFrame:
    """Percentile interval of the median of resampled units, per key.

    The median of ``k`` draws with replacement is the unit at a random *position*: the
    middle order statistic of ``k`` uniforms, which follows a Beta law. One Beta draw per
    replicate therefore replaces a resample of ``k`` units, whatever ``k`` is. Positions are
    then read off the ranked units between the lowest and highest position drawn.
    """
    keys = list(keys)
    ranked = value_ranks(units, value, keys).select(*keys, value, "n", "n_before", "n_total")
    sizes = ranked.groupBy(*keys).agg(F.max("n_total").alias("__units"))
    chunks = -(-replicates // _DRAW_CHUNK)
    plan = sizes.where(F.col("__units") >= minimum).select(
        *keys, "__units", F.abs(F.xxhash64(*keys)).alias("__code"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("__chunk"),
    )
    fields = [f for f in plan.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("times", T.LongType())])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                k, chunk = int(row[-3]), int(row[-1])
                size = min(_DRAW_CHUNK, replicates - chunk * _DRAW_CHUNK)
                rng = np.random.default_rng([seed, int(row[-2]), chunk])
                middle = (k + 1) // 2
                first = rng.beta(middle, k - middle + 1, size)
                second = first
                if k % 2 == 0:
                    second = first + (1 - first) * (1 - rng.random(size) ** (1.0 / (k - middle)))
                spots = np.minimum(np.floor(np.column_stack([first, second]) * k), k - 1).astype("int64")
                spots, times = _count_pairs(spots, k)
                out = pd.DataFrame({"lo": spots[:, 0], "hi": spots[:, 1], "times": times})
                for i, name in enumerate(keys):
                    out.insert(i, name, row[i])
                yield out

    # A row of the plan is little data but much drawing: one task per core, not one per megabyte.
    tasks = units.sparkSession.sparkContext.defaultParallelism
    draws = plan.repartition(tasks, *keys, "__chunk").mapInPandas(draw, schema)
    if chunks > 1:
        draws = draws.groupBy(*keys, "lo", "hi").agg(F.sum("times").alias("times"))
    draws = cut_lineage(draws)
    reach = draws.groupBy(*keys).agg(F.min("lo").alias("__from"), F.max("hi").alias("__to")).join(sizes, keys)
    near = hot_key_lookup(ranked, reach, keys)
    start, stop = F.greatest("n_before", "__from"), F.least(F.col("n_before") + F.col("n") - 1, F.col("__to"))
    spots = near.where(start <= stop).select(*keys, F.explode(F.sequence(start, stop)).alias("pos"), F.col(value).cast("double").alias("v"))
    low = spots.select(*keys, F.col("pos").alias("lo"), F.col("v").alias("v_lo"))
    high = spots.select(*keys, F.col("pos").alias("hi"), F.col("v").alias("v_hi"))
    medians = draws.join(low, [*keys, "lo"]).join(high, [*keys, "hi"])
    ends = medians.groupBy(*keys).agg(
        F.percentile((F.col("v_lo") + F.col("v_hi")) / 2, F.array(F.lit(PERCENT_LOW), F.lit(PERCENT_HIGH)), F.col("times")).alias("q"),
        F.sum("times").alias("n_replicates"),
    )
    out = sizes.join(ends, keys, "left")
    return out.select(
        *keys, F.col("__units").alias("n_units"), F.col("n_replicates"), F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"),
        F.when(F.col("__units") >= minimum, "bootstrap").otherwise("insufficient").alias("method"),
    )


def name_contrasts(pairs: DataFrame, fields: Sequence[str], extra_fields: Sequence[str]) -> DataFrame:
    """Which field differs, its two values, and how far the wording may go."""
    def pick(side: str) -> Column:
        out = F.lit(None).cast("string")
        for f in [*fields, *extra_fields]:
            out = F.when(F.col("differing_field") == f, F.col(f"{side}.{f}").cast("string")).otherwise(out)
        return out

    field = F.when(F.size("diff") == 1, F.get("diff", F.lit(0))).otherwise(F.get("extra_diff", F.lit(0)))
    note = F.when(F.size("diff") == 1, F.lit("one_difference_among_extracted_fields__others_unverified")).otherwise(
        F.concat(F.col("differing_field"), F.lit("_differs__other_fields_unverified"))
    )
    named = pairs.withColumn("differing_field", field)
    return named.select("*", pick("a").alias("value_a"), pick("b").alias("value_b"), note.alias("confidence"))


def paired_contrasts(
    records: DataFrame,
    sources: DataFrame,
    source: str,
    collection: str,
    entity: str,
    value: str,
    group: str,
    fields: Sequence[str],
    extra_fields: Sequence[str] = (),
    min_shared: int = 20,
    replicates: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """All contrasts of one collection: matched pairs, differences, row- and group-level statistics."""
    usable = records.where(F.col(value).isNotNull())
    pairs = cut_lineage(near_signature_pairs(usable, sources, source, collection, entity, fields, extra_fields, min_shared))
    deltas = cut_lineage(pair_deltas(pairs, usable, source, entity, value, group, collection))
    medians = cut_lineage(cluster_medians(deltas))
    named = name_contrasts(pairs, fields, extra_fields).select(
        *PAIR, collection, "differing_field", "value_a", "value_b", "confidence"
    )
    out = named.join(paired_summary(deltas), PAIR).join(cluster_summary(medians), PAIR, "left")
    for name, rows, col, n, mean, sd in (
        ("entity", deltas, "delta", "n_entities", "delta_mean", "delta_sd"),
        ("group", medians, "group_median", "n_groups", "group_mean", "group_sd"),
    ):
        low, high = t_interval(F.col(n), F.col(mean), F.col(sd))
        out = out.withColumn(f"mean_low_{name}", low).withColumn(f"mean_high_{name}", high)
        test = signed_rank(rows, PAIR, col).select(*PAIR, F.col("p_value").alias(f"signed_rank_p_{name}"))
        ends = bootstrap_median(rows, PAIR, col, replicates, seed).select(
            *PAIR, F.col("ci_low").alias(f"median_low_{name}"), F.col("ci_high").alias(f"median_high_{name}"),
            F.col("method").alias(f"ci_method_{name}"),
        )
        out = out.join(test, PAIR, "left").join(ends, PAIR, "left")
        out = out.withColumn(f"signed_rank_p_{name}", F.when(F.col(n) > 2, F.col(f"signed_rank_p_{name}")))
    rho = spearman(deltas, PAIR, "value_a", "value_b", "rank_correlation").drop("n")
    return out.join(rho, PAIR, "left")
