"""Paired contrasts: suppliers of one nation that share parts."""

from pyspark.sql import functions as F

from ...operators import contrasts as c
from ...operators.aggregate import median_range
from ...operators.metrics import spearman
from ...session import cut_lineage
from ..registry import MEASUREMENTS, query, rounded
from .joins import FIELDS, PAIRS_SQL, TIMES, described_sources, near_pairs

DELTA_SQL = f"""{PAIRS_SQL}, md AS (SELECT source, entity, median(value) AS v, min("group") AS g FROM m GROUP BY 1, 2),
  dl AS (SELECT p.source_a, p.source_b, p.collection, p.field, x.entity AS entity, x.g AS g, x.v AS va, y.v AS vb, y.v - x.v AS d
         FROM p JOIN md x ON x.source = p.source_a JOIN md y ON y.source = p.source_b AND y.entity = x.entity)"""
SUMMARY = """count(d) AS n_entities, round(avg(d), 6) AS delta_mean, round(stddev_samp(d), 6) AS delta_sd,
  round(greatest(avg(CAST(d > 0 AS DOUBLE)), 1 - avg(CAST(d > 0 AS DOUBLE))), 6) AS sign_consistency,
  CASE WHEN avg(CAST(d > 0 AS DOUBLE)) >= 0.5 THEN 'B_higher' ELSE 'A_higher' END AS dominant_direction,
  round(avg(CAST(abs(d) > 0.5 AS DOUBLE)), 6) AS share_abs_gt_05, round(median(d), 6) AS delta_median"""


def deltas(t):
    return cut_lineage(c.pair_deltas(near_pairs(t), t.measurements(), "source", "entity", "value", "group", "collection"))


@query("c01_paired_contrasts", f"""WITH {DELTA_SQL}, gm AS (SELECT source_a, source_b, g, median(d) AS md FROM dl GROUP BY 1, 2, 3),
    gs AS (SELECT source_a, source_b, count(*) AS n_groups, round(avg(md), 6) AS group_mean, round(median(md), 6) AS group_median_median FROM gm GROUP BY 1, 2)
    SELECT dl.source_a AS source_a, dl.source_b AS source_b, dl.collection AS collection, field AS differing_field,
      CASE WHEN field = 'stage' THEN 'stage_differs__other_fields_unverified' ELSE 'one_difference_among_extracted_fields__others_unverified' END AS confidence,
      {SUMMARY}, any_value(n_groups) AS n_groups, any_value(group_mean) AS group_mean, any_value(group_median_median) AS group_median_median
    FROM dl JOIN gs ON dl.source_a = gs.source_a AND dl.source_b = gs.source_b GROUP BY 1, 2, 3, 4""")
def paired_contrasts(t):
    """The whole analysis with 10,000 replicates; the columns that do not depend on draws."""
    out = c.paired_contrasts(
        t.measurements(), described_sources(t), "source", "collection", "entity", "value", "group", FIELDS, TIMES, 20
    )
    keep = ["source_a", "source_b", "collection", "differing_field", "confidence", "n_entities", "delta_mean", "delta_sd", "sign_consistency",
            "dominant_direction", "share_abs_gt_05", "delta_median", "n_groups", "group_mean", "group_median_median"]
    return rounded(out.select(*keep), "delta_mean", "delta_sd", "sign_consistency", "share_abs_gt_05", "delta_median", "group_mean", "group_median_median")


@query("c02_paired_summary", f"WITH {DELTA_SQL} SELECT source_a, source_b, {SUMMARY} FROM dl GROUP BY 1, 2")
def paired_summary(t):
    return rounded(c.paired_summary(deltas(t)), "delta_mean", "delta_sd", "sign_consistency", "share_abs_gt_05", "delta_median")


@query("c03_cluster_summary", f"""WITH {DELTA_SQL}, gm AS (SELECT source_a, source_b, g, median(d) AS md FROM dl GROUP BY 1, 2, 3)
    SELECT source_a, source_b, count(md) AS n_groups, round(avg(md), 6) AS group_mean, round(stddev_samp(md), 6) AS group_sd, round(median(md), 6) AS group_median_median FROM gm GROUP BY 1, 2""")
def cluster_summary(t):
    return rounded(c.cluster_summary(c.cluster_medians(deltas(t))), "group_mean", "group_sd", "group_median_median")


# Statistics over groups of order lines: two return flags per brand and month, paired by part.
FLAG_SQL = """fl AS (SELECT p_brand AS brand, l_partkey AS entity, p_type AS kind, median(CASE WHEN l_returnflag = 'A' THEN log10(l_extendedprice / l_quantity) END) AS va,
    median(CASE WHEN l_returnflag = 'R' THEN log10(l_extendedprice / l_quantity) END) AS vb FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
  fd AS (SELECT *, vb - va AS d FROM fl WHERE va IS NOT NULL AND vb IS NOT NULL)"""


def flag_deltas(t):
    """Per part: median log unit price of returned against accepted lines, by brand."""
    from ...operators.aggregate import median_by

    rows = t.lineitem.where("l_returnflag IN ('A', 'R')").select(
        F.col("l_partkey").alias("entity"), "l_returnflag", F.log10(F.col("l_extendedprice") / F.col("l_quantity")).alias("v")
    )
    med = median_by(rows, ["entity", "l_returnflag"], "v", "m")
    a = med.where("l_returnflag = 'A'").select("entity", F.col("m").alias("va"))
    b = med.where("l_returnflag = 'R'").select("entity", F.col("m").alias("vb"))
    parts = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    return a.join(b, "entity").join(parts, "entity").withColumn("d", F.col("vb") - F.col("va"))


@query("c04_t_interval", f"""WITH {FLAG_SQL}, s AS (SELECT brand, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM fd GROUP BY 1)
    SELECT brand, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM s""")
def t_interval_inputs(t):
    s = flag_deltas(t).groupBy("brand").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return rounded(s, "mean", "sd")


# The t quantile by its series in 1/df around the normal one, good to 1e-7 from 40 degrees on.
Z = 1.959963984540054
T_SQL = " + ".join([
    str(Z), f"({(Z**3 + Z) / 4}) / v", f"({(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96}) / v ** 2", f"({(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384}) / v ** 3",
    f"({(79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160}) / v ** 4",
])


@query("c04_t_interval_rows", f"""WITH {FLAG_SQL}, s AS (SELECT brand, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd, (count(d) - 1)::DOUBLE AS v FROM fd GROUP BY 1)
    SELECT brand, n, round(mean, 6) AS mean, round(mean - ({T_SQL}) * sd / sqrt(n), 5) AS ci_low, round(mean + ({T_SQL}) * sd / sqrt(n), 5) AS ci_high FROM s""")
def t_interval_rows(t):
    s = flag_deltas(t).groupBy("brand").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    low, high = c.t_interval(F.col("n"), F.col("mean"), F.col("sd"))
    return rounded(rounded(s.select("brand", "n", "mean", low.alias("ci_low"), high.alias("ci_high")), "ci_low", "ci_high", digits=5), "mean")


@query("c05_signed_rank", f"""WITH {FLAG_SQL}, r AS (SELECT brand, d, rank() OVER (PARTITION BY brand ORDER BY abs(d)) + (count(*) OVER (PARTITION BY brand, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM fd WHERE d <> 0)
    SELECT brand, count(*) AS n_nonzero, CAST(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS DOUBLE) AS w_plus FROM r GROUP BY 1""")
def signed_rank(t):
    return c.signed_rank(flag_deltas(t), ["brand"], "d").select("brand", "n_nonzero", "w_plus")


# Two-sided p by the normal law with its tie term; the density is summed by Simpson's rule.
@query("c05_signed_rank_p", f"""WITH {FLAG_SQL}, r AS (SELECT brand, d, rank() OVER (PARTITION BY brand ORDER BY abs(d)) + (count(*) OVER (PARTITION BY brand, abs(d)) - 1) / 2.0::DOUBLE AS rk,
      count(*) OVER (PARTITION BY brand, abs(d)) AS ties FROM fd WHERE d <> 0),
    w AS (SELECT brand, count(*) AS n_nonzero, CAST(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS DOUBLE) AS w_plus, sum(ties * ties - 1)::DOUBLE AS tie_term FROM r GROUP BY 1),
    z AS (SELECT *, abs(w_plus - n_nonzero * (n_nonzero + 1) / 4.0::DOUBLE) / sqrt((n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) - tie_term / 2) / 24) AS z FROM w)
    SELECT brand, n_nonzero, w_plus, tie_term, (SELECT count(*) FROM fd WHERE fd.brand = z.brand AND d = 0) AS n_zero,
      round(1 - z / 3000 * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * i / 1000) * (z * i / 1000) / 2))) * sqrt(2 / pi()), 6) AS p_value FROM z""")
def signed_rank_p(t):
    out = c.signed_rank(flag_deltas(t), ["brand"], "d").withColumn("tie_term", F.col("tie_term").cast("double"))
    return rounded(out.select("brand", "n_nonzero", "w_plus", "tie_term", "n_zero", "p_value"), "p_value")


def _intervals(units, value):
    """The bootstrap intervals of the brands' medians: what does not depend on draws, and whether the median lies inside."""
    from ...operators.aggregate import median_by

    found = c.bootstrap_median(units, ["brand"], value, 10_000).join(median_by(units, ["brand"], value, "m"), "brand")
    inside = (F.col("ci_low") <= F.col("m")) & (F.col("m") <= F.col("ci_high"))
    return found.select("brand", "n_units", "n_replicates", "method", inside.alias("estimate_inside"))


@query("c06_bootstrap_group_median", f"""WITH {FLAG_SQL}, gm AS (SELECT brand, kind, median(d) AS v FROM fd GROUP BY 1, 2)
    SELECT brand, count(*) AS n_units, 10000::BIGINT AS n_replicates, 'bootstrap' AS method, true AS estimate_inside FROM gm GROUP BY 1""")
def bootstrap_group_median(t):
    """Interval of the median of group medians: kinds of part as groups, per brand."""
    return _intervals(c.cluster_medians(flag_deltas(t), ["brand"], "kind", "d"), "group_median")


@query("c07_bootstrap_median", f"""WITH {FLAG_SQL}
    SELECT brand, count(*) AS n_units, 10000::BIGINT AS n_replicates, 'bootstrap' AS method, true AS estimate_inside FROM fd GROUP BY 1""")
def bootstrap_median(t):
    return _intervals(flag_deltas(t), "d")


RHO_SQL = """SELECT {k}, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (
      SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY {k} ORDER BY {y}) + (count(*) OVER (PARTITION BY {k}, {y}) - 1) / 2.0 AS ry FROM {t}) GROUP BY {k}"""


@query("c08_rank_correlation", f"WITH {FLAG_SQL} " + RHO_SQL.format(k="brand", x="va", y="vb", t="fd"))
def rank_correlation(t):
    return rounded(spearman(flag_deltas(t), ["brand"], "va", "vb"), "rho")


@query("c09_source_spread", f"""WITH {MEASUREMENTS}, s AS (SELECT source, median(value) AS m FROM m GROUP BY 1 HAVING count(value) >= 20)
    SELECT count(*) AS n_groups, round(min(m), 6) AS median_min, round(max(m), 6) AS median_max, round(max(m) - min(m), 6) AS median_range, 'not_an_effect' AS reading FROM s""")
def source_spread(t):
    out = median_range(t.measurements(), "source", "value", 20).withColumn("reading", F.lit("not_an_effect"))
    return rounded(out, "median_min", "median_max", "median_range")
