"""Two releases of a keyed table, cut from the order lines by ship year."""

from pyspark.sql import functions as F

from ...operators import delta as d
from ...operators.aggregate import median_by
from ..registry import query, rounded
from .cleaning import largest_sql, normal_sql

# A release: per (part, supplier) the median price and the number of lines shipped up to a year.
COLUMNS = ["value_median", "n_measurements", "year_max"]
RELEASE_SQL = """r AS (SELECT l_partkey * 100000 + l_suppkey AS k, log10(l_extendedprice) AS v, CAST(year(l_shipdate) AS INTEGER) AS y, l_quantity AS q FROM lineitem),
  o AS (SELECT k, median(v) AS value_median, count(*) AS n_measurements, max(y) AS year_max FROM r WHERE y <= 1998 GROUP BY 1),
  n AS (SELECT k, median(v) AS value_median, count(*) AS n_measurements, max(y) AS year_max FROM r WHERE y <= 1999 AND q > 2 GROUP BY 1)"""
CHANGED = "NOT (o.{0} IS NOT DISTINCT FROM n.{0} OR coalesce(abs(o.{0} - n.{0}) <= 1e-10, false))"
VALUES_SQL = RELEASE_SQL + """, v AS (SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'right_only' WHEN n.k IS NULL THEN 'left_only' ELSE 'both' END AS side,
    """ + ", ".join(f"o.{c} AS {c}_old, n.{c} AS {c}_new, {CHANGED.format(c)} AS {c}_changed" for c in COLUMNS) + """
  FROM o FULL OUTER JOIN n ON o.k = n.k)"""
ANY = " OR ".join(f"{c}_changed" for c in COLUMNS)


def releases(t):
    rows = t.lineitem.select(
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("k"), F.log10("l_extendedprice").alias("v"),
        F.year("l_shipdate").alias("y"), "l_quantity",
    )

    def table(df):
        facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n_measurements"), F.max("y").alias("year_max"))
        return facts.join(median_by(df, ["k"], "v", "value_median"), "k")

    return table(rows.where("y <= 1998")), table(rows.where("y <= 1999 AND l_quantity > 2"))


@query("d01_delta_keys", f"""WITH {RELEASE_SQL} SELECT (SELECT count(*) FROM o) AS n_old, (SELECT count(*) FROM n) AS n_new_release,
    (SELECT count(*) FROM o JOIN n ON o.k = n.k) AS n_overlap, (SELECT count(*) FROM n WHERE k NOT IN (SELECT k FROM o)) AS n_new,
    (SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM n)) AS n_removed""")
def delta_keys(t):
    rows = t.lineitem.select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("k"), F.year("l_shipdate").alias("y"), "l_quantity")
    return d.delta_counts(rows.where("y <= 1998"), rows.where("y <= 1999 AND l_quantity > 2"), "k")


@query("d02_delta_values", f"""WITH {VALUES_SQL} SELECT k, side, {", ".join(f"{c}_changed" for c in COLUMNS)}, {ANY} AS any_change,
    round(value_median_old, 6) AS value_median_old, round(value_median_new, 6) AS value_median_new FROM v WHERE side = 'both' AND ({ANY})""")
def delta_values(t):
    old, new = releases(t)
    out = d.changed_overlap(d.delta_values(old, new, "k", COLUMNS))
    return rounded(out, "value_median_old", "value_median_new").select(
        "k", "side", *[f"{c}_changed" for c in COLUMNS], "any_change", "value_median_old", "value_median_new"
    )


@query("d03_delta_report", f"""WITH {VALUES_SQL}, b AS (SELECT *, {ANY} AS any_change, value_median_new - value_median_old AS d FROM v WHERE side = 'both')
    SELECT {", ".join(f"count_if({c}_changed) AS {c}_changed" for c in COLUMNS)}, count_if(any_change) AS any_change,
      count_if(n_measurements_new > n_measurements_old) AS increased, count_if(n_measurements_new < n_measurements_old) AS decreased,
      count_if(n_measurements_new = n_measurements_old) AS unchanged, count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd,
      round(min(d), 6) AS min, round(max(d), 6) AS max, count_if(abs(d) > 0.01) AS n_abs_gt_001, count_if(abs(d) > 0.10) AS n_abs_gt_010,
      count_if(abs(d) > 0.50) AS n_abs_gt_050, round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.75), 6) AS p75 FROM b""")
def delta_report(t):
    old, new = releases(t)
    out = d.delta_report(d.delta_values(old, new, "k", COLUMNS), COLUMNS, "n_measurements", "value_median")
    return rounded(out, "mean", "sd", "min", "max", "p25", "p50", "p75")


@query("d04_recent_records", """
    SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority FROM orders WHERE year(o_orderdate) >= 2001""")
def recent_records(t):
    rows = t.orders.withColumn("y", F.year("o_orderdate"))
    return d.recent_records(rows, "y", 2001, ["o_custkey", "y", "o_orderpriority"], ["y", "o_custkey", "o_orderpriority"])


@query("d05_verdict", f"""WITH {VALUES_SQL}, c AS (SELECT count_if(side = 'right_only') AS n_new, count_if(side = 'left_only') AS n_removed, count_if(side = 'both' AND ({ANY})) AS n_changed FROM v)
    SELECT *, CASE WHEN n_new > 0 THEN 'new_entities' WHEN n_changed > 0 THEN 'changed_values' ELSE 'identical' END AS verdict,
    CASE WHEN n_new >= 100 THEN 'sufficient' WHEN n_new >= 40 THEN 'marginal' WHEN n_new > 0 THEN 'too_few' ELSE 'none' END AS holdout FROM c""")
def verdict(t):
    old, new = releases(t)
    return d.verdict(old, new, "k", COLUMNS)


def _key(text: str) -> str:
    part = largest_sql(text)
    return f"CASE WHEN {normal_sql(part)} <> '' THEN sha256({normal_sql(part)}) END"


NEG_SQL = f"""d AS (SELECT doc_id, lang, {_key('text')} AS entity_key FROM documents),
    b AS (SELECT DISTINCT {_key('text')} AS entity_key FROM benchmark), c AS (SELECT DISTINCT {_key('text')} AS entity_key FROM conversations)"""


@query("d06_negatives_report", f"""WITH {NEG_SQL}, k AS (SELECT *, entity_key IN (SELECT entity_key FROM b WHERE entity_key IS NOT NULL) AS hb,
      entity_key IN (SELECT entity_key FROM c WHERE entity_key IS NOT NULL) AS hc FROM d)
    SELECT count(*) AS n_input, count_if(entity_key IS NULL) AS n_failed, count_if(hb) AS n_collisions_1, count_if(NOT hb AND hc) AS n_collisions_2,
      count_if(entity_key IS NOT NULL AND NOT hb AND NOT hc) - count(DISTINCT CASE WHEN NOT hb AND NOT hc THEN entity_key END) AS n_duplicates,
      count(DISTINCT CASE WHEN NOT hb AND NOT hc THEN entity_key END) AS n_clean,
      count(*) / count(DISTINCT CASE WHEN NOT hb AND NOT hc THEN entity_key END) AS ratio FROM k""")
def negatives_report(t):
    return d.negatives_report(t.texts(), "text", [(t.benchmark, "text"), (t.texts("conversations", "conv_id"), "text")])


@query("d06_clean_negatives", f"""WITH {NEG_SQL} SELECT min(doc_id) AS doc_id, entity_key FROM d WHERE entity_key IS NOT NULL
    AND entity_key NOT IN (SELECT entity_key FROM b WHERE entity_key IS NOT NULL) AND entity_key NOT IN (SELECT entity_key FROM c WHERE entity_key IS NOT NULL) GROUP BY 2""")
def clean_negatives(t):
    out = d.clean_negatives(t.texts().select("doc_id", "text"), "text", [(t.benchmark, "text"), (t.texts("conversations", "conv_id"), "text")], ["doc_id"])
    return out.select("doc_id", "entity_key")
