"""Sorts, ranks, running shares, samples, set operations."""

from pyspark.sql import functions as F

from ...functions.clean import triage_priority
from ...operators import ordering as o
from ...session import scratch_path
from ...sources import sinks
from ..registry import MEASUREMENTS, query, rounded
from .joins import OLD_NEW_SQL, old_new


@query("w01_custom_sort", """
    SELECT doc_id, n_chars, CASE WHEN n_chars < 200 THEN 'high' WHEN lang = 'en' THEN 'candidate_strict' ELSE 'normal' END AS priority,
           CASE WHEN n_chars < 200 THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS sort_key FROM documents ORDER BY sort_key, n_chars DESC, doc_id""")
def custom_sort(t):
    docs = t.documents.select(
        "doc_id", "n_chars", triage_priority(F.lit(False), F.col("n_chars") < 200, F.col("lang") == "en").alias("priority")
    )
    keyed = docs.withColumn("sort_key", o.order_by_map(F.col("priority"), {"high": 0, "candidate_strict": 1, "normal": 2}))
    return o.ordered(keyed, ["sort_key", F.col("n_chars").desc(), "doc_id"])


@query("w02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_k(t):
    return o.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 15)


@query("w03_keep_one", """
    SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def keep_one(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    return o.keep_one(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("w04_average_rank", """
    SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS rank FROM orders""")
def average_rank(t):
    return o.rows_with_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "rank")


@query("w04_average_rank_by_group", """
    SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rank FROM part""")
def average_rank_by_group(t):
    return o.rows_with_rank(t.part.select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", "rank")


@query("w04_percentiles", f"""WITH {MEASUREMENTS}
    SELECT source, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM m GROUP BY 1""")
def percentiles(t):
    return rounded(o.percentiles(t.measurements(), "value", ["source"], {"p05": 0.05, "p50": 0.5, "p95": 0.95}), "p05", "p50", "p95")


@query("w05_cumulative_share", """
    WITH s AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT row_number() OVER (ORDER BY n DESC) AS position, n, sum(n) OVER (ORDER BY n DESC, l_partkey ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER () AS total FROM s)
    SELECT position, n, CAST(sum(n) OVER (ORDER BY position) AS BIGINT) AS cumulative, round(sum(n) OVER (ORDER BY position) / total, 6) AS share FROM r""")
def cumulative_share(t):
    sizes = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(o.cumulative_share(sizes, "l_partkey", "n").drop("l_partkey"), "share")


@query("w06_seeded_sample", """
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 560""")
def seeded_sample(t):
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")))
    return o.seeded_sample(t.documents.select("doc_id"), t.labels, "doc_id", 560, 42, order)


@query("w07_seeded_permutation", """
    WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i FROM orders)
    SELECT count(*) AS n, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last, count(DISTINCT i) AS n_positions FROM p""")
def seeded_permutation(t):
    """Facts that hold for every permutation: each position 1..n once."""
    p = o.seeded_permutation(t.orders.select("o_orderkey"), "o_orderkey", 7)
    return p.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.countDistinct("position").alias("n_positions"))


@query("w07_seeded_permutation_rows", "SELECT o_orderkey, true AS in_range FROM orders")
def seeded_permutation_rows(t):
    rows = t.orders.select("o_orderkey")
    n = t.orders.select(F.count(F.lit(1))).scalar()
    return o.seeded_permutation(rows, "o_orderkey", 7).select("o_orderkey", F.col("position").between(1, n).alias("in_range"))


@query("u01_labelled_union", """
    SELECT o_orderkey AS k, o_totalprice AS v, 1 AS label FROM orders WHERE o_orderstatus = 'F' UNION ALL
    SELECT o_orderkey, o_totalprice, 0 FROM orders WHERE o_orderstatus <> 'F'""")
def labelled_union(t):
    def part(rows, label):
        return rows.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(label).alias("label"))

    return part(t.orders.where("o_orderstatus = 'F'"), 1).unionByName(part(t.orders.where("o_orderstatus <> 'F'"), 0))


@query("u02_key_sets", f"""WITH {OLD_NEW_SQL}
    SELECT 'new' AS part, k FROM (SELECT k FROM new EXCEPT SELECT k FROM old) UNION ALL
    SELECT 'overlap', k FROM (SELECT k FROM new INTERSECT SELECT k FROM old)""")
def key_sets(t):
    old, new = (df.select("k") for df in old_new(t))
    return new.subtract(old).withColumn("part", F.lit("new")).unionByName(new.intersect(old).withColumn("part", F.lit("overlap")))


@query("u03_append_batches", """
    SELECT o_orderstatus AS representation, 'sum' AS algorithm, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def append_batches(t):
    """Each batch is appended to one results table; readers see them as one."""
    path = scratch_path(t.spark, "results")
    for status in ("F", "O", "P"):
        rows = t.orders.where(F.col("o_orderstatus") == status)
        sinks.append_results(
            rows.select(F.col("o_orderstatus").alias("representation"), F.lit("sum").alias("algorithm"), "o_totalprice"), path
        )
    found = t.spark.read.parquet(path)
    return found.groupBy("representation", "algorithm").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("u03_committed_batches", """
    SELECT o_orderstatus AS representation, 'sum' AS algorithm, o_orderstatus || '/sum' AS batch, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1""")
def committed_batches(t):
    """Each batch is sent twice and one of the runs is lost before its record: readers see each batch once."""
    path = scratch_path(t.spark, "batches")
    for status in ("F", "O", "P"):
        rows = t.orders.where(F.col("o_orderstatus") == status)
        rows = rows.select(F.col("o_orderstatus").alias("representation"), F.lit("sum").alias("algorithm"), "o_totalprice")
        sinks.commit_batch(rows, path, f"{status}/sum")
        sinks.commit_batch(rows, path, f"{status}/sum")
        rows.write.parquet(f"{path}/data/batch={status}%2Fsum/attempt=lost")
    found = sinks.read_batches(t.spark, path, rows.schema)
    return found.groupBy("representation", "algorithm", "batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
