"""Joins with stated contracts."""

from pyspark.sql import functions as F

from ...operators import joins as j
from ...operators.aggregate import median_by
from ...operators.contrasts import PAIR
from ..registry import MEASUREMENTS, query, rounded


@query("j01_one_to_one_left", """
    WITH c AS (SELECT c_nationkey AS n, count(*) AS n_customers FROM customer GROUP BY 1)
    SELECT n_nationkey AS n, n_name, n_customers FROM nation LEFT JOIN c ON n_nationkey = n""")
def one_to_one_left(t):
    per = t.customer.groupBy(F.col("c_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("n_customers"))
    return j.one_to_one_left(t.nation.select(F.col("n_nationkey").alias("n"), "n_name"), per, ["n"])


@query("j02_left_join_zero", """
    WITH o AS (SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_closed
               FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_closed, 0) AS n_closed FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def left_join_zero(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_closed")
    )
    return j.left_join_zero(t.customer.select("c_custkey"), per, ["c_custkey"], ["n_orders", "n_closed"])


OLD_NEW_SQL = """old AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    new AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""


def old_new(t):
    rows = t.lineitem
    return [
        rows.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        for f in ("A", "R")
    ]


@query("j03_outer_with_indicator", f"""WITH {OLD_NEW_SQL}
    SELECT coalesce(old.k, new.k) AS k, old.n AS n_old, new.n AS n_new,
           CASE WHEN old.k IS NULL THEN 'right_only' WHEN new.k IS NULL THEN 'left_only' ELSE 'both' END AS side
    FROM old FULL OUTER JOIN new ON old.k = new.k""")
def outer_with_indicator(t):
    old, new = old_new(t)
    return j.outer_with_indicator(old, new, ["k"], ("_old", "_new"))


@query("j04_semi_anti", f"""WITH {OLD_NEW_SQL}
    SELECT 'overlap' AS part, count(*) AS n FROM new WHERE k IN (SELECT k FROM old) UNION ALL
    SELECT 'new', count(*) FROM new WHERE k NOT IN (SELECT k FROM old) UNION ALL
    SELECT 'removed', count(*) FROM old WHERE k NOT IN (SELECT k FROM new)""")
def semi_anti(t):
    old, new = old_new(t)
    parts = {"overlap": j.within(new, old, ["k"]), "new": j.without(new, old, ["k"]), "removed": j.without(old, new, ["k"])}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("j05_shared_keys", """
    WITH a AS (SELECT l_partkey AS k, median(log10(l_extendedprice / l_quantity)) AS m_a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
         b AS (SELECT l_partkey AS k, median(log10(l_extendedprice / l_quantity)) AS m_b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT a.k AS k, round(m_a, 6) AS m_a, round(m_b, 6) AS m_b FROM a JOIN b ON a.k = b.k""")
def shared_keys(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("k"), "l_returnflag", F.log10(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    a = median_by(rows.where("l_returnflag = 'A'"), ["k"], "v", "m_a")
    b = median_by(rows.where("l_returnflag = 'R'"), ["k"], "v", "m_b")
    return rounded(j.shared_keys(a, b, ["k"]), "m_a", "m_b")


# Sources described by three derived fields and one time-like field.
FIELDS, TIMES = ["sign", "level", "parity"], ["stage"]
DESCRIBED_SQL = """src AS (SELECT s_suppkey AS source, s_nationkey AS collection,
    CASE WHEN s_acctbal < 0 THEN 'neg' END AS sign, CAST(floor(s_acctbal / 4000) AS INTEGER) AS level,
    CAST(floor(abs(s_acctbal)) AS BIGINT) % 2 AS parity, CAST(floor(abs(s_acctbal)) AS BIGINT) % 3 AS stage FROM supplier)"""


def described_sources(t):
    whole = F.floor(F.abs("s_acctbal"))
    return t.supplier.select(
        F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("collection"),
        F.when(F.col("s_acctbal") < 0, "neg").alias("sign"), F.floor(F.col("s_acctbal") / 4000).cast("int").alias("level"),
        (whole % 2).alias("parity"), (whole % 3).alias("stage"),
    )


PAIRS_SQL = f"""{DESCRIBED_SQL}, {MEASUREMENTS}, se AS (SELECT DISTINCT source, entity FROM m),
  c AS (SELECT a.source AS source_a, b.source AS source_b, a.collection AS collection,
      CAST(a.sign IS DISTINCT FROM b.sign AS INTEGER) + CAST(a.level IS DISTINCT FROM b.level AS INTEGER) + CAST(a.parity IS DISTINCT FROM b.parity AS INTEGER) AS n_diff,
      CASE WHEN a.sign IS DISTINCT FROM b.sign THEN 'sign' WHEN a.level IS DISTINCT FROM b.level THEN 'level'
           WHEN a.parity IS DISTINCT FROM b.parity THEN 'parity' WHEN a.stage IS DISTINCT FROM b.stage THEN 'stage' END AS field
    FROM src a JOIN src b ON a.collection = b.collection AND a.source < b.source),
  p AS (SELECT c.source_a, c.source_b, c.collection, c.field, count(*) AS n_shared
    FROM c JOIN se x ON x.source = c.source_a JOIN se y ON y.source = c.source_b AND y.entity = x.entity
    WHERE c.n_diff <= 1 AND c.field IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)"""


def near_pairs(t):
    return j.near_signature_pairs(
        t.lineitem.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("entity")), described_sources(t), "source", "collection", "entity", FIELDS, TIMES, 20
    )


@query("j06_constrained_self_join", f"WITH {PAIRS_SQL} SELECT source_a, source_b, collection, n_shared FROM p")
def constrained_self_join(t):
    return near_pairs(t).select(*PAIR, "collection", "n_shared")


@query("j07_preserve_annotations", """
    WITH prior AS (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'reviewed' END AS review_status,
                          'checked ' || s_name AS manual_notes FROM supplier WHERE s_acctbal > 0)
    SELECT s.s_suppkey, s.s_name, coalesce(p.review_status, 'unreviewed') AS review_status, coalesce(p.manual_notes, '') AS manual_notes,
           '' AS manual_exclusion_reason FROM supplier s LEFT JOIN prior p ON s.s_suppkey = p.s_suppkey""")
def preserve_annotations(t):
    prior = t.supplier.where("s_acctbal > 0").select(
        "s_suppkey", F.when(F.col("s_acctbal") > 5000, "reviewed").alias("review_status"),
        F.concat(F.lit("checked "), "s_name").alias("manual_notes"),
    )
    current = t.supplier.select("s_suppkey", "s_name", F.lit("stale").alias("review_status"))
    defaults = {"review_status": "unreviewed", "manual_notes": "", "manual_exclusion_reason": ""}
    return j.preserve_annotations(current, prior, "s_suppkey", defaults)


@query("j08_dictionary_lookup", """
    SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 9 END AS position FROM customer""")
def dictionary_lookup(t):
    order = t.spark.createDataFrame([("AUTOMOBILE", 0), ("BUILDING", 1), ("MACHINERY", 2)], "c_mktsegment string, position int")
    return j.dictionary_lookup(t.customer, order, "c_mktsegment", "position", 9).select("c_custkey", "position")


@query("j09_alignment_check", """
    WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders),
         b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 0.01 ELSE o_totalprice END AS v,
                      CASE WHEN o_orderpriority = '2-HIGH' THEN lower(o_orderstatus) ELSE o_orderstatus END AS s FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT count(b.k) AS n_both, count(*) - count(b.k) AS n_left_only, 0 AS n_right_only,
           count(*) FILTER (WHERE abs(a.v - b.v) > 1e-9) AS v_mismatch, count(*) FILTER (WHERE a.s <> b.s) AS s_mismatch
    FROM a LEFT JOIN b ON a.k = b.k""")
def alignment_check(t):
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    prio = F.col("o_orderpriority")
    b = t.orders.where(prio != "5-LOW").select(
        F.col("o_orderkey").alias("k"),
        F.when(prio == "1-URGENT", F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")).alias("v"),
        F.when(prio == "2-HIGH", F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("s"),
    )
    return j.alignment_report(a, b, "k", ["v"], ["s"])


@query("j10_star_join", """
    SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total, count_if(c_nationkey = s_nationkey) AS n_same_nation
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def star_join(t):
    """Two routes from a line to a nation, by customer and by supplier, and how often they agree."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = t.orders.select("o_orderkey", "o_custkey")
    customer = t.customer.select("c_custkey", "c_nationkey")
    out = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    out = j.star_join(
        out, (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey"), (t.supplier, "l_suppkey", "s_suppkey")
    )
    return out.groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.count_if(F.col("c_nationkey") == F.col("s_nationkey")).alias("n_same_nation"),
    )


@query("j11_explode_list", """
    SELECT c_custkey, count(DISTINCT o_orderpriority) AS n_listed, count(DISTINCT l_returnflag) AS n_flags
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def explode_list(t):
    """A ``;``-joined list of order keys per customer is taken apart again and joined."""
    from ...operators.aggregate import join_unique

    listed = join_unique(t.orders.select("o_custkey", F.col("o_orderkey").cast("string").alias("k")), ["o_custkey"], {"keys": "k"})
    items = j.explode_list(listed, "keys", "key").select(F.col("o_custkey").alias("c_custkey"), F.col("key").cast("long").alias("l_orderkey"))
    facts = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return items.join(facts, "l_orderkey").join(t.lineitem.select("l_orderkey", "l_returnflag"), "l_orderkey").groupBy("c_custkey").agg(
        F.countDistinct("o_orderpriority").alias("n_listed"), F.countDistinct("l_returnflag").alias("n_flags")
    )


@query("j12_job_plan", """
    WITH combos AS (SELECT r.r AS representation, a.a AS algorithm FROM (SELECT DISTINCT lang AS r FROM documents) r CROSS JOIN (VALUES ('forest'), ('boosted')) AS a(a)
                    UNION ALL SELECT '__baseline__', 'mean')
    SELECT representation, algorithm, CAST(p.p AS INTEGER) AS "partition", CAST(f.f AS INTEGER) AS fold FROM combos CROSS JOIN range(3) AS p(p) CROSS JOIN range(5) AS f(f)""")
def job_plan(t):
    names = [r["lang"] for r in t.documents.select("lang").distinct().orderBy("lang").collect()]
    return j.job_plan(t.spark, names, ["forest", "boosted"], 3, 5)


@query("j13_distinct_over_members", f"""WITH {MEASUREMENTS}
    SELECT collection, count(DISTINCT entity) AS n_entities FROM m GROUP BY 1""")
def distinct_over_members(t):
    m = t.measurements()
    members = t.supplier.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("collection"))
    return j.distinct_over_members(m.select("source", "entity"), members, "source", "collection", "entity", "n_entities")
