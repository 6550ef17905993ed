"""Roll-ups to entities, sources, signatures and whole tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...operators import aggregate as a
from ...session import cut_lineage
from ...sources.readers import property_rows
from ..registry import MEASUREMENTS, query, rounded
from .cleaning import CENSOR, CENSOR_SQL, DOC_FLAGS, FLAGS_SQL, censored, flagged_documents
from .joins import OLD_NEW_SQL, old_new
from .rules import KEYWORD_SQL, RULEBOOK, SIGNED_SQL, keyword_documents, signed_orders

STATS = ("value_min", "value_max", "value_sd", "value_median")


@query("a01_entity_aggregate", f"""WITH {MEASUREMENTS}
    SELECT entity, arg_min(flag, (year, record, line, flag)) AS flag, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max,
           round(stddev_samp(value), 6) AS value_sd, count(value) AS n_measurements, min(year) AS year_min, max(year) AS year_max,
           count(DISTINCT collection) AS n_collections, count(DISTINCT source) AS n_sources, round(median(value), 6) AS value_median
    FROM m GROUP BY 1""")
def entity_aggregate(t):
    m = t.measurements()
    out = a.entity_aggregate(m, "entity", "value", "year", "collection", "source", ["flag"], ["year", "record", "line", "flag"])
    return rounded(out, *STATS)


@query("a02_source_aggregate", f"""WITH {MEASUREMENTS}
    SELECT source, count(*) AS n_measurements, count(DISTINCT entity) AS n_entities, count(DISTINCT record) AS n_records,
           count(value) AS value_n, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(avg(value), 6) AS value_mean,
           round(stddev_samp(value), 6) AS value_sd, min(year) AS year_min, max(year) AS year_max, round(median(value), 6) AS value_median,
           string_agg(DISTINCT flag, ';' ORDER BY flag) AS flags, string_agg(DISTINCT CAST(year AS VARCHAR), ';' ORDER BY CAST(year AS VARCHAR)) AS years
    FROM m GROUP BY 1""")
def source_aggregate(t):
    out = a.source_aggregate(
        t.measurements(), "source", "entity", "value", "year", {"n_records": "record"}, {"flags": "flag"}
    )
    return rounded(out, "value_mean", *STATS)


@query("a03_join_unique", """
    SELECT lang, string_agg(DISTINCT source, ';' ORDER BY source) AS sources,
           coalesce(string_agg(DISTINCT nullif(lang, 'en'), ';'), '') AS labels FROM documents GROUP BY 1""")
def join_unique(t):
    docs = t.documents.select("lang", "source", F.when(F.col("lang") == "en", "nan").otherwise(F.col("lang")).alias("label"))
    return a.join_unique(docs, ["lang"], {"sources": "source", "labels": "label"})


@query("a04_conditional_counts", f"""WITH {CENSOR_SQL}
    SELECT user_id AS source, count(*) AS n_records, count(DISTINCT f.event_type) AS n_entities, {", ".join(f'count_if({x}) AS n_{x}' for x in
    ['exact', 'non_exact', '"interval"', 'right_censored', 'left_censored']).replace('n_"interval"', 'n_interval')}
    FROM f JOIN events ON f.event_id = events.event_id GROUP BY 1""")
def conditional_counts(t):
    return a.conditional_counts(censored(t).withColumnRenamed("user_id", "source"), "source", "event_type", CENSOR)


@query("a05_long_value_counts", f"""WITH {CENSOR_SQL}, e2 AS (SELECT event_type, coalesce(relation, '<MISSING>') AS relation FROM e)
    SELECT 'type' AS "group", event_type AS value, count(*) AS n_records FROM e2 GROUP BY 2 UNION ALL
    SELECT 'relation', relation, count(*) FROM e2 GROUP BY 2 UNION ALL
    SELECT 'flag', 'exact', count_if(exact) FROM f UNION ALL SELECT 'flag', 'right_censored', count_if(right_censored) FROM f""")
def long_value_counts(t):
    return a.long_value_counts(censored(t), {"type": "event_type", "relation": "relation"}, ["exact", "right_censored"])


@query("a06_field_coverage", """
    WITH x AS (SELECT CAST(count(*) AS BIGINT) AS n, count(doc_id) AS a, count(CASE WHEN source <> 'src1' THEN 1 END) AS b,
                      count(CASE WHEN trim(text, ' ' || chr(10) || chr(9)) <> '' THEN 1 END) AS c, count(n_chars) AS d FROM documents),
    y AS (SELECT unnest([{'field': 'doc_id', 'p': a}, {'field': 'source', 'p': b}, {'field': 'text', 'p': c}, {'field': 'n_chars', 'p': d}]) AS s, n FROM x)
    SELECT s.field AS field, s.p AS n_present, n - s.p AS n_missing, round(s.p * 100.0 / n, 3) AS coverage_percent FROM y""")
def field_coverage(t):
    docs = t.documents.select(
        "doc_id", F.when(F.col("source") == "src1", "  ").otherwise(F.col("source")).alias("source"),
        "text", "n_chars",
    )
    return a.field_coverage(docs)


@query("a07_nested_field_coverage", """
    WITH x AS (SELECT count(*) AS n, count(CASE WHEN event_type <> 'view' THEN 1 END) AS kinds FROM events WHERE event_type <> 'error'),
         y AS (SELECT count(*) AS n FROM events WHERE event_type = 'click')
    SELECT 'k' AS field, x.n + y.n AS n_present, x.n + y.n AS n_property_rows, 100.0::DOUBLE AS coverage_percent FROM x, y UNION ALL
    SELECT 'kind', x.kinds, x.n + y.n, round(x.kinds * 100.0 / (x.n + y.n), 3) FROM x, y""")
def nested_field_coverage(t):
    """Payloads as nested properties: missing for errors, one object, or (for clicks) a list of two."""
    kind = F.col("event_type")
    one = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.when(kind == "view", " ").otherwise(kind).alias("kind")))
    text = F.when(kind == "error", F.lit("")).when(kind == "click", F.concat(F.lit("["), one, F.lit(","), F.col("props"), F.lit("]"))).otherwise(one)
    items = property_rows(text, T.StructType.fromDDL("k string, kind string"))
    return a.nested_field_coverage(t.events.select(items.alias("p")), "p")


def flagged_sources(t):
    """Document sources by language with the keyword flags of all their texts, and text keys as entities."""
    docs = cut_lineage(keyword_documents(t).withColumn("src", F.concat_ws("/", "source", "lang")))
    flags = [f"flag_{x}" for x in RULEBOOK]
    sources = docs.groupBy("src").agg(
        *[F.bool_or(f).alias(f) for f in flags], F.countDistinct("matches_license").alias("n_entities"), F.count(F.lit(1)).alias("n_measurements")
    )
    return sources, docs.select("src", F.col("matches_license").alias("entity")), flags


@query("a08_flag_coverage", f"""WITH {KEYWORD_SQL}, d AS (SELECT *, source || '/' || lang AS src FROM k),
    s AS (SELECT src, count(DISTINCT matches_license) AS n_entities, count(*) AS n_measurements, {", ".join(f"bool_or(matches_{x} <> '') AS flag_{x}" for x in RULEBOOK)} FROM d GROUP BY 1),
    u AS ({" UNION ALL ".join(f"SELECT 'flag_{x}' AS category, src, n_entities, n_measurements FROM s WHERE flag_{x}" for x in RULEBOOK)})
    SELECT category, count(*) AS n_sources, CAST(sum(n_entities) AS BIGINT) AS sum_entity_counts, CAST(sum(n_measurements) AS BIGINT) AS n_measurements,
      (SELECT count(DISTINCT matches_license) FROM d WHERE src IN (SELECT src FROM u v WHERE v.category = u.category)) AS entities_union
    FROM u GROUP BY category""")
def flag_coverage(t):
    sources, records, flags = flagged_sources(t)
    return a.flag_coverage(sources, records, "src", "entity", flags, "n_entities", "n_measurements")


@query("a09_signature_families", f"""WITH {SIGNED_SQL}, c AS (SELECT o_custkey, min(sig) AS sig, max(n_known) AS n_known, count(*) AS size FROM s GROUP BY 1),
    l AS (SELECT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT sig, count(*) AS n_sources, string_agg(CAST(c.o_custkey AS VARCHAR), ';' ORDER BY c.o_custkey) AS members, CAST(sum(size) AS BIGINT) AS sum_entities,
      count(DISTINCT c_nationkey) AS n_collections, max(n_known) AS n_known_fields,
      (SELECT count(DISTINCT l_partkey) FROM l WHERE l.o_custkey IN (SELECT o_custkey FROM c d WHERE d.sig = c.sig)) AS unique_entities,
      CASE WHEN max(n_known) >= 5 THEN 'well_specified' WHEN max(n_known) >= 3 THEN 'partially_specified' ELSE 'low_information' END AS information, false AS verified
    FROM c JOIN customer ON c.o_custkey = c_custkey GROUP BY sig""")
def signature_families(t):
    """Customers as sources, described by the first signature among their orders."""
    described = signed_orders(t).groupBy("o_custkey").agg(
        F.min("sig").alias("sig"), F.max("n_known").alias("n_known"), F.count(F.lit(1)).alias("size")
    ).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    records = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    )
    out = a.signature_families(described, records, "sig", "o_custkey", "l_partkey", "c_nationkey", "size", "n_known")
    return out.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ";"))


@query("a10_pair_medians", f"WITH {MEASUREMENTS} SELECT source, entity, round(median(value), 6) AS median FROM m GROUP BY 1, 2")
def pair_medians(t):
    return rounded(a.median_by(t.measurements(), ["source", "entity"], "value"), "median")


@query("a11_sized_medians", f"""WITH {MEASUREMENTS}
    SELECT entity, count(*) AS n, round(median(value), 6) AS median FROM m GROUP BY 1 HAVING count(*) >= 35""")
def sized_medians(t):
    return rounded(a.sized_medians(t.measurements(), "entity", "value", 35), "median")


@query("a12_describe_delta", """
    WITH d AS (SELECT l_tax - l_discount AS d FROM lineitem)
    SELECT count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(min(d), 6) AS min, round(max(d), 6) AS max,
           count_if(abs(d) > 0.01) AS n_abs_gt_001, count_if(abs(d) > 0.10) AS n_abs_gt_010, count_if(abs(d) > 0.50) AS n_abs_gt_050,
           round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.75), 6) AS p75 FROM d""")
def describe_delta(t):
    df = t.lineitem.select((F.col("l_tax") - F.col("l_discount")).alias("d"))
    return rounded(a.describe_delta(df, "d"), "mean", "sd", "min", "max", "p25", "p50", "p75")


@query("a13_direction_counts", f"""WITH {OLD_NEW_SQL}
    SELECT count_if(new.n > old.n) AS increased, count_if(new.n < old.n) AS decreased, count_if(new.n = old.n) AS unchanged FROM old JOIN new ON old.k = new.k""")
def direction_counts(t):
    old, new = old_new(t)
    both = old.withColumnRenamed("n", "n_old").join(new.withColumnRenamed("n", "n_new"), "k")
    return a.direction_counts(both, "n_old", "n_new")


@query("a14_replicate_counts", f"""WITH {MEASUREMENTS}
    SELECT record, line, entity, source, flag, count(*) OVER (PARTITION BY entity, source) AS n_replicates,
           count(*) OVER (PARTITION BY entity, source) > 1 AS is_replicated FROM m""")
def replicate_counts(t):
    rows = t.measurements().select("record", "line", "entity", "source", "flag")
    return a.with_replicate_counts(rows, "entity", "source")


@query("a15_multi_source_range", f"""WITH {MEASUREMENTS}, s AS (SELECT entity, max(value) - min(value) AS spread FROM m GROUP BY 1 HAVING count(DISTINCT source) >= 2)
    SELECT count(*) AS n_entities, round(max(spread), 6) AS max_range, round(median(spread), 6) AS median_range FROM s""")
def multi_source_range(t):
    return rounded(a.multi_source_range(t.measurements(), "entity", "source", "value"), "max_range", "median_range")


@query("a16_global_coverage", """
    SELECT count(*) AS n_rows, count(quality) AS n_quality, count(text) AS n_text, count(DISTINCT source) AS u_source, count(DISTINCT text) AS u_text
    FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id""")
def global_coverage(t):
    return a.global_coverage(t.documents.join(t.labels, "doc_id", "left"), ["quality", "text"], ["source", "text"])


@query("a17_new_set_summary", """
    WITH o AS (SELECT l_partkey AS k, median(log10(l_extendedprice)) AS med, count(*) AS n, CAST(min(year(l_shipdate)) AS INTEGER) AS y FROM lineitem WHERE year(l_shipdate) <= 1997 AND l_returnflag = 'A' GROUP BY 1),
         w AS (SELECT l_partkey AS k, median(log10(l_extendedprice)) AS med, count(*) AS n, CAST(min(year(l_shipdate)) AS INTEGER) AS y FROM lineitem WHERE year(l_shipdate) > 1997 GROUP BY 1)
    SELECT count(*) AS n_new, round(min(med), 6) AS median_min, round(max(med), 6) AS median_max, round(avg(med), 6) AS median_mean,
           min(y) AS year_min, max(y) AS year_max, count_if(n >= 2) AS n_repeated FROM w WHERE k NOT IN (SELECT k FROM o)""")
def new_set_summary(t):
    from ...operators.delta import new_set_summary as summary

    rows = t.lineitem.select(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y"), "l_returnflag", F.log10("l_extendedprice").alias("v"))

    def table(df):
        return df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y")).join(a.median_by(df, ["k"], "v", "med"), "k")

    old = table(rows.where((F.col("y") <= 1997) & (F.col("l_returnflag") == "A")))
    return rounded(summary(old, table(rows.where("y > 1997")), "k", "med", "n", "y"), "median_min", "median_max", "median_mean")


@query("a18_role_rollup", """
    WITH r AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT CASE WHEN s_acctbal < 0 THEN 'excluded' WHEN s_acctbal < 3000 THEN 'sensitivity' ELSE 'primary' END AS role,
           count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS sum_entities FROM supplier JOIN r ON s_suppkey = l_suppkey GROUP BY 1""")
def role_rollup(t):
    bal = F.col("s_acctbal")
    role = F.when(bal < 0, "excluded").when(bal < 3000, "sensitivity").otherwise("primary")
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    return a.role_rollup(t.supplier.join(n, "s_suppkey").withColumn("role", role), "role", "n")


@query("a06_flag_totals", f"WITH {FLAGS_SQL} SELECT " + ", ".join(f"count_if({x}) AS {x}" for x in DOC_FLAGS) + " FROM f")
def flag_totals(t):
    return flagged_documents(t).agg(*[F.count_if(F.col(x)).alias(x) for x in DOC_FLAGS])


