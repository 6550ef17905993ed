"""Whole flows on the input tables: overview, protocol reading, audit, release comparison, folds."""

from pyspark.sql import functions as F

from ...functions.rulebook import keyword_rules
from ...session import cut_lineage, kept_columns
from .. import audit as audit_flow
from .. import overview as overview_flow
from .. import protocol as protocol_flow
from .. import release as release_flow
from ..registry import MEASUREMENTS, query, rounded
from .cleaning import normal_sql

KINDS = """r AS (SELECT event_id, user_id, event_type = 'purchase' AS p, value, CAST(props->>'k' AS INT) AS k FROM events),
  f AS (SELECT *, p AND k % 3 = 0 AND k <= 90 AS exact, p AND k > 90 AS ranged, p AND k % 3 = 1 AS rightc, p AND k % 3 = 2 AS leftc FROM r)"""


def raw_events(t):
    """Events in the shape of raw records: text numbers, a relation, an upper bound for a few."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("event_id").cast("string").alias("record_id"), F.col("user_id").cast("string").alias("source_id"),
        F.col("event_type").alias("entity_id"), F.lit("T1").alias("target_id"),
        F.when(k % 2 == 0, F.col("event_type")).alias("standard_type"), F.col("event_type").alias("type"),
        F.when(k % 3 == 0, "=").when(k % 3 == 1, ">").otherwise("<=").alias("relation"),
        F.col("value").cast("string").alias("standard_value"), F.when(k > 90, F.lit("500.0")).alias("standard_upper_value"),
        F.when(k == 7, "Not  active here").alias("comment"), F.lit("x").alias("structure"),
    )


@query("e01_snapshot_overview", f"""WITH {KINDS}
    SELECT CAST(user_id AS VARCHAR) AS source_id, count(*) AS n_records, count(DISTINCT p) AS n_purchase_states, count_if(exact) AS n_exact,
      count_if(ranged) AS n_interval, count_if(rightc) AS n_right_censored, count_if(leftc) AS n_left_censored, count_if(k = 7) AS n_text_contains_inactive FROM f GROUP BY 1""")
def snapshot_overview(t):
    raw = raw_events(t).withColumn("entity_id", (F.col("entity_id") == "purchase").cast("string"))
    expected = raw.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_records"))
    tables = overview_flow.overview(raw, raw.select("source_id").distinct(), "PURCHASE", expected)
    return tables["sources"].select(
        "source_id", "n_records", F.col("n_entities").alias("n_purchase_states"), "n_exact", "n_interval", "n_right_censored", "n_left_censored",
        "n_text_contains_inactive",
    )


def described_documents(t):
    """Documents as source descriptions; the length stands for the number of entities."""
    return t.texts().select(
        F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("description"), F.col("source").alias("collection_id"),
        F.col("n_chars").alias("n_entities"), F.col("lang").alias("label"),
    )


@query("e02_protocol_signatures")
def protocol_signatures(t):
    """The fixed protocol patterns on the whole texts: field values, confidences, signature, priority."""
    out = protocol_flow.decompose(described_documents(t), "description", "XYZ1")
    return out.drop("description", *[c for c in out.columns if c.endswith("__evidence")])


AUDIT_RULES = keyword_rules("XYZ1")
RAISED_SQL = ", ".join(
    f"CASE WHEN {' OR '.join(f'regexp_matches(s, {chr(39)}{p}{chr(39)})' for _, p in rules)} THEN '{name}' END" for name, rules in AUDIT_RULES.items())


@query("e03_source_audit", f"""
    WITH d AS (SELECT doc_id, {normal_sql('text')} AS s FROM documents),
    f AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, length(s) AS description_length, concat_ws(';', {RAISED_SQL}) AS flags FROM d)
    SELECT source_id, 1::BIGINT AS n_measurements, 1::BIGINT AS n_entities, 'unreviewed' AS review_status, description_length, flags,
      CASE WHEN description_length < 25 THEN 'high' ELSE 'normal' END AS review_priority FROM f""")
def source_audit(t):
    """Documents as sources, described by their whole texts: all keyword flags, triage and review columns."""
    table, _ = audited(t)
    flags = F.concat_ws(";", *[F.when(F.col(f"flag_{x}"), F.lit(x)) for x in AUDIT_RULES])
    return table.select(
        "source_id", "n_measurements", "n_entities", "review_status", F.col("description_length").cast("long").alias("description_length"),
        flags.alias("flags"), "review_priority",
    )


def audited(t):
    docs = t.texts().select(F.col("doc_id").cast("string").alias("source_id"), F.col("lang").alias("entity_id"), F.col("text").alias("description"))
    return audit_flow.audit(docs.select("source_id", "entity_id"), docs.drop("entity_id"), "XYZ1")


@query("e03_audit_summary", f"""
    WITH d AS (SELECT lang, {normal_sql('text')} AS s FROM documents), f AS (SELECT lang, concat_ws(';', {RAISED_SQL}, CASE WHEN length(s) < 25 THEN 'sparse_description' END) AS flags FROM d),
    u AS (SELECT lang, unnest(string_split(flags, ';')) AS flag FROM f WHERE flags <> '')
    SELECT 'flag_' || flag AS category, count(*) AS n_sources, count(DISTINCT lang) AS entities_union FROM u GROUP BY 1""")
def audit_summary(t):
    """Coverage of the flags over all documents; those that some document raises."""
    _, summary = audited(t)
    return summary.where("n_sources > 0 AND category LIKE 'flag%'").select("category", "n_sources", "entities_union")


ENTITY = """SELECT entity, median(value) AS value_median, count(value) AS n_measurements, max(year) AS year_max FROM m WHERE year <= {y} GROUP BY 1"""


@query("e04_release_counts", f"""WITH {MEASUREMENTS}, o AS ({ENTITY.format(y=1998)}), n AS ({ENTITY.format(y=1999)})
    SELECT count_if(o.entity IS NULL) AS n_new, count_if(n.entity IS NULL) AS n_removed,
      count_if(o.entity IS NOT NULL AND n.entity IS NOT NULL AND (abs(o.value_median - n.value_median) > 1e-10 OR o.n_measurements <> n.n_measurements OR o.year_max <> n.year_max)) AS n_changed
    FROM o FULL OUTER JOIN n ON o.entity = n.entity""")
def release_counts(t):
    # Both tables read the joined lines three times.
    m = kept_columns(t.measurements().select("entity", "value", "year", "collection", "source"), "measurements")

    def table(until):
        rows = m.where(F.col("year") <= until).withColumn("entity", F.col("entity").cast("string"))
        return cut_lineage(release_flow.entity_table(rows, "entity", "value", "year", "collection", "source"))

    found = release_flow.compare(table(1998), table(1999), "entity", ["value_median", "n_measurements", "year_max"])
    return found["verdict"].select("n_new", "n_removed", "n_changed")


@query("e05_entity_release", f"WITH {MEASUREMENTS} SELECT CAST(entity AS VARCHAR) AS entity, round(median(value), 6) AS value_median, count(*) AS n_measurements FROM m GROUP BY 1")
def entity_release(t):
    rows = t.measurements().withColumn("entity", F.concat(F.lit(" "), F.col("entity").cast("string"), F.lit(" ")))
    out = release_flow.entity_table(rows, "entity", "value", "year", "collection", "source")
    return rounded(out.select("entity", "value_median", "n_measurements"), "value_median")
