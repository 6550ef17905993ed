"""Readers, snapshots, sinks: files are written from the input tables and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...operators.expect import enforce
from ...operators.models import pending_jobs
from ...session import scratch_path
from ...sources import readers, sinks, snapshots
from ..registry import query

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
EVENT = "event_id long, user_id long, event_type string, value double"


@query("s01_read_table_csv", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS INTEGER) AS absent FROM customer""")
def read_table_csv(t):
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(t.customer, path, bom=True)
    schema = T.StructType.fromDDL(CUSTOMER + ", absent int")
    return readers.read_table_csv(t.spark, path, schema)


def _broken_lines(t, broken=True):
    """Events as JSON lines; one kind is blank, and if ``broken`` one loses its closing brace and one is no object."""
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    kind, spoil = F.col("event_type"), F.lit(broken)
    path = scratch_path(t.spark, "jsonl")
    t.events.select(
        F.when(spoil & (kind == "error"), F.rtrim(line, F.lit("}"))).when(spoil & (kind == "signup"), F.lit("[1]"))
        .when(kind == "view", F.lit("  ")).otherwise(line).alias("value")
    ).write.text(path)
    return path


@query("s02_read_jsonl_strict", """
    SELECT event_type, count(*) AS n, round(sum(value), 4) AS total,
           (SELECT count(*) > 0 FROM events WHERE event_type IN ('error', 'signup')) AS broken_file_refused
    FROM events WHERE event_type <> 'view' GROUP BY 1""")
def read_jsonl_strict(t):
    """The whole file reads strictly; the file with bad lines is refused."""
    schema = T.StructType.fromDDL(EVENT)
    try:
        readers.read_jsonl_strict(t.spark, _broken_lines(t), schema)
        refused = False
    except ValueError:
        refused = True
    rows = readers.read_jsonl_strict(t.spark, _broken_lines(t, broken=False), schema)
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.lit(refused).alias("broken_file_refused")
    )


@query("s02_read_jsonl", """
    SELECT CASE WHEN event_type IN ('error', 'signup') THEN '<BAD>' ELSE event_type END AS event_type,
           count(*) AS n, round(sum(CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE value END), 4) AS total
    FROM events WHERE event_type <> 'view' GROUP BY 1""")
def read_jsonl(t):
    path = _broken_lines(t)
    rows = readers.read_jsonl(t.spark, path, T.StructType.fromDDL(EVENT))
    bad = F.col(readers.CORRUPT).isNotNull()
    return rows.groupBy(F.when(bad, "<BAD>").otherwise(F.col("event_type")).alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(bad, 0.0).otherwise(F.col("value"))), 4).alias("total")
    )


@query("s02_locate_bad_lines", """
    SELECT CASE WHEN event_type = 'signup' THEN 'not_an_object' ELSE 'not_json' END AS problem, count(*) AS n
    FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1""")
def locate_bad_lines(t):
    bad = readers.locate_bad_lines(t.spark, _broken_lines(t), T.StructType.fromDDL(EVENT))
    problem = F.when(F.col("text").startswith("{"), "not_json").otherwise("not_an_object")
    return bad.groupBy(problem.alias("problem")).agg(F.countDistinct("file", "line").alias("n"))


@query("s03_read_json_doc", """
    SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, 'orders' AS name FROM orders""")
def read_json_doc(t):
    path = scratch_path(t.spark, "doc")
    facts = {"n_orders": F.count(F.lit(1)), "n_customers": F.countDistinct("o_custkey")}
    sinks.write_jsonl(snapshots.run_metadata(t.orders, facts, name="orders").drop("as_json"), path)
    schema = T.StructType.fromDDL("n_orders long, n_customers long, name string")
    return readers.read_json_doc(t.spark, path, schema)


@query("s04_read_keyed_json", """
    SELECT event_type, 'k' AS field, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total,
           min(CAST(props->>'k' AS INTEGER)) AS lowest, max(CAST(props->>'k' AS INTEGER)) AS highest
    FROM events GROUP BY event_type""")
def read_keyed_json(t):
    rows = t.events.select("event_type", *readers.explode_keyed_json(F.col("props"), T.IntegerType(), "field", "v"))
    return rows.groupBy("event_type", "field").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("lowest"), F.max("v").alias("highest")
    )


@query("s05_latest_complete_snapshot", """
    WITH v AS (SELECT strftime(o_orderdate, '%Y-%m') AS version, count(*) AS n,
                      count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
    SELECT max(version) AS version, 'release/' || max(version) AS path FROM v WHERE n > 3 AND NOT f > n / 2.0""")
def latest_complete(t):
    versions = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("version")).agg(
        (F.count(F.lit(1)) > 3).alias("complete"),
        (F.count_if(F.col("o_orderstatus") == "F") > F.count(F.lit(1)) / 2.0).alias("failed"),
    ).withColumn("path", F.concat(F.lit("release/"), F.col("version")))
    return snapshots.latest_complete(versions, "version", "path")


@query("s06_write_snapshot", """
    SELECT l_returnflag, count(*) AS n_records FROM lineitem GROUP BY 1""")
def write_snapshot(t):
    path = scratch_path(t.spark, "snapshot")
    snapshots.write_snapshot(t.lineitem, path, "l_returnflag", "v1")
    enforce(snapshots.verify_snapshot(t.spark, path, "l_returnflag"))
    return t.spark.read.parquet(f"{path}/counts")


@query("s06_manifest", """
    SELECT count(*) AS n_records, count(DISTINCT l_returnflag) AS n_groups, 'v1' AS version,
           (SELECT string_agg(k || '=' || n, ';' ORDER BY k)
            FROM (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1)) AS counts
    FROM lineitem""")
def manifest(t):
    row = snapshots.manifest(t.lineitem, "l_returnflag", version="v1")
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return row.withColumn("counts", F.array_join(F.array_sort(pairs), ";"))


@query("s07_atomic_publish", """
    SELECT 'finished' AS path, 'v1' AS version, true AS complete, count(*) AS n_orders FROM orders""")
def atomic_publish(t):
    """Of two snapshot folders only the one that got its marker is found."""
    done, open_ = scratch_path(t.spark, "finished"), scratch_path(t.spark, "unfinished")
    snapshots.write_snapshot(t.orders, done, "o_orderstatus", "v1")
    t.orders.write.parquet(f"{open_}/data")
    found = snapshots.snapshot_versions(t.spark, [done, open_]).where("complete")
    n = t.spark.read.parquet(f"{done}/data").select(F.count(F.lit(1))).scalar()
    return found.select(F.lit("finished").alias("path"), "version", "complete", n.alias("n_orders"))


@query("s08_sinks", """
    WITH s AS (SELECT o_orderpriority, count(*) AS n, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS statuses
               FROM orders GROUP BY 1)
    SELECT f.sink, s.* FROM s CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) AS f(sink)""")
def all_sinks(t):
    table = t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses")
    )
    order = ["o_orderpriority", "n", "statuses"]
    csv, js, pq = (scratch_path(t.spark, x) for x in ("csv", "json", "parquet"))
    sinks.write_csv(table, csv, order)
    sinks.write_jsonl(table, js, order)
    sinks.write_parquet(table, pq, columns=order)
    schema = T.StructType.fromDDL("o_orderpriority string, n long, statuses string")
    lists = T.StructType.fromDDL("o_orderpriority string, n long, statuses array<string>")
    found = [
        ("csv", readers.read_table_csv(t.spark, csv, schema)),
        ("json", sinks.flat(readers.read_jsonl_strict(t.spark, js, lists))),
        ("parquet", sinks.flat(t.spark.read.parquet(pq))),
    ]
    out = None
    for name, df in found:
        df = df.withColumn("sink", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@query("s08_text_report", """
    SELECT unnest(['n_orders: ' || count(*), 'statuses: ' || count(DISTINCT o_orderstatus)]) AS value FROM orders""")
def text_report(t):
    path = scratch_path(t.spark, "report")
    sinks.write_report(t.orders.agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_orderstatus").alias("statuses")), path)
    return t.spark.read.text(path)


@query("s09_array_side_table", """
    SELECT doc_id, lang, len(embedding) AS n_dims, round(list_sum(embedding), 4) AS total
    FROM documents JOIN embeddings ON doc_id = vec_id""")
def array_side_table(t):
    arrays = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    joined = readers.attach_arrays(t.documents.select("doc_id", "lang"), arrays, "doc_id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return joined.select("doc_id", "lang", F.size("embedding").cast("long").alias("n_dims"), F.round(total, 4).alias("total"))


@query("s10_pending_jobs", """
    SELECT c_custkey, c_mktsegment FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def pending(t):
    done = t.orders.where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return pending_jobs(t.customer.select("c_custkey", "c_mktsegment"), done, ["c_custkey"])


@query("s11_run_metadata", """
    SELECT 'lineitem' AS name, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_entities,
           max(year(l_shipdate)) AS year_max,
           '{"n_entities":' || count(DISTINCT l_partkey) || ',"n_rows":' || count(*) || ',"name":"lineitem","year_max":'
             || max(year(l_shipdate)) || '}' AS as_json
    FROM lineitem""")
def run_metadata(t):
    facts = {
        "n_rows": F.count(F.lit(1)), "n_entities": F.countDistinct("l_partkey"), "year_max": F.max(F.year("l_shipdate")).cast("long"),
    }
    return snapshots.run_metadata(t.lineitem, facts, name="lineitem")
