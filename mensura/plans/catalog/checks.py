"""Data contracts on input tables and on views that break them on purpose."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...operators import expect as q
from ...session import scratch_path
from ...sources import readers, snapshots
from ..registry import query
from .sources import EVENT, _broken_lines


@query("q01_parseable", """
    SELECT 'parseable' AS "check", count_if(event_type IN ('error', 'signup')) AS n_bad FROM events""")
def parseable(t):
    rows = readers.read_jsonl(t.spark, _broken_lines(t), T.StructType.fromDDL(EVENT))
    return q.parseable(rows).drop("sample")


@query("q02_required_columns", """
    SELECT 'required_columns' AS "check", CAST(3 - count(*) AS BIGINT) AS n_bad, 'o_missing' AS sample, (SELECT count(*) FROM orders) AS n_rows
    FROM (DESCRIBE orders) WHERE column_name IN ('o_orderkey', 'o_custkey', 'o_missing') UNION ALL
    SELECT unnest(['o_orderkey_blank', 'o_custkey_blank']), unnest([count_if(o_orderkey IS NULL), count_if(o_custkey IS NULL)]), NULL, count(*) FROM orders""")
def required_columns(t):
    """Columns of the table, and how many of its rows leave a required one that is there blank."""
    wanted = ["o_orderkey", "o_custkey", "o_missing"]
    report = q.required_columns(t.orders, wanted).unionByName(q.non_blank(t.orders, [c for c in wanted if c in t.orders.columns]))
    return report.withColumn("n_rows", t.orders.select(F.count(F.lit(1))).scalar())


@query("q03_unique_key", """
    SELECT 'line key' AS "check", count(*) AS n_bad FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
    SELECT 'order key', 0 UNION ALL SELECT 'l_orderkey_blank', 0""")
def unique_key(t):
    line = q.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"], "line key")
    order = q.unique_key(t.orders, ["o_orderkey"], "order key")
    return line.unionByName(order).unionByName(q.non_blank(t.lineitem, ["l_orderkey"])).drop("sample")


@query("q04_domain", """
    SELECT 'o_orderstatus_domain' AS "check", count_if(o_orderstatus <> 'F') AS n_bad, min(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END) AS sample FROM orders UNION ALL
    SELECT 'note_domain', count_if(o_orderpriority = '1-URGENT'), '1-URGENT' FROM orders""")
def domain(t):
    note = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).when(F.col("o_orderpriority") == "5-LOW", " ")
    strict = q.domain(t.orders, "o_orderstatus", "F")
    return strict.unionByName(q.domain(t.orders.withColumn("note", note), "note", "2-HIGH", optional=True))


@query("q05_counts_match", """
    WITH a AS (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'missing_group' AS "check", 1 AS n_bad, 'X' AS sample UNION ALL SELECT 'extra_group', count(*), min(k) FROM a WHERE k = 'P'
    UNION ALL SELECT 'count_differs', count(*), min(k) FROM a WHERE k = 'F'""")
def counts_match(t):
    """The expected table lacks one group, names one that is not there and miscounts a third."""
    actual = snapshots.group_counts(t.orders, "o_orderstatus")
    wrong = actual.where("o_orderstatus <> 'P'").withColumn(
        "n_records", F.col("n_records") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    )
    ghost = actual.agg(F.lit("X").alias("o_orderstatus"), F.sum("n_records").alias("n_records"))
    return q.counts_match(actual, wrong.unionByName(ghost), "o_orderstatus", "n_records")


@query("q06_hashes_match", """
    SELECT unnest(['file_missing', 'file_extra', 'hash_differs']) AS "check", unnest([0, 0, 1]) AS n_bad FROM (SELECT count(*) FROM orders)""")
def hashes_match(t):
    """Hashes of a written table against a copy in which one hash was changed."""
    path = scratch_path(t.spark, "hashes")
    t.orders.coalesce(4).write.parquet(path)
    good = snapshots.file_hashes(t.spark, path, "*.parquet")
    first = good.select(F.min("file")).scalar()
    broken = good.withColumn("sha256", F.when(F.col("file") == first, F.reverse("sha256")).otherwise(F.col("sha256")))
    return snapshots.hashes_match(good, broken).drop("sample")


@query("q07_constant_version", """
    SELECT 'constant_version' AS "check", count(DISTINCT v) - 1 AS n_bad FROM (SELECT min(o_orderstatus) AS v FROM orders UNION ALL SELECT max(o_orderstatus) FROM orders)""")
def constant_version(t):
    start, end = (t.orders.agg(f("o_orderstatus").alias("version")) for f in (F.min, F.max))
    return q.constant_version(start, end).drop("sample")


@query("q08_split_rows", """
    WITH x AS (SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'too_large' END AS a, CASE WHEN o_orderstatus = 'P' THEN 'open' END AS b,
                      CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE '' END AS w FROM orders)
    SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'kept' ELSE 'rejected' END AS part,
           CASE WHEN a IS NULL AND b IS NULL THEN w ELSE concat_ws(';', a, b) END AS notes, count(*) AS n FROM x GROUP BY 1, 2""")
def split_rows(t):
    kept, rejected = q.split_rows(
        t.orders, {"too_large": F.col("o_totalprice") > 450000, "open": F.col("o_orderstatus") == "P"},
        {"urgent": F.col("o_orderpriority") == "1-URGENT"},
    )
    a = kept.groupBy(F.lit("kept").alias("part"), F.col("warnings").alias("notes")).agg(F.count(F.lit(1)).alias("n"))
    b = rejected.groupBy(F.lit("rejected").alias("part"), F.col("reasons").alias("notes")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@query("q09_array_quality", """
    SELECT 'wrong_size' AS "check", count_if(label = 1) AS n_bad FROM embeddings UNION ALL
    SELECT 'not_finite', count_if(label = 2) FROM embeddings UNION ALL SELECT 'empty', count_if(label = 3) FROM embeddings""")
def array_quality(t):
    label, e = F.col("label"), F.col("embedding")
    broken = F.when(label == 1, F.slice(e, 1, 63)).when(label == 2, F.transform(e, lambda x: (x * float("nan")).cast("float"))).when(
        label == 3, F.transform(e, lambda x: (x * 0).cast("float"))
    ).otherwise(e)
    return q.array_quality(t.embeddings.withColumn("embedding", broken), "embedding", 64, "vec_id").drop("sample")


@query("q10_no_leakage", """
    SELECT 'group_in_two_folds' AS "check", count(*) AS n_bad FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1) UNION ALL
    SELECT 'row_not_placed_once', 0 UNION ALL SELECT 'empty_fold', 1""")
def no_leakage(t):
    """Order status as a naive fold: customers leak, and of four folds one is empty."""
    fold = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    naive = t.orders.select("o_orderkey", "o_custkey", F.lit(0).alias("partition"), fold.alias("fold"))
    return q.no_leakage(naive, "o_orderkey", "o_custkey", 4).drop("sample")


@query("q11_predictions_complete", """
    SELECT 'missing_prediction' AS "check", count_if(o_orderstatus = 'P') AS n_bad FROM orders UNION ALL
    SELECT 'repeated_prediction', 0 UNION ALL SELECT 'not_finite', count_if(o_orderstatus = 'O') FROM orders""")
def predictions_complete(t):
    oof = t.orders.where("o_orderstatus <> 'P'").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", float("nan")).otherwise(F.col("o_totalprice")).alias("y_pred")
    )
    return q.predictions_complete(oof, t.orders, "o_orderkey", "y_pred").drop("sample")


@query("q12_group_labels_present", """
    SELECT 'group_label_blank' AS "check", count_if(lang IN ('fr', 'de')) AS n_bad FROM documents""")
def group_labels_present(t):
    broken = F.when(F.col("lang") == "fr", "NaN").when(F.col("lang") == "de", " ").otherwise(F.col("lang"))
    return q.group_labels_present(t.documents.select("doc_id", broken.alias("g")), "g", "doc_id").drop("sample")
