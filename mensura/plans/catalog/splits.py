"""Leakage-safe partitions of orders (group: customer) and labelled documents."""

from pyspark.sql import functions as F

from ...operators import splits as s
from ...operators.expect import no_leakage
from ..registry import query
from .metrics import labelled

# The lightest-fold rule, group by group, written out as a recursion over groups in falling size.
GREEDY_SQL = """g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
  o AS (SELECT n, row_number() OVER (ORDER BY n DESC, o_custkey) AS i FROM g)"""


@query("k01_group_kfold", f"""WITH RECURSIVE {GREEDY_SQL},
  w AS (SELECT CAST(0 AS BIGINT) AS i, [0::BIGINT, 0, 0, 0, 0] AS loads, [0::BIGINT, 0, 0, 0, 0] AS counts UNION ALL
    SELECT o.i, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END),
           list_transform(range(1, 6), lambda j: counts[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN 1 ELSE 0 END)
    FROM w JOIN o ON o.i = w.i + 1),
  f AS (SELECT loads, counts FROM w ORDER BY i DESC LIMIT 1)
  SELECT 0 AS "partition", CAST(j AS INTEGER) AS fold, loads[j + 1] AS n_rows, counts[j + 1] AS n_groups FROM f CROSS JOIN range(5) AS r(j)""")
def group_kfold(t):
    return s.fold_sizes(s.group_kfold(t.orders, "o_orderkey", "o_custkey", 5), "o_custkey")


@query("k02_shuffled_partitions", """
    SELECT unnest(['group_in_two_folds', 'row_not_placed_once', 'empty_fold']) AS "check", unnest([0, 0, 0]) AS n_bad FROM (SELECT count(*) FROM orders)""")
def shuffled_partitions(t):
    folds = s.group_kfold(t.orders, "o_orderkey", "o_custkey", 5, partitions=3)
    return no_leakage(folds, "o_orderkey", "o_custkey", 5).drop("sample")


@query("k02_partition_rows", """
    SELECT o_orderkey, o_custkey, CAST(p AS INTEGER) AS partition, true AS fold_of_group FROM orders, range(3) AS r(p)""")
def partition_rows(t):
    """Every row in every partition, and whether its fold is one of the five and that of its whole group."""
    folds = s.group_kfold(t.orders, "o_orderkey", "o_custkey", 5, partitions=3)
    group = folds.groupBy("o_custkey", "partition").agg(F.min("fold").alias("low"), F.max("fold").alias("high"))
    placed = (F.col("low") == F.col("high")) & F.col("low").between(0, 4)
    return folds.join(group, ["o_custkey", "partition"]).select(
        "o_orderkey", "o_custkey", F.col("partition").cast("int").alias("partition"), placed.alias("fold_of_group")
    )


@query("k03_stratified_split", """
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
    SELECT quality, 'test' AS split, CAST(round(n * 0.2) AS BIGINT) AS n FROM c UNION ALL SELECT quality, 'train', n - CAST(round(n * 0.2) AS BIGINT) FROM c""")
def stratified_split(t):
    return s.stratified_split(t.labels, "doc_id", "quality", 0.2).groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n"))


@query("k04_stratified_kfold", """
    WITH p AS (SELECT quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 10 AS INTEGER) AS fold FROM labels)
    SELECT quality, fold, count(*) AS n FROM p GROUP BY 1, 2""")
def stratified_kfold(t):
    return s.stratified_kfold(t.labels, "doc_id", "quality", 10).groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("k05_inner_validation", """
    WITH f AS (SELECT CAST(quality * 2 + toxic AS INTEGER) AS fold, count(*) AS n FROM labels GROUP BY 1),
         o AS (SELECT CAST(j AS INTEGER) AS outer_fold, CAST((SELECT sum(n) FROM f WHERE fold <> j) AS BIGINT) AS n FROM range(4) AS r(j))
    SELECT outer_fold, 'validation' AS role, CAST(floor(n * 0.15) AS BIGINT) AS n FROM o UNION ALL SELECT outer_fold, 'fit', n - CAST(floor(n * 0.15) AS BIGINT) FROM o""")
def inner_validation(t):
    folds = t.labels.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("fold"))
    return s.inner_validation(folds, "doc_id", "fold", 4).groupBy("outer_fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("k06_group_split", """
    SELECT count(*) AS n_rows, 0 AS n_leaks, true AS balanced FROM orders""")
def group_split(t):
    """80/10/10 by customers: no customer in two parts, every part within one group of its share."""
    parts = s.group_split(t.orders, "o_orderkey", "o_custkey")
    per = parts.groupBy("o_custkey").agg(F.countDistinct("split").alias("k"), F.count(F.lit(1)).alias("n"), F.min("split").alias("split"))
    share = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    sizes = per.groupBy("split").agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.count_if(F.col("k") > 1).alias("leaks"))
    total = sizes.select(F.sum("n")).scalar()
    return sizes.withColumn("off", F.abs(F.col("n") - total * share) <= F.col("largest")).agg(
        F.sum("n").alias("n_rows"), F.sum("leaks").cast("int").alias("n_leaks"), F.bool_and("off").alias("balanced")
    )


@query("k06_split_parts", """
    SELECT lang, count_if(quality = 1) AS n_train, count_if(quality = 0) AS n_test FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY 1""")
def split_parts(t):
    """A ready-made split column selects the parts."""
    docs = labelled(t).withColumn("split", F.when(F.col("quality") == 1, "train").otherwise("test"))
    train, _, test = s.split_parts(docs)
    a = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n_train"))
    b = test.groupBy("lang").agg(F.count(F.lit(1)).alias("n_test"))
    return a.join(b, "lang", "full_outer").na.fill(0)


@query("k07_fold_table", """
    SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(DISTINCT o_custkey) AS n_groups, 5 AS n_folds FROM orders""")
def fold_table(t):
    folds = s.group_kfold(t.orders, "o_orderkey", "o_custkey", 5)
    return folds.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"), F.countDistinct("o_custkey").alias("n_groups"),
        F.countDistinct("fold").cast("int").alias("n_folds"),
    )
