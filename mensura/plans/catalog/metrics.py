"""Metrics on order lines (a crude price forecast) and on labelled documents."""

from pyspark.sql import functions as F

from ...operators import metrics as m
from ..registry import query, rounded
from .contrasts import RHO_SQL

# y: log price; p: a forecast from the quantity alone. Flag and status are the keys.
FORECAST_SQL = """f AS (SELECT l_returnflag AS rep, l_linestatus AS alg, CAST(month(l_shipdate) % 5 AS INTEGER) AS fold,
    log10(l_extendedprice) AS y, 3.0 + l_quantity / 50.0 AS p FROM lineitem)"""


def forecast(t):
    return t.lineitem.select(
        F.col("l_returnflag").alias("rep"), F.col("l_linestatus").alias("alg"), (F.month("l_shipdate") % 5).alias("fold"),
        F.log10("l_extendedprice").alias("y"), (F.lit(3.0) + F.col("l_quantity") / 50.0).alias("p"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
    )


REG = """count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2"""


@query("m01_regression_metrics", f"WITH {FORECAST_SQL}, s AS (SELECT rep, alg, {REG} FROM f GROUP BY 1, 2) SELECT rep, alg, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM s")
def regression_metrics(t):
    return rounded(m.regression_metrics(forecast(t), ["rep", "alg"], "y", "p"), "rmse", "mae", "r2")


@query("m02_spearman", f"WITH {FORECAST_SQL} " + RHO_SQL.format(k="rep", x="y", y="p", t="f"))
def spearman(t):
    return rounded(m.spearman(forecast(t), ["rep"], "y", "p"), "rho")


@query("m02_spearman_constant", """SELECT l_returnflag AS rep, count(*) AS n, CAST(NULL AS DOUBLE) AS rho FROM lineitem GROUP BY 1""")
def spearman_constant(t):
    return m.spearman(forecast(t).withColumn("p", F.lit(1.0)), ["rep"], "y", "p")


LABELLED_SQL = """d AS (SELECT lang, quality, toxic, n_chars, CAST(n_chars >= 1000 AS INTEGER) AS guess FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"""


def labelled(t):
    docs = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return docs.withColumn("guess", (F.col("n_chars") >= 1000).cast("int"))


AUC_SQL = """r AS (SELECT {k} AS k, quality, rank() OVER (PARTITION BY {k} ORDER BY n_chars) + (count(*) OVER (PARTITION BY {k}, n_chars) - 1) / 2.0 AS rk FROM d)"""


@query("m03_roc_auc", f"""WITH {LABELLED_SQL}, {AUC_SQL.format(k='lang')}, s AS (SELECT k, count(*) AS n, sum(quality)::BIGINT AS n_pos, sum(quality * rk)::DOUBLE AS rs FROM r GROUP BY 1)
    SELECT k AS lang, n, n_pos, CASE WHEN n_pos > 0 AND n_pos < n THEN round((rs - n_pos * (n_pos + 1) / 2) / (n_pos * (n - n_pos)), 6) END AS auc FROM s""")
def roc_auc(t):
    return rounded(m.roc_auc(labelled(t), ["lang"], "quality", "n_chars"), "auc")


@query("m03_roc_auc_pooled", f"""WITH {LABELLED_SQL}, {AUC_SQL.format(k='1')}, s AS (SELECT count(*) AS n, sum(quality)::BIGINT AS n_pos, sum(quality * rk)::DOUBLE AS rs FROM r)
    SELECT n, n_pos, round((rs - n_pos * (n_pos + 1) / 2) / (n_pos * (n - n_pos)), 6) AS auc FROM s""")
def roc_auc_pooled(t):
    return rounded(m.roc_auc(labelled(t), [], "quality", "n_chars"), "auc")


CONF_SQL = f"""{LABELLED_SQL}, c AS (SELECT lang, count_if(quality = 1 AND guess = 1) AS tp, count_if(quality = 0 AND guess = 0) AS tn,
    count_if(quality = 0 AND guess = 1) AS fp, count_if(quality = 1 AND guess = 0) AS fn FROM d GROUP BY 1)"""


@query("m04_confusion_metrics", f"""WITH {CONF_SQL} SELECT lang, tp, tn, fp, fn,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS tpr, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS tnr, round((tp + tn) / (tp + tn + fp + fn), 6) AS acc,
    round(coalesce(fp / nullif(tn + fp, 0), 0), 6) AS fpr, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS npv FROM c""")
def confusion_metrics(t):
    out = m.classification_metrics(labelled(t), ["lang"], "quality", "guess")
    return rounded(out.drop("bacc", "mcc"), "tpr", "tnr", "acc", "fpr", "npv")


@query("m05_mcc_balanced_accuracy", f"""WITH {CONF_SQL} SELECT lang,
    round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS bacc,
    round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE), 0), 0), 6) AS mcc FROM c""")
def mcc_balanced_accuracy(t):
    return rounded(m.classification_metrics(labelled(t), ["lang"], "quality", "guess").select("lang", "bacc", "mcc"), "bacc", "mcc")


def _around(interval, estimate):
    """How many replicates gave a value, and whether the estimate lies inside their interval."""
    inside = (F.col("ci_low") < estimate) & (estimate < F.col("ci_high"))
    return interval.select("n_replicates", inside.alias("estimate_inside"))


@query("m06_bootstrap_r2", "SELECT 1000::BIGINT AS n_replicates, count(*) > 0 AS estimate_inside FROM lineitem")
def bootstrap_r2(t):
    rows = forecast(t)
    estimate = m.regression_metrics(rows, [], "y", "p").select("r2").scalar()
    return _around(m.bootstrap_r2(rows, "key", "y", "p", replicates=1000), estimate)


@query("m06_bootstrap_auc", "SELECT 1000::BIGINT AS n_replicates, count(*) > 0 AS estimate_inside FROM labels")
def bootstrap_auc(t):
    rows = labelled(t)
    estimate = m.roc_auc(rows, [], "quality", "n_chars").select("auc").scalar()
    return _around(m.bootstrap_auc(rows, "quality", "n_chars", replicates=1000), estimate)


@query("m07_fold_summary", f"""WITH {FORECAST_SQL},
    rk AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2.0 AS py, rank() OVER (PARTITION BY rep ORDER BY p) + (count(*) OVER (PARTITION BY rep, p) - 1) / 2.0 AS pp,
      rank() OVER (PARTITION BY rep, fold ORDER BY y) + (count(*) OVER (PARTITION BY rep, fold, y) - 1) / 2.0 AS fy, rank() OVER (PARTITION BY rep, fold ORDER BY p) + (count(*) OVER (PARTITION BY rep, fold, p) - 1) / 2.0 AS fp FROM f),
    pool AS (SELECT rep, {REG}, corr(py, pp) AS rho FROM rk GROUP BY 1),
    each AS (SELECT rep, fold, {REG}, corr(fy, fp) AS rho FROM rk GROUP BY 1, 2),
    fs AS (SELECT rep, avg(rmse) AS a, stddev_samp(rmse) AS b, avg(r2) AS c, stddev_samp(r2) AS d, avg(rho) AS e, stddev_samp(rho) AS g, string_agg(printf('%.4f', r2), ';' ORDER BY fold) AS l FROM each GROUP BY 1)
    SELECT pool.rep AS rep, n, round(rmse, 6) AS rmse_pooled, round(r2, 6) AS r2_pooled, round(rho, 6) AS rho_pooled, round(a, 6) AS rmse_foldmean, round(b, 6) AS rmse_foldsd,
      round(c, 6) AS r2_foldmean, round(d, 6) AS r2_foldsd, round(e, 6) AS rho_foldmean, round(g, 6) AS rho_foldsd, l AS r2_per_fold FROM pool JOIN fs ON pool.rep = fs.rep""")
def fold_summary(t):
    out = m.fold_summary(forecast(t), ["rep"], "fold", "y", "p")
    return rounded(out, *[c for c in out.columns if c not in ("rep", "n", "r2_per_fold")])


@query("m07_class_fold_summary", """
    WITH d AS (SELECT lang, d.doc_id % 5 AS fold, quality AS y, n_chars AS s, CAST(n_chars >= 1000 AS INTEGER) AS g FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    r AS (SELECT *, rank() OVER (PARTITION BY lang, fold ORDER BY s) + (count(*) OVER (PARTITION BY lang, fold, s) - 1) / 2.0 AS rk FROM d),
    c AS (SELECT lang, fold, count(*) AS n, sum(y)::DOUBLE AS p, sum(y * rk)::DOUBLE AS rs, count_if(y = 1 AND g = 1)::DOUBLE AS tp, count_if(y = 0 AND g = 0)::DOUBLE AS tn,
      count_if(y = 0 AND g = 1)::DOUBLE AS fp, count_if(y = 1 AND g = 0)::DOUBLE AS fn FROM r GROUP BY 1, 2),
    e AS (SELECT lang, (rs - p * (p + 1) / 2) / (p * (n - p)) AS auc, coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) AS mcc
      FROM c WHERE p > 0 AND p < n)
    SELECT lang, count(*) AS n_folds, round(avg(auc), 6) AS auc_foldmean, round(stddev_pop(auc), 6) AS auc_foldsd, round(avg(mcc), 6) AS mcc_foldmean, round(stddev_pop(mcc), 6) AS mcc_foldsd FROM e GROUP BY 1""")
def class_fold_summary(t):
    rows = labelled(t).withColumn("fold", F.col("doc_id") % 5)
    out = m.class_fold_summary(rows, ["lang"], "fold", "quality", "n_chars", 1000)
    return rounded(out, "auc_foldmean", "auc_foldsd", "mcc_foldmean", "mcc_foldsd")


RESULTS_SQL = f"{FORECAST_SQL}, res AS (SELECT rep, alg, fold, {REG} FROM f GROUP BY 1, 2, 3)"


def results(t):
    return m.regression_metrics(forecast(t), ["rep", "alg", "fold"], "y", "p")


@query("m08_metric_pivot", f"""WITH {RESULTS_SQL} SELECT rep, round(avg(rmse) FILTER (WHERE alg = 'F'), 6) AS "F_rmse", round(avg(r2) FILTER (WHERE alg = 'F'), 6) AS "F_r2",
    round(avg(rmse) FILTER (WHERE alg = 'O'), 6) AS "O_rmse", round(avg(r2) FILTER (WHERE alg = 'O'), 6) AS "O_r2" FROM res GROUP BY 1""")
def metric_pivot(t):
    return rounded(m.metric_pivot(results(t), "rep", "alg", ["F", "O"], ["rmse", "r2"]), "F_rmse", "F_r2", "O_rmse", "O_r2")


@query("m08_metric_stability", f"WITH {RESULTS_SQL} SELECT rep, alg, round(min(rmse), 6) AS lowest, round(max(rmse), 6) AS highest FROM res GROUP BY 1, 2")
def metric_stability(t):
    return rounded(m.metric_stability(results(t), ["rep", "alg"], "rmse"), "lowest", "highest")


@query("m09_leaderboard", f"""WITH {RESULTS_SQL}, l AS (SELECT rep || '/' || alg AS label, avg(r2) AS r2 FROM res GROUP BY 1)
    SELECT label, round(r2, 6) AS r2, round(r2 - (SELECT r2 FROM l WHERE label = 'A/F'), 6) AS delta, r2 = (SELECT max(r2) FROM l) AS is_best FROM l""")
def leaderboard(t):
    table = results(t).groupBy(F.concat_ws("/", "rep", "alg").alias("label")).agg(F.round(F.avg("r2"), 12).alias("r2"))
    return rounded(m.leaderboard(table, "label", "r2", "A/F"), "r2", "delta")
