"""Models, the grid, importances and association statistics on labelled documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import features as f
from ...operators import models as m
from ...operators.boosting import SecondOrderBoosting
from ...operators.kernel import KernelMargin
from ...operators.metrics import classification_metrics, fold_summary, regression_metrics, roc_auc
from ...operators.network import DropoutNetwork
from ...operators.splits import group_kfold, stratified_split
from ...session import cut_lineage
from ..registry import query, rounded

# Descriptors that do not give the length away; y is the log length.
INPUTS = [d for d in f.DESCRIPTORS if d not in ("n_chars", "n_tokens", "n_lines", "lines_per_kchar")]


def described(t):
    """Documents with descriptors, log length as y, the source as group; written once."""
    docs = f.descriptors(t.texts().select("doc_id", "text", "lang", "source"), "text")
    docs = docs.withColumn("y", F.log10("n_chars")).withColumn("grp", F.concat_ws("/", "source", "lang"))
    return cut_lineage(f.to_vector(docs.drop("text"), INPUTS))


def classed(t):
    """Labelled documents with descriptors, quality as class, split 80/20 by class."""
    docs = f.descriptors(t.texts().select("doc_id", "text").join(t.labels, "doc_id"), "text")
    rows = f.to_vector(docs.drop("text"), list(f.DESCRIPTORS)).withColumn("y", F.col("quality").cast("double"))
    return cut_lineage(stratified_split(rows, "doc_id", "quality", 0.2))


@query("l01_mean_baseline", """
    WITH d AS (SELECT doc_id, CAST(n_chars % 5 AS INTEGER) AS fold, log10(n_chars) AS y FROM documents), s AS (SELECT fold, sum(y) AS s, count(y) AS c FROM d GROUP BY 1)
    SELECT doc_id, fold, round((SELECT sum(s) FROM s o WHERE o.fold <> d.fold) / (SELECT sum(c) FROM s o WHERE o.fold <> d.fold), 6) AS y_pred FROM d""")
def mean_baseline(t):
    rows = t.documents.select("doc_id", (F.col("n_chars") % 5).cast("int").alias("fold"), F.log10("n_chars").alias("y"))
    return rounded(m.mean_baseline(rows, "fold", "y").select("doc_id", "fold", "y_pred"), "y_pred")


def _regression(t, estimator):
    """All documents, each scored by the model of the four folds it is not in, against the mean baseline."""
    rows = described(t)
    folds = group_kfold(rows, "doc_id", "grp", 5)
    oof = cut_lineage(m.model_grid(rows, folds, "doc_id", "y", {"descriptors": "features"}, {"model": estimator}))
    table = regression_metrics(oof, ["representation"], "y_true", "y_pred")
    base = table.where("representation = '__baseline__'").select(F.max("rmse")).scalar()
    model = table.where("representation = 'descriptors'")
    return model.select("n", (F.col("rmse") < base).alias("beats_mean"), (F.col("r2") > 0.5).alias("explains_half"))


REGRESSION_SQL = "SELECT count(*) AS n, true AS beats_mean, true AS explains_half FROM documents"


# The operators' defaults are 500 trees or rounds; these queries take fewer to stay within minutes.
@query("l02_forest_regression", REGRESSION_SQL)
def forest_regression(t):
    return _regression(t, lambda v: m.forest_regressor(50, 10, v))


@query("l03_boosted_regression", REGRESSION_SQL)
def boosted_regression(t):
    return _regression(t, lambda v: m.boosted_regressor(10, 4, 0.1, v))


@query("l03_second_order_regression", REGRESSION_SQL)
def second_order_regression(t):
    """Depth 6, curvature-weighted leaves, 80 % of rows and features a round; 12 rounds of step 0.2 in each of five folds."""
    return _regression(t, lambda v: SecondOrderBoosting("doc_id", 12, 6, 0.2, rows=0.8, columns=0.8, features=v))


def _classification(t, estimator, balanced=False, rows=None):
    """The test documents of both classes, and whether scores and labels tell them apart better than chance."""
    rows = classed(t) if rows is None else rows
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    if balanced:
        train = m.balanced_weights(train, "y")
    scored = cut_lineage(m.class_scores(m.fit_score(estimator, train, test), ["doc_id", "quality"]))
    table = classification_metrics(scored, [], "quality", "label_pred")
    auc = roc_auc(scored, [], "quality", "score").select("auc").scalar()
    return table.select(
        (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("tn") + F.col("fp")).alias("n_neg"),
        (auc > 0.6).alias("ranks_better"), (F.col("mcc") > 0).alias("labels_better"),
    )


CLASS_SQL = """SELECT CAST(round(count_if(quality = 1) * 0.2) AS BIGINT) AS n_pos, CAST(round(count_if(quality = 0) * 0.2) AS BIGINT) AS n_neg,
    true AS ranks_better, true AS labels_better FROM labels"""


@query("l04_forest_classification", CLASS_SQL)
def forest_classification(t):
    return _classification(t, m.forest_classifier(trees=20, depth=8), balanced=True)


@query("l05_boosted_classification", CLASS_SQL)
def boosted_classification(t):
    return _classification(t, m.boosted_classifier(rounds=10, depth=4, step=0.1))


@query("l05_second_order_classification", CLASS_SQL)
def second_order_classification(t):
    """Leaf-wise trees of up to 31 leaves and six levels, 80 % of rows and features a round; 60 rounds of step 0.1."""
    return _classification(t, SecondOrderBoosting("doc_id", 60, 6, 0.1, leaves=31, rows=0.8, columns=0.8, classes=True))


@query("l06_margin_classifier", CLASS_SQL)
def margin_classifier(t):
    return _classification(t, m.margin_classifier(50))


def _fingerprinted(t):
    """Labelled documents as 2,048-bit fingerprints, quality as class, split 80/20 by class."""
    docs = t.texts().select("doc_id", "text").join(t.labels, "doc_id")
    rows = f.fingerprint(docs, "text", "features", longest=1).drop("text").withColumn("y", F.col("quality").cast("double"))
    return cut_lineage(stratified_split(rows, "doc_id", "quality", 0.2))


@query("l06_kernel_margin_classifier", CLASS_SQL.replace(", true AS labels_better", ""))
def kernel_margin_classifier(t):
    """The Gaussian kernel machine (C = 8, gamma = 0.001) on fingerprints. Classes are unweighted, so with few rows of
    one class its labels need not beat chance where its scores do; no statement is made about them."""
    return _classification(t, KernelMargin("doc_id"), rows=_fingerprinted(t)).drop("labels_better")


@query("l06_kernel_margin_scores")
def kernel_margin_scores(t):
    """Margin and calibrated probability of every test document."""
    rows = _fingerprinted(t)
    scored = KernelMargin("doc_id").fit(rows.where("split = 'train'")).transform(rows.where("split = 'test'"))
    return m.class_scores(scored, ["doc_id", "quality", "margin"]).withColumnRenamed("score", "probability")


@query("l07_network_classifier", CLASS_SQL)
def network_classifier(t):
    return _classification(t, m.network_classifier([len(f.DESCRIPTORS), 16, 2], 50))


@query("l07_dropout_network_classifier", CLASS_SQL.replace(", true AS labels_better", ""))
def dropout_network_classifier(t):
    """2,048 bits, 750 rectified units with dropout 0.6, one output, 30 epochs of four steps. As with the kernel machine, classes
    are unweighted, so no statement is made about labels."""
    return _classification(t, DropoutNetwork("doc_id", batches=4), rows=_fingerprinted(t)).drop("labels_better")


@query("l07_dropout_network_scores")
def dropout_network_scores(t):
    """Probability and label of every test document."""
    rows = _fingerprinted(t)
    scored = DropoutNetwork("doc_id", batches=4).fit(rows.where("split = 'train'")).transform(rows.where("split = 'test'"))
    return m.class_scores(scored, ["doc_id", "quality"]).withColumnRenamed("score", "probability")


def _grid(t):
    rows = described(t)
    rows = f.fingerprint(rows.join(t.texts().select("doc_id", "text"), "doc_id"), "text", bits=256, longest=1).drop("text")
    folds = group_kfold(rows, "doc_id", "grp", 3)
    return m.model_grid(
        rows, folds, "doc_id", "y",
        {"descriptors": "features", "fingerprint": "fingerprint"},
        {"forest": lambda v: m.forest_regressor(10, 5, v), "boosted": lambda v: m.boosted_regressor(5, 4, 0.1, v)},
    )


@query("l08_model_grid", """
    SELECT representation, algorithm, 0 AS partition, (SELECT count(*) FROM documents) AS n, 3 AS n_folds, representation <> '__baseline__' AS beats_mean
    FROM (VALUES ('descriptors', 'forest'), ('descriptors', 'boosted'), ('fingerprint', 'forest'), ('fingerprint', 'boosted'), ('__baseline__', 'mean')) AS j(representation, algorithm)""")
def model_grid(t):
    """Grid summary: two representations × two algorithms and the baseline, three group folds, each row scored once;
    which jobs have a smaller pooled error than the baseline. A document without text has no length to be wrong about, but counts as scored."""
    oof = _grid(t)
    scored = oof.groupBy(*m.JOB).agg(F.count("y_pred").alias("n"))
    out = cut_lineage(fold_summary(oof, m.JOB, "fold", "y_true", "y_pred").drop("n").join(scored, m.JOB))
    base = out.where("representation = '__baseline__'").select(F.max("rmse_pooled")).scalar()
    return out.select(
        "representation", "algorithm", F.col("partition").cast("int").alias("partition"), "n",
        F.size(F.split("r2_per_fold", ";")).alias("n_folds"), (F.col("rmse_pooled") < base).alias("beats_mean"),
    )


def _checked(importances):
    """Per feature whether its importance is a number; over all, whether the strongest one helps."""
    best = F.max("importance_mean").over(Window.partitionBy())  # one row per feature
    number = F.col("importance_mean").isNotNull() & ~F.isnan("importance_mean") & (F.col("importance_sd") >= 0)
    return importances.select("feature", number.alias("is_number"), (best > 0).alias("strongest_helps"))


IMPORTANCE_SQL = f"""SELECT unnest({INPUTS}) AS feature, n > 0 AS is_number, n > 0 AS strongest_helps FROM (SELECT count(*) AS n FROM documents)"""


@query("l09_impurity_importance", IMPORTANCE_SQL)
def impurity_importance(t):
    rows = described(t)
    folds = group_kfold(rows, "doc_id", "grp", 5)
    return _checked(m.impurity_importance(rows, folds, "doc_id", INPUTS, lambda v: m.forest_regressor(10, 5, v)))


@query("l10_permutation_importance", IMPORTANCE_SQL)
def permutation_importance(t):
    from pyspark.ml.functions import vector_to_array

    rows = described(t).withColumn("x", vector_to_array("features"))
    folds = group_kfold(rows, "doc_id", "grp", 3)
    return _checked(m.permutation_importance(rows, folds, "doc_id", "y", "x", INPUTS, lambda v: m.forest_regressor(10, 5, v), repeats=10))


# Four features of an order line against its log price.
ASSOC = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "year": "year(l_shipdate)"}
LONG_SQL = "lg AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, CAST({e} AS DOUBLE) AS x, l_extendedprice AS y, CAST(month(l_shipdate) AS DOUBLE) AS z FROM lineitem" for n, e in ASSOC.items()) + """),
  rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
     rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry,
     rank() OVER (PARTITION BY feature ORDER BY z) + (count(*) OVER (PARTITION BY feature, z) - 1) / 2.0 AS rz FROM lg),
  c AS (SELECT feature, count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM rk GROUP BY 1),
  p AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS part FROM c)"""


def assoc(t):
    return t.lineitem.select(
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("y"), F.month("l_shipdate").alias("z"),
    )


@query("l11_feature_associations", f"""WITH {LONG_SQL} SELECT feature, n, round(xy, 6) AS rho,
    CASE WHEN xy > 0.05 THEN 'up' WHEN xy < -0.05 THEN 'down' ELSE 'neutral' END AS direction FROM p""")
def feature_associations(t):
    return rounded(m.feature_associations(assoc(t), list(ASSOC), "y"), "rho")


@query("l12_partial_correlation", f"""WITH {LONG_SQL} SELECT feature, n, round(xy, 6) AS rho_xy, round(xz, 6) AS rho_xz, round(yz, 6) AS rho_yz, round(part, 6) AS partial,
    CASE WHEN abs(xy - part) < 0.1 THEN 'signal_holds' ELSE 'partly_explained' END AS verdict FROM p""")
def partial_correlation(t):
    return rounded(m.partial_table(assoc(t), list(ASSOC), "y", "z"), "rho_xy", "rho_xz", "rho_yz", "partial")


@query("l13_confound_screen", f"""WITH {LONG_SQL} SELECT feature, n, round(xz, 6) AS rho_xz, round(xy, 6) AS rho_xy,
    CASE WHEN abs(xz) > 0.3 THEN 'confound_possible' WHEN abs(xz) > 0.15 THEN 'mild_trend' ELSE 'independent' END AS level FROM p""")
def confound_screen(t):
    return rounded(m.confound_screen(assoc(t), list(ASSOC), "y", "z"), "rho_xz", "rho_xy")


@query("l10_ranked_importance", f"""SELECT unnest({INPUTS}) AS feature, n > 0 AS ranked, n > 0 AS direction_of_sign FROM (SELECT count(*) AS n FROM documents)""")
def ranked_importance(t):
    """Impurity, permutation and correlation side by side; whether ranks lie in 1..k and the direction follows the sign."""
    from pyspark.ml.functions import vector_to_array

    rows = cut_lineage(described(t).withColumn("x", vector_to_array("features")))
    folds = cut_lineage(group_kfold(rows, "doc_id", "grp", 3))
    models = {}  # the same forest, folds and features for both importances
    out = m.ranked_importance(
        m.impurity_importance(rows, folds, "doc_id", INPUTS, lambda v: m.forest_regressor(10, 5, v), fitted=models),
        m.permutation_importance(rows, folds, "doc_id", "y", "x", INPUTS, lambda v: m.forest_regressor(10, 5, v), repeats=10, fitted=models),
        m.feature_associations(rows, INPUTS, "y"),
    )
    ranked = F.col("impurity_rank").between(1, len(INPUTS)) & F.col("permutation_rank").between(1, len(INPUTS))
    sign = F.when(F.col("rho") > 0.05, "up").when(F.col("rho") < -0.05, "down").otherwise("neutral")
    return out.select("feature", ranked.alias("ranked"), (F.col("direction") == sign).alias("direction_of_sign"))
