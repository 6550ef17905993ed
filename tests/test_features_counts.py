import numpy as np
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.operators import features as f
from mensura.operators import models as m


def test_fingerprint_counts_its_neighbourhoods(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, ""), (3, "x")], "i int, text string")
    got = f.fingerprint(df, "text", bits=64, count="n").select("i", "n", f.on_bits("fingerprint").alias("b")).collect()
    assert {r.i: r.n for r in got} == {1: 6, 2: 0, 3: 1}
    assert all(min(1, r.n) <= r.b <= r.n for r in got)
    schema = T.StructType([T.StructField("v", VectorUDT())])
    assert spark.createDataFrame([(SparseVector(5, [1, 3], [1.0, 2.0]),)], schema).select(f.on_bits("v")).first()[0] == 2


def test_importances_share_the_models_of_a_fold(spark):
    """Models that the impurity importance has fitted serve the permutation; the losses are those of models fitted anew."""
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(3 * a)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").withColumn("x", F.array("a", "b")).withColumn("features", f.array_vector("x"))
    folds = df.select("id", F.lit(0).alias("partition"), (F.col("id") % 3).cast("int").alias("fold"))
    models, fits = {}, []

    def forest(vector):
        fits.append(vector)
        return m.forest_regressor(5, 3, vector)

    m.impurity_importance(df, folds, "id", ["a", "b"], forest, fitted=models).collect()
    out = m.permutation_importance(df, folds, "id", "y", "x", ["a", "b"], forest, repeats=2, fitted=models)
    got = {r.feature: r.importance_mean for r in out.collect()}
    assert sorted(models) == [0, 1, 2] and len(fits) == 3 and got["a"] > got["b"]


def _partly_labelled(spark):
    """120 rows whose label follows ``a``; three labels are missing."""
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), {5: None, 7: float("nan"), 11: None}.get(i, float(3 * a))) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").withColumn("x", F.array("a", "b")).withColumn("features", f.array_vector("x"))
    return df, df.select("id", F.lit(0).alias("partition"), (F.col("id") % 3).cast("int").alias("fold"))


def test_grid_predicts_rows_without_label(spark):
    df, folds = _partly_labelled(spark)
    algorithms = {"forest": lambda v: m.forest_regressor(5, 3, v), "boosted": lambda v: m.boosted_regressor(2, 2, 0.5, v)}
    out = m.model_grid(df, folds, "id", "y", {"plain": "features"}, algorithms).toPandas()
    assert len(out) == 360 and out.y_pred.notna().all()
    mean = out[(out.representation == "__baseline__") & (out.id == 5)].y_pred.iloc[0]
    labels = {r.id: r.y for r in df.collect() if r.id % 3 != 2 and r.id not in (5, 7, 11)}
    assert abs(mean - sum(labels.values()) / len(labels)) < 1e-9


def test_importances_without_some_labels(spark):
    """The importances are those of the rows with a label."""
    df, folds = _partly_labelled(spark)
    forest = lambda v: m.forest_regressor(5, 3, v)
    whole = df.where("id NOT IN (5, 7, 11)")
    for one in (
        lambda d: m.impurity_importance(d, folds, "id", ["a", "b"], forest),
        lambda d: m.permutation_importance(d, folds, "id", "y", "x", ["a", "b"], forest, repeats=2),
    ):
        got, want = ({r.feature: r.importance_mean for r in one(d).collect()} for d in (df, whole))
        assert got["a"] > got["b"] and all(abs(got[k] - want[k]) < 0.05 for k in want)


def test_fingerprint_of_missing_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "i int, text string")
    got = {r.i: (r.n, r.b) for r in f.fingerprint(df, "text", bits=64, count="n").select("i", "n", f.on_bits("fingerprint").alias("b")).collect()}
    assert got[2] == (0, 0) and got[1][0] == 3
