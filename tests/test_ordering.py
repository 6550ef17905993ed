import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.operators import ordering as o
from mensura.operators.joins import hot_key_lookup
from mensura.operators.metrics import partial_spearman, roc_auc, spearman


def skewed(n=3000, seed=5):
    """One key with a third of all rows and one value with a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        value = 7.5 if rng.random() < 0.34 else round(rng.gauss(0, 3), 2)
        rows.append((i, key, value, rng.randrange(2), round(rng.random(), 2)))
    return pd.DataFrame(rows, columns=["i", "key", "value", "label", "z"])


@pytest.mark.parametrize("path", ["window", "slots"])
def test_ranks_and_percentiles(spark, request, path):
    if path == "slots":
        request.getfixturevalue("slots_only")
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    want = pdf.assign(r=pdf.groupby("key")["value"].rank()).set_index("i")["r"]
    got = o.rows_with_rank(df, "value", ["key"]).toPandas().set_index("i")["rank"]
    assert len(got) == len(pdf) and (got.sort_index() == want.sort_index()).all()
    all_got = o.rows_with_rank(df, "value").toPandas().set_index("i")["rank"]
    assert (all_got.sort_index() == pdf.set_index("i")["value"].rank()).all()
    assert all_got.sum() == len(pdf) * (len(pdf) + 1) / 2
    pct = o.percentiles(df, "value", ["key"], {"a": 0.025, "m": 0.5, "b": 0.975}).toPandas().set_index("key")
    for key, part in pdf.groupby("key")["value"]:
        assert np.allclose(pct.loc[key].to_numpy(dtype=float), np.percentile(part, [2.5, 50, 97.5]))


@pytest.mark.parametrize("path", ["window", "slots"])
def test_correlation_and_auc(spark, request, path):
    if path == "slots":
        request.getfixturevalue("slots_only")
    pdf = skewed(1500)
    df = spark.createDataFrame(pdf)
    got = spearman(df, ["key"], "value", "z").toPandas().set_index("key")["rho"]
    for key, part in pdf.groupby("key"):
        want = part["value"].rank().corr(part["z"].rank())
        assert got[key] == pytest.approx(want, abs=1e-9)
    row = partial_spearman(df, [], "value", "z", "i").first()
    x, y, z = (pdf[c].rank() for c in ("value", "z", "i"))
    design = np.column_stack([z, np.ones(len(z))])
    res = [v - design @ np.linalg.lstsq(design, v, rcond=None)[0] for v in (x, y)]
    assert row.partial == pytest.approx(np.corrcoef(*res)[0, 1], abs=1e-9)
    auc = roc_auc(df, [], "label", "value").first().auc
    pos, neg = pdf[pdf.label == 1].value.to_numpy(), pdf[pdf.label == 0].value.to_numpy()
    pairs = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert auc == pytest.approx(pairs / (len(pos) * len(neg)), abs=1e-12)
    flipped = roc_auc(df.selectExpr("label", "-value AS value"), [], "label", "value").first().auc
    assert flipped == pytest.approx(1 - auc, abs=1e-12)


def test_constant_and_single_class(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 1.0, 1)], "x double, y double, l int")
    assert spearman(df, [], "x", "y").first().rho is None
    assert roc_auc(df, [], "l", "x").first().auc is None


@pytest.mark.parametrize("path", ["window", "slots"])
def test_positions_split_a_frequent_value(spark, request, path):
    if path == "slots":
        request.getfixturevalue("slots_only")
    pdf = skewed()
    placed = o.positions(spark.createDataFrame(pdf), "value", ["i"], [], "p").toPandas()
    assert sorted(placed["p"]) == list(range(len(pdf)))
    assert placed.sort_values("p")["value"].is_monotonic_increasing


def test_frequent_value_gets_several_slots(spark):
    df = spark.createDataFrame(skewed())
    slotted, _ = o.with_row_slots(df, "value", ["i"], slots=16)
    sizes = [r["count"] for r in slotted.groupBy("__slot").count().collect()]
    assert max(sizes) < len(skewed()) / 6


def test_cumulative_share_permutation_keep_one(spark):
    pdf = pd.DataFrame({"k": range(200), "w": [1] * 150 + list(range(2, 52))})
    run = o.cumulative_share(spark.createDataFrame(pdf), "k", "w").toPandas().sort_values("position")
    assert list(run["position"]) == list(range(1, 201)) and run["w"].is_monotonic_decreasing
    assert list(run["cumulative"]) == list(run["w"].cumsum()) and run["share"].iloc[-1] == pytest.approx(1.0)
    df = spark.createDataFrame(pdf)
    first = {r.k: r.position for r in o.seeded_permutation(df, "k", 1).collect()}
    again = {r.k: r.position for r in o.seeded_permutation(df.repartition(5), "k", 1).collect()}
    other = {r.k: r.position for r in o.seeded_permutation(df, "k", 2).collect()}
    assert first == again and first != other and sorted(first.values()) == list(range(1, 201))
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(tuple(r) for r in o.keep_one(rows, ["k"], ["o"]).collect()) == [("a", 1, "y"), ("b", 3, None)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_lookup_equals_join(spark, how):
    pdf = skewed(2000)
    rows = spark.createDataFrame(pdf).selectExpr("i", "CASE WHEN i % 50 = 0 THEN NULL ELSE key END AS key")
    table = spark.createDataFrame([(f"k{j}", j) for j in range(0, 40, 2)] + [("hot", -1)], "key string, v int")
    plain = Counter(tuple(r) for r in rows.join(table, "key", how).select("i", "key", "v").collect())
    safe = Counter(tuple(r) for r in hot_key_lookup(rows, table, ["key"], how, hot_rows=100).select("i", "key", "v").collect())
    assert plain == safe


def test_sample_is_repeatable_and_excludes(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    known = spark.range(100).withColumnRenamed("id", "k")
    a = {r.k for r in o.seeded_sample(df, known, "k", 56, 3).collect()}
    b = {r.k for r in o.seeded_sample(df.repartition(7), known, "k", 56, 3).collect()}
    assert a == b and len(a) == 56 and min(a) >= 100


@pytest.mark.parametrize("kind", ["double", "string"])
def test_positions_agree_beyond_the_window(spark, monkeypatch, kind):
    """NULL, NaN, infinite and text values, and NULL keys, are numbered alike on both paths."""
    values = [None, None, 1.0, 2.0, 2.0, float("inf"), float("-inf"), float("nan"), 0.5] * 6
    rows = [(i, "a" if i % 3 else None, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    if kind == "string":
        df = df.withColumn("v", F.concat(F.lit("né"), F.col("v").cast("string"), F.lit(" text")))
    small = {r["id"]: r["at"] for r in o.positions(df, "v", ["id"], ["g"], "at").collect()}
    monkeypatch.setattr(o, "WINDOW_ROWS", 0)
    large = {r["id"]: r["at"] for r in o.positions(df, "v", ["id"], ["g"], "at").collect()}
    assert len(small) == len(rows) and small == large


def test_rows_without_label_are_split_too(spark):
    from mensura.operators import splits

    df = spark.range(20).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("y"))
    assert splits.stratified_split(df, "k", "y").count() == 20
    assert splits.stratified_kfold(df, "k", "y", 5).count() == 20
