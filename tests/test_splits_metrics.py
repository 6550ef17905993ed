import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.operators import metrics as m
from mensura.operators import splits as s
from mensura.operators.expect import ExpectationError, enforce, no_leakage


def greedy(sizes, weights):
    loads = [0] * len(weights)
    for size in sorted((x for x, n in sizes for _ in range(n)), reverse=True):
        i = min(range(len(weights)), key=lambda j: (loads[j] / weights[j], j))
        loads[i] += size
    return loads


@pytest.mark.parametrize("seed", range(30))
def test_bulk_fill_equals_one_by_one(seed):
    rng = random.Random(seed)
    k = rng.choice([2, 3, 5, 7])
    sizes = [(x, rng.randrange(1, 30)) for x in rng.sample(range(1, 60), rng.randrange(1, 12))]
    runs = s.fill_lightest(sizes, [1] * k)
    loads = [0] * k
    for size, fold, first, stop in runs:
        loads[fold] += size * (stop - first)
    assert loads == greedy(sizes, [1] * k)
    for size, many in sizes:
        spots = sorted((a, b) for z, _, a, b in runs if z == size)
        assert spots[0][0] == 0 and spots[-1][1] == many and all(x[1] == y[0] for x, y in zip(spots, spots[1:]))


@pytest.mark.parametrize("path", ["plain", "hot"])
def test_group_kfold_has_no_leaks(spark, request, path):
    if path == "hot":
        request.getfixturevalue("slots_only")
    rows = [(i, "giant" if i % 3 == 0 else f"g{i % 101}") for i in range(900)]
    df = spark.createDataFrame(rows, "k int, g string")
    folds = s.group_kfold(df, "k", "g", 5, partitions=2).cache()
    enforce(no_leakage(folds, "k", "g", 5))
    assert folds.count() == 1800
    sizes = {r.fold: r.n_rows for r in s.fold_sizes(folds, "g").where("partition = 0").collect()}
    assert max(sizes.values()) == 300 and len(sizes) == 5
    a = {(r.partition, r.k): r.fold for r in folds.collect()}
    b = {(r.partition, r.k): r.fold for r in s.group_kfold(df.repartition(6), "k", "g", 5, partitions=2).collect()}
    assert a == b and any(a[0, k] != a[1, k] for k, _ in rows)


def test_group_kfold_refuses_bad_groups(spark):
    few = spark.createDataFrame([(1, "a"), (2, "b")], "k int, g string")
    with pytest.raises(ValueError):
        s.group_kfold(few, "k", "g", 3)
    blank = spark.createDataFrame([(1, "a"), (2, " ")], "k int, g string")
    with pytest.raises(ExpectationError):
        s.group_kfold(blank, "k", "g", 2)


def test_stratified_and_inner(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(403)], "k int, y boolean")
    sizes = {(r.y, r.split): r["count"] for r in s.stratified_split(df, "k", "y").groupBy("y", "split").count().collect()}
    assert sizes[True, "test"] == round(101 * 0.2) and sizes[False, "test"] == round(302 * 0.2)
    folds = s.stratified_kfold(df, "k", "y", 10)
    per = folds.groupBy("y", "fold").count().collect()
    for y in (True, False):
        counts = [r["count"] for r in per if r.y == y]
        assert len(counts) == 10 and max(counts) - min(counts) <= 1
    inner = s.inner_validation(folds, "k", "fold", 10).toPandas()
    assert len(inner) == 403 * 9
    for _, part in inner.groupby("outer_fold"):
        assert (part.role == "validation").sum() == math.floor(0.15 * len(part))


def test_group_split_shares(spark):
    df = spark.createDataFrame([(i, f"g{i % 97}") for i in range(970)], "k int, g string")
    out = s.group_split(df, "k", "g").toPandas()
    assert len(out) == 970 and (out.groupby("g")["split"].nunique() == 1).all()
    assert abs((out.split == "train").sum() - 776) <= 10 and abs((out.split == "val").sum() - 97) <= 10


def test_regression_and_fold_summary(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"rep": ["a"] * 60 + ["b"] * 60, "fold": list(range(3)) * 40, "y": rng.normal(size=120)})
    pdf["p"] = pdf.y + rng.normal(size=120) / 2
    pdf.loc[pdf.rep == "b", "p"] = 0.5
    out = m.fold_summary(spark.createDataFrame(pdf), ["rep"], "fold", "y", "p").toPandas().set_index("rep")
    for rep, part in pdf.groupby("rep"):
        r2 = lambda d: 1 - ((d.y - d.p) ** 2).sum() / ((d.y - d.y.mean()) ** 2).sum()
        folds = [r2(d) for _, d in part.groupby("fold")]
        assert out.loc[rep, "r2_pooled"] == pytest.approx(r2(part))
        assert out.loc[rep, "r2_foldmean"] == pytest.approx(np.mean(folds))
        assert out.loc[rep, "r2_foldsd"] == pytest.approx(np.std(folds, ddof=1))
        assert out.loc[rep, "r2_per_fold"] == ";".join(f"{v:.4f}" for v in folds)
    assert math.isnan(out.loc["b", "rho_pooled"]) and math.isnan(out.loc["b", "rho_foldmean"])


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(1)
    n = 800
    y = rng.normal(10, 1, size=n)
    pdf = pd.DataFrame({"k": range(n), "y": y, "p": y + rng.normal(size=n) * 0.7, "l": (y > 10).astype(int)})
    df = spark.createDataFrame(pdf)
    row = m.bootstrap_r2(df, "k", "y", "p", 400).first()
    boot = []
    for _ in range(2000):
        i = rng.integers(0, n, n)
        boot.append(1 - ((pdf.y - pdf.p).to_numpy()[i] ** 2).sum() / (n * y[i].var()))
    low, high = np.percentile(boot, [2.5, 97.5])
    assert row.n_replicates == 400 and row.ci_low == pytest.approx(low, abs=0.02) and row.ci_high == pytest.approx(high, abs=0.02)
    assert m.bootstrap_r2(df.repartition(3), "k", "y", "p", 400).first() == pytest.approx(row)
    a = m.bootstrap_auc(df, "l", "p", 300).first()
    b = m.bootstrap_auc(df, "l", "p", 300, slot_rows=50).first()
    auc = m.roc_auc(df, [], "l", "p").first().auc
    for r in (a, b):
        assert r.n_replicates == 300 and r.ci_low < auc < r.ci_high and r.ci_high - r.ci_low < 0.1
    assert a.ci_low == pytest.approx(b.ci_low, abs=0.02)


def test_confusion_zero_guard_and_leaderboard(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "y int, p int")
    row = m.classification_metrics(df, [], "y", "p").first()
    assert (row.tpr, row.tnr, row.npv, row.fpr, row.mcc) == (pytest.approx(2 / 3), 0.0, 0.0, 0.0, 0.0)
    table = spark.createDataFrame([("a", 0.2), ("b", 0.5)], "label string, r2 double")
    got = {r.label: (round(r.delta, 9), r.is_best) for r in m.leaderboard(table, "label", "r2", "a").collect()}
    assert got == {"a": (0.0, False), "b": (0.3, True)}
    assert m.metric_stability(table.withColumn("x", F.lit(1)), ["x"], "r2").first().highest == 0.5


def test_class_fold_summary_leaves_one_class_folds_out(spark):
    rows = [(0, 0, 0.1), (0, 1, 0.9), (0, 1, 0.4), (1, 0, 0.6), (1, 1, 0.7), (2, 1, 0.2), (2, 1, 0.8)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, fold int, y int, s double")
    row = m.class_fold_summary(df, ["k"], "fold", "y", "s").first()
    mcc = [(1 * 1 - 0 * 1) / math.sqrt(1 * 2 * 1 * 2), 0.0]
    assert (row.n_folds, row.auc_foldmean, row.auc_foldsd) == (2, 1.0, 0.0)
    assert row.mcc_foldmean == pytest.approx(np.mean(mcc)) and row.mcc_foldsd == pytest.approx(np.std(mcc))


def test_number_of_hash_slots_changes_nothing(spark, monkeypatch):
    from mensura.operators import ordering

    df = spark.range(500).withColumn("g", F.col("id") % 37)
    found = []
    for bits in (1, 8, 16):
        monkeypatch.setattr(ordering, "hash_bits", lambda _, b=bits: b)
        order = ordering.seeded_permutation(df, "id", 3)
        folds = s.group_kfold(df, "id", "g", 5)
        found.append((sorted(map(tuple, order.collect())), sorted(map(str, folds.collect()))))
    assert found[0] == found[1] == found[2]


def test_ranks_of_few_values_are_sent_to_the_rows(spark, slots_only, monkeypatch):
    """In large groups no rank is joined to the rows by a shuffle, unless all columns have many values; the sums agree."""
    import numpy as np

    from mensura.operators import metrics

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 600), "x": rng.integers(0, 9, 600).astype(float), "y": rng.normal(size=600).round(2), "z": rng.integers(1, 5, 600)})
    pdf["y"] += pdf["x"] / 5
    pdf.loc[:5, "x"] = None
    df = spark.createDataFrame(pdf)
    want = {}
    for k, part in pdf.dropna().groupby("k"):
        r = part[["x", "y", "z"]].rank().corr()
        xy, xz, yz = r.loc["x", "y"], r.loc["x", "z"], r.loc["y", "z"]
        want[k] = (len(part), xy, xz, yz, (xy - xz * yz) / np.sqrt((1 - xz**2) * (1 - yz**2)))

    def check():
        got = metrics.partial_spearman(df, ["k"], "x", "y", "z").select("k", "n", "rho_xy", "rho_xz", "rho_yz", "partial").collect()
        assert {r[0]: pytest.approx(tuple(r)[1:], abs=1e-9) for r in got} == {k: v for k, v in want.items()}
        assert metrics.spearman(df, ["k"], "y", "x").count() == 2

    def refused(*_):
        raise AssertionError("joined to large tables")

    with monkeypatch.context() as m:
        m.setattr(metrics, "joint_ranks", refused)
        check()
    monkeypatch.setattr(metrics, "BROADCAST_ROW_LIMIT", 2)
    check()
    constant = metrics.spearman(df.withColumn("z", F.lit(1)), ["k"], "y", "z").collect()
    assert [r.rho for r in constant] == [None, None]
