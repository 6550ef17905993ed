"""Second-order boosting against a plain recursive version that grows leaf by leaf, and on odd rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mensura.operators import boosting, models
from mensura.operators.metrics import roc_auc


def table(spark, n, seed, classes=False, holes=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, 4)), 1)
    x[:, 3] = rng.integers(0, 3, n)
    target = 2 * (x[:, 0] > 0.3) + x[:, 1] * x[:, 3] + 0.1 * rng.standard_normal(n)
    x[rng.random(x.shape) < holes] = np.nan
    y = (target > 1).astype(float) if classes else target
    data = [((1 << 60) + i, [float(v) for v in r], float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "k long, x array<double>, y double").withColumn("features", array_to_vector("x"))


def plain(s, edges, x, y):
    """Scores of the training rows after all rounds: per leaf every (feature, value, side of missing) is tried on the rows."""
    base = y.mean() if not s.classes else np.log(y.mean() / (1 - y.mean()))
    score = np.full(len(y), base)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y, p * (1 - p)) if s.classes else (score - y, np.ones(len(y)))

        def best(rows, depth):
            if depth == s.depth:
                return None
            found = None
            whole = g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
            for f, cuts in enumerate(edges):
                gone = np.isnan(x[rows, f])
                for missing in (False, True)[: 1 + gone.any()]:
                    for cut in [*cuts, np.inf]:
                        left = np.where(gone, missing, x[rows, f] <= cut)
                        a, b = rows[left], rows[~left]
                        if h[a].sum() < s.least or h[b].sum() < s.least or not len(a) or not len(b):
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + s.l2) + g[b].sum() ** 2 / (h[b].sum() + s.l2) - whole
                        if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                            found = (gain, a, b)
            return found

        leaves = [(np.arange(len(y)), 0)]
        splits = [best(*leaves[0])]
        while len(leaves) < (s.leaves or 10**9):
            able = [i for i, found in enumerate(splits) if found]
            if not able:
                break
            i = max(able, key=lambda j: splits[j][0])
            (_, a, b), (_, depth) = splits.pop(i), leaves.pop(i)
            for side in (a, b):
                leaves.append((side, depth + 1))
                splits.append(best(side, depth + 1))
        move = np.zeros(len(y))
        for rows, _ in leaves:
            move[rows] = -s.step * g[rows].sum() / (h[rows].sum() + s.l2)
        score = score + move
    return score


@pytest.mark.parametrize("classes,leaves,holes", [(False, None, 0.0), (False, 5, 0.2), (True, 4, 0.1)])
def test_trees_are_those_of_a_plain_version(spark, monkeypatch, classes, leaves, holes):
    monkeypatch.setattr(boosting, "SEGMENT", 2)
    monkeypatch.setattr(boosting, "CHUNK", 7)
    monkeypatch.setattr(boosting, "GROUPS", 2)
    rows = table(spark, 120, 3, classes, holes)
    machine = boosting.SecondOrderBoosting("k", rounds=5, depth=3, step=0.3, leaves=leaves, l2=0.5, least=1.0, bins=10, classes=classes)
    model = machine.fit(rows.repartition(5))
    data = rows.collect()
    x, y = np.array([r.x for r in data]), np.array([r.y for r in data])
    got = {r[0]: r[1] for r in model.transform(rows).select("k", "margin" if classes else "y_pred").collect()}
    assert np.allclose([got[r.k] for r in data], plain(machine, model.edges, x, y), atol=1e-5)
    if leaves:
        assert max(sum(f < 0 for f in t.feature) for t in model.trees) <= leaves
    # Whole-number sums: the same trees however rows are dealt.
    again = machine.fit(rows.repartition(2))
    assert [t.__dict__ for t in model.trees] == [t.__dict__ for t in again.trees]


def test_one_split_by_hand(spark):
    data = [(i, [float(i)], v) for i, v in enumerate([1.0, 1.0, 1.0, 5.0])]
    rows = spark.createDataFrame(data, "k long, x array<double>, y double").withColumn("features", array_to_vector("x"))
    model = boosting.SecondOrderBoosting("k", rounds=1, depth=1, step=1.0, l2=1.0).fit(rows)
    # The mean is 2; leaves of 3 and 1 rows move by 3 * -1 / (3 + 1) and 3 / (1 + 1).
    assert [r.y_pred for r in model.transform(rows).orderBy("k").collect()] == pytest.approx([1.25, 1.25, 1.25, 3.5])


def test_better_with_rounds_and_with_draws(spark):
    rows = table(spark, 800, 9, classes=True)
    train, test = rows.where("k % 4 <> 0"), rows.where("k % 4 = 0")
    machine = boosting.SecondOrderBoosting("k", rounds=15, depth=4, step=0.3, rows=0.8, columns=0.8, classes=True)
    scored = models.class_scores(machine.fit(train).transform(test), ["k", "y"])
    assert roc_auc(scored, [], "y", "score").first().auc > 0.97
    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    assert abs(boosting.drawn(h, 0.8, 5).mean() - 0.8) < 0.02 and boosting.drawn(h, 1.0, 5).all()


def test_odd_training_rows(spark):
    rows = table(spark, 40, 1)
    machine = boosting.SecondOrderBoosting("k", rounds=2, depth=2)
    assert machine.fit(rows.limit(0)).transform(rows).select("y_pred").distinct().collect() == [(0.0,)]
    flat = rows.withColumn("y", F.lit(3.0))
    assert machine.fit(flat).transform(rows).select("y_pred").distinct().collect() == [(3.0,)]
    shaky = rows.withColumn("features", F.when(F.col("k") % 5 > 0, F.col("features")))
    shaky = shaky.withColumn("y", F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 7 == 1, float("nan")).otherwise(F.col("y")))
    out = machine.fit(shaky).transform(shaky).select("k", "y_pred").collect()
    assert len(out) == 40 and all((r.y_pred is None) == (r.k % 5 == 0) for r in out)
    one = boosting.SecondOrderBoosting("k", rounds=2, classes=True).fit(rows.withColumn("y", F.lit(1)))
    assert one.transform(rows).select("prediction").distinct().collect() == [(1.0,)]
