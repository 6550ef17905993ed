"""The kernel margin classifier against the exact kernel, on a ring that no line divides, and on odd training rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mensura.operators import kernel, models
from mensura.operators.metrics import roc_auc


def ring(spark, n=600, seed=3):
    """Points inside a ring (class 1) and on it (class 0), with keys beyond the whole numbers of a double."""
    rng = np.random.default_rng(seed)
    angle, inner = rng.uniform(0, 2 * np.pi, n), rng.random(n) < 0.5
    radius = np.where(inner, rng.uniform(0, 1, n), rng.uniform(1.6, 2.4, n))
    data = [((1 << 60) + i, [float(r * np.cos(a)), float(r * np.sin(a))], float(c)) for i, (r, a, c) in enumerate(zip(radius, angle, inner))]
    return spark.createDataFrame(data, "k long, x array<double>, y double").withColumn("features", array_to_vector("x"))


def test_descriptions_multiply_to_the_kernel():
    rng = np.random.default_rng(1)
    marks, others = rng.standard_normal((40, 3)), rng.standard_normal((25, 3))
    k = kernel.gaussian(others, marks, 0.3)
    far = ((others[:, None] - marks[None]) ** 2).sum(axis=2)
    assert np.allclose(k, np.exp(-0.3 * far))
    phi = kernel.gaussian(marks, marks, 0.3) @ kernel.landmark_map(marks, 0.3)
    assert np.allclose(phi @ phi.T, kernel.gaussian(marks, marks, 0.3), atol=1e-5)


def test_a_ring_needs_the_kernel(spark):
    rows = ring(spark)
    train, test = rows.where("k % 4 <> 0"), rows.where("k % 4 = 0")
    machine = kernel.KernelMargin("k", c=8.0, gamma=0.5, landmarks=40, folds=2)
    scored = models.class_scores(machine.fit(train.repartition(3)).transform(test), ["k", "y", "margin"]).cache()
    own = roc_auc(scored, [], "y", "score").first().auc
    line = models.class_scores(models.fit_score(models.margin_classifier(50), train, test), ["y"])
    assert own > 0.99 and roc_auc(line, [], "y", "score").first().auc < 0.75
    # Probabilities are calibrated: they beat the base rate by far and agree with the labels on average.
    p, y = (np.array(c) for c in zip(*[(r.score, r.y) for r in scored.collect()]))
    assert ((p - y) ** 2).mean() < 0.05 and abs(p.mean() - y.mean()) < 0.08
    # Landmarks, folds and so all numbers hang on the keys, not on how rows are dealt.
    again = machine.fit(train.repartition(7)).transform(test).select("k", "margin")
    both = scored.select("k", F.col("margin").alias("m")).join(again, "k").select(F.max(F.abs(F.col("m") - F.col("margin")))).first()[0]
    assert both < 1e-3


def test_margins_are_those_of_the_exact_machine(spark):
    """With every row a landmark, the loss is at most a little above what a long plain descent reaches."""
    rows = ring(spark, 60, 8)
    c, gamma = 2.0, 0.7
    machine = kernel.KernelMargin("k", c=c, gamma=gamma, landmarks=60, folds=2)
    model = machine.fit(rows)
    data = rows.orderBy("k").collect()
    x, y = np.array([r.x for r in data]), np.array([2 * r.y - 1 for r in data])
    k = kernel.gaussian(x, x, gamma)

    def loss(alpha, bias):
        f = k @ alpha + bias
        return 0.5 * alpha @ k @ alpha + c * np.maximum(0, 1 - y * f).sum()

    alpha, bias, best = np.zeros(60), 0.0, np.inf
    for step in range(1, 40_001):
        short = (y * (k @ alpha + bias) < 1) * y
        alpha = alpha - (alpha - c * short) / step
        bias += 0.5 * c * short.sum() / step
        if step % 50 == 0:
            best = min(best, loss(alpha, bias))
    got = {r.k: r.margin for r in model.transform(rows).collect()}
    f = np.array([got[r.k] for r in data])
    mine = 0.5 * model.weights @ model.weights + c * np.maximum(0, 1 - y * f).sum()
    assert mine <= best * 1.03


@pytest.mark.parametrize("data,want", [([], 0.0), ([(1, [0.0], 1.0), (2, [1.0], 1.0)], 1.0), ([(1, [0.0], 0.0), (2, None, 1.0), (3, [2.0], None)], 0.0)])
def test_one_class_or_no_rows(spark, data, want):
    rows = spark.createDataFrame(data, "k long, x array<double>, y double")
    rows = rows.withColumn("features", F.when(F.col("x").isNotNull(), array_to_vector(F.coalesce("x", F.array(F.lit(0.0))))))
    test = spark.createDataFrame([(9, [0.5])], "k long, x array<double>").withColumn("features", array_to_vector("x"))
    got = kernel.KernelMargin("k").fit(rows).transform(test)
    assert got.first().prediction == want and models.class_scores(got, ["k"]).first().score == want
