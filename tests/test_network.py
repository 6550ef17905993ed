"""The dropout network: gradient against finite differences, one epoch against a plain version, repeats, odd rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mensura.operators import models, network
from mensura.operators.metrics import roc_auc

from test_kernel import ring


def test_gradient_is_the_finite_difference():
    rng = np.random.default_rng(5)
    sizes = [4, 6, 3, 1]
    x, y, n = rng.standard_normal((9, 4)), (rng.random(9) < 0.5).astype(float), rng.integers(1, 4, 9).astype(float)
    masks = [network.dropout_mask(np.arange(9), u, 0.4, 7 + i) for i, u in enumerate(sizes[1:-1])]
    at = network.flat(network.first_weights(sizes, 3)) + 0.05 * rng.standard_normal(4 * 6 + 6 + 6 * 3 + 3 + 3 + 1)

    def loss(w):
        return network.loss_and_gradient(network.shaped(w, sizes), x, y, n, masks)[0]

    slope = network.loss_and_gradient(network.shaped(at, sizes), x, y, n, masks)[1]
    for i in range(len(at)):
        e = np.zeros(len(at))
        e[i] = 1e-6
        assert slope[i] == pytest.approx((loss(at + e) - loss(at - e)) / 2e-6, abs=1e-5)


def test_masks_hang_on_row_unit_and_seed():
    rows = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 2000)
    mask = network.dropout_mask(rows, 50, 0.6, 11)
    assert set(np.unique(mask)) == {0.0, 1 / (1 - 0.6)} and abs((mask > 0).mean() - 0.4) < 0.01
    assert abs(np.corrcoef(mask[:, 0], mask[:, 1])[0, 1]) < 0.1
    assert (network.dropout_mask(rows[::-1], 50, 0.6, 11) == mask[::-1]).all()
    assert (network.dropout_mask(rows, 50, 0.6, 12) != mask).any()
    assert (network.dropout_mask(rows, 3, 0.0, 1) == 1).all()


def test_a_ring_is_learnt_and_repeats(spark):
    rows = ring(spark, 400)
    train, test = rows.where("k % 4 <> 0"), rows.where("k % 4 = 0")
    net = network.DropoutNetwork("k", hidden=(32,), dropout=0.1, epochs=25, batches=4, step=0.03)
    model = net.fit(train.repartition(3))
    assert model.losses[-1] < 0.5 * model.losses[0]
    scored = models.class_scores(model.transform(test), ["k", "y"])
    assert roc_auc(scored, [], "y", "score").first().auc > 0.98
    # The same rows, dealt in another way: the same weights, bit by bit.
    again = net.fit(train.repartition(7, "y"))
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(model.layers, again.layers))


def test_one_epoch_is_the_plain_one(spark, monkeypatch):
    """With many lanes, whose sums are added in groups, and repeated rows, weights are those of a plain loop."""
    monkeypatch.setattr(network, "LANE_ROWS", 2)
    monkeypatch.setattr(network, "GROUPS", 2)
    monkeypatch.setattr(network, "CHUNK", 3)
    rows = ring(spark, 60, 4)
    rows = rows.union(rows.where("k % 3 = 0"))
    net = network.DropoutNetwork("k", hidden=(5, 4), dropout=0.3, epochs=2, batches=3, step=0.01)
    got = net.fit(rows)
    data = (
        rows.select("y", F.col("x").cast("array<float>").alias("x"), F.xxhash64("k", "y", F.col("x").cast("array<float>"), F.lit(42)).alias("h"))
        .withColumn("batch", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(3))).collect()
    )
    sizes = [2, 5, 4, 1]
    w = network.flat(network.first_weights(sizes, 42))
    pace, swing, steps = 0 * w, 0 * w, 0
    for epoch in range(2):
        for b in np.random.default_rng([42, epoch]).permutation([0, 1, 2]):
            own = [r for r in data if r.batch == b]
            h, x, y = np.array([r.h for r in own]), np.array([r.x for r in own]), np.array([r.y for r in own])
            masks = [network.dropout_mask(h, u, 0.3, 42 + 1000 * (epoch + 1) + i) for i, u in enumerate((5, 4))]
            slope = network.loss_and_gradient(network.shaped(w, sizes), x, y, np.ones(len(y)), masks)[1] / len(y)
            steps += 1
            pace, swing = 0.9 * pace + 0.1 * slope, 0.999 * swing + 0.001 * slope**2
            w = w - 0.01 * (pace / (1 - 0.9**steps)) / (np.sqrt(swing / (1 - 0.999**steps)) + 1e-7)
    assert np.allclose(network.flat(got.layers), w, atol=1e-9)


def test_odd_training_rows(spark):
    rows = ring(spark, 40)
    net = network.DropoutNetwork("k", hidden=(3,), epochs=1, batches=50)
    assert net.fit(rows.limit(0)).transform(rows).select("prediction").distinct().collect() == [(0.0,)]
    only = net.fit(rows.where("y = 1")).transform(rows)
    assert only.select("prediction").distinct().collect() == [(1.0,)]
    # Rows without label, with another one, or without features teach nothing; those without features get no score.
    shaky = rows.withColumn("features", F.when(F.col("k") % 5 > 0, F.col("features"))).withColumn("y", F.when(F.col("k") % 7 > 0, F.col("y")))
    out = net.fit(shaky).transform(shaky).select("k", "probability", "prediction").collect()
    assert all((r.probability is None) == (r.k % 5 == 0) == (r.prediction is None) for r in out) and len(out) == 40
    empty = spark.createDataFrame([], "k long, x array<double>").withColumn("features", array_to_vector("x"))
    assert net.fit(rows).transform(empty).count() == 0


def test_a_step_sends_one_gradient_to_the_driver(spark, monkeypatch):
    """Whatever the number of lanes, a step brings one number of single precision per weight."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(network, "LANE_ROWS", 4)
    got, real = [], DataFrame.toArrow

    def counted(self):
        table = real(self)
        got.append(sum(len(x) for x in table.column("sums").to_pylist()))
        return table

    monkeypatch.setattr(DataFrame, "toArrow", counted)
    network.DropoutNetwork("k", hidden=(40,), epochs=2, batches=2).fit(ring(spark, 200))
    assert got == [4 * (2 * 40 + 40 + 40 + 1)] * 4
