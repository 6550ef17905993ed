"""Feed-forward classifier with rectified layers and dropout, trained on mini-batches that Spark adds up.

Rows are dealt to batches once, by a hash of their content, and written one folder per batch, so that a step reads
only its own rows. In a step every task adds up the gradients of its rows and the driver moves the weights (Adam).
Dropout masks are hashes of (row, epoch, unit): a task that is tried again drops the same units, and as partial
sums are added in the order of their lane, the same rows and seed give the same weights however they were dealt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows that go through the layers at once, which bounds a task's memory.
CHUNK = 512
#: Lanes of a batch hold about so many rows; there are at most LANES of them, and so many partial sums at a time.
LANE_ROWS = 4096
LANES = 24
#: Pieces of a gradient that are added up apart.
GROUPS = 8


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers with all bits stirred (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dropout_mask(rows: np.ndarray, units: int, share: float, seed: int) -> np.ndarray:
    """Per row and unit 0, or 1 / (1 - share) for units that stay; a function of the row's hash, the unit and the seed."""
    start = mixed(rows.astype("<i8").view("<u8") ^ mixed(np.array([seed], dtype=np.uint64)))
    steps = np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    uniform = (mixed(start[:, None] + steps[None, :]) >> np.uint64(11)) * 2.0**-53
    return (uniform >= share) / (1.0 - share)


def first_weights(sizes: Sequence[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Uniform weights within sqrt(6 / (in + out)) of 0 and biases of 0, per layer."""
    rng = np.random.default_rng(seed)
    bounds = [np.sqrt(6.0 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    return [(rng.uniform(-r, r, (a, b)), np.zeros(b)) for a, b, r in zip(sizes, sizes[1:], bounds)]


def flat(layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def shaped(values: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((values[at : at + a * b].reshape(a, b), values[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def margins(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The last layer's output without dropout."""
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0.0)
    return (x @ layers[-1][0] + layers[-1][1])[:, 0]


def loss_and_gradient(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, n: np.ndarray,
                      masks: Sequence[np.ndarray]) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of rows that count ``n`` times each, and its gradient; one mask per hidden layer."""
    inputs, bent = [x], []
    for (w, b), mask in zip(layers, masks):
        z = inputs[-1] @ w + b
        bent.append((z > 0) * mask)
        inputs.append(z * bent[-1])
    f = (inputs[-1] @ layers[-1][0] + layers[-1][1])[:, 0]
    loss = float((n * (np.logaddexp(0.0, f) - y * f)).sum())
    back = (n * (logistic(f) - y))[:, None]
    slopes = []
    for i in range(len(layers) - 1, -1, -1):
        slopes.append((inputs[i].T @ back, back.sum(axis=0)))
        if i:
            back = (back @ layers[i][0].T) * bent[i - 1]
    return loss, flat(slopes[::-1])


def logistic(f: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -f))


def _summed(rows: DataFrame, weights: np.ndarray, sizes: Sequence[int], dropout: float, seed: int, lanes: int) -> np.ndarray:
    """[loss, number of rows, gradient] over ``rows`` (lane, h, y, n, x).

    Lanes add up in double precision and hand over slices of single precision, which are added up over lanes slice by
    slice: the driver gets one gradient, whatever the number of lanes.
    """
    spark, groups = rows.sparkSession, GROUPS
    sent = spark.sparkContext.broadcast(weights)  # as large as the network, whatever the number of rows

    def tasks(batches):
        layers = shaped(sent.value, sizes)
        sums = {}
        for b in batches:
            lane, h, y, n = (b.column(i).to_numpy() for i in range(4))
            x = b.column(4).flatten().to_numpy().reshape(b.num_rows, -1)
            for one in np.unique(lane):
                own = np.flatnonzero(lane == one)
                for start in range(0, len(own), CHUNK):
                    at = own[start : start + CHUNK]
                    masks = [dropout_mask(h[at], u, dropout, seed + i) for i, u in enumerate(sizes[1:-1])]
                    loss, slope = loss_and_gradient(layers, x[at].astype(float), y[at], n[at], masks)
                    part = np.concatenate([[loss, n[at].sum()], slope])
                    if one in sums:
                        sums[one][1] += part
                    else:
                        sums[one] = [int(h[at[0]]), part]
                        # A task may read several lanes; it holds one sum, since lanes come one after the other.
                        for done in [k for k in sums if k != one]:
                            yield _batch(done, *sums.pop(done), groups)
        for k, (first, part) in sums.items():
            yield _batch(k, first, part, groups)

    def several(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lane", "first"])
        out = frame.iloc[:1].copy()
        out["loss"], out["n"], out["sums"] = frame["loss"].sum(), frame["n"].sum(), [_total(frame["sums"]).astype("<f4").tobytes()]
        return out

    form = "lane int, first long, slice int, loss double, n double, sums binary"
    parts = rows.select("lane", "h", "y", "n", "x").mapInArrow(tasks, form)
    if lanes > 1:
        parts = parts.groupBy("slice").applyInPandas(several, form)
    got = sorted(parts.toArrow().to_pylist(), key=lambda r: (r["slice"], r["lane"], r["first"]))
    sent.destroy()
    slices = [_total([r["sums"] for r in got if r["slice"] == i]) for i in range(groups)]
    return np.concatenate([[sum(r["loss"] for r in got), sum(r["n"] for r in got)], *slices])


def _batch(lane: int, first: int, part: np.ndarray, groups: int) -> pa.RecordBatch:
    """The sums of a lane, one row per slice of the gradient; loss and number of rows go with the first."""
    pieces = [p.astype("<f4").tobytes() for p in np.array_split(part[2:], groups)]
    head = [[float(v)] + [0.0] * (groups - 1) for v in part[:2]]
    columns = [pa.array([int(lane)] * groups, pa.int32()), pa.array([first] * groups, pa.int64()), pa.array(range(groups), pa.int32()),
               pa.array(head[0], pa.float64()), pa.array(head[1], pa.float64()), pa.array(pieces, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["lane", "first", "slice", "loss", "n", "sums"])


def _total(parts) -> np.ndarray:
    total = None
    for p in parts:
        values = np.frombuffer(p, "<f4").astype(float)
        total = values if total is None else total + values
    return total


def known_array(vector: str, kind: str = "float64") -> Column:
    """The entries of a vector column; null where the vector is, which ``vector_to_array`` alone does not take."""
    return F.when(F.col(vector).isNotNull(), vector_to_array(vector, kind))


@dataclass
class NetworkModel:
    """What ``DropoutNetwork.fit`` has learnt. Of training rows with one class only, every row takes that class.

    ``losses`` holds the mean loss of each epoch, with dropout, as the weights moved on.
    """

    layers: list[tuple[np.ndarray, np.ndarray]]
    features: str
    losses: list[float]
    only: float | None = None

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability`` (vector of both classes) and ``prediction`` (0.0 or 1.0, from 0.5 on);
        both are null where the features are."""
        if self.only is not None:
            p = F.when(F.col(self.features).isNotNull(), F.lit(float(self.only)))
        else:
            layers = self.layers

            @F.pandas_udf("double")
            def scored(x: pd.Series) -> pd.Series:
                known = x.notna().to_numpy()
                out = np.full(len(x), np.nan)
                at = np.flatnonzero(known)
                for start in range(0, len(at), CHUNK):
                    some = at[start : start + CHUNK]
                    out[some] = logistic(margins(layers, np.stack(x.iloc[some].to_numpy())))
                return pd.Series(out).where(known, None)

            p = scored(known_array(self.features))
        rows = rows.withColumn("__p", p)
        both = F.when(F.col("__p").isNotNull(), array_to_vector(F.array(1 - F.col("__p"), F.col("__p"))))
        return rows.withColumn("probability", both).withColumn("prediction", (F.col("__p") >= 0.5).cast("double")).drop("__p")


@dataclass
class DropoutNetwork:
    """Settings: widths of the ``hidden`` layers, the share ``dropout`` of their units left out of a step, ``step`` of Adam.

    An epoch is ``batches`` steps (fewer if there are fewer rows), in an order drawn anew; ``batches`` bounds the number of
    jobs, so batches grow with the input. ``key`` names the column that, with label and features, draws batches and
    dropout; rows that agree in all three become one that counts several times. Rows without label (other than 0
    and 1) or features are not learnt from.
    """

    key: str
    hidden: Sequence[int] = (750,)
    dropout: float = 0.6
    epochs: int = 30
    batches: int = 16
    step: float = 0.001
    features: str = "features"
    label: str = "y"
    seed: int = 42

    def fit(self, train: DataFrame) -> NetworkModel:
        spark = train.sparkSession
        known = train.where(F.col(self.label).isin(0, 1) & F.col(self.features).isNotNull()).select(
            F.col(self.key).alias("key"), F.col(self.label).cast("double").alias("y"), known_array(self.features, "float32").alias("x"))
        known = known.withColumn("h", F.xxhash64("key", "y", "x", F.lit(self.seed)))
        rows = known.groupBy("h").agg(F.count(F.lit(1)).cast("double").alias("n"), F.first("y").alias("y"), F.first("x").alias("x"))
        plain = scratch_path(spark, "network-rows")
        rows.write.parquet(plain)
        rows = spark.read.parquet(plain)
        facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.min("y").alias("low"), F.max("y").alias("high")).first()
        if facts["rows"] == 0 or facts["low"] == facts["high"]:
            return NetworkModel([], self.features, [], facts["low"] or 0.0)
        batches = min(self.batches, facts["rows"])
        lanes = max(1, min(LANES, facts["rows"] // batches // LANE_ROWS))
        dealt = scratch_path(spark, "network-batches")
        (
            rows.withColumn("batch", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(batches)).cast("int"))
            .withColumn("lane", F.pmod(F.xxhash64("h", F.lit(2)), F.lit(lanes)).cast("int"))
            .repartition(lanes, "lane").sortWithinPartitions("batch", "lane", "h")
            .write.partitionBy("batch").parquet(dealt)
        )
        whole = spark.read.parquet(dealt)
        # A hash may leave a batch empty; its folder does not exist.
        present = sorted(r["batch"] for r in whole.select("batch").distinct().collect())
        folders = {b: spark.read.schema(whole.drop("batch").schema).parquet(f"{dealt}/batch={b}") for b in present}
        sizes = [len(rows.select("x").first()["x"]), *self.hidden, 1]
        weights = flat(first_weights(sizes, self.seed))
        pace, swing = np.zeros_like(weights), np.zeros_like(weights)
        losses, steps = [], 0
        for epoch in range(self.epochs):
            order = np.random.default_rng([self.seed, epoch]).permutation(present)
            total = np.zeros(2)
            for b in order:
                sums = _summed(folders[int(b)], weights, sizes, self.dropout, self.seed + 1000 * (epoch + 1), lanes)
                total += sums[:2]
                slope = sums[2:] / sums[1]
                steps += 1
                pace = 0.9 * pace + 0.1 * slope
                swing = 0.999 * swing + 0.001 * slope * slope
                weights = weights - self.step * (pace / (1 - 0.9**steps)) / (np.sqrt(swing / (1 - 0.999**steps)) + 1e-7)
            losses.append(float(total[0] / total[1]))
        return NetworkModel(shaped(weights, sizes), self.features, losses)
