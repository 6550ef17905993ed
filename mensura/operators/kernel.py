"""Margin classifier with a Gaussian kernel and calibrated probabilities.

A kernel machine needs the kernel of all pairs of rows; here it is replaced by its Nyström form. A bounded
number of landmark rows is drawn by a hash of the key, and a row is described by its kernel values with them,
times the inverse root of the landmarks' own kernel matrix, so that products of two descriptions are the kernel
(exactly for landmarks, and the better for others the more there are). On these the hinge loss is minimised by
Newton steps whose sums Spark adds up over the rows, and a logistic curve, fitted to scores of rows that their model has not seen, turns
margins into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Eigenvalues of the landmarks' kernel matrix below this share of the largest carry only rounding.
NEGLIGIBLE = 1e-10
#: The corner of the hinge is rounded off over 1 - width to 1 + width; at first that holds a margin of 0, where steps begin.
WIDTHS = (2.0, 0.5, 0.15, 0.03)
#: Step lengths that are tried at once; the last is no step.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001, 0.0)
#: Sums of so many groups of tasks reach the driver.
GROUPS = 16


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - y|^2) for every row of ``x`` and of ``y``."""
    far = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * x @ y.T
    return np.exp(-gamma * np.maximum(far, 0.0))


def landmark_map(marks: np.ndarray, gamma: float) -> np.ndarray:
    """The matrix that turns kernel values with the landmarks into a description."""
    values, vectors = np.linalg.eigh(gaussian(marks, marks, gamma))
    keep = values > NEGLIGIBLE * values[-1]
    return vectors[:, keep] / np.sqrt(values[keep])


def rounded_hinge(z: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and bend at the margins ``z``."""
    low = np.clip(1 + width - z, 0.0, 2 * width)
    inside = (low > 0) & (low < 2 * width)
    loss = np.where(z <= 1 - width, 1 - z, low * low / (4 * width))
    return loss, -low / (2 * width), inside / (2 * width)


def _slopes(w: np.ndarray, width: float):
    def run(phi: np.ndarray, y: np.ndarray) -> np.ndarray:
        _, slope, bend = rounded_hinge(y * (phi @ w), width)
        return np.concatenate([phi.T @ (slope * y), ((phi.T * bend) @ phi).ravel()])

    return run


def _losses(w: np.ndarray, step: np.ndarray, width: float):
    def run(phi: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([rounded_hinge(y * (phi @ (w + t * step)), width)[0].sum() for t in LENGTHS])

    return run


def _added(rows: DataFrame, work) -> np.ndarray:
    """The sum over all rows (y, phi) of ``work(descriptions with a one, labels of -1 and 1)``: tasks add up
    their rows, groups of tasks their sums."""

    def one(batches):
        total = None
        for b in batches:
            if b.num_rows:
                phi = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                part = work(np.column_stack([phi, np.ones(len(phi))]), 2 * b.column(0).to_numpy() - 1)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["sums"])

    def several(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [sum(np.frombuffer(x, "<f8") for x in frame["sums"]).tobytes()]})

    parts = rows.select("y", "phi").mapInArrow(one, "sums binary")
    if rows.rdd.getNumPartitions() > GROUPS:
        parts = parts.groupBy(F.pmod(F.xxhash64("sums"), F.lit(GROUPS))).applyInPandas(several, "sums binary")
    return sum(np.frombuffer(bytes(r["sums"]), "<f8") for r in parts.collect())


@dataclass
class KernelModel:
    """What ``KernelMargin.fit`` has learnt. Of training rows with one class only, every row takes that class."""

    marks: np.ndarray
    turn: np.ndarray
    gamma: float
    weights: np.ndarray
    bias: float
    curve: tuple[float, float]
    features: str
    only: float | None = None

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``margin``, ``probability`` (vector of both classes) and ``prediction`` (0.0 or 1.0, by the margin)."""
        if self.only is not None:
            out = rows.withColumn("margin", F.lit(1.0 if self.only else -1.0)).withColumn("__p", F.lit(self.only))
        else:
            marks, direction, gamma, bias = self.marks, self.turn @ self.weights, self.gamma, self.bias

            @F.pandas_udf("double")
            def margin(x: pd.Series) -> pd.Series:
                return pd.Series(gaussian(np.stack(x.to_numpy()), marks, gamma) @ direction + bias if len(x) else [], dtype=float)

            a, b = self.curve
            out = rows.withColumn("margin", margin(vector_to_array(self.features)))
            out = out.withColumn("__p", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), a * F.col("margin") + b)))))
        both = array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))
        return out.withColumn("probability", both).withColumn("prediction", (F.col("margin") > 0).cast("double")).drop("__p")


@dataclass
class KernelMargin:
    """Settings: ``c`` and ``gamma`` as in a kernel machine that minimises ``|w|^2 / 2 + c * sum(hinge)``.

    ``iterations`` bounds the steps at each of ``WIDTHS``. ``key`` names the column whose hash draws landmarks and folds, so a retry draws the same ones; at most
    ``landmarks`` rows reach the driver. Rows without label (other than 0 and 1) or features are not learnt from.
    """

    key: str
    c: float = 8.0
    gamma: float = 0.001
    landmarks: int = 256
    folds: int = 3
    iterations: int = 10
    features: str = "features"
    label: str = "y"
    seed: int = 42

    def fit(self, train: DataFrame) -> KernelModel:
        known = train.where(F.col(self.label).isin(0, 1) & F.col(self.features).isNotNull())
        drawn = F.xxhash64(F.col(self.key), F.lit(self.seed))
        known = known.select(F.col(self.key).alias("key"), F.col(self.label).cast("double").alias("y"),
                             vector_to_array(self.features).alias("x"), drawn.alias("h"))
        known = cut_lineage(known.withColumn("fold", F.pmod(F.xxhash64("key", F.lit(self.seed + 1)), F.lit(self.folds))))
        classes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
        if len(classes) < 2:
            none = np.zeros((0, 0))
            return KernelModel(none, none, self.gamma, np.zeros(0), 0.0, (0.0, 0.0), self.features, next(iter(classes), 0.0))
        # Rows that repeat would be one landmark several times.
        marks = [r["x"] for r in known.groupBy("x").agg(F.min("h").alias("h")).orderBy("h").limit(self.landmarks).collect()]
        marks = np.array(marks)
        turn = landmark_map(marks, self.gamma)
        gamma = self.gamma

        @F.pandas_udf("array<double>")
        def described(x: pd.Series) -> pd.Series:
            return pd.Series(list(gaussian(np.stack(x.to_numpy()), marks, gamma) @ turn) if len(x) else [])

        rows = cut_lineage(known.select("y", "fold", described("x").alias("phi")))
        unseen = None
        for fold in range(self.folds):
            rest, own = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
            if rest.select("y").distinct().count() < 2:
                continue
            weights, bias = self._solve(rest)
            f = F.aggregate(F.zip_with("phi", F.lit(weights.tolist()), lambda a, b: a * b), F.lit(bias), lambda a, x: a + x)
            scored = own.select("y", F.array(f).alias("f"))
            unseen = scored if unseen is None else unseen.union(scored)
        weights, bias = self._solve(rows)
        return KernelModel(marks, turn, self.gamma, weights, bias, self._curve(unseen), self.features)

    def _solve(self, rows: DataFrame) -> tuple[np.ndarray, float]:
        """Weights and bias by Newton steps on the hinge rounded off over ever less of its corner.

        A step is two passes over ``rows``: sums of gradient and curvature, then the losses of several step lengths.
        """
        size = len(rows.select("phi").first()["phi"]) + 1
        own = np.ones(size)
        own[-1] = 1e-9  # the bias is free
        w = np.zeros(size)
        for width in WIDTHS:
            for _ in range(self.iterations):
                sums = _added(rows, _slopes(w, width))
                slope, bend = sums[:size], sums[size:].reshape(size, size)
                step = np.linalg.solve(np.diag(own) + self.c * bend, -(own * w + self.c * slope))
                losses = self.c * _added(rows, _losses(w, step, width)) + [0.5 * (own * (w + t * step) ** 2).sum() for t in LENGTHS]
                best = int(np.argmin(losses))
                w = w + LENGTHS[best] * step
                if losses[-1] - losses[best] <= 1e-9 * abs(losses[best]):
                    break
        return w[:-1], float(w[-1])

    def _curve(self, unseen: DataFrame | None) -> tuple[float, float]:
        if unseen is None or unseen.select("y").distinct().count() < 2:
            return 1.0, 0.0
        curve = LogisticRegression(featuresCol="f", labelCol="y", maxIter=100, regParam=1e-4).fit(unseen.withColumn("f", array_to_vector("f")))
        return max(0.0, float(curve.coefficients[0])), float(curve.intercept)
