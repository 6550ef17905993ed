"""Boosted trees with second-order gains: every round fits one tree to the gradients and curvatures of the loss.

Features are cut into bins once and the binned rows are written once. A level of a tree is one pass: tasks add up
gradient and curvature per (open node, feature, bin), the driver sees sums only and picks the splits. Sums are whole
numbers (fixed point), so they do not depend on the order in which tasks end, and of two siblings one is counted and
the other is what remains of their parent. Growing all levels and then keeping the best ``leaves - 1`` splits in
order of gain is leaf-wise growth, since a node's split does not depend on when it is made.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, spread
from .network import dropout_mask, known_array, logistic

#: Rows counted at once, which bounds a task's memory.
CHUNK = 2048
#: Sums of so many groups of tasks reach the driver.
GROUPS = 16
#: Rounds after which the scores so far are written, so that a pass walks few trees.
SEGMENT = 25
#: A gradient of the largest size counts as this whole number; some eight thousand million rows fit a sum.
UNIT = 2.0**30


@dataclass
class Tree:
    """Nodes in order of making, the root first. ``feature`` is -1 for a leaf; a bin up to ``cut`` goes left, and a
    missing value (bin 0) goes left if ``missing`` says so."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, start in zip((self.feature, self.cut, self.missing, self.left, self.right), (-1, 0, False, -1, -1)):
            column.append(start)
        self.value.append(value)
        return len(self.value) - 1

    def split(self, node: int, feature: int, cut: int, missing: bool, low: float, high: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing[node] = feature, cut, missing
        self.left[node], self.right[node] = self.add(low), self.add(high)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``bins``."""
        feature, cut, missing, left, right = (np.array(c) for c in (self.feature, self.cut, self.missing, self.left, self.right))
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while True:
            rows = rows[feature[at[rows]] >= 0]
            if not len(rows):
                return at
            here = at[rows]
            seen = bins[rows, feature[here]]
            goes = np.where(seen == 0, missing[here], seen <= cut[here])
            at[rows] = np.where(goes, left[here], right[here])

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin 0 for NaN, else 1 + the number of the feature's edges below the value."""
    out = np.empty(x.shape, dtype=np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(e, x[:, i], side="left"))
    return out


def best_split(sums: np.ndarray, features: np.ndarray, l2: float, least: float) -> tuple[float, int, int, bool, np.ndarray] | None:
    """(gain, feature, cut, missing goes left, sums of the left side) of ``sums`` [feature, bin, gradient and curvature].

    Both sides keep a curvature of at least ``least``. Of equal gains the first feature, missing values to the right
    and the lowest cut count.
    """
    whole = sums[0].sum(axis=0)
    best = None
    for f in features:
        for missing in (False, True):
            if missing and not sums[f, 0].any():
                continue
            low = np.cumsum(sums[f, 1:], axis=0) + (sums[f, 0] if missing else 0.0)
            high = whole - low
            fits = (low[:, 1] >= least) & (high[:, 1] >= least) & (low[:, 1] > 0) & (high[:, 1] > 0)
            if not fits.any():
                continue
            gain = np.full(len(low), -np.inf)
            gain[fits] = (low[fits, 0] ** 2 / (low[fits, 1] + l2) + high[fits, 0] ** 2 / (high[fits, 1] + l2)
                          - whole[0] ** 2 / (whole[1] + l2))
            at = int(np.argmax(gain))
            if best is None or gain[at] > best[0]:
                best = (float(gain[at]), int(f), at + 1, missing, low[at])
    return best


def pushes(y: np.ndarray, score: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of half the squared error, or of the cross-entropy."""
    if not classes:
        return score - y, np.ones(len(y))
    p = logistic(score)
    return p - y, p * (1 - p)


def drawn(h: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Whether a row, known by its hash, takes part in a round."""
    return dropout_mask(h, 1, 1.0 - share, seed)[:, 0] > 0 if share < 1 else np.ones(len(h), dtype=bool)


def _chunks(batch: pa.RecordBatch, trees: list[Tree]):
    """(row hashes, labels, bins, scores with ``trees``) of at most CHUNK rows."""
    for start in range(0, batch.num_rows, CHUNK):
        part = batch.slice(start, CHUNK)
        h, y, score = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3).to_numpy()
        bins = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
        for tree in trees:
            score = score + tree.scores(bins)
        yield h, y, bins, score


def _sums(rows: DataFrame, trees: list[Tree], tree: Tree, nodes: list[int], spec: dict) -> np.ndarray:
    """[node, feature, bin, gradient and curvature] of ``nodes``, whole numbers, over ``rows`` (h, y, bins, score)."""
    d, width = spec["d"], spec["width"]
    slot = np.full(len(tree.value), -1)
    slot[nodes] = np.arange(len(nodes))
    cells = len(nodes) * d * width

    def tasks(batches):
        total = np.zeros((2, cells), dtype=np.int64)
        for b in batches:
            for h, y, bins, score in _chunks(b, trees):
                where = slot[tree.nodes(bins)]
                keep = (where >= 0) & drawn(h, spec["share"], spec["seed"])
                if not keep.any():
                    continue
                gradient, bend = pushes(y[keep], score[keep], spec["classes"])
                cell = ((where[keep][:, None] * d + np.arange(d)) * width + bins[keep]).ravel()
                for i, (v, unit) in enumerate(((gradient, spec["unit"]), (bend, UNIT))):
                    total[i] += np.bincount(cell, np.repeat(np.rint(v * unit), d), cells).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def several(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [sum(np.frombuffer(s, "<i8") for s in frame["sums"]).tobytes()]})

    parts = rows.select("h", "y", "bins", "score").mapInArrow(tasks, "sums binary")
    if spec["tasks"] > GROUPS:
        parts = parts.groupBy(F.pmod(F.xxhash64("sums"), F.lit(GROUPS))).applyInPandas(several, "sums binary")
    got = [np.frombuffer(s, "<i8") for s in parts.toArrow().column("sums").to_pylist()]
    total = sum(got) if got else np.zeros(2 * cells, dtype=np.int64)
    return np.moveaxis(total.reshape(2, len(nodes), d, width), 0, -1)


@dataclass
class BoostedModel:
    """What ``SecondOrderBoosting.fit`` has learnt: a first score and trees whose values are added to it."""

    base: float
    trees: list[Tree]
    edges: list[np.ndarray]
    features: str
    classes: bool

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``y_pred``, or with ``margin``, ``probability`` (vector of both classes) and ``prediction``
        (0.0 or 1.0, from 0.5 on); null where the features are."""
        base, trees, edges = self.base, self.trees, self.edges

        @F.pandas_udf("double")
        def scored(x: pd.Series) -> pd.Series:
            known = x.notna().to_numpy()
            out = np.full(len(x), np.nan)
            at = np.flatnonzero(known)
            for start in range(0, len(at) if edges else 0, CHUNK):
                some = at[start : start + CHUNK]
                bins = binned(np.stack(x.iloc[some].to_numpy()), edges)
                out[some] = base + sum((t.scores(bins) for t in trees), np.zeros(len(some)))
            return pd.Series(np.where(known & np.isnan(out), base, out)).where(known, None)

        if not self.classes:
            return rows.withColumn("y_pred", scored(known_array(self.features)))
        rows = rows.withColumn("margin", scored(known_array(self.features)))
        rows = rows.withColumn("__p", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("margin"))))))
        # ``greatest`` and ``least`` skip nulls, so a missing margin is told apart again.
        rows = rows.withColumn("__p", F.when(F.col("margin").isNotNull(), F.col("__p")))
        both = F.when(F.col("__p").isNotNull(), array_to_vector(F.array(1 - F.col("__p"), F.col("__p"))))
        return rows.withColumn("probability", both).withColumn("prediction", (F.col("__p") >= 0.5).cast("double")).drop("__p")


@dataclass
class SecondOrderBoosting:
    """Settings. ``classes`` chooses cross-entropy on labels 0 and 1, else the squared error.

    ``l2`` is added to the curvature of a leaf, ``least`` is the smallest curvature of a leaf, a split gains more than
    ``gain``; ``rows`` and ``columns`` are the shares of rows and features drawn for a round, rows by a hash of ``key``.
    ``leaves`` of None keeps all leaves of ``depth`` levels. ``bins`` (at most 254) holds the values of a feature, whose edges
    come from a quantile sketch. Rows without label or features are not learnt from (with ``classes``, also those with
    another label); NaN is a missing value, for which every split learns a side. Without rows every score is 0.
    """

    key: str
    rounds: int = 500
    depth: int = 6
    step: float = 0.05
    leaves: int | None = None
    l2: float = 1.0
    least: float = 1.0
    gain: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 128
    classes: bool = False
    features: str = "features"
    label: str = "y"
    seed: int = 42

    def fit(self, train: DataFrame) -> BoostedModel:
        spark = train.sparkSession
        label = F.col(self.label).cast("double")
        fits = label.isin(0.0, 1.0) if self.classes else label.isNotNull() & ~F.isnan(label)
        known = train.where(fits & F.col(self.features).isNotNull())
        known = known.select(F.xxhash64(F.col(self.key), F.lit(self.seed)).alias("h"), label.alias("y"), known_array(self.features).alias("x"))
        plain = scratch_path(spark, "boosting-rows")
        spread(known).write.parquet(plain)
        known = spark.read.parquet(plain)
        facts = known.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.max(F.size("x")).alias("d")).first()
        if not facts["n"]:
            return BoostedModel(0.0, [], [], self.features, self.classes)
        edges = self._edges(known, facts["d"])
        base = facts["mean"]
        if self.classes:
            share = min(max(base, 1e-6), 1 - 1e-6)
            base = float(np.log(share / (1 - share)))

        @F.pandas_udf("binary")
        def cells(x: pd.Series) -> pd.Series:
            return pd.Series([r.tobytes() for r in binned(np.stack(x.to_numpy()), edges)] if len(x) else [], dtype=object)

        data = self._written(known.select("h", "y", cells("x").alias("bins"), F.lit(base).alias("score")))
        spread_of = 1.0 if self.classes else max(facts["high"] - facts["low"], 1e-300)
        spec = {"d": facts["d"], "width": 2 + max(len(e) for e in edges), "classes": self.classes, "share": self.rows,
                "unit": UNIT / spread_of, "tasks": data.rdd.getNumPartitions()}
        trees, fresh = [], []
        for r in range(self.rounds):
            if len(fresh) == SEGMENT:
                data, fresh = self._moved(data, fresh), []
            tree = self._grown(data, fresh, {**spec, "seed": self.seed + 1 + r}, r)
            trees.append(tree)
            fresh.append(tree)
        return BoostedModel(base, trees, edges, self.features, self.classes)

    def _edges(self, rows: DataFrame, d: int) -> list[np.ndarray]:
        """Per feature the upper ends of its bins but the last; features without values have none."""
        shares = [i / self.bins for i in range(1, self.bins)]
        values = rows.select(F.posexplode("x").alias("f", "v")).where(~F.isnan("v"))
        found = values.groupBy("f").agg(F.percentile_approx("v", shares, 10_000).alias("e"), F.max("v").alias("top")).collect()
        edges = [np.zeros(0)] * d
        for r in found:
            e = np.unique(r["e"])
            edges[r["f"]] = e[e < r["top"]]
        return edges

    def _written(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(rows.sparkSession, "boosting-scores")
        rows.write.parquet(path)
        return rows.sparkSession.read.parquet(path)

    def _moved(self, rows: DataFrame, trees: list[Tree]) -> DataFrame:
        """``rows`` with ``trees`` added to their scores, written."""

        def tasks(batches):
            for b in batches:
                if b.num_rows:
                    score = np.concatenate([s for *_, s in _chunks(b, trees)])
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score)], names=["h", "y", "bins", "score"])

        return self._written(rows.select("h", "y", "bins", "score").mapInArrow(tasks, "h long, y double, bins binary, score double"))

    def _value(self, sums: np.ndarray) -> float:
        return float(-self.step * sums[0] / (sums[1] + self.l2)) if sums[1] + self.l2 > 0 else 0.0

    def _grown(self, rows: DataFrame, trees: list[Tree], spec: dict, round_number: int) -> Tree:
        features = np.arange(spec["d"])
        if self.columns < 1:
            some = max(1, int(round(self.columns * len(features))))
            features = np.sort(np.random.default_rng([self.seed, round_number]).choice(features, some, replace=False))
        scale = np.array([spec["unit"], UNIT])
        tree = Tree()
        root = tree.add(0.0)
        counted = {root: _sums(rows, trees, tree, [root], spec)[0]}
        tree.value[root] = self._value(counted[root][0].sum(axis=0) / scale)
        gains, open_nodes = {}, [root]
        for level in range(self.depth):
            pairs = []
            for node in open_nodes:
                found = best_split(counted[node] / scale, features, self.l2, self.least)
                if found is None or not found[0] > max(self.gain, 1e-12):
                    continue
                gain, f, cut, missing, low = found
                high = (counted[node][0].sum(axis=0) / scale) - low
                pairs.append((node, tree.split(node, f, cut, missing, self._value(low), self._value(high))))
                gains[node] = gain
            if not pairs or level == self.depth - 1:
                break
            lefts = [left for _, (left, _) in pairs]
            found = dict(zip(lefts, _sums(rows, trees, tree, lefts, spec)))
            following = {}
            for node, (left, right) in pairs:
                following[left], following[right] = found[left], counted[node] - found[left]
            counted, open_nodes = following, list(following)
        return tree if self.leaves is None else pruned(tree, gains, self.leaves)


def pruned(tree: Tree, gains: dict[int, float], leaves: int) -> Tree:
    """The tree that leaf-wise growth reaches: splits in order of gain, each after its parent's, until ``leaves`` are left."""
    out = Tree()
    first = out.add(tree.value[0])
    waiting = [(-gains[0], 0, first)] if 0 in gains and leaves > 1 else []
    count = 1
    while waiting and count < leaves:
        _, node, copy = heapq.heappop(waiting)
        sides = (tree.left[node], tree.right[node])
        made = out.split(copy, tree.feature[node], tree.cut[node], tree.missing[node], *(tree.value[s] for s in sides))
        count += 1
        for side, place in zip(sides, made):
            if side in gains:
                heapq.heappush(waiting, (-gains[side], side, place))
    return out
