"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a normal distribution over the statistics, its covariance shrunk towards the pooled
one and towards its own mean variance. A score is the difference of the two log densities, from
Mahalanobis distances by Cholesky factors that are computed once per fit and cached, passed through a
logistic curve fitted to labelled rows that the densities did not see.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slowly, small_batches, stored

STATISTICS = ("chars", "words", "word_length", "upper", "digits", "symbols", "exclaims", "spaces", "distinct", "repeats", "top_word",
              "odd_ends", "lines", "line_length", "repeated_lines", "shouted", "symbol_words", "pairs")
_DIGITS, _SPACES = list(range(48, 58)), [9, 10, 11, 12, 13, 32]
_SYMBOLS = [ord(c) for c in "#$%&*@^_+=|~<>{}[]\\/`"]
_FINE = frozenset("abcdefghijklmnopqrstuvwxyz.,;:!?)\"'")


def statistics(text: str) -> np.ndarray:
    """The statistics of one text; an empty text has zeros. Shares are under a square root and sizes
    under a logarithm, which brings them nearer to a normal distribution."""
    out = np.zeros(len(STATISTICS))
    words = text.split()
    if not words:
        return out
    n, chars = len(words), len(text)
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    ends = [w[-1] for w in words]
    odd = sum(1 for e in ends if e not in _FINE and not e.isalnum())
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper())
    symbol_words = sum(1 for w in words if not any(map(str.isalnum, w))) if odd else 0
    size = max(1, len(raw))
    shares = (
        count[65:91].sum() / size, count[_DIGITS].sum() / size, count[_SYMBOLS].sum() / size, count[33] / size,
        count[_SPACES].sum() / size, len(distinct) / n, sum(map(str.__eq__, words, words[1:])) / n, max(distinct.values()) / n, odd / n,
    )
    out[:3] = math.log1p(chars), math.log1p(n), math.log1p(chars / n)
    out[3:12] = np.sqrt(shares)
    out[12:14] = math.log1p(len(lines)), math.log1p(chars / len(lines))
    out[14:] = np.sqrt([1 - len(set(lines)) / len(lines), shouted / n, symbol_words / n, len(set(zip(words, words[1:]))) / max(1, n - 1)])
    return out


@dataclass
class Discriminant:
    """Two shrunk normal distributions and the curve that turns their log ratio into a probability."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    covariances: tuple[np.ndarray, np.ndarray]
    prior: float
    curve: tuple[float, float] = (1.0, 0.0)
    _factors: list = field(default_factory=list)

    def factors(self):
        """Inverse Cholesky factor and log determinant of each class, computed once."""
        if not self._factors:
            for c in self.covariances:
                low = np.linalg.cholesky(c)
                self._factors.append((np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()))
        return self._factors

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.centre) / self.scale
        density = []
        for mean, (inverse, logdet) in zip(self.means, self.factors()):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return density[1] - density[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        # The log ratio is unbounded; its signed square root keeps the curve steady.
        r = self.log_ratio(x)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * np.sign(r) * np.sqrt(np.abs(r)) + self.curve[1], -30, 30)))


def moments(x: np.ndarray) -> np.ndarray:
    """Count, sums and sums of products of the rows, in one vector; they add up over tasks."""
    one = np.column_stack([np.ones(len(x)), x])
    return (one.T @ one).ravel()


def fit(sums: list[np.ndarray], shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """From the summed moments of classes 0 and 1. A class without rows takes the pooled values."""
    d = len(STATISTICS)
    tables = [np.asarray(s).reshape(d + 1, d + 1) for s in sums]
    both = tables[0] + tables[1]
    n = max(both[0, 0], 1.0)
    centre = both[0, 1:] / n
    spread = np.sqrt(np.maximum(np.diag(both)[1:] / n - centre**2, 0.0))
    scale = np.where(spread > 1e-6, spread, 1.0)
    scaled = lambda t: (t[1:, 1:] / max(t[0, 0], 1.0) - np.outer(t[0, 1:], t[0, 1:]) / max(t[0, 0], 1.0) ** 2) / np.outer(scale, scale)
    pooled = sum(t[0, 0] * scaled(t) for t in tables) / n
    means, covariances = [], []
    for t in tables:
        m = t[0, 0]
        means.append((t[0, 1:] / m - centre) / scale if m else np.zeros(d))
        own = scaled(t) if m else pooled
        own = (1 - shrink) * own + shrink * pooled
        covariances.append((1 - ridge) * own + ridge * max(np.trace(own) / d, 1e-3) * np.eye(d))
    prior = math.log((tables[1][0, 0] + 1) / (tables[0][0, 0] + 1))
    return Discriminant(centre, scale, tuple(means), tuple(covariances), prior)


def fit_curve(r: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[float, float]:
    """Logistic curve over binned log ratios ``r`` with labels ``y`` and row counts."""
    x = np.sign(r) * np.sqrt(np.abs(r))
    a, b = 1.0, 0.0
    # Two soft rows keep the curve finite for perfectly divided labels.
    x, y, rows = np.append(x, [-1.0, 1.0]), np.append(y, [0.5, 0.5]), np.append(rows, [1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = rows * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(rows * (y - p) * x).sum() - 1e-3 * a, (rows * (y - p)).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


# Training on labelled rows, and scoring.

SHRINK, RIDGE = 0.3, 0.02
_STATS = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _statistics(batches):
    for b in batches:
        yield batch(_STATS, b.column(0), [statistics(t or "") for t, in slowly(b.column(1))])


def _ratios(model: Discriminant):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(model.log_ratio(x)), b.column(1)], names=["r", "label"])

    return run


def training_fold(row: str, folds: int):
    """crc32 of the id's text modulo ``folds``; null ids have none."""
    return F.pmod(F.crc32(F.col(row).cast("string").cast("binary")), F.lit(folds))


def train(stats: DataFrame, labels: DataFrame, label: str, row: str = "doc_id", folds: int = 5, held_out: int = 0) -> Discriminant:
    """Fit on all labelled rows of ``stats`` (doc_id, x) outside the held-out fold.

    One of the other folds fits the curve, the rest the densities. Rows without label or id teach
    nothing; of several labels of one id the largest counts. Only sums reach the driver.
    """
    labels = labels.select(F.col(row).alias("doc_id"), F.col(label).cast("int").alias("label"))
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    fold = training_fold("doc_id", folds)
    curve = (held_out + 1) % folds
    known = stored(stats.join(labels.where(fold != held_out), "doc_id").withColumn("fold", fold), "labelled")
    d = len(STATISTICS) + 1
    terms = [F.lit(1.0), *(F.col("x")[i] for i in range(d - 1))]
    sums = [F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]
    found = {r["label"]: r for r in known.where(F.col("fold") != curve).groupBy("label").agg(*sums).collect()}
    tables = []
    for k in (0, 1):
        t = np.zeros((d, d))
        if k in found:
            for i in range(d):
                for j in range(i, d):
                    t[i, j] = t[j, i] = found[k][f"s{i}_{j}"]
        tables.append(t)
    model = fit(tables, SHRINK, RIDGE)
    ratios = known.where(F.col("fold") == curve).select("x", "label").mapInArrow(_ratios(model), "r double, label int")
    # At most a few thousand bins of the root of the ratio, whatever the rows.
    root = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.signum("r") * F.sqrt(F.abs("r"))))
    bins = ratios.groupBy(F.round(root, 2).alias("v"), "label").count().collect()
    if bins:
        v, y, n = (np.array(c, float) for c in zip(*bins))
        model.curve = fit_curve(np.sign(v) * v * v, y, n)
    return model


def _score(model: Discriminant):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(row, held_out, score, predicted) for every row of ``docs``, from its text alone.

    Null and empty texts are scored as texts without words. Repeated rows are each scored, a null id is
    kept and counts as not held out. Without labels the score is the prior's. Other columns are ignored.
    No rows, no rows.
    """
    small_batches(docs.sparkSession)
    stats = stored(docs.select(F.col(row).cast("long"), F.col(text)).mapInArrow(_statistics, "doc_id long, x array<double>"), "statistics")
    model = train(stats, labels, label, row)
    scores = stats.mapInArrow(_score(model), "doc_id long, score double")
    held = F.coalesce(training_fold("doc_id", 5) == 0, F.lit(False))
    return scores.select(F.col("doc_id").alias(row), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``; all columns stay as they are."""
    small_batches(docs.sparkSession)
    stats = stored(docs.select(F.col(row).cast("long"), F.col(text)).mapInArrow(_statistics, "doc_id long, x array<double>"), "statistics")
    model = train(stats, labels, label, row)

    def keep(batches):
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t or "") for t, in slowly(b.column(b.schema.get_field_index(text)))])
                yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
