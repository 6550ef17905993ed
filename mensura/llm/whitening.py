"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With ``X`` the centred rows, each step takes a direction ``v`` (one number per dimension), forms the
distributed column ``u = Xv`` and the product ``Xᵀu``, and so builds ``XV = UB`` with ``B`` upper
bidiagonal. The singular value decomposition of the small ``B`` gives the components (``V`` times its
right vectors) and the deviations along them.

``u`` has one number per row and is never kept: every left vector is ``Xp`` for a vector ``p`` with one
number per dimension, so a step is one pass in which a task forms its part of ``Xp`` and adds up its part
of ``Xᵀ(Xp)``. With ``s = Xᵀ(Xp)`` on the driver, ``uᵀX w = sᵀw``, so left vectors are reorthogonalised
against all earlier ones without touching a row, and right vectors directly. What reaches the driver per
step is one number per dimension and one more.

A breakdown (rows that span fewer dimensions, or a spectrum with equal values) leaves a zero beside the
diagonal of ``B`` and the process goes on with another direction orthogonal to all before, until the
dimensions are used up or the wanted components no longer move.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, small_batches, stored

SCALE, SHIFT = 64, 1_000_000
#: Entries up to this size are whole numbers of ``x`` without rounding.
LARGEST = float(1 << 52) / SCALE
#: A direction whose share of the largest singular value is below this carries only rounding.
NEGLIGIBLE = 1e-10
#: The vectors of up to so many tasks are added up by the driver.
FEW_TASKS = 64

_SUMS = pa.schema([("at", pa.int32()), ("value", pa.float64())])
_WHOLE = pa.schema([("at", pa.int32()), ("value", pa.decimal128(38, 0))])


@dataclass(frozen=True)
class Fit:
    """``origin`` + ``rest`` is the mean (whole and broken part), ``sums`` the exact sums of ``n`` rows;
    columns of ``components`` are unit vectors by falling ``values`` (variances); ``total`` is the trace."""

    n: int
    sums: tuple[int, ...]
    origin: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    total: float


def whole_vectors(rows: DataFrame, row: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, x array<long>) with ``x = floor(64 * entry) + 1000000``.

    Dropped are null vectors and those that are empty, hold null or non-finite entries or one so large
    (2^46) that ``x`` would be rounded. Of several lengths the most frequent stays (of equally frequent
    ones the longer). Null and repeated row ids stay.
    """
    rows = rows.select(F.col(row).alias("row"), F.col(vector).cast("array<double>").alias("e"))
    fine = F.forall("e", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False)))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & fine)
    rows = rows.select("row", F.transform("e", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _per_task(width: int, add):
    """One vector of ``width`` doubles per task, as rows (at, value): the sum of ``add`` over its batches."""

    def run(batches):
        total, any_rows = np.zeros(width), False
        for b in batches:
            if b.num_rows:
                total += add(_matrix(b.column(0), b.num_rows))
                any_rows = True
        if any_rows:
            yield batch(_SUMS, np.arange(width), total)

    return run


def _added(rows: DataFrame, width: int, add) -> np.ndarray:
    """The sum over all tasks; the vectors of many tasks meet per place first."""
    parts = rows.select("x").mapInArrow(_per_task(width, add), "at int, value double")
    if rows.rdd.getNumPartitions() > FEW_TASKS:
        parts = parts.groupBy("at").agg(F.sum("value"))
    out = np.zeros(width)
    for at, value in parts.collect():
        out[at] += value
    return out


def _exact_sums(batches):
    total = None
    n = 0
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0), b.num_rows)
            # Two halves of each number keep the sums of a batch below 2^63.
            low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
            part = [(int(h) << 32) + int(k) for h, k in zip(high, low)]
            total = part if total is None else [a + c for a, c in zip(total, part)]
            n += b.num_rows
    if n:
        yield batch(_WHOLE, range(-1, len(total)), [n, *total])


def bidiagonalise(product, d: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of ``X``, ``wanted`` of them at most.

    ``product(p)`` returns the squared length of ``Xp`` and ``Xᵀ(Xp)``. Values below ``NEGLIGIBLE`` of the
    largest are left out. It ends when the dimensions are used up, or when no wanted value or vector
    moves in ``wanted`` more steps from another direction.
    """
    rng = np.random.default_rng(seed)
    right, left, mapped = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, P, Xᵀ(XP)
    alphas, betas = [], []
    top, settled = 0.0, None

    def orthogonal(v, basis):
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        return v

    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    while True:
        k = len(alphas)
        p = v - (betas[-1] * left[:, -1] if betas and betas[-1] else 0.0)
        for _ in range(2):
            p = p - left @ (mapped.T @ p)
        square, through = product(p)
        alpha = float(np.sqrt(max(square, 0.0)))
        top = max(top, alpha)
        right = np.column_stack([right, v])
        if alpha <= NEGLIGIBLE * top or alpha == 0.0:
            # v lies where X does nothing beyond the left vectors so far.
            left, mapped = np.column_stack([left, np.zeros(d)]), np.column_stack([mapped, np.zeros(d)])
            alphas.append(0.0)
            rest = np.zeros(d)
        else:
            left, mapped = np.column_stack([left, p / alpha]), np.column_stack([mapped, through / alpha])
            alphas.append(alpha)
            rest = orthogonal(through / alpha, right)
        beta = float(np.linalg.norm(rest))
        b = np.diag(alphas) + np.diag(betas, 1)
        outer, values, inner = np.linalg.svd(b)
        top = max(top, values[0])
        if k + 1 == d:
            break
        fresh = not beta > NEGLIGIBLE * top
        # How far the wanted vectors are from done: the last entries of the left ones.
        if k + 1 >= wanted and beta * np.abs(outer[-1, :wanted]).max() <= 1e-15 * values[0]:
            same = settled is not None and np.allclose(values[:wanted], settled[1], rtol=1e-13, atol=0)
            if same and k - settled[0] >= wanted:
                break
            if not same:
                # Equal singular values show up only from another direction: go on from one for a while.
                settled, fresh = (k, values[:wanted]), True
        if not fresh:
            betas.append(beta)
            v = rest / beta
        else:
            betas.append(0.0)
            v = orthogonal(rng.standard_normal(d), right)
            v /= np.linalg.norm(v)
    keep = min(wanted, int((values > max(NEGLIGIBLE * top, 0.0)).sum()))
    return values[:keep], (right @ inner.T)[:, :keep]


def fit(rows: DataFrame, wanted: int = 32) -> Fit | None:
    """Components of ``rows`` (row, x), a stored table, since it is passed over once per step; None without rows."""
    sums = rows.select("x").mapInArrow(_exact_sums, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value"))
    found = {at: int(value) for at, value in sums.collect()}
    if not found:
        return None
    n = found.pop(-1)
    exact = [found[i] for i in range(len(found))]
    d = len(exact)
    origin = np.array([s // n for s in exact], np.int64)
    rest = np.array([(s - (s // n) * n) / n for s in exact])

    def centred(x):
        return (x - origin) - rest

    def product(p):
        def add(x):
            c = centred(x)
            u = c @ p
            return np.append(u @ c, u @ u)

        both = _added(rows, d + 1, add)
        return both[-1], both[:-1]

    total = _added(rows, 1, lambda x: np.array([np.square(centred(x)).sum()]))[0] / n
    values, components = bidiagonalise(product, d, wanted)
    # One of the two signs: the entry of the largest size is positive.
    for j in range(components.shape[1]):
        if components[np.abs(components[:, j]).argmax(), j] < 0:
            components[:, j] *= -1
    return Fit(n, tuple(exact), origin, rest, components, values**2 / n, float(total))


def _whiten(model: Fit):
    scale = model.components / np.sqrt(model.values)

    def run(x: np.ndarray) -> np.ndarray:
        return ((x - model.origin) - model.rest) @ scale

    return run


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k, whiten = len(model.values), _whiten(model)

    def add(x):
        one = np.column_stack([np.ones(len(x)), whiten(x)])
        return (one.T @ one).ravel()

    s = _added(rows, (k + 1) ** 2, add).reshape(k + 1, k + 1) / model.n
    return float(np.abs(s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:]) - np.eye(k)).max()) if k else 0.0


def _deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """Exact sums of (n x - S)^2 per row; null where a sum does not fit a long."""
    left = np.array([s - model.n * int(o) for s, o in zip(model.sums, model.origin)], object)
    off = x - model.origin
    reach = model.n * int(np.abs(off).max(initial=0)) + max(map(abs, left), default=0)
    if reach * reach * x.shape[1] < 1 << 63:
        return np.square(model.n * off - left.astype(np.int64)).sum(axis=1).tolist()
    sums = ((model.n * off.astype(object) - left) ** 2).sum(axis=1)
    return [int(s) if s < 1 << 63 else None for s in sums]


def whiten(rows: DataFrame, row: str = "vec_id", vector: str = "embedding", wanted: int = 32) -> DataFrame:
    """(row, component, n, deviation, whitened, explained, identity_error), a row for each vector that
    ``whole_vectors`` keeps and each of at most ``wanted`` components.

    Directions without any deviation are no components, so equal vectors, a single one or none give no
    rows. Repeated ids and vectors count and come back as often as they are there. ``deviation`` is null
    where the exact sum is beyond a long. Other columns of ``rows`` are ignored, whatever their names.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[row].dataType.simpleString()
    table = stored(whole_vectors(rows, row, vector), "vectors")
    model = fit(table, wanted)
    k = 0 if model is None else len(model.values)
    names = f"`{row}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], names)
    error = identity_error(table, model)
    project, explained = _whiten(model), model.values / model.total

    def run(batches):
        for b in batches:
            m = b.num_rows
            if m:
                x = _matrix(b.column(1), m)
                each = np.repeat(np.arange(m), k)
                columns = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                           pa.array(np.full(m * k, model.n)), pa.array(_deviations(x, model), pa.int64()).take(pa.array(each)),
                           pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[row, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select("row", "x").mapInArrow(run, names)
