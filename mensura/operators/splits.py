"""Leakage-safe partitions: group folds, stratified splits, inner validation."""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .expect import enforce, group_labels_present
from .joins import hot_key_lookup
from .ordering import cumulative, seeded_hash, with_hash_slots


def fill_lightest(sizes: Sequence[tuple[int, int]], weights: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Hand out groups, largest size first, always to the lightest fold.

    ``sizes`` lists (group size, number of such groups). Groups of one size are
    interchangeable, so a whole size class is placed at once: fold *i* would take its next
    groups at loads L, L+s, L+2s, …; the class goes to the smallest of all those loads
    (scaled by the fold's weight). Returns ``(size, fold, first, last+1)`` runs of positions.
    """
    scale = lcm(*weights)
    cost = [scale // w for w in weights]
    loads = [0] * len(weights)
    runs = []
    for size, many in sorted(sizes, reverse=True):
        def taken(level: int) -> list[int]:
            return [max(0, (level // c - load) // size + 1) for c, load in zip(cost, loads)]

        low, high = 0, max(c * (load + size * many) for c, load in zip(cost, loads))
        while low < high:
            level = (low + high) // 2
            if sum(taken(level)) >= many:
                high = level
            else:
                low = level + 1
        quota = taken(low)
        surplus = sum(quota) - many
        # Equal loads go to the lowest fold number first, so the surplus leaves the highest.
        for i in reversed(range(len(weights))):
            if surplus and quota[i] and cost[i] * (loads[i] + (quota[i] - 1) * size) == low:
                quota[i] -= 1
                surplus -= 1
        start = 0
        for i, q in enumerate(quota):
            if q:
                runs.append((size, i, start, start + q))
                start += q
                loads[i] += q * size
    return runs


def assign_groups(
    df: DataFrame, group: str, weights: Sequence[int], seed: int, out: str = "fold", allow_empty: bool = False
) -> DataFrame:
    """``group, n, <out>``: each group placed whole, balanced by size.

    Only the histogram of group sizes reaches the driver: N rows have at most √(2N)
    distinct sizes. Within a size the order is a seeded hash, numbered without one big task.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    histogram = [(int(r["n"]), int(r["m"])) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()]
    if not allow_empty and sum(m for _, m in histogram) < len(weights):
        raise ValueError(f"{sum(m for _, m in histogram)} groups cannot fill {len(weights)} folds")
    runs = df.sparkSession.createDataFrame(
        fill_lightest(histogram, weights), f"n long, {out} int, first long, stop long"
    )
    hashed = sizes.withColumn("__hash", seeded_hash(seed, group)).withColumn("__one", F.lit(1))
    placed = cumulative(with_hash_slots(hashed, "__hash"), ["n"], ["__hash", group], ["__one"])
    joined = placed.join(broadcast_if_small(runs), "n").where(
        (F.col("__one_before") >= F.col("first")) & (F.col("__one_before") < F.col("stop"))
    )
    return joined.select(group, "n", out)


def group_kfold(
    df: DataFrame, key: str, group: str, n_splits: int, partitions: int = 1, seed: int = 42
) -> DataFrame:
    """Long fold table ``key, group, partition, fold``; partitions differ by their tie order."""
    enforce(group_labels_present(df, group, key))
    rows = df.select(key, group)
    out = None
    for p in range(partitions):
        placed = assign_groups(df, group, [1] * n_splits, seed + p)
        one = hot_key_lookup(rows, placed, [group]).select(
            key, group, F.lit(p).alias("partition"), F.col("fold")
        )
        out = one if out is None else out.unionByName(one)
    return out


def group_split(
    df: DataFrame, key: str, group: str, shares: Sequence[tuple[str, int]] = (("train", 8), ("val", 1), ("test", 1)), seed: int = 42
) -> DataFrame:
    """Train / validation / test by whole groups, filled in proportion to the shares."""
    placed = assign_groups(df, group, [w for _, w in shares], seed, "__part", allow_empty=True)
    names = F.array(*[F.lit(n) for n, _ in shares])
    named = placed.select(group, "n", F.get(names, F.col("__part")).alias("split"))
    return hot_key_lookup(df, named, [group]).drop("n")


def split_parts(df: DataFrame, split: str = "split", names: Sequence[str] = ("train", "val", "test")) -> list[DataFrame]:
    return [df.where(F.col(split) == n) for n in names]


def positions_in_class(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """0-based hash-order position within the class, and the class size."""
    rows = df.withColumn("__hash", seeded_hash(seed, key)).withColumn("__one", F.lit(1))
    run = cumulative(with_hash_slots(rows, "__hash"), [label], ["__hash", key], ["__one"])
    return run.select(*df.columns, F.col("__one_before").alias("position"), F.col("__one_total").alias("class_size"))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 34) -> DataFrame:
    """Exactly ``round(share · n)`` test rows of every class."""
    placed = positions_in_class(df, key, label, seed)
    n_test = F.round(F.col("class_size") * F.lit(test_share)).cast("long")
    split = F.when(F.col("position") < n_test, "test").otherwise("train")
    return placed.withColumn("split", split).drop("position", "class_size")


def stratified_kfold(df: DataFrame, key: str, label: str, n_splits: int = 10, seed: int = 34) -> DataFrame:
    placed = positions_in_class(df, key, label, seed)
    return placed.withColumn("fold", F.pmod("position", F.lit(n_splits)).cast("int")).drop("position", "class_size")


def inner_validation(folds: DataFrame, key: str, fold: str, n_splits: int, share: float = 0.15, seed: int = 42) -> DataFrame:
    """For every outer fold: its training rows split into ``fit`` and ``validation``.

    A row trains in every fold but its own, so the result holds ``n_splits - 1`` copies.
    """
    outer = folds.select(key, fold, F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("outer_fold"))
    train = outer.where(F.col(fold) != F.col("outer_fold")).select("outer_fold", key)
    hashed = train.withColumn("__hash", F.xxhash64(F.col(key), F.col("outer_fold"), F.lit(seed))).withColumn("__one", F.lit(1))
    run = cumulative(with_hash_slots(hashed, "__hash"), ["outer_fold"], ["__hash", key], ["__one"])
    n_val = F.floor(F.col("__one_total") * F.lit(share))
    return run.select(
        "outer_fold", key, F.when(F.col("__one_before") < n_val, "validation").otherwise("fit").alias("role")
    )


def fold_sizes(folds: DataFrame, group: str) -> DataFrame:
    return folds.groupBy("partition", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups")
    )


def test_rows(folds: DataFrame, partition: int, fold: int) -> Column:
    return (F.col("partition") == partition) & (F.col("fold") == fold)
