"""Entities → group folds → model grid → fold summary, pivot and stability."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from ..operators import expect, metrics, models, splits
from ..session import cut_lineage


def run(
    data: DataFrame, key: str, group: str, y: str, representations: Mapping[str, str],
    algorithms: Mapping[str, Callable[[str], Estimator]], n_splits: int = 5, partitions: int = 3, seed: int = 42,
    done: DataFrame | None = None, sink: Callable[[DataFrame], None] | None = None,
) -> dict[str, DataFrame]:
    """Folds are checked for leaks before any model is trained."""
    expect.enforce(expect.unique_key(data, [key]), expect.non_blank(data, [key]))
    folds = cut_lineage(splits.group_kfold(data, key, group, n_splits, partitions, seed))
    expect.enforce(expect.no_leakage(folds, key, group, n_splits))
    oof = models.model_grid(data, folds, key, y, representations, algorithms, done=done, sink=sink)
    summary = metrics.fold_summary(oof, ["representation", "algorithm", "partition"], "fold", "y_true", "y_pred")
    return {
        "folds": folds, "oof": oof, "summary": summary,
        "pivot": metrics.metric_pivot(summary, "representation", "algorithm", list(algorithms), ["rmse_pooled", "r2_pooled"]),
        "stability": metrics.metric_stability(summary, ["representation", "algorithm"], "rmse_pooled"),
    }
