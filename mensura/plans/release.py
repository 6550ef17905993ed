"""Release comparison: new records → entity table → differences to the stored release → verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import aggregate, delta, expect
from ..operators.joins import within, without

COMPARED = ("value_median", "value_min", "value_max", "value_sd", "n_measurements", "year_min", "year_max", "n_collections", "n_sources")


def entity_table(records: DataFrame, entity: str, value: str, year: str, collection: str, source: str, representatives: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    keyed = delta.entity_keys(records, entity)
    return aggregate.entity_aggregate(keyed.where(f"`{value}` is not null"), entity, value, year, collection, source, representatives, order)


def compare(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str] = COMPARED) -> dict[str, DataFrame]:
    """Key counts, new and removed rows, side-by-side values, changed overlap, report and verdict."""
    stored = delta.entity_keys(old, key)
    expect.enforce(expect.unique_key(stored, [key], "stored release key"))
    common = [c for c in columns if c in stored.columns and c in new.columns]
    values = delta.delta_values(stored, new, key, common)
    return {
        "counts": delta.delta_counts(stored, new, key),
        "new": without(new, stored, [key]),
        "removed": without(stored, new, [key]),
        "overlap": within(new, stored, [key]),
        "values": values,
        "changed": delta.changed_overlap(values),
        "report": delta.delta_report(values, common, "n_measurements", "value_median"),
        "verdict": delta.verdict(stored, new, key, common),
    }
