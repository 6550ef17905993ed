"""Snapshot → overview: classify records, profile fields, roll up to sources, tie out with the manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as c
from ..operators import aggregate, expect, joins


@dataclass(frozen=True)
class Roles:
    """Which columns of the raw records play which part."""

    record: str = "record_id"
    source: str = "source_id"
    entity: str = "entity_id"
    target: str = "target_id"
    organism: str = "target_organism"
    structure: str = "structure"
    kind: tuple[str, str] = ("standard_type", "type")
    relation: tuple[str, str] = ("standard_relation", "relation")
    value: str = "standard_value"
    upper: str = "standard_upper_value"
    unit: str = "standard_units"
    comments: tuple[str, ...] = ("comment", "standard_text_value", "text_value")
    text_value: str = "standard_text_value"
    validity: str = "validity_comment"
    duplicate: str = "potential_duplicate"
    properties: str = "properties"


CENSORING = ("exact", "non_exact", "interval", "right_censored", "left_censored")
REMARKS = (
    "text_contains_inactive", "single_point", "missing_structure", "potential_duplicate_true",
    "has_validity_comment", "missing_organism", "has_text_value",
)
REVIEWED = ("interval", "right_censored", "non_exact", "left_censored", "text_contains_inactive", "single_point", "has_text_value")
# Flags counted per source and in the long value counts.
SOURCE_FLAGS = (
    "exact", "interval", "right_censored", "left_censored", "text_contains_inactive", "single_point",
    "missing_structure", "potential_duplicate_true",
)


def check_records(raw: DataFrame, target: str, organism: str, roles: Roles = Roles()) -> None:
    """Key present and unique, one target, organism blank or as expected; raises otherwise."""
    expect.enforce(expect.required_columns(raw, [roles.record, roles.source, roles.target]))
    reports = [
        expect.non_blank(raw, [roles.record]), expect.unique_key(raw, [roles.record]),
        expect.domain(raw, roles.target, target),
    ]
    if roles.organism in raw.columns:
        reports.append(expect.domain(raw, roles.organism, organism, optional=True))
    expect.enforce(*reports)


def classify(raw: DataFrame, wanted: str, roles: Roles = Roles()) -> DataFrame:
    """Raw records plus effective type and relation, numbers, all flags and the flag list.

    Absent optional columns count as missing.
    """
    def col(name: str):
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    def either(pair: tuple[str, str]):
        return c.first_present(*[p if p in raw.columns else None for p in pair])

    kind = F.upper(F.coalesce(either(roles.kind), F.lit("")))
    staged = raw.withColumns({
        "effective_type": kind,
        "effective_relation": F.coalesce(either(roles.relation), F.lit("")),
        "value_number": c.to_number(col(roles.value)),
        "upper_number": c.to_number(col(roles.upper)),
    })
    flags = c.classify_censoring(
        F.col("effective_type"), F.col("effective_relation"), F.col("value_number"), F.col("upper_number"), wanted
    )
    flags |= c.record_flags(
        comments=[col(x) for x in roles.comments], kind=F.col("effective_type"), wanted=wanted, structure=col(roles.structure),
        duplicate=col(roles.duplicate), validity=col(roles.validity), organism=col(roles.organism), text_value=col(roles.text_value),
    )
    out = staged.withColumns(flags)
    return out.withColumn("descriptive_flags", c.flags_to_list([*CENSORING, *REMARKS]))


def source_overview(records: DataFrame, sources: DataFrame, roles: Roles = Roles()) -> DataFrame:
    counts = aggregate.conditional_counts(records, roles.source, roles.entity, SOURCE_FLAGS)
    names = [x for x in counts.columns if x.startswith("n_")]
    expect.enforce(expect.unique_key(sources, [roles.source], "source key"))
    return joins.left_join_zero(sources, counts, [roles.source], names)


def overview(raw: DataFrame, sources: DataFrame, wanted: str, expected_counts: DataFrame | None = None, roles: Roles = Roles()) -> dict[str, DataFrame]:
    """All tables of the overview by name. With ``expected_counts`` (source, n_records) the
    per-source counts must tie out."""
    records = classify(raw, wanted, roles)
    if expected_counts is not None:
        actual = records.groupBy(roles.source).agg(F.count(F.lit(1)).alias("n_records"))
        report = expect.counts_match(actual, expected_counts, roles.source, "n_records")
        expect.enforce(report)
    out = {
        "records": records,
        "sources": source_overview(records, sources, roles),
        "counts": aggregate.long_value_counts(
            records,
            {"type": "effective_type", "relation": "effective_relation",
             **({"text_value": roles.text_value} if roles.text_value in raw.columns else {})},
            [*SOURCE_FLAGS, "has_validity_comment", "missing_organism"],
        ),
        "field_coverage": aggregate.field_coverage(raw),
        "review": records.where(c.any_flag(REVIEWED)),
        "summary": records.agg(
            F.count(F.lit(1)).alias("n_records"), F.countDistinct(roles.source).alias("n_sources"),
            F.countDistinct(c.clean_text(roles.entity)).alias("n_entities"),
            *[F.count_if(F.col(f)).alias(f"n_{f}") for f in (*CENSORING, *REMARKS)],
            F.count_if(c.any_flag(REVIEWED)).alias("n_review"),
        ),
    }
    if roles.properties in raw.columns:
        out["property_coverage"] = aggregate.nested_field_coverage(raw, roles.properties)
    return out


