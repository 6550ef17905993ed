"""Descriptions → protocol fields with evidence → signatures, families and paired contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions.rulebook import SIGNATURE_FIELDS, TIME_FIELDS, protocol_patterns
from ..operators import aggregate, contrasts

FIELDS = (
    "assay_modality", "challenge_agonist", "agonist_level", "agonist_concentration", "cell_line", "species_mentioned_in_text",
    "construct", "dye_loading_time", "plate_equilibration_min", "compound_preincubation_min", "assay_title_time_min",
    "application_order", "hill_coefficient_fixed",
)


def protocol_fields(text: Column, symbol: str) -> dict[str, Column]:
    """Field name → struct(value, evidence, confidence); plus two plain side columns.

    An unclear description yields NULL and says so in the confidence; nothing is guessed.
    """
    p = protocol_patterns(symbol)
    text = F.coalesce(text, F.lit(""))
    concentration, token = r.number_with_unit(text, p["concentration"], p["bare_concentration"])
    preincubation, candidates = r.clause_then_numbers(text, p["preincubation_clauses"], p["minutes"])
    species = r.multi_label(text, p["species"], p["species_evidence"])
    out = {
        "assay_modality": r.conflict_label(text, p["calcium"], p["ephys"], p["mixed"]),
        "challenge_agonist": r.multi_label(text, p["agonists"], p["agonist_evidence"]),
        "agonist_level": r.extract_levels(
            text, p["level"], p["level_evidence"], lambda x: F.upper(F.replace(x, F.lit(" "), F.lit("")))
        ),
        "agonist_concentration": concentration,
        "cell_line": r.multi_label(text, p["cells"], p["cell_evidence"]),
        "species_mentioned_in_text": r.field(species["value"], species["evidence"], F.lit("text_mentions_only__not_record_species")),
        "dye_loading_time": r.simple_field(text, p["dye_loading_time"]),
        "plate_equilibration_min": r.simple_field(text, p["plate_equilibration_min"]),
        "compound_preincubation_min": preincubation,
        "assay_title_time_min": r.prefix_extract(text, p["title_time"], 80, "inferred_from_assay_title"),
        "application_order": r.precedence_label(text, p["order"], None, p["order_evidence"]),
        "hill_coefficient_fixed": r.simple_field(text, p["hill_coefficient_fixed"]),
    }
    construct = r.precedence_label(text, p["construct"], "not_reported", ignore_case=False)
    out["construct"] = r.field(construct["value"], r.evidence_of(text, p["construct_evidence"]), construct["confidence"])
    out["agonist_concentration_unresolved_token"] = token
    out["compound_preincubation_candidates"] = candidates
    return out


def decompose(sources: DataFrame, text: str, symbol: str, size: str = "n_entities", record_species: str = "human") -> DataFrame:
    """Sources plus, per field, its value, ``__evidence`` and ``__confidence``; signature and priority."""
    parsed = sources.select("*", *[c.alias(f"__{n}") for n, c in protocol_fields(F.col(text), symbol).items()])
    flat = []
    for name in FIELDS:
        flat += [
            F.col(f"__{name}.value").alias(name), F.col(f"__{name}.evidence").alias(f"{name}__evidence"),
            F.col(f"__{name}.confidence").alias(f"{name}__confidence"),
        ]
    side = ["agonist_concentration_unresolved_token", "compound_preincubation_candidates"]
    out = parsed.select(*sources.columns, *flat, *[F.col(f"__{s}").alias(s) for s in side])
    out = out.withColumn("record_species", F.lit(record_species))
    mentioned = F.coalesce(F.split("species_mentioned_in_text", ";"), F.array().cast("array<string>"))
    out = out.withColumn("text_mentions_other_species", r.extra_labels(mentioned, [record_species]))
    facts = r.count_by_confidence([F.col(f"{n}__confidence") for n in FIELDS], [F.col(f) for f in SIGNATURE_FIELDS])
    out = out.withColumns({
        "n_ambiguous_fields": facts["n_ambiguous"], "n_unknown_fields": facts["n_unknown"],
        "n_known_signature_fields": facts["n_known"], "protocol_signature": r.signature(SIGNATURE_FIELDS),
    })
    out = out.withColumn("review_priority", r.review_priority(F.col(size), F.col("n_ambiguous_fields"), F.col("n_unknown_fields")))
    return out.withColumn("requires_source_review", r.requires_review(F.col("review_priority")))


def families(decomposed: DataFrame, records: DataFrame, source: str, entity: str, collection: str, size: str = "n_entities") -> DataFrame:
    """Equal signatures; shared ignorance also makes a signature, hence the information level."""
    out = aggregate.signature_families(
        decomposed, records, "protocol_signature", source, entity, collection, size, "n_known_signature_fields"
    )
    return out.orderBy(F.col("sum_entities").desc(), "protocol_signature")


def protocol_contrasts(decomposed: DataFrame, records: DataFrame, source: str, entity: str, collection: str, value: str, group: str,
                       min_shared: int = 20, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    found = contrasts.paired_contrasts(
        records, decomposed, source, collection, entity, value, group, list(SIGNATURE_FIELDS), list(TIME_FIELDS), min_shared, replicates, seed
    )
    return found.orderBy(F.col("n_entities").desc())
