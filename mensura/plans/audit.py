"""Source audit: record aggregates, keyword flags, triage, manual annotations, coverage summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as c
from ..functions.rulebook import MANUAL_DEFAULTS, PRIORITY_ORDER, keyword_rules
from ..functions.rules import keyword_matrix
from ..operators import aggregate, joins
from ..operators.ordering import order_by_map
from ..session import cut_lineage, spread_wide

SEARCHED = ("description", "organism", "cell_type", "tissue", "label", "variant_mutation")
CANDIDATES = ("candidate_signal_trigger", "candidate_functional_direction", "candidate_strict")


def usable_records(records: DataFrame, source: str, entity: str) -> DataFrame:
    """Records without a source are dropped; without an entity they stay and count as rows only."""
    cleaned = records.withColumns({source: c.clean_text(source, False), entity: c.clean_text(entity, False)})
    return cleaned.where(F.col(source).isNotNull())


def annotate(sources: DataFrame, rulebook: Mapping[str, Sequence[tuple[str, str]]], text: Sequence[str] = SEARCHED) -> DataFrame:
    """Keyword flags and labels, length, sparseness, candidates and review priority."""
    available = [x for x in text if x in sources.columns]
    searched = sources.withColumn("search_text", c.normalize_text(c.combine_text(available)))
    out = keyword_matrix(searched, "search_text", rulebook)

    def col(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in sources.columns else F.lit("")

    functional = (F.upper(col("type")) == "F") | F.lower(col("label")).contains("functional")
    # A lone description is the searched text, which is normalised once.
    length = F.length("search_text") if available == ["description"] else F.length(c.normalize_text(col("description")))
    out = out.withColumns({
        "description_length": length,
        "flag_functional_metadata": functional,
    }).withColumn("flag_sparse_description", F.col("description_length") < 25)
    flags = c.candidate_flags(
        F.col("flag_calcium"), F.col("flag_aitc"), F.col("flag_functional_metadata"), F.col("flag_inhibition"), F.col("flag_mutant_or_chimera")
    )
    failed = col("fetch_source") == "error"
    out = out.withColumns(flags)
    return out.withColumn("review_priority", c.triage_priority(failed, F.col("flag_sparse_description"), F.col("candidate_strict")))


def audit(
    records: DataFrame, sources: DataFrame, symbol: str, prior: DataFrame | None = None,
    source: str = "source_id", entity: str = "entity_id", value: str = "value", year: str = "year",
) -> tuple[DataFrame, DataFrame]:
    """Review-ready source table and the flag coverage summary."""
    rows = usable_records(records, source, entity)
    counts = aggregate.source_aggregate(rows, source, entity, value if value in rows.columns else None, year if year in rows.columns else None)
    # Counts are few bytes and would leave the scan of the texts to few tasks.
    joined = spread_wide(joins.one_to_one_left(counts, sources, [source]), source)
    rulebook = keyword_rules(symbol)
    table = annotate(joined, rulebook)
    if prior is not None:
        table = joins.preserve_annotations(table, prior, source, MANUAL_DEFAULTS)
    else:
        table = table.withColumns({k: F.lit(v) for k, v in MANUAL_DEFAULTS.items()})
    # The scanned texts serve the table, its sort and the summary: they are searched once.
    table = cut_lineage(table)
    flags = [*[f"flag_{x}" for x in rulebook], "flag_functional_metadata", "flag_sparse_description", *CANDIDATES]
    summary = aggregate.flag_coverage(table, rows, source, entity, flags, "n_entities", "n_measurements")
    order = order_by_map(F.col("review_priority"), PRIORITY_ORDER)
    return (
        table.orderBy(order, F.col("n_entities").desc(), F.col("n_measurements").desc(), source),
        summary.orderBy(F.col("n_sources").desc(), F.col("entities_union").desc(), "category"),
    )
