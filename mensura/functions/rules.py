"""Text-rule annotation: keyword rules and field extraction that keep their evidence.

Patterns follow Python's Unicode-aware reading of ``\\w``, ``\\b`` and ``\\d``; the ``(?U)``
flag asks the JVM for the same one. A field is a struct of value, evidence and confidence.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import as_column, ladder, strip

Rule = tuple[str, str]

# Confidence words.
EXPLICIT = "explicit_description"
AMBIGUOUS_MULTIPLE = "ambiguous_multiple"
AMBIGUOUS = "ambiguous"
UNKNOWN = "unknown"

EVIDENCE_MARGIN = 60


def java(pattern: str, ignore_case: bool = True) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def required_words(pattern: str) -> list[str]:
    """ASCII texts of which every match of ``pattern`` holds at least one; empty where none can be told, as with
    inline flags, nested classes or what only Java's patterns know."""
    kinds = re._constants

    def of(items) -> list[str]:
        choices, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is kinds.LITERAL and arg < 128:
                run += chr(arg)
                continue
            choices.append([run] if run else [])
            run = ""
            if op is kinds.SUBPATTERN:
                choices.append(of(arg[-1]))
            elif op is kinds.BRANCH:
                parts = [of(b) for b in arg[1]]
                choices.append([w for p in parts for w in p] if all(parts) else [])
            elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[0] >= 1:
                choices.append(of(arg[2]))
        return max((c for c in choices if c), key=lambda c: min(map(len, c)), default=[])

    if re.search(r"\(\?[a-zA-Z-]|&&|\[[^\]]*\[", pattern):
        return []
    try:
        return list(dict.fromkeys(of(re._parser.parse(pattern))))
    except re.error:
        return []


# Letters outside ASCII that match one of it where case is ignored: long s, dotless i, I with dot, Kelvin sign.
FOLDED = "\u017f\u0131\u0130\u212a"


def found(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether ``pattern`` occurs; only texts that hold a word which it needs are scanned for it."""
    hit = text.rlike(java(pattern, ignore_case))
    words = required_words(pattern)
    if words:
        low = F.lower(text) if ignore_case else text
        hints = [low.contains(w.lower() if ignore_case else w) for w in words]
        hints += [text.contains(x) for x in FOLDED] if ignore_case else []
        hit = reduce(lambda x, y: x | y, hints) & hit
    return F.coalesce(hit, F.lit(False))


def matched_labels(text: Column, rules: Sequence[Rule], ignore_case: bool = False) -> Column:
    """Sorted distinct labels of the rules whose pattern occurs in ``text``."""
    hits = F.array(*[F.when(found(text, p, ignore_case), F.lit(label)) for label, p in rules])
    return F.array_sort(F.array_distinct(F.array_compact(hits)))


def keyword_matrix(df: DataFrame, text: str, rulebook: Mapping[str, Sequence[Rule]]) -> DataFrame:
    """For each category a ``flag_`` column and a ``matches_`` column of ``;``-joined labels.

    Each pattern is scanned once: the flags are read off the label arrays.
    """
    labels = df.select("*", *[matched_labels(F.col(text), r).alias(f"__{c}") for c, r in rulebook.items()])
    flags = [(F.size(f"__{c}") > 0).alias(f"flag_{c}") for c in rulebook]
    joined = [F.array_join(f"__{c}", ";").alias(f"matches_{c}") for c in rulebook]
    return labels.select(*df.columns, *flags, *joined)


def contains_any(text: Column | str, words: Sequence[str]) -> Column:
    low = F.lower(as_column(text))
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return F.coalesce(hit, F.lit(False))


def field(value: Column, evidence: Column, confidence: Column) -> Column:
    return F.struct(
        value.cast("string").alias("value"),
        evidence.cast("string").alias("evidence"),
        confidence.cast("string").alias("confidence"),
    )


def evidence_of(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """The first match with up to 60 characters on both sides, on one line.

    Lengths are taken from extracted text, hence in characters, also beyond the BMP.
    """
    whole = java(f"(?s)^(.*?)((?-s){pattern})", ignore_case)
    head = F.length(F.regexp_extract(text, whole, 1))
    match = F.length(F.regexp_extract(text, whole, 2))
    lead = F.least(head, F.lit(EVIDENCE_MARGIN))
    window = F.substring(text, head - lead + 1, lead + match + EVIDENCE_MARGIN)
    return F.when(found(text, pattern, ignore_case), strip(F.translate(window, "\n", " ")))


def extract_field(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """Struct of value (capture ``group``; 0 for the whole match) and evidence; NULL without match."""
    value = F.regexp_extract(text, java(pattern, ignore_case), group)
    return F.when(
        found(text, pattern, ignore_case),
        F.struct(value.alias("value"), evidence_of(text, pattern, ignore_case).alias("evidence")),
    )


def extract_value(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    return F.when(
        found(text, pattern, ignore_case), F.regexp_extract(text, java(pattern, ignore_case), group)
    )


def extract_all(text: Column, pattern: str, group: int = 1, normalize=None) -> Column:
    """Sorted distinct matches as an array; ``normalize`` maps one match to its stored form."""
    hits = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))
    hits = F.when(text.isNull() | found(text, pattern), hits).otherwise(F.array().cast("array<string>"))
    if normalize is not None:
        hits = F.transform(hits, normalize)
    return F.array_sort(F.array_distinct(hits))


def joined_or_null(labels: Column, sep: str = ";") -> Column:
    return F.when(F.size(labels) > 0, F.array_join(labels, sep))


def count_confidence(labels: Column, one: str = EXPLICIT, many: str = AMBIGUOUS_MULTIPLE) -> Column:
    size = F.coalesce(F.size(labels), F.lit(0))
    return ladder([(size == 1, one), (size > 1, many)], UNKNOWN)


def multi_label(text: Column, rules: Sequence[Rule], evidence_pattern: str | None = None) -> Column:
    """All labels that apply, in rule order; more than one is ambiguous, none is unknown."""
    labels = F.array_compact(F.array(*[F.when(found(text, p), F.lit(label)) for label, p in rules]))
    proof = evidence_of(text, evidence_pattern) if evidence_pattern else F.lit(None)
    return field(joined_or_null(labels), proof, count_confidence(labels))


def extract_levels(text: Column, pattern: str, evidence_pattern: str | None = None, normalize=None) -> Column:
    labels = extract_all(text, pattern, 1, normalize)
    proof = evidence_of(text, evidence_pattern or pattern)
    return field(joined_or_null(labels), proof, count_confidence(labels))


def conflict_label(
    text: Column,
    first: tuple[str, str, str],
    second: tuple[str, str, str],
    mixed: str,
) -> Column:
    """Two detectors ``(label, pattern, evidence pattern)``: one label, the other, or ``mixed``."""
    a, b = found(text, first[1]), found(text, second[1])
    ev_a, ev_b = evidence_of(text, first[2]), evidence_of(text, second[2])
    none = F.lit("None")  # a detector may fire without its narrower evidence pattern
    both = F.concat(F.coalesce(ev_a, none), F.lit(" || "), F.coalesce(ev_b, none))
    value = F.when(a & b, mixed).when(a, first[0]).when(b, second[0])
    proof = F.when(a & b, both).when(a, ev_a).when(b, ev_b)
    return field(value, proof, F.when(value.isNotNull(), EXPLICIT).otherwise(UNKNOWN))


def precedence_label(
    text: Column,
    rules: Sequence[Rule],
    absent: str | None,
    evidence_pattern: str | None = None,
    ignore_case: bool = True,
) -> Column:
    """First rule that matches decides; no match gives ``absent`` with confidence unknown."""
    value, hit = F.lit(absent).cast("string"), F.lit(False)
    for label, pattern in reversed(rules):
        here = found(text, pattern, ignore_case)
        value, hit = F.when(here, F.lit(label)).otherwise(value), hit | here
    proof = evidence_of(text, evidence_pattern) if evidence_pattern else F.lit(None)
    return field(value, proof, F.when(hit, EXPLICIT).otherwise(UNKNOWN))


def simple_field(text: Column, pattern: str, confidence: str = EXPLICIT) -> Column:
    value = extract_value(text, pattern)
    return field(value, evidence_of(text, pattern), F.when(value.isNotNull(), confidence).otherwise(UNKNOWN))


def number_with_unit(text: Column, with_unit: str, bare: str) -> tuple[Column, Column]:
    """A number counts only with its unit; a bare one is kept aside as an unresolved token."""
    value = extract_value(text, with_unit)
    token = F.when(value.isNull(), extract_value(text, bare))
    proof = F.coalesce(evidence_of(text, with_unit), evidence_of(text, bare))
    out = field(value, proof, F.when(value.isNotNull(), "explicit_with_units").otherwise(UNKNOWN))
    return out, token


def clause_then_numbers(
    text: Column, clauses: Sequence[str], unit_number: str, any_number: str = r"(\d+)"
) -> tuple[Column, Column]:
    """Find the clause, then its numbers near a unit, else any numbers.

    One number is the value; several give NULL, ``ambiguous`` and the candidate list.
    """
    clause = F.coalesce(*[extract_value(text, p) for p in clauses])
    proof = F.coalesce(*[evidence_of(text, p) for p in clauses])
    near = F.regexp_extract_all(clause, F.lit(java(unit_number)), F.lit(1))
    plain = F.regexp_extract_all(clause, F.lit(java(any_number)), F.lit(1))
    numbers = F.when(F.size(near) > 0, near).otherwise(plain)
    size = F.coalesce(F.size(numbers), F.lit(0))
    value = F.when(size == 1, F.get(numbers, F.lit(0)))
    confidence = ladder([(size == 1, EXPLICIT), (size > 1, AMBIGUOUS)], UNKNOWN)
    return field(value, proof, confidence), F.when(size > 0, F.array_join(numbers, ";"))


def prefix_extract(text: Column, pattern: str, length: int = 80, confidence: str = "inferred_from_title") -> Column:
    """A field that is defined on the first ``length`` characters: the title part of a description."""
    return simple_field(F.substring(text, 1, length), pattern, confidence)


def signature(columns: Sequence[Column | str], missing: str = "NA", sep: str = " | ") -> Column:
    parts = []
    for c in columns:
        text = as_column(c).cast("string")
        parts.append(F.when(text.isNull() | (text == "nan"), F.lit(missing)).otherwise(text))
    return F.concat_ws(sep, *parts)


def count_by_confidence(confidences: Sequence[Column], values: Sequence[Column]) -> dict[str, Column]:
    def total(conditions):
        out = F.lit(0)
        for cond in conditions:
            out = out + F.coalesce(cond, F.lit(False)).cast("int")
        return out

    return {
        "n_ambiguous": total(c.startswith("ambiguous") for c in confidences),
        "n_unknown": total(c == UNKNOWN for c in confidences),
        "n_known": total(v.isNotNull() for v in values),
    }


def review_priority(size: Column, n_ambiguous: Column, n_unknown: Column, big: int = 50) -> Column:
    large, unclear = size >= big, n_ambiguous > 0
    return ladder(
        [
            (unclear & large, "critical"),
            (unclear | (large & (n_unknown >= 3)), "high"),
            (large | (n_unknown >= 4), "medium"),
        ],
        "low",
    )


def requires_review(priority: Column) -> Column:
    return priority.isin("critical", "high")


def extra_labels(labels: Column, allowed: Sequence[str]) -> Column:
    """Whether labels outside the allowed ones occur."""
    return F.size(F.array_except(labels, F.array(*[F.lit(a) for a in allowed]))) > 0
