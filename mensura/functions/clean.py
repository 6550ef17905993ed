"""Missing-value rules, coercion, normalisation and flag expressions.

Every function takes and returns Spark columns, so Catalyst keeps them inside one
projection and pushes filters on raw columns down to the scan.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that count as blank at the ends of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Spellings of the two truth values.
TRUE_WORDS = ("true", "1", "1.0", "yes", "y")
FALSE_WORDS = ("false", "0", "0.0", "no", "n")
# Dashes unified to the ASCII hyphen (minus sign, en dash, em dash).
DASHES = "\u2212\u2013\u2014"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NON_ASCII = r"[^\x00-\x7F]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(as_column(c).cast("string"), F.lit(BLANKS))


def clean_text(c: Column | str, nan_is_missing: bool = True) -> Column:
    """Stripped text; blank (and, by default, the word ``nan``) becomes NULL."""
    text = strip(c)
    missing = text == ""
    if nan_is_missing:
        missing = missing | (F.lower(text) == "nan")
    return F.when(~missing, text)


def clean_array(c: Column | str) -> Column:
    """An empty collection counts as missing."""
    return F.when(F.size(as_column(c)) > 0, as_column(c))


def is_present(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Whether a value of any type is present: not NULL, NaN, blank or empty."""
    col = as_column(c)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNotNull() & ~F.isnan(col)
    if isinstance(dtype, (T.StringType, type(None))):
        return F.coalesce(strip(col) != "", F.lit(False))
    return col.isNotNull()


def to_number(c: Column | str) -> Column:
    """Double, or NULL where the text is not a number (NaN counts as missing)."""
    text = strip(c)
    special = F.lower(text).isin("inf", "+inf", "infinity", "+infinity")
    negative = F.lower(text).isin("-inf", "-infinity")
    return (
        F.when(text.rlike(_NUMBER), text.try_cast("double"))
        .when(special, F.lit(float("inf")))
        .when(negative, F.lit(float("-inf")))
    )


def nan_to_null(c: Column | str) -> Column:
    col = as_column(c).try_cast("double")
    return F.when(~F.isnan(col), col)


def first_present(*columns: Column | str | None) -> Column:
    """First non-missing text; absent columns may be passed as ``None``."""
    found = [clean_text(c, nan_is_missing=False) for c in columns if c is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def parse_bool3(c: Column | str) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_text(c: Column | str, nfkc: bool = True) -> Column:
    """Compatibility form, lower case, one kind of dash, single blanks, stripped.

    Pure ASCII text is already in compatibility form: those rows go to the Arrow
    function as NULL and keep their JVM value.
    """
    text = F.coalesce(as_column(c).cast("string"), F.lit(""))
    if nfkc:
        text = F.coalesce(_nfkc(F.when(text.rlike(_NON_ASCII), text)), text)
    text = F.translate(F.lower(text), DASHES, "-" * len(DASHES))
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def combine_text(columns: Sequence[Column | str], sep: str = " | ") -> Column:
    """Join columns; a missing one keeps its empty slot."""
    return F.concat_ws(sep, *[F.coalesce(as_column(c).cast("string"), F.lit("")) for c in columns])


def nested_to_json(c: Column | str, dtype: T.DataType) -> Column:
    """Canonical JSON text (map keys sorted), '' when missing."""
    col = as_column(c)
    value = F.map_from_entries(F.array_sort(F.map_entries(col))) if isinstance(dtype, T.MapType) else col
    present = F.size(col) > 0 if isinstance(dtype, (T.MapType, T.ArrayType)) else col.isNotNull()
    return F.when(present, F.to_json(value)).otherwise(F.lit(""))


def conform_schema(df: DataFrame, schema: T.StructType, strict_types: bool = False) -> DataFrame:
    """Select exactly the columns of ``schema``: absent ones as typed NULLs, extra ones dropped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for field in schema.fields:
        if field.name not in have:
            col = F.lit(None).cast(field.dataType)
        elif have[field.name] == field.dataType:
            col = F.col(field.name)
        else:
            cast = F.col(field.name).cast if strict_types else F.col(field.name).try_cast
            col = cast(field.dataType)
        out.append(col.alias(field.name))
    return df.select(*out)


def strict_filter(
    df: DataFrame,
    equals: Mapping[str, object],
    not_null: Sequence[str] = (),
) -> DataFrame:
    """Rows with the given exact values and present required columns; plain predicates only,
    so the scan receives them as pushed filters."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    for name in not_null:
        df = df.where(F.col(name).isNotNull())
    return df


# Relation signs of one-sided measurements.
RIGHT_SIGNS = (">", ">=", ">>")
LEFT_SIGNS = ("<", "<=", "<<")


def classify_censoring(
    kind: Column, relation: Column, value: Column, upper: Column, wanted: str
) -> dict[str, Column]:
    """Five flags of a measurement of the ``wanted`` kind."""
    is_kind = F.coalesce(kind == wanted, F.lit(False))
    exact = is_kind & F.coalesce(relation == "=", F.lit(False)) & value.isNotNull() & upper.isNull()
    return {
        "exact": exact,
        "non_exact": is_kind & ~exact,
        "interval": is_kind & upper.isNotNull(),
        "right_censored": is_kind & F.coalesce(relation.isin(*RIGHT_SIGNS), F.lit(False)),
        "left_censored": is_kind & F.coalesce(relation.isin(*LEFT_SIGNS), F.lit(False)),
    }


# Wording that marks a record as inactive, and the part of a type label
# that marks a single-point measurement.
INACTIVE_PATTERN = r"\binactive\b|\bnot\s+active\b"
SINGLE_POINT_PART = "INHIB"


def record_flags(
    comments: Sequence[Column],
    kind: Column,
    wanted: str,
    structure: Column,
    duplicate: Column,
    validity: Column,
    organism: Column,
    text_value: Column,
    inactive_pattern: str = INACTIVE_PATTERN,
    single_point_part: str = SINGLE_POINT_PART,
) -> dict[str, Column]:
    """Descriptive flags of a record; every one is TRUE or FALSE, never NULL."""
    remark = F.concat_ws(" ", *[F.coalesce(clean_text(c, False), F.lit("")) for c in comments])
    label = F.upper(F.coalesce(kind, F.lit("")))
    return {
        "text_contains_inactive": remark.rlike("(?iU)" + inactive_pattern),
        "single_point": label.contains(single_point_part) & (label != wanted),
        "missing_structure": clean_text(structure, False).isNull(),
        "potential_duplicate_true": F.coalesce(parse_bool3(duplicate), F.lit(False)),
        "has_validity_comment": clean_text(validity, False).isNotNull(),
        "missing_organism": clean_text(organism, False).isNull(),
        "has_text_value": clean_text(text_value, False).isNotNull(),
    }


def flags_to_list(flags: Mapping[str, Column] | Sequence[str], sep: str = ";") -> Column:
    items = flags.items() if isinstance(flags, Mapping) else [(f, F.col(f)) for f in flags]
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for name, cond in items])


def any_flag(flags: Sequence[str]) -> Column:
    """Review mask: at least one flag is set."""
    mask = F.lit(False)
    for name in flags:
        mask = mask | F.coalesce(F.col(name), F.lit(False))
    return mask


# Factors that turn a concentration unit into mol/l.
MOLAR_FACTORS = {"M": 1.0, "mM": 1e-3, "uM": 1e-6, "nM": 1e-9, "pM": 1e-12}


def neg_log10_molar(value: Column, unit: Column | None = None) -> Column:
    """-log10 of a concentration in mol/l; nM when no unit is given."""
    if unit is None:
        factor = F.lit(MOLAR_FACTORS["nM"])
    else:
        factor = F.lit(None).cast("double")
        for name, number in MOLAR_FACTORS.items():
            factor = F.when(unit == name, F.lit(number)).otherwise(factor)
    return F.when(value > 0, -F.log10(value * factor))


def threshold_label(value: Column, threshold: float = 7.0) -> Column:
    return (value >= F.lit(threshold)).cast("int")


def ladder(steps: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """First condition that holds decides; the general form of all bucket rules."""
    out = None
    for cond, label in steps:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def information_level(n_known: Column) -> Column:
    return ladder(
        [(n_known >= 5, "well_specified"), (n_known >= 3, "partially_specified")], "low_information"
    )


def delta_size_verdict(n_new: Column) -> Column:
    return ladder([(n_new >= 100, "sufficient"), (n_new >= 40, "marginal"), (n_new > 0, "too_few")], "none")


def confound_level(rho: Column) -> Column:
    return ladder(
        [(F.abs(rho) > 0.3, "confound_possible"), (F.abs(rho) > 0.15, "mild_trend")], "independent"
    )


def direction_arrow(rho: Column) -> Column:
    return ladder([(rho > 0.05, "up"), (rho < -0.05, "down")], "neutral")


def partial_verdict(raw: Column, partial: Column) -> Column:
    return ladder([(F.abs(raw - partial) < 0.1, "signal_holds")], "partly_explained")


def triage_priority(error: Column, sparse: Column, candidate: Column) -> Column:
    """Failed or sparse descriptions first, then strict candidates."""
    return ladder([(error | sparse, "high"), (candidate, "candidate_strict")], "normal")


def candidate_flags(
    signal: Column, trigger: Column, functional: Column, direction: Column, excluded: Column
) -> dict[str, Column]:
    first = signal & trigger
    second = functional & direction
    return {
        "candidate_signal_trigger": first,
        "candidate_functional_direction": second,
        "candidate_strict": first & second & ~excluded,
    }


def text_length(c: Column | str) -> Column:
    return F.length(normalize_text(c))


def is_sparse(c: Column | str, minimum: int = 25) -> Column:
    return text_length(c) < minimum


def link_column(template: str, key: Column) -> Column:
    """``template`` has one ``%s``; a missing key gives ''."""
    present = clean_text(key)
    return F.when(present.isNotNull(), F.format_string(template, present)).otherwise(F.lit(""))


def is_finite(c: Column | str) -> Column:
    col = as_column(c).try_cast("double")
    return F.coalesce(~F.isnan(col) & (F.abs(col) < float("inf")), F.lit(False))


def array_is_finite(c: Column | str) -> Column:
    return F.coalesce(F.forall(as_column(c), is_finite), F.lit(False))


def fold_change(delta: Column) -> Column:
    return F.pow(F.lit(10.0), delta)


def largest_component(
    c: Column | str, separator: str = r"\n", dropped: Sequence[str] = (), size=F.length
) -> Column:
    """Split, drop listed parts (never all of them), keep the largest; first one wins a tie."""
    def largest(parts: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.aggregate(
            parts, none, lambda best, p: F.when(best.isNull() | (size(p) > size(best)), p).otherwise(best)
        )

    parts = F.filter(F.split(as_column(c), separator), lambda p: strip(p) != "")
    if not dropped:
        return largest(parts)
    kept = F.filter(parts, lambda p: ~p.isin(*dropped))
    return F.coalesce(largest(kept), largest(parts))


def identity_key(c: Column | str, nfkc: bool = True) -> Column:
    """Stable key of a text: hash of its normal form, NULL when nothing is left."""
    return F.sha2(F.nullif(normalize_text(c, nfkc=nfkc), F.lit("")), 256)


def empty_group_sentinel(group: Column, key: Column, prefix: str = "UNGROUPED::") -> Column:
    """A blank group becomes one group per row instead of one large false cluster."""
    return F.coalesce(clean_text(group), F.concat(F.lit(prefix), key.cast("string")))
