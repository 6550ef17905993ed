"""Joins with stated contracts: validation, indicators, skew-safe lookups, blocked self-joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage
from .expect import enforce, unique_key

# A key is hot when it holds more rows than this and more than this share of all rows;
# by the second rule at most 1/share keys can be hot.
HOT_ROWS = 250_000
HOT_SHARE = 1 / 2000


def hot_key_lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Attach to ``rows`` the columns of ``table`` (unique on ``on``), safe for hot keys.

    Key sizes are counted first (before the shuffle, so cheaply). Without a hot key this is
    an ordinary join. Otherwise the hot part of the table - at most ``1/share`` rows - is
    broadcast, and rows of hot or NULL keys pass the shuffle spread by a salt taken from
    their content; they find no partner there and need none. Identical rows share a salt,
    so collapse copies first.
    """
    on = list(on)
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    facts = sizes.agg(F.max("__n").alias("top"), F.sum("__n").alias("total")).first()
    limit = max(hot_rows, (facts["total"] or 0) * share)
    if (facts["top"] or 0) <= limit:
        return rows.join(table, on, how).select(*rows.columns, *[c for c in table.columns if c not in on])
    keys = [tuple(r) for r in sizes.where(F.col("__n") > limit).select(*on).collect()]
    schema = T.StructType([rows.schema[c] for c in on])
    hot_keys = F.broadcast(rows.sparkSession.createDataFrame(keys, schema))
    extra = [c for c in table.columns if c not in on]

    def side(mark: str, part: DataFrame) -> DataFrame:
        return part.select(*on, *[F.col(c).alias(f"{mark}{c}") for c in extra], F.lit(True).alias(mark))

    hot = side("__hot", table.join(hot_keys, on, "left_semi"))
    tagged = rows.join(hot_keys.withColumn("__away", F.lit(True)), on, "left").join(F.broadcast(hot), on, "left")
    content = [f.name for f in rows.schema.fields if "map" not in f.dataType.simpleString()]
    away = F.col("__away").isNotNull()
    for key in on:
        away = away | F.col(key).isNull()
    salt = F.when(away, F.pmod(F.xxhash64(*content), F.lit(251)) + 1).otherwise(F.lit(0))
    cold = side("__cold", table).withColumn("__salt", F.lit(0).cast("long"))
    joined = tagged.withColumn("__salt", salt).join(cold, [*on, "__salt"], "left")
    if how == "inner":
        joined = joined.where(F.col("__hot").isNotNull() | F.col("__cold").isNotNull())
    return joined.select(
        *rows.columns,
        *[F.when(F.col("__hot"), F.col(f"__hot{c}")).otherwise(F.col(f"__cold{c}")).alias(c) for c in extra],
    )


def one_to_one_left(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join after both sides proved unique on the key."""
    on = list(on)
    enforce(unique_key(left, on, "left key"), unique_key(right, on, "right key"))
    return left.join(right, on, "left")


def left_join_zero(left: DataFrame, right: DataFrame, on: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Left join whose missing counts become 0."""
    out = left.join(right, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})


def outer_with_indicator(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str], indicator: str = "side"
) -> DataFrame:
    """Full outer join; shared value columns get a suffix, ``indicator`` tells the origin."""
    on = list(on)

    def suffixed(df: DataFrame, suffix: str, mark: str) -> DataFrame:
        cols = [F.col(c) if c in on else F.col(c).alias(c + suffix) for c in df.columns]
        return df.select(*cols, F.lit(True).alias(mark))

    joined = suffixed(left, suffixes[0], "__l").join(suffixed(right, suffixes[1], "__r"), on, "full_outer")
    side = (
        F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    )
    return joined.withColumn(indicator, side).drop("__l", "__r")


def within(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def without(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "inner")


def preserve_annotations(
    current: DataFrame, prior: DataFrame, key: str, defaults: Mapping[str, str]
) -> DataFrame:
    """Earlier manual values win, defaults fill the rest; a repeated prior key is an error."""
    enforce(unique_key(prior, [key], "prior annotation key"))
    known = [c for c in defaults if c in prior.columns]
    base = current.drop(*known)
    out = base.join(prior.select(key, *known), key, "left")
    for name, default in defaults.items():
        value = F.col(name) if name in out.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(value, F.lit(default)))
    return out


def dictionary_lookup(df: DataFrame, table: DataFrame, on: str, value: str, default) -> DataFrame:
    """Look a code up in a small table; unknown codes get ``default``."""
    out = df.join(broadcast_if_small(table.select(on, value)), on, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def alignment_report(
    left: DataFrame,
    right: DataFrame,
    on: str,
    numeric: Sequence[str] = (),
    exact: Sequence[str] = (),
    tolerance: float = 1e-9,
) -> DataFrame:
    """Do two tables describe the same rows? Counts of mismatches, compared by key."""
    both = outer_with_indicator(left.select(on, *numeric, *exact), right.select(on, *numeric, *exact), [on], ("_l", "_r"))
    is_both = F.col("side") == "both"

    def differs(name: str, number: bool) -> Column:
        a, b = F.col(name + "_l"), F.col(name + "_r")
        same = a.eqNullSafe(b)
        if number:
            same = same | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        return F.count_if(is_both & ~same)

    return both.agg(
        F.count_if(is_both).alias("n_both"),
        F.count_if(F.col("side") == "left_only").alias("n_left_only"),
        F.count_if(F.col("side") == "right_only").alias("n_right_only"),
        *[differs(c, True).alias(f"{c}_mismatch") for c in numeric],
        *[differs(c, False).alias(f"{c}_mismatch") for c in exact],
    )


def star_join(fact: DataFrame, *hops: tuple[DataFrame, str, str]) -> DataFrame:
    """Follow foreign keys ``(table, fact column, table key)``; a table goes to every
    executor only when it was counted to be small."""
    out = fact
    for table, column, key in hops:
        out = out.join(broadcast_if_small(table), F.col(column) == F.col(key), "left")
    return out


def explode_list(df: DataFrame, column: str, out: str, sep: str = ";") -> DataFrame:
    """One row per non-blank item of a joined list column."""
    items = df.withColumn(out, F.explode(F.split(F.col(column), sep)))
    return items.withColumn(out, F.trim(out)).where(F.col(out) != "")


def job_plan(
    spark, representations: Sequence[str], algorithms: Sequence[str], partitions: int, folds: int,
    baseline: tuple[str, str] | None = ("__baseline__", "mean"),
) -> DataFrame:
    """Every (representation, algorithm) combination × partition × fold: a fixed, tiny plan."""
    combos = [(r, a) for r in representations for a in algorithms]
    if baseline:
        combos.append(baseline)
    jobs = spark.createDataFrame(combos, "representation string, algorithm string")
    return jobs.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))


def distinct_over_members(records: DataFrame, members: DataFrame, on: str, group: str, entity: str, out: str) -> DataFrame:
    """Distinct entities over the sources of each group, for all groups in one job."""
    joined = records.select(on, entity).distinct().join(members.select(on, group).distinct(), on)
    return joined.groupBy(group).agg(F.countDistinct(entity).alias(out))


def differing_fields(fields: Sequence[str], a: str, b: str) -> Column:
    """Names of the signature fields in which two rows differ; NULL equals NULL."""
    return F.array_compact(
        F.array(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.lit(f)) for f in fields])
    )


def _field_text(f: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("?"))


def masked_signatures(fields: Sequence[str], extra_fields: Sequence[str] = ()) -> Column:
    """The signature with one field left out, for every field, plus the whole signature; each with
    what it leaves out (the whole one: the extra fields).

    Two rows that differ in exactly field *f* share exactly the signature without *f*, and differ
    in what it leaves out.
    """
    def without_field(skip: str | None) -> Column:
        parts = F.struct(*[_field_text(f).alias(f) for f in fields if f != skip])
        left_out = _field_text(skip) if skip else F.to_json(F.struct(*[_field_text(f).alias(f"f{i}") for i, f in enumerate(extra_fields)]))
        return F.struct(F.lit(skip or "").alias("mask"), F.xxhash64(parts).alias("code"), left_out.alias("left_out"))

    return F.array(*[without_field(f) for f in fields], *([without_field(None)] if extra_fields else []))


def whole_signature(fields: Sequence[str]) -> Column:
    """A signature that leaves everything out, in the form of ``masked_signatures``: all rows share it."""
    left_out = F.to_json(F.struct(*[_field_text(f).alias(f"f{i}") for i, f in enumerate(fields)]))
    return F.struct(F.lit("").alias("mask"), F.lit(0).cast("long").alias("code"), left_out.alias("left_out"))


def near_signature_pairs(
    records: DataFrame,
    sources: DataFrame,
    source: str,
    collection: str,
    entity: str,
    fields: Sequence[str],
    extra_fields: Sequence[str] = (),
    min_shared: int = 20,
) -> DataFrame:
    """Source pairs of one collection that share at least ``min_shared`` entities and differ in
    exactly one signature field, or in none but in an extra (time) field.

    No collection is crossed with itself. Sources meet only on a masked signature *and* a shared entity that
    is rare for one of the two: with entities ordered from rare to common, two sets that overlap in ``t``
    entities must meet within their first ``size - t + 1`` ones. What the signature leaves out must differ
    where they meet, so sources described alike are no candidates of each other. The meetings of a pair are
    counted, and the fewer than ``min_shared`` common entities at the end of both are compared as arrays, so
    no pair is joined to its entities again. Where collections hold few sources per entity (measured), the
    signature is left to the check of the pairs. All rules are exact; the surviving pairs are verified.
    Returns ``source_a, source_b, <collection>, diff, n_shared``.
    """
    known = F.col(source).isNotNull() & F.col(entity).isNotNull()
    # Read five times below, so the distinct is paid for once.
    pairs = cut_lineage(records.select(source, entity).where(known).distinct())
    sizes = pairs.groupBy(source).agg(F.count(F.lit(1)).alias("__size"))
    big = sizes.where(F.col("__size") >= min_shared)
    # Only fields of comparable sources take part from here on; a source described twice is two of them.
    described = sources.where(F.col(collection).isNotNull()).join(big, source).select(source, collection, *fields, *extra_fields)
    described = cut_lineage(described.withColumn("__id", F.monotonically_increasing_id()))
    frequency = pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("__freq"))
    weighted = hot_key_lookup(pairs, frequency, [entity])
    placed = cut_lineage(_rare_first(weighted.join(big, source), source, entity, min_shared))
    members = placed.join(described.select(source, collection), source)
    crowds = members.groupBy(collection, entity).agg(F.count(F.lit(1)).cast("double").alias("n"))
    facts = crowds.agg(F.sum(F.col("n") * F.col("n")).alias("meetings"), F.sum("n").alias("rows")).first()
    masked = (facts["meetings"] or 0) > 2 * (len(fields) + 2) * (facts["rows"] or 0)
    signature = F.explode(masked_signatures(fields, extra_fields) if masked else F.array(whole_signature([*fields, *extra_fields])))
    coded = described.select(source, "__id", collection, signature.alias("m")).select(
        source, "__id", F.col("m.mask").alias("__mask"), F.xxhash64(collection, "m.mask", "m.code").alias("__key"), F.col("m.left_out").alias("__out")
    )
    tokens = placed.join(coded, source)
    every = tokens.select("__key", entity, F.col(source).alias("__s"), F.col("__id").alias("__i"), "__mask", "__out", "__rare")
    rare = tokens.where("__rare").select("__key", entity, F.col(source).alias("__t"), F.col("__id").alias("__j"), F.col("__out").alias("__other"))
    # An entity that is rare for both is met from both sides and counted from the smaller source's.
    met = every.join(rare, ["__key", entity]).where(
        (F.col("__out") != F.col("__other")) & (F.col("__s") != F.col("__t")) & (~F.col("__rare") | (F.col("__s") < F.col("__t")))
    )
    ahead = F.col("__s") < F.col("__t")
    met = met.groupBy(
        F.when(ahead, F.col("__i")).otherwise(F.col("__j")).alias("__a"), F.when(ahead, F.col("__j")).otherwise(F.col("__i")).alias("__b"), "__mask"
    ).agg(F.count(F.lit(1)).alias("__met"), F.max("__rare").alias("__both")).where("__both")
    common = placed.where("NOT __rare").groupBy(source).agg(F.collect_list(entity).alias("__common"))
    info = described.join(common, source, "left").select(
        "__id", source, collection, F.struct(*fields, *extra_fields).alias("s"), F.coalesce("__common", F.array().cast(common.schema["__common"].dataType)).alias("c")
    )
    sides = [info.select(F.col("__id").alias(f"__{x}"), F.col(source).alias(f"source_{x}"), F.col(collection).alias(collection if x == "a" else "__collection"),
                         F.col("s").alias(x), F.col("c").alias(f"__common_{x}")) for x in "ab"]
    named = met.join(sides[0], "__a").join(sides[1], "__b").where(F.col(collection) == F.col("__collection"))
    diff = named.withColumn("diff", differing_fields(fields, "a", "b")).withColumn(
        "extra_diff", differing_fields(extra_fields, "a", "b") if extra_fields else F.array().cast("array<string>")
    )
    one, none = F.size("diff") == 1, (F.size("diff") == 0) & (F.size("extra_diff") > 0)
    if masked:
        # Codes are hashes: the count of the mask that the pair does share.
        one, none = one & (F.get("diff", F.lit(0)) == F.col("__mask")), none & (F.col("__mask") == "")
    shared = F.col("__met") + F.size(F.array_intersect("__common_a", "__common_b"))
    ok = cut_lineage(diff.where(one | none).select("source_a", "source_b", collection, "a", "b", "diff", "extra_diff", shared.alias("__shared")))
    # A pair of sources that are described several times counts its entities as often.
    counts = ok.groupBy("source_a", "source_b").agg(F.sum("__shared").alias("n_shared")).where(F.col("n_shared") >= min_shared)
    return ok.drop("__shared").join(counts, ["source_a", "source_b"])


def _rare_first(weighted: DataFrame, source: str, entity: str, min_shared: int) -> DataFrame:
    """The entities of each source; ``__rare`` marks the ``size - min_shared + 1`` rarest, in one order for all."""
    from .ordering import positions

    placed = positions(weighted, "__freq", [entity], [source], "__pos")
    return placed.select(source, entity, (F.col("__pos") < F.col("__size") - min_shared + 1).alias("__rare"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other."""
    right_named = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on])
    return left.join(right_named, cond, how).drop(*[f"__r_{c}" for c in on])
