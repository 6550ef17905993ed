"""Feature columns from text and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small

FINGERPRINT_BITS = 2048


def tokens(text: Column | str) -> Column:
    """Lower-case word tokens."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(col), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def fingerprint(df: DataFrame, text: str, out: str = "fingerprint", bits: int = FINGERPRINT_BITS, longest: int = 3,
                count: str | None = None) -> DataFrame:
    """Binary hashed fingerprint: each token with its neighbourhood of up to ``longest`` tokens; ``count`` names a
    column for the number of distinct ones (0 without text)."""
    grams = F.array_distinct(F.concat(*[ngrams(F.col("__tok"), n) for n in range(1, longest + 1)]))
    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    staged = df.withColumn("__tok", words).withColumn("__grams", grams)
    hashed = HashingTF(numFeatures=bits, binary=True, inputCol="__grams", outputCol=out).transform(staged)
    if count:
        hashed = hashed.withColumn(count, F.coalesce(F.size("__grams"), F.lit(0)).cast("long"))
    return hashed.drop("__tok", "__grams")


def on_bits(vector: Column | str) -> Column:
    """Number of entries of a vector that are not 0."""
    return F.size(F.array_remove(vector_to_array(vector, "float32"), F.lit(0.0).cast("float")))


DESCRIPTORS = (
    "n_chars", "n_tokens", "n_lines", "digit_share", "upper_share", "punct_share", "blank_share", "accent_share",
    "vowel_share", "mean_token", "longest_token", "distinct_share", "short_share", "long_share", "lines_per_kchar",
)


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def descriptors(df: DataFrame, text: str) -> DataFrame:
    """Fifteen numeric descriptors of a text; an empty or missing text gives zeros."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumn("__t", t).withColumn("__tok", tokens(t))
    words, n = F.col("__tok"), F.size("__tok")
    lengths = F.transform(words, F.length)
    n_safe = F.greatest(n, F.lit(1))
    size = F.length("__t")
    lines = F.regexp_count(F.col("__t"), F.lit("\n")) + 1
    cols = {
        "n_chars": size,
        "n_tokens": n,
        "n_lines": F.when(size > 0, lines).otherwise(0),
        "digit_share": _share(F.col("__t"), "[0-9]"),
        "upper_share": _share(F.col("__t"), r"\p{Lu}"),
        "punct_share": _share(F.col("__t"), r"[.,;:!?#$%&*]"),
        "blank_share": _share(F.col("__t"), r"[ \n\t]"),
        "accent_share": _share(F.col("__t"), r"[^\x00-\x7F]"),
        "vowel_share": _share(F.col("__t"), r"[aeiouAEIOU]"),
        "mean_token": F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / n_safe,
        "longest_token": F.coalesce(F.array_max(lengths), F.lit(0)),
        "distinct_share": F.size(F.array_distinct(words)) / n_safe,
        "short_share": F.size(F.filter(lengths, lambda x: x <= 3)) / n_safe,
        "long_share": F.size(F.filter(lengths, lambda x: x >= 8)) / n_safe,
        "lines_per_kchar": lines * 1000.0 / F.greatest(size, F.lit(1)),
    }
    return base.select(*df.columns, *[c.cast("double").alias(k) for k, c in cols.items()])


def to_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def array_vector(array: Column | str) -> Column:
    return array_to_vector(array)


def concat_features(*arrays: Column | str) -> Column:
    parts = [F.col(a) if isinstance(a, str) else a for a in arrays]
    return F.concat(*[F.transform(p, lambda x: x.cast("double")) for p in parts])


def scale_on_train(df: DataFrame, key: str, features: str, fold: str, outer: str = "outer_fold") -> DataFrame:
    """Standardise an array column: centre and population sd come from training rows only.

    ``df`` holds one copy of a row per outer fold; the row's own fold tells train from test.
    The statistics are one row per (outer fold, position). A constant position keeps scale 1.
    """
    cells = df.where(F.col(fold) != F.col(outer)).select(outer, F.posexplode(features).alias("__i", "__x"))
    stats = cells.groupBy(outer, "__i").agg(F.avg("__x").alias("m"), F.stddev_pop("__x").alias("s"))
    packed = stats.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct("__i", "m", "s"))).alias("__stats"))
    scaled = F.zip_with(
        F.col(features), F.col("__stats"),
        lambda x, st: (x - st["m"]) / F.when(st["s"] > 0, st["s"]).otherwise(F.lit(1.0)),
    )
    return df.join(broadcast_if_small(packed), outer).withColumn("scaled", scaled).drop("__stats")


def first_token(vectors: Column) -> Column:
    """Pooling by the first token's vector."""
    return F.get(vectors, F.lit(0))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean over the token vectors whose mask is 1."""
    kept = F.transform(
        F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["v"]
    )
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))
