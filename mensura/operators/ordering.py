"""Order-based operators that never gather a group in one task.

Ranks, percentiles, running sums and numbered permutations all need the position of a
row within its group. A window over the group would hand a hot key to a single task, so
positions are built from *slots*: ordered intervals of the sort value. Rows are first
collapsed to distinct (group, value) pairs, slots are numbered by a window per
(group, slot), and a small table of slot totals supplies the offsets. Slot edges come
from an approximate quantile sketch; they decide only how work is spread, never a result.
"""

from __future__ import annotations

import functools
import math
import operator
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .joins import hot_key_lookup

_SLOT = "__slot"
MAX_SLOTS = 4096
# Groups measured to be at most this large are numbered by an ordinary window (which sorts
# and may spill) or fed to ``percentile`` (which keeps distinct values in memory).
WINDOW_ROWS = 2_000_000
PERCENTILE_ROWS = 250_000
TIE_RANGE = 1 << 20


def slot_count(spark: SparkSession) -> int:
    """One slot per shuffle partition, within sensible limits."""
    return max(8, min(MAX_SLOTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _sketch(df: DataFrame, value: Column, slots: int) -> list[float]:
    probabilities = [i / slots for i in range(1, slots)]
    row = df.agg(F.percentile_approx(value.cast("double"), probabilities, 10 * slots).alias("q")).first()
    # Infinities and NaN lie beyond the first or last edge anyway.
    return [float(v) for v in (row["q"] or []) if math.isfinite(v)]


def _number(df: DataFrame, value: str) -> Column:
    """The value as a double in the same order; a text by its first six bytes, a date by its day."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(value).cast("timestamp").cast("double")
    return F.col(value).cast("double")


def slot_edges(df: DataFrame, value: str, slots: int) -> list[float]:
    """Interior slot edges: an approximate quantile sketch merged map-side, ``slots - 1`` numbers."""
    return sorted(set(_sketch(df, _number(df, value), slots)))


def with_value_slots(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Slot number by binary search in the edges; order-preserving, so ties share a slot."""
    if not edges:
        return df.withColumn(_SLOT, F.lit(0))
    probe = "__probe"
    splits = [float("-inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=probe, outputCol=_SLOT, handleInvalid="keep")
    out = cut.transform(df.withColumn(probe, _number(df, value)))
    return out.withColumn(_SLOT, F.col(_SLOT).cast("int")).drop(probe)


def with_row_slots(
    df: DataFrame, value: str, tie: Sequence[str], slots: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Slots for rows in the order (value, hash of ``tie``, ``tie``); returns that order too.

    A value that fills several quantiles gets an interval of its own, cut by the hash into
    as many slots as it filled, so one frequent value does not end up in one task.
    """
    slots = slots or slot_count(df.sparkSession)
    sketch = Counter(_sketch(df, _number(df, value), slots))
    # Texts are compared by their first bytes here: equal ones may still differ, so none is cut by a hash.
    text = isinstance(df.schema[value].dataType, T.StringType)
    frequent = {} if text else {v: m for v, m in sketch.items() if m > 1}
    edges = sorted(set(sketch) | {math.nextafter(v, math.inf) for v in frequent})
    out = with_value_slots(df.withColumn("__tie", F.pmod(F.xxhash64(*tie), F.lit(TIE_RANGE))), value, edges)
    if frequent:
        pairs = [F.lit(x) for item in frequent.items() for x in item]
        cuts = F.try_element_at(F.create_map(*pairs), _number(df, value))
        part = F.coalesce(F.floor(F.col("__tie") * cuts / TIE_RANGE), F.lit(0))
        out = out.withColumn(_SLOT, F.col(_SLOT) * (slots + 1) + part)
    return out, [value, "__tie", *tie]


def hash_bits(df: DataFrame) -> int:
    """Leading bits that cut a hash order into slots of some 8 MB by Catalyst's estimate of the size: 256 to a million
    slots. The order of the hashes is that of the slots, so their number decides balance, never a result."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, min(20, (size >> 23).bit_length()))


def with_hash_slots(df: DataFrame, hash_col: str, bits: int | None = None) -> DataFrame:
    """Slots of a 64-bit hash: its leading bits, already evenly spread; as many as the size asks for."""
    bits = bits or hash_bits(df)
    return df.withColumn(_SLOT, F.shiftright(F.col(hash_col), 64 - bits).cast("int"))


def positions(df: DataFrame, value: str, tie: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """0-based position of each row in its group, in the order (value, hash of ``tie``, ``tie``).

    A window per group up to the measured size limit, slots beyond it.
    """
    if largest_group(df, keys) <= WINDOW_ROWS:
        group = Window.partitionBy(*(keys or [F.lit(0)]))
        order = [F.col(value), F.pmod(F.xxhash64(*tie), F.lit(TIE_RANGE)), *tie]
        return df.withColumn(out, F.row_number().over(group.orderBy(*order)) - 1)
    slotted, order = with_row_slots(df, value, tie)
    placed = cumulative(slotted.withColumn("__one", F.lit(1)), keys, order, ["__one"])
    return placed.select(*df.columns, F.col("__one_before").alias(out))


def cumulative(
    slotted: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    measures: Sequence[str],
) -> DataFrame:
    """Add ``<m>_before`` (sum over earlier rows of the group) and ``<m>_total`` per measure.

    ``slotted`` carries a slot column whose order agrees with ``order``. NULL keys are a group and NULL values a slot,
    the first, of their own.
    """
    spread = slotted.repartition(*keys, _SLOT)
    inside = Window.partitionBy(*keys, _SLOT).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = spread.select(
        "*", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"__in_{m}") for m in measures]
    )
    # One row per (group, slot): a group holds at most MAX_SLOTS of them.
    sums = spread.groupBy(*keys, _SLOT).agg(*[F.sum(m).alias(f"__s_{m}") for m in measures])
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        _SLOT,
        *[F.coalesce(F.sum(f"__s_{m}").over(before), F.lit(0)).alias(f"__off_{m}") for m in measures],
        *[F.sum(f"__s_{m}").over(group).alias(f"{m}_total") for m in measures],
    )
    names = {k: f"__k{i}" for i, k in enumerate([*keys, _SLOT])}
    offsets = offsets.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    out = numbered.join(offsets, functools.reduce(operator.and_, same))
    kept = [c for c in slotted.columns if c != _SLOT]
    return out.select(
        *kept,
        *[(F.col(f"__in_{m}") + F.col(f"__off_{m}")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def largest_group(df: DataFrame, keys: Sequence[str], limit: int = WINDOW_ROWS) -> int:
    """An upper bound of the largest group's rows, exact where it exceeds ``limit``.

    Groups of the first key alone are at least as large, and cheaper to count; further keys
    are added only while the bound is above the limit. Counting happens before the shuffle.
    """
    top = 0
    for used in range(min(1, len(keys)), len(keys) + 1):
        sizes = df.groupBy(*keys[:used]).agg(F.count(F.lit(1)).alias("n"))
        top = int(sizes.agg(F.max("n")).first()[0] or 0)
        if top <= limit:
            break
    return top


def _usable(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    known = F.col(value).isNotNull()
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        known = known & ~F.isnan(value)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return df.where(known)


def value_ranks(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    extra: Mapping[str, Column] | None = None,
    running: Sequence[str] = (),
    large: bool | None = None,
) -> DataFrame:
    """One row per distinct (keys, value): ``n``, ``n_before``, ``n_total`` and ``avg_rank``.

    Missing values and missing keys take no part. ``extra`` aggregates further columns at
    the same level; those named in ``running`` get their own ``_before`` and ``_total``.
    Tied rows share the mean of the ranks they cover. The largest group is measured first:
    up to ``WINDOW_ROWS`` a window per group numbers the values, beyond it slots do. ``large`` says what a
    caller has already measured.
    """
    keys = list(keys)
    rows = _usable(df, value, keys)
    counted = rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (extra or {}).items()]
    )
    measures = ["n", *running]
    if large is None:
        large = largest_group(rows, keys) > WINDOW_ROWS
    if not large:
        group = Window.partitionBy(*(keys or [F.lit(0)]))
        earlier = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        out = counted.select(
            "*",
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
        )
    else:
        edges = slot_edges(rows, value, slot_count(df.sparkSession))
        out = cumulative(with_value_slots(counted, value, edges), keys, [value], measures)
    return out.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2)


def percentiles(df: DataFrame, value: str, keys: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per group, any group size.

    Groups measured to fit in a task use Spark's ``percentile``; otherwise ranks do it.
    """
    rows = _usable(df, value, keys)
    if largest_group(rows, keys, PERCENTILE_ROWS) <= PERCENTILE_ROWS:
        ends = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in wanted.values()]))
        found = rows.groupBy(*keys).agg(ends.alias("__p"))
        return found.select(*keys, *[F.col("__p")[i].alias(name) for i, name in enumerate(wanted)])
    return percentiles_of_ranks(value_ranks(rows, value, keys), value, keys, wanted)


def percentiles_of_ranks(
    ranked: DataFrame, value: str, keys: Sequence[str], wanted: Mapping[str, float]
) -> DataFrame:
    v, n, before, total = F.col(value).cast("double"), F.col("n"), F.col("n_before"), F.col("n_total")

    def at(position: Column) -> Column:
        return F.max(F.when((before <= position) & (position < before + n), v))

    aggs, out = [], []
    for name, p in wanted.items():
        spot = (total - 1) * F.lit(float(p))
        low = F.floor(spot)
        aggs += [
            at(low).alias(f"__l_{name}"),
            at(F.ceil(spot)).alias(f"__h_{name}"),
            F.first(spot - low).alias(f"__f_{name}"),
        ]
        lo, hi, part = F.col(f"__l_{name}"), F.col(f"__h_{name}"), F.col(f"__f_{name}")
        # As ``percentile`` does it; equal ends stay as they are, infinite ones too.
        out.append(F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi).alias(name))
    # The interpolation weight depends on the group total only, so any row supplies it.
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *out)


def rows_with_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """``df`` plus the average rank of ``value`` within its group (NULL where it has none)."""
    ranked = value_ranks(df, value, keys).withColumnRenamed("avg_rank", out)
    on = [*keys, value]
    return hot_key_lookup(df, ranked.select(*on, out), on, "left")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows: every task keeps ``k`` rows, one merges them."""
    return df.orderBy(*order).limit(k)


def ordered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order)


def order_by_map(col: Column, order: Mapping[str, int], default: int = 9) -> Column:
    """Sort position of a label from a custom order."""
    out = F.lit(default)
    for label, position in order.items():
        out = F.when(col == label, F.lit(position)).otherwise(out)
    return out


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """One whole row per key, chosen by an explicit order.

    ``min_by`` is a partial aggregate: a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def cumulative_share(df: DataFrame, key: str, weight: str) -> DataFrame:
    """Position of each key by falling weight and the share held by it and all before it."""
    negative = df.withColumn("__neg", -F.col(weight)).withColumn("__one", F.lit(1))
    slotted, order = with_row_slots(negative, "__neg", [key])
    run = cumulative(slotted, [], order, ["__one", weight])
    upto = F.col(f"{weight}_before") + F.col(weight)
    return run.select(
        *df.columns,
        (F.col("__one_before") + 1).alias("position"),
        upto.alias("cumulative"),
        (upto / F.col(f"{weight}_total")).alias("share"),
    )


def seeded_hash(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def seeded_permutation(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """A repeatable shuffle: position of each row in hash order (1-based)."""
    h = "__hash"
    hashed = df.withColumn(h, seeded_hash(seed, key)).withColumn("__one", F.lit(1))
    run = cumulative(with_hash_slots(hashed, h), [], [h, key], ["__one"])
    return run.select(*df.columns, (F.col("__one_before") + 1).alias(out))


def seeded_sample(df: DataFrame, known: DataFrame, key: str, n: int, seed: int, order: Column | None = None) -> DataFrame:
    """``n`` rows whose key is not among the known ones, in repeatable random order."""
    left = df.join(known.select(key).distinct(), key, "left_anti")
    return left.orderBy(order if order is not None else seeded_hash(seed, key), key).limit(n)
