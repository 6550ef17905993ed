"""Mixing sources to target weights, with DataFrame operations only.

The words of a source are laid end to end and packed into blocks of fixed length. Every slot of the
output takes one block. How many slots of a shard a source gets is a multinomial draw per output shard, drawn
jointly for all shards given that the totals meet the targets: a pseudorandom permutation deals the slots of all
sources out to the shards (multinomial counts with given totals are multivariate hypergeometric, which is
what such a deal gives). A block's words stand in the shard of its slot. Slots of
a source walk through pseudorandom permutations of its block numbers, a new one each time all its blocks are used,
and are joined with the blocks by number. So no block is taken more often than its source's target asks for,
rounded up, and every draw is a hash: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_AND_GAP, stored, words

BLOCK_WORDS, SHARD_SLOTS, ROUNDS = 128, 4096, 20
WEIGHTS, MOST = (1, 2, 3), 3
#: Slots that a task draws.
SLOTS_A_TASK = 1 << 16
#: Documents of a source that are numbered together.
CHUNK = 2048


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """Place of ``x`` in a pseudorandom permutation of 0 .. n - 1, by ``ROUNDS`` swap-or-not rounds:
    each pairs every number with another and swaps some of the pairs, decided by a hash of the larger."""

    def swap(at: Column, r: Column) -> Column:
        key = F.xxhash64(*seed, r)
        other = F.pmod(F.pmod(key, n) + n - at, n)
        return F.when(F.xxhash64(key, F.greatest(at, other)).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` (key, size, rid, copy, ...) with ``start``: words of the source's documents before this one.

    Documents are numbered inside chunks of bounded size; totals of the chunks give each chunk's offset.
    """
    counts = stored(docs.groupBy("key").agg(F.count("*").alias("docs")), "counts")
    docs = docs.join(counts, "key").withColumn("chunk", F.pmod(F.xxhash64("rid", "copy"), F.ceil(F.col("docs") / CHUNK)))
    docs = stored(docs.drop("docs"), "chunks")
    inside = Window.partitionBy("key", "chunk").orderBy("rid", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = docs.groupBy("key", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(totals.select("key", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")), "offsets")
    return placed.join(offsets, ["key", "chunk"]).withColumn("start", F.col("start") + F.col("offset")).drop("offset", "chunk")


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, blocks, slots) from (source, size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. Targets share the sum of all sizes by
    weight and stop at ``most`` times their source's size; the excess is shared again until none is above. That
    is min(most * size, weight * level) for one level, found among the sources in order of most * size / weight.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    table = table.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    table = table.withColumn("total", F.sum("source_size").over(everything))
    # With the sources before this one at their caps, the others would share at this level.
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", (F.col("total") - capped) / others)
    # Levels rise up to the right one, the first that its source's cap allows, and fall behind it.
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return table.withColumn("target", target).select("source", "source_size", "target")


def blocks_and_slots(targets: DataFrame, block_words: int) -> DataFrame:
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    return targets.withColumn("blocks", blocks).withColumn("slots", slots)


def mixture(targets: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(shard, slot, source, epoch, block) for every slot of the output.

    ``targets`` has blocks and slots per source; slot numbers run through 0 .. all slots - 1.
    """
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    table = targets.where("slots > 0").withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    table = table.withColumn("all", F.sum("slots").over(Window.partitionBy()))
    # Ranges of slots first, spread over the tasks, then the slots.
    ranges = table.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("slots") - 1, F.lit(shard_slots))))
    wanted = targets.agg(F.sum("slots")).first()[0] or 0
    ranges = ranges.repartition(-(-wanted // SLOTS_A_TASK) or 1, F.col("source"), F.col("low"))
    slots = ranges.withColumn("i", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + shard_slots, F.col("slots")) - 1)))
    slots = slots.withColumn("epoch", F.floor(F.col("i") / F.col("blocks")))
    block = permuted(F.col("i") % F.col("blocks"), F.col("blocks"), F.lit(seed), _key(), F.col("epoch"))
    place = permuted(F.col("first") + F.col("i"), F.col("all"), F.lit(seed), F.lit("slots"))
    return slots.select("source", "epoch", block.alias("block"), place.alias("slot")).withColumn("shard", F.floor(F.col("slot") / shard_slots))


def mix_documents(docs: DataFrame, row: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS,
                  shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """(row, size, source_size, target, taken) for every document.

    Texts that are null, empty or blank have size 0 and nothing is taken of them; a null source is a source
    of its own, the last. Rows that repeat are documents of their own. Other columns are ignored. No rows, no rows.
    """
    laid, dealt, targets = _plan(docs, row, text, source, block_words, shard_slots, weights, most, seed)
    times = dealt.groupBy("key", "block").agg(F.sum(F.size("slots")).alias("times"))
    touched = _touched(laid, block_words).join(times, ["key", "block"]).groupBy("rid", "copy").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    laid = laid.join(touched, ["rid", "copy"], "left").join(targets, "key")
    return laid.select(F.col("doc_id").alias(row), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _identity(row: str, text: str, source: str) -> Column:
    """Equal for rows that repeat; their ``copy`` numbers then tell them apart."""
    return F.xxhash64(F.col(row), F.col(text), F.col(source).cast("string"))


def _key() -> Column:
    """A source's name where names must not be null."""
    return F.coalesce("source", F.lit("\0null"))


def _copies():
    return Window.partitionBy("rid").orderBy("rid")


def _plan(docs, row, text, source, block_words, shard_slots, weights, most, seed):
    size = F.size(words(F.col(text))).cast("long")
    base = docs.select(F.col(row).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"),
                       _identity(row, text, source).alias("rid"))
    base = stored(base, "sizes").withColumn("copy", F.row_number().over(_copies()))
    targets = stored(blocks_and_slots(source_targets(base, weights, most), block_words), "targets")
    laid = stored(numbered(base.withColumn("key", _key())), "laid")
    slots = mixture(targets, shard_slots, seed)
    # At most ``most`` slots per block in all.
    dealt = slots.groupBy(_key().alias("key"), "block", "shard").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return laid, stored(dealt, "dealt"), targets.withColumn("key", _key()).drop("source")


def _touched(laid: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block that it lies in, with the words it has there."""
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    rows = laid.where("size > 0").select("rid", "copy", "key", "start", "size", F.explode(blocks).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.select("rid", "copy", "key", "block", (low - F.col("start")).alias("low"), (high - low).alias("words"))


def mix_corpus(docs: DataFrame, row: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars",
               block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0,
               shard: str | None = None) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, sorted by shard and by slot inside it; ``shard`` names a
    further column for the shard's number.

    A document comes once for each shard that its blocks are dealt to, with the words of those blocks in order, each with
    the white space behind it; a block that a shard holds k times makes it come k times there. A document that lies
    whole in a shard keeps its text as it is. ``length`` is set to the new text's characters. Documents of size 0
    are not taken. Rows that repeat, nulls and clashing column names as in ``mix_documents``.
    """
    laid, dealt, _ = _plan(docs, row, text, source, block_words, shard_slots, weights, most, seed)
    parts = _touched(laid, block_words).join(dealt, ["key", "block"])
    parts = parts.select("rid", "copy", "shard", "low", "words", F.posexplode("slots").alias("turn", "slot"))
    parts = parts.groupBy("rid", "copy", "shard", "turn").agg(F.min("slot").alias("slot"), F.sort_array(F.collect_list(F.struct("low", "words"))).alias("mine"))
    parts = parts.select("rid", F.struct("copy", "slot", "shard", "mine").alias("__part")).groupBy("rid").agg(F.collect_list("__part").alias("__parts"))
    rest = [c for c in docs.columns if c not in (text, length)]
    rows = docs.select(F.struct(F.lit(0), *rest).alias("__row"), _identity(row, text, source).alias("rid"), F.col(text).alias("__text"))
    rows = rows.withColumn("__copy", F.row_number().over(_copies())).join(parts, "rid")
    own = F.filter("__parts", lambda p: p["copy"] == F.col("__copy"))

    def cut(pieces: Column, part: Column) -> Column:
        taken = F.aggregate(part["mine"], F.lit(0).cast("long"), lambda n, p: n + p["words"])
        words_of = F.flatten(F.transform(part["mine"], lambda p: F.slice(pieces, (p["low"] + 1).cast("int"), p["words"].cast("int"))))
        return F.when(taken == F.size(pieces), F.col("__text")).otherwise(F.array_join(words_of, ""))

    # Bound by a lambda, so that a text is taken apart once, whatever the number of its shards.
    pieces = F.regexp_extract_all("__text", F.lit(WORD_AND_GAP), F.lit(0))
    cuts = F.transform(F.array(pieces), lambda w: F.transform(own, lambda p: F.struct(p["slot"].alias("slot"), p["shard"].alias("shard"), cut(w, p).alias("new"))))
    rows = rows.select("__row", F.explode(cuts[0]).alias("__cut")).orderBy("__cut.slot", F.xxhash64("__row"))
    columns = {text: F.col("__cut.new"), **({length: F.length("__cut.new")} if length in docs.columns else {})}
    out = [columns[c].cast(t).alias(c) if c in columns else F.col("__row")[c].alias(c) for c, t in docs.dtypes]
    return rows.select(*out, *([F.col("__cut.shard").alias(shard)] if shard else []))
