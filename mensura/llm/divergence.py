"""Source divergence audit: how far the word shares of a language's sources lie apart, term by term.

Terms are runs of letters, A-Z lower-cased. A language keeps the terms that at least 30 of its documents
hold, V of them. A group (language, source) gives each kept term ``p = 1 + floor(10^9 (count + 5) /
(N + 5 V))``, N the counts' sum; two groups differ by the sum of ``|p - q|`` over the kept terms.

Count-level bitmaps. A share depends on the count only, so kept terms get ids and each (group, count)
stores the set of its terms as a bitmap. For two groups, AND and popcount of a bitmap of each tell how many
terms have these two counts (the joint cell), which is multiplied by ``|p - q|``; cells with a count of zero
follow by complement. Ids are given in blocks of terms with totals of one size, so that a group has few
levels in a block: wide blocks for rare terms, one machine word for terms so frequent that most counts are
unlike. Blocks decide cost, never a result.

Pairs of sources are the result and grow with the square of a language's sources; they are formed in tiles
of sources per block, never from rows. Counts, shares and sums are whole numbers: the shares of a group add
up to 10^9 + V at most, so a sum fits a long.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import batch, slowly, small_batches, stored, utf8

SHARES, PRIOR = 1_000_000_000, 5
#: Terms counted in a task before they are handed on; the same term may then come again.
HELD = 300_000
#: Bytes of one text that are split into words at once.
PIECE = 1 << 20
#: Sources of a tile.
TILE = 64
#: Words of 64 terms in a block, by the mean count of its terms in a source.
WIDTHS = ((16, 64), (128, 8))

# The bytes of a term; all of a character beyond ASCII are 0x80 or more.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _pieces(text: bytes):
    """Lower-cased words of a text, a list for each piece of it; words are not cut."""
    at = 0
    while at < len(text):
        to = at + PIECE
        if to < len(text):
            blank = text.find(b" ", to)
            to = len(text) if blank < 0 else blank
        yield text[at:to].split()
        at = to


def _count_terms(batches):
    """(lang, source, term, n, docs) sums of a task, and a row without term for each (lang, source)."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def out():
        for (lang, source), own in counts.items():
            terms = list(own)
            for i in range(0, len(terms), 8192):
                some = terms[i : i + 8192]
                m = len(some)
                yield batch(_COUNTS, [lang] * m, [source] * m, some, [own[t] for t in some], [docs[lang, source][t] for t in some])
        keys = list(counts)
        yield batch(_COUNTS, [k[0] for k in keys], [k[1] for k in keys], [None] * len(keys), [0] * len(keys), [0] * len(keys))

    for b in batches:
        data, offsets = utf8(b.column(0))
        low, whole = int(offsets[0]), data[offsets[0] : offsets[-1]].tobytes().translate(_LETTERS)
        for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            if key not in counts:
                counts[key], docs[key] = Counter(), Counter()
            own, before = counts[key], len(counts[key])
            distinct: set[bytes] = set()
            for terms in _pieces(whole[offsets[i] - low : offsets[i + 1] - low]):
                own.update(terms)
                distinct.update(terms)
            docs[key].update(distinct)
            held += len(own) - before
            if held >= HELD:
                yield from out()
                counts, docs, held = {}, {}, 0
    if counts:
        yield from out()


def count_terms(rows: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents (rows) of every term of a group, and for
    each group a row whose term is null. Null text, lang and source are read as ''."""
    small_batches(rows.sparkSession)
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    parts = rows.select(*plain).mapInArrow(_count_terms, "lang string, source string, term binary, n long, docs long")
    parts = parts.withColumn("term", F.col("term").cast("string"))
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count, total, kept):
    """1 + floor(10^9 (count + 5) / (N + 5 V)), exact: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.expr("1L") + F.call_function("div", wide(count + PRIOR) * F.lit(SHARES).cast("decimal(10,0)"), wide(total + PRIOR * kept))


def kept_terms(counts: DataFrame, at_least: int = 30) -> DataFrame:
    """(lang, term, total, block, at, words): kept terms, their occurrences, and their place in a block of
    ``words`` times 64 terms. Places are given per block, by falling total."""
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = stored(kept.where(F.col("docs") >= at_least).select("lang", "term", "total"), "kept")
    sources = counts.where("term is null").groupBy("lang").agg(F.count("*").alias("sources"))
    mean = F.col("total") / F.col("sources")
    words = F.lit(1)
    for below, width in reversed(WIDTHS):
        words = F.when(mean < below, width).otherwise(words)
    # A class holds totals of one size; it is cut by hash into runs, and a run into blocks by place.
    size = F.floor(F.log2("total")).cast("int")
    runs = kept.groupBy("lang", size.alias("size")).agg(F.count("*").alias("terms"))
    runs = runs.select("lang", "size", F.ceil(F.col("terms") / 16384).alias("runs"))
    kept = kept.withColumn("size", size).join(broadcast_if_small(sources), "lang").withColumn("words", words)
    kept = kept.join(broadcast_if_small(runs), ["lang", "size"])
    kept = kept.withColumn("run", F.pmod(F.xxhash64("term"), "runs"))
    place = F.row_number().over(Window.partitionBy("lang", "size", "words", "run").orderBy(F.desc("total"), "term")) - 1
    kept = kept.withColumn("place", place)
    span = F.col("words") * 64
    block = F.concat_ws("/", "size", "words", "run", F.floor(F.col("place") / span))
    return kept.select("lang", "term", "total", block.alias("block"), F.pmod("place", span).cast("int").alias("at"), "words")


def _pair_sums(batches):
    """Sums of |p - q| per pair of sources, added up while (lang, tiles) stays the same.

    Rows come sorted by (lang, left, right, block); a block's rows are the sources of both tiles, each with
    the share of a zero count and the number of terms, and its levels (share, places and bits of words).
    """
    key, sums, block, held = None, {}, None, []

    def flush():
        if sums:
            m = len(sums)
            yield batch(_PAIRS, [key[0]] * m, [a for a, _ in sums], [b for _, b in sums], list(sums.values()))

    for b in batches:
        for lang, left, right, name, tile, source, share, terms, words, bits in slowly(*b.columns, step=1024):
            if (lang, left, right, name) != block:
                if held:
                    _add_block(sums, held, key[1] == key[2], key[1])
                    held = []
                block = (lang, left, right, name)
                if block[:3] != key:
                    yield from flush()
                    key, sums = block[:3], {}
            held.append((tile, source, share, terms, words, bits))
    if held:
        _add_block(sums, held, key[1] == key[2], key[1])
    yield from flush()


def _add_block(sums: dict, held: list, same: bool, left: int) -> None:
    """Adds the joint cells of all pairs of a block. ``held`` holds (tile, source, share, terms, words, bits): one row
    per source with the share of a zero count and the number of terms, one per level with its bitmap."""
    zero, terms, levels, width = {}, 0, {}, 1
    for tile, source, share, size, words, bits in held:
        if bits is None:
            zero[source] = (tile, share)
            terms = size
        else:
            levels.setdefault(source, []).append((share, words, bits))
            width = max(width, words[-1] + 1)
    names = sorted(zero)
    starts = np.concatenate([[0], np.cumsum([len(levels.get(s, ())) for s in names])]).astype(np.int64)
    bitmap = np.zeros((starts[-1], width), np.int64)
    p = np.zeros(starts[-1], np.int64)
    for i, s in enumerate(names):
        for k, (share, words, bits) in enumerate(levels.get(s, ()), starts[i]):
            p[k] = share
            bitmap[k, words] = bits
    bitmap = bitmap.view(np.uint64)
    count = np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
    none = np.array([zero[s][1] for s in names], np.int64)
    others = [i for i, s in enumerate(names) if same or zero[s][0] != left]
    for i, s in enumerate(names):
        if not same and zero[s][0] != left:
            continue
        mine = slice(starts[i], starts[i + 1])
        for j in others:
            if same and j <= i:
                continue
            yours = slice(starts[j], starts[j + 1])
            cells = np.zeros((starts[i + 1] - starts[i], starts[j + 1] - starts[j]), np.int64)
            for w in range(width):
                cells += np.bitwise_count(bitmap[mine, w, None] & bitmap[None, yours, w])
            only_mine, only_yours = count[mine] - cells.sum(axis=1), count[yours] - cells.sum(axis=0)
            neither = terms - int(cells.sum()) - int(only_mine.sum()) - int(only_yours.sum())
            value = (cells * np.abs(p[mine, None] - p[None, yours])).sum() + (only_mine * np.abs(p[mine] - none[j])).sum()
            value += (only_yours * np.abs(p[yours] - none[i])).sum() + neither * abs(none[i] - none[j])
            pair = (s, names[j]) if s < names[j] else (names[j], s)
            sums[pair] = sums.get(pair, 0) + int(value)


def pair_values(levels: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a before b for every two sources of a language.

    ``levels`` (lang, source, block, share, words, bits) are the bitmaps, ``groups`` (lang, source, none) the
    shares of a zero count, ``blocks`` (lang, block, terms). A source meets others tile by tile.
    """
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    # Each language has an empty block besides, so that its pairs appear even without a kept term.
    empty = groups.select("lang").distinct().select("lang", F.lit("-").alias("block"), F.lit(0).cast("long").alias("terms"))
    sizes = groups.join(broadcast_if_small(blocks.union(empty)), "lang").select(
        "lang", "block", "source", F.col("none").alias("share"), "terms",
        F.lit(None).cast("array<int>").alias("words"), F.lit(None).cast("array<long>").alias("bits"))
    maps = levels.select("lang", "block", "source", "share", F.lit(0).cast("long").alias("terms"), "words", "bits")
    rows = sizes.union(maps).join(broadcast_if_small(tiles), "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"),
                       "block", "tile", "source", "share", "terms", "words", "bits")
    rows = rows.repartition("lang", "left", "right", "block").sortWithinPartitions("lang", "left", "right", "block")
    parts = rows.mapInArrow(_pair_sums, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(rows: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      at_least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of ``rows``.

    Part ``pair``: item is each other source of the language, value the sum of ``|p - q|`` over the kept
    terms (0 without any). Part ``term``: item is each kept term that the group holds and whose share there
    is above the language's, value the difference, the ``top`` first only. Ranks start at 1 and go by falling
    value, then by the item's UTF-8 bytes. Null text, lang and source are ''; repeated rows, with equal ids or
    not, are documents of their own; a group without terms has its pairs. Other columns are ignored. No rows,
    no rows.
    """
    counts = stored(count_terms(rows, text, lang, source), "counts")
    kept = stored(kept_terms(counts, at_least), "terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n"))
    own = counts.where("term is not null").join(kept, ["lang", "term"]).select(
        "lang", "source", "term", "n", "total", "block", "at", "words")
    own = stored(own, "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = groups.join(broadcast_if_small(sizes), "lang", "left").fillna(0, ["in_group", "v", "n"])
    none = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("in_group"), F.col("v"))).otherwise(F.lit(0).cast("long"))
    groups = stored(groups.withColumn("none", none), "groups")
    shared = own.join(broadcast_if_small(groups.withColumnRenamed("n", "in_lang")), ["lang", "source"])
    shared = shared.withColumn("share", _share(F.col("n"), F.col("in_group"), F.col("v")))

    # One bit per term; a level's words meet in a map of a block's width at most.
    bit = F.expr("shiftleft(1L, at % 64)")
    words = shared.groupBy("lang", "source", "block", "share", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits"))
    maps = words.groupBy("lang", "source", "block", "share").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("m"))
    levels = maps.select("lang", "source", "block", "share", F.col("m.word").alias("words"), F.col("m.bits").alias("bits"))
    blocks = kept.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    pairs = stored(pair_values(levels, groups, blocks), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        pairs.select("lang", "b", "a", "value"))

    in_lang = _share(F.col("total"), F.col("in_lang"), F.col("v"))
    terms = shared.select("lang", "source", F.col("term").alias("item"), (F.col("share") - in_lang).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).cast("int")
    out = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    first = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.union(first.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

