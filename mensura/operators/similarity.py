"""Applicability domain: for each test row the most similar training row, exactly.

Rows are sparse bit sets, similarity is Tanimoto (shared bits over bits of either). No pair of rows is ever
emitted. Training rows are cut into blocks of neighbouring set sizes, and a test row visits blocks in rounds:
first the block of its own size, which gives a best score so far, then only blocks whose sizes could still
reach that score (a set of ``m`` bits is at most ``min(n, m) / max(n, m)`` similar to one of ``n``). Inside a
block there are two exact ways. Where rows rarely share a bit (measured), inverted lists are read from the test
row's rarest bit on, and the best score so far ends the reading: a set at least ``s`` similar shares ``s n`` bits,
so it shares one of any ``n - ceil(s n) + 1`` of them. Where most rows share some, shared bits are counted by
matrix products, each number of which holds the counts of two to four training rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Training rows of a block, and test rows that visit it in one task. A block goes to as many tasks as test rows fill, and a
#: test row to the blocks it visits, so both decide how much is moved.
BLOCK_ROWS, VISIT_ROWS = 50_000, 100_000
#: Bits read before the best score is looked at again.
FIRST_BITS = 4
#: Shared bits of a pair, on the average, from which matrix products count them.
SHARED_BITS = 0.05
#: Test rows and training rows of a product, and the most numbers in the matrix of its training rows.
TILE_ROWS, CHUNK_ROWS, CHUNK_CELLS = 512, 8_192, 1 << 24
#: Binary digits of a count and the counts that a number of single precision holds exactly (24 digits).
PACKED = ((6, 4), (8, 3), (12, 2), (24, 1))


def hashed_bits(words, bits: int = 2048):
    """Ascending distinct places in ``0 .. bits - 1`` of the words of an array column, by the first 32 bits of MD5."""
    spot = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % bits
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(words), lambda w: spot(w).cast("int"))))


class _Block:
    """Training rows of one block: bit matrix, sizes and inverted lists."""

    def __init__(self, keys: np.ndarray, sets: list[np.ndarray], bits: int):
        self.keys, self.words = keys, -(-bits // 64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.matrix = _packed(owner, flat, len(sets), self.words)
        order = np.argsort(flat, kind="stable")
        self.lists, self.starts = owner[order], np.searchsorted(flat[order], np.arange(bits + 1))

    def best(self, own: np.ndarray, score: float) -> tuple[float, object]:
        """The block's most similar row (of equals the smallest key) if it is at least ``score`` similar, else no key."""
        n, nearest = len(own), None
        rare_first = own[np.argsort(self.starts[own + 1] - self.starts[own], kind="stable")]
        line = _packed(np.zeros(n, np.int64), own, 1, self.words)[0]
        read, step, seen = 0, FIRST_BITS, np.zeros(len(self.sizes), bool)
        while read < min(n, n - math.ceil(score * n - 1e-9) + 1):
            met = np.zeros(len(seen), bool)
            for b in rare_first[read : read + step]:
                met[self.lists[self.starts[b] : self.starts[b + 1]]] = True
            read, step = read + step, 2 * step
            found = np.flatnonzero(met & ~seen)
            seen |= met
            m = self.sizes[found]
            found = found[np.minimum(m, n) >= score * np.maximum(m, n) - 1e-9]
            if not len(found):
                continue
            shared = np.bitwise_count(self.matrix[found] & line).sum(axis=1, dtype=np.int64)
            scores = shared / (self.sizes[found] + n - shared)
            top = scores.max()
            key = self.keys[found[scores == top]].min()
            if top > score or (top == score and (nearest is None or key < nearest)):
                score, nearest = float(top), key
        return score, nearest


def _packed(owner: np.ndarray, bit: np.ndarray, rows: int, words: int) -> np.ndarray:
    out = np.zeros((rows, words), np.uint64)
    np.bitwise_or.at(out, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


class _Sets:
    """Bit sets, one after the other."""

    def __init__(self, sets: Sequence[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.asarray(s) for s in sets])

    def cells(self, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every bit of the picked sets, which pick has it, and the bit."""
        n = self.sizes[picks]
        place = np.arange(n.sum()) + np.repeat(self.starts[picks] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(picks)), n), self.flat[place]


def _by_products(keys: np.ndarray, train: _Sets, test: _Sets, scores: np.ndarray, bits: int) -> tuple[np.ndarray, list]:
    """As ``_Block.best`` for all test rows: their best scores, and the keys that have them, None below the given scores."""
    by_key = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[by_key] = np.arange(len(keys))
    scores, nearest = scores.astype(np.float64), np.full(len(scores), len(keys), np.int64)
    rows = max(1, min(CHUNK_ROWS, CHUNK_CELLS // bits))
    by_size = np.argsort(train.sizes, kind="stable")
    chunks = [by_size[a : a + rows] for a in range(0, len(by_size), rows)]
    low = np.array([train.sizes[c[0]] for c in chunks])
    high = np.array([train.sizes[c[-1]] for c in chunks])
    asked = np.argsort(test.sizes, kind="stable")
    asked = asked[test.sizes[asked] > 0]
    home = np.minimum(np.searchsorted(high, test.sizes), len(chunks) - 1)
    # Rows meet the chunk of their own size first; its score rules out others.
    for first in (True, False):
        for c, chunk in enumerate(chunks):
            n = test.sizes[asked]
            reach = np.minimum(np.minimum(n, high[c]) / np.maximum(n, low[c]), 1.0)
            own = asked[((home[asked] == c) == first) & (reach >= scores[asked] - 1e-9)]
            packed: dict[int, np.ndarray] = {}
            for at in range(0, len(own), TILE_ROWS):
                _tile(own[at : at + TILE_ROWS], chunk, train, test, rank, scores, nearest, bits, packed)
    return scores, [keys[by_key[r]] if r < len(keys) else None for r in nearest]


def _tile(own: np.ndarray, chunk: np.ndarray, train: _Sets, test: _Sets, rank: np.ndarray, scores: np.ndarray, nearest: np.ndarray,
          bits: int, packed: dict[int, np.ndarray]) -> None:
    """Some test rows against a chunk of training rows of rising size: better rows go to ``scores`` and ``nearest``."""
    n = test.sizes[own]
    most = min(n.max(), train.sizes[chunk[-1]])
    digits, many = next(p for p in PACKED if most < 1 << p[0])
    if digits not in packed:
        packed[digits] = np.zeros((-(-len(chunk) // many), bits), np.float32)
        for r in range(many):
            packed[digits][train.cells(chunk[r::many])] += np.float32(1 << digits * r)
    asked = np.zeros((len(own), bits), np.float32)
    asked[test.cells(own)] = 1
    counts = (asked @ packed[digits].T).astype(np.int32)
    shared = [(counts >> digits * r) & ((1 << digits) - 1) for r in range(many)]
    least = scores[own]
    if not least.all():
        # Rows without a score: that of the row which shares most, so that few are looked at below.
        for r, s in enumerate(shared):
            top = s.argmax(axis=1)
            met = s[np.arange(len(own)), top]
            m = train.sizes[chunk[np.minimum(many * top + r, len(chunk) - 1)]]
            least = np.maximum(least, met / (n + m - met))
    # Of two sets of n and m bits that are s similar, s / (1 + s) of n + m are shared.
    need = np.maximum(1, np.ceil(least / (1 + least) * (n + train.sizes[chunk[0]]) - 1e-6)).astype(np.int32)[:, None]
    found = []
    for r, s in enumerate(shared):
        i, at = np.divmod(np.flatnonzero(s >= need), s.shape[1])
        j = chunk[many * at + r]
        met = s[i, at].astype(np.int64)
        score = met / (n[i] + train.sizes[j] - met)
        good = score >= least[i]
        found.append((i[good], score[good], rank[j[good]]))
    i, score, key = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, -score, i))
    order = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order
    row, score, key = own[i[order]], score[order], key[order]
    better = (score > scores[row]) | ((score == scores[row]) & (key < nearest[row]))
    scores[row[better]], nearest[row[better]] = score[better], key[better]


def _shared_bits(train: _Sets, test: _Sets, bits: int) -> float:
    """How many bits a training row and a test row share on the average."""
    met = np.bincount(train.flat, minlength=bits).astype(np.float64) @ np.bincount(test.flat, minlength=bits)
    return float(met / max(1, len(train.sizes) * len(test.sizes)))


def _search(bits: int):
    def run(train: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        if not len(train) or not len(visits):
            return pd.DataFrame([], columns=["row", "score", "nearest"])
        keys, known, asked = train["key"].to_numpy(), _Sets(train["set"]), _Sets(visits["set"])
        if _shared_bits(known, asked, bits) >= SHARED_BITS:
            scores, nearest = _by_products(keys, known, asked, visits["score"].to_numpy(), bits)
            found = [(row, float(s), k) for row, s, k in zip(visits["row"], scores, nearest) if k is not None]
            return pd.DataFrame(found, columns=["row", "score", "nearest"])
        block = _Block(keys, [np.asarray(s, np.int64) for s in train["set"]], bits)
        out = []
        for row, own, score in zip(visits["row"], visits["set"], visits["score"]):
            score, nearest = block.best(np.asarray(own, np.int64), float(score))
            if nearest is not None:
                out.append((row, score, nearest))
        return pd.DataFrame(out, columns=["row", "score", "nearest"])

    return run


def max_similarity(test: DataFrame, train: DataFrame, key: str, bit_set: str, bits: int = 2048) -> DataFrame:
    """(key, n_bits, similarity, nearest) for every row of ``test``: the largest Tanimoto similarity of its
    ``bit_set`` (array of ints below ``bits``) to one of ``train``, and the smallest key that has it.

    A set without bits (or null), or that shares none with any training row, has similarity 0 and no nearest
    row. Repeated bits count once; null and other bits than ``0 .. bits - 1`` do not count. Test rows that
    repeat come back as often; training rows without key take no part.
    """
    spark = test.sparkSession
    kind = train.schema[key].dataType.simpleString()
    clean = F.array_distinct(F.filter(F.coalesce(F.col(bit_set).cast("array<int>"), F.array().cast("array<int>")),
                                      lambda b: b.isNotNull() & (b >= 0) & (b < bits)))
    if bits <= 1 << 15:
        clean = clean.cast("array<smallint>")
    # Sets are written before their sizes are asked for; a filter on the size would build each set once more.
    train = cut_lineage(train.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), clean.alias("set")))
    train = train.withColumn("n", F.size("set")).where("n > 0")
    test = cut_lineage(test.select(F.col(key).alias("own"), clean.alias("set"), F.monotonically_increasing_id().alias("row")))
    test = test.withColumn("n", F.size("set"))
    # One entry per set size, so at most ``bits`` of them.
    sizes = {r["n"]: r["count"] for r in train.groupBy("n").count().collect()}
    spans = _blocks(sizes)
    out_type = f"row long, score double, nearest {kind}"
    best = spark.createDataFrame([], out_type)
    if spans:
        last = max(s[2] for s in spans)
        # Blocks of a size, and of the next larger and smaller size that occurs.
        first_of = {n: a for n, a, _ in spans}
        last_of = {n: b for n, _, b in spans}
        known = sorted(first_of)
        table = []
        for n in range(1, bits + 1):
            up = next((k for k in known[np.searchsorted(known, n):]), None)
            down = next((k for k in reversed(known[: np.searchsorted(known, n, "right")])), None)
            table.append((n, first_of[up] if up is not None else last + 1, last_of[down] if down is not None else -1,
                          first_of[up] if up is not None else first_of[down], last_of[up] if up is not None else last_of[down]))
        places = spark.createDataFrame(table, "size int, from_block int, to_block int, home_from int, home_to int")
        by_size = F.broadcast(places)  # one row per set size
        spread = F.col("home_from") + F.pmod(F.xxhash64("key"), F.col("home_to") - F.col("home_from") + 1).cast("int")
        blocks = cut_lineage(train.join(by_size, train["n"] == places["size"]).withColumn("block", spread).select("key", "set", "block"))
        # Few blocks are cut into more visits, so that all cores have some.
        salts = max(1, -(-test.count() // VISIT_ROWS), -(-6 * spark.sparkContext.defaultParallelism // (last + 1)))
        home = F.col("home_from") + F.pmod(F.xxhash64("row"), F.col("home_to") - F.col("home_from") + 1).cast("int")
        asked = test.where("n > 0")
        visits = asked.join(by_size, asked["n"] == places["size"]).select(
            "row", "set", "n", home.alias("block"), home.alias("home"), F.lit(0.0).alias("score"))
        best = _round(visits, blocks, last + 1, salts, bits, out_type)
        homes = visits.select("row", "home")
        left = asked.join(best.select("row", "score"), "row", "left").fillna(0.0, ["score"]).join(homes, "row")
        low = F.greatest(F.lit(1), F.ceil(F.col("score") * F.col("n") - 1e-9)).cast("int")
        high = F.when(F.col("score") > 0, F.least(F.lit(bits), F.floor(F.col("n") / F.col("score") + 1e-9))).otherwise(bits).cast("int")
        left = left.withColumn("low", low).withColumn("high", high)
        left = left.join(by_size.select(F.col("size").alias("low"), F.col("from_block").alias("block_from")), "low")
        left = left.join(by_size.select(F.col("size").alias("high"), F.col("to_block").alias("block_to")), "high")
        left = left.where("block_from <= block_to").withColumn("block", F.explode(F.sequence("block_from", "block_to")))
        left = left.where("block <> home").select("row", "set", "n", "block", "home", "score")
        more = _round(left, blocks, last + 1, salts, bits, out_type)
        best = best.union(more).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("least"), "nearest")).alias("b"))
        best = best.select("row", (-F.col("b.least")).alias("score"), "b.nearest")
    out = test.join(best, "row", "left")
    return out.select(F.col("own").alias(key), F.col("n").alias("n_bits"), F.coalesce("score", F.lit(0.0)).alias("similarity"), "nearest")


def _blocks(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(size, first block, last block): neighbouring sizes share a block until it is full; a frequent size has several."""
    out, block, held = [], -1, BLOCK_ROWS
    for n in sorted(sizes):
        if held + sizes[n] > BLOCK_ROWS:
            block, held = block + 1, 0
        pieces = max(1, -(-sizes[n] // BLOCK_ROWS))
        out.append((n, block, block + pieces - 1))
        block += pieces - 1
        held = held + sizes[n] if pieces == 1 else BLOCK_ROWS
    return out


def _round(visits: DataFrame, blocks: DataFrame, spread: int, salts: int, bits: int, out_type: str) -> DataFrame:
    """The best row of each visited block; many test rows visit it in several tasks."""
    visits = visits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    tasks = max(8, min(2000, 2 * spread * salts))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # A set number of partitions, which adaptive execution does not merge: groups are small data but long work.
    pairs = blocks.repartition(tasks, "block", "salt").groupBy("block", "salt").cogroup(
        visits.repartition(tasks, "block", "salt").groupBy("block", "salt"))
    return cut_lineage(pairs.applyInPandas(_search(bits), out_type))


def similarity_bands(df: DataFrame, similarity: str, value: str, width: float = 0.1) -> DataFrame:
    """Rows, mean similarity and mean ``value`` (an error, say) by band of similarity: ``band`` 0 is [0, width),
    the last band holds 1 as well. Rows without similarity have no band."""
    last = round(1 / width) - 1
    band = F.least(F.lit(last), F.floor(F.col(similarity) / width + 1e-9)).cast("int")
    rows = df.where(F.col(similarity).isNotNull()).groupBy(band.alias("band"))
    return rows.agg(F.count("*").alias("n"), F.avg(similarity).alias("mean_similarity"), F.avg(value).alias("mean_value"))
