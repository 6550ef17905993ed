"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Sets of hashed word n-grams are ordered from rare to common. Two sets that reach the wanted
similarity share an n-gram of their prefixes, so sets meet on prefix n-grams only, and each pair
that passes the filters is verified once on the whole sets.

How it stays linear in a large group of near copies: classes only need the links that connect
them. In a first round every set meets one pivot per n-gram (the smallest key of its group), which
connects tight groups with one link per set; in two more those outside an n-gram's largest component meet
a member of it, drawn anew. Sets that share a prefix n-gram and are still in different components then
all meet, so no link between components is lost. Each posting of that meeting carries the open n-grams just
before it, and two sets do not meet on an n-gram if one before it is common as well, since they meet there:
the first common one has none before it, and most near misses meet once however much they share. A pair that
was tried in an earlier round is not tried again. Posting lists
expected to be long are split by salts, whose pivots meet in turn.

Equal sets are one node, a 64-bit key of the set (chance that any two of n different sets share a
key: n^2 / 2^65). n-gram frequencies are counted over all documents in a table of 2^18 counters, so
its size does not grow with the data; it decides only the order, never a result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small
from .common import batch, mix64, slowly, small_batches, stored, tasks_for, utf8
from .components import components
from .shingles import set_keys, shingle_sets

COUNTER_BITS = 18
CHUNK = 4096
#: Posting lists are split so that a group holds about so many sets.
GROUP = 4096
#: Bits of a set's parity map for the suffix filter: each n-gram turns one bit over.
PARITY_BITS = 2048
#: 64-bit words of the map folded up for use inside a join.
FOLDED = 4
#: Rounds with drawn pivots before what is left meets in full.
DRAWN_ROUNDS = 2
#: Earlier open n-grams that a posting of the full meeting carries along.
EARLIER = 8
#: Up to so many places apart, the sets of a group are held against each other before their postings are kept.
BESIDE = 8
#: Sets of more n-grams than this on average count as more rows when tasks are dealt out.
ROW_GRAMS = 256

_SETS = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("parity", pa.binary()), ("folded", pa.list_(pa.int64())),
                   ("chunk", pa.int32()), ("counts", pa.binary())])
_POSTINGS = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("key", pa.int64()),
                       ("n", pa.int32()), ("pos", pa.int32())])
_SHARED = pa.schema([*_POSTINGS, ("pkey", pa.int64()), ("pn", pa.int32()), ("ppos", pa.int32())])


def _first_of_key(keys: np.ndarray, seen: set[int]) -> list[int]:
    """Places of the keys that this task meets for the first time (empty sets never)."""
    new = []
    for i, k in enumerate(keys.tolist()):
        if k and k not in seen:
            seen.add(k)
            new.append(i)
    return new


def _read_sets(width: int):
    def run(batches):
        seen: set[int] = set()
        counts = np.zeros(1 << COUNTER_BITS, np.int32)
        for b in batches:
            data, offsets = utf8(b.column(1))
            rows = b.column(0)
            for at, hashes, bounds in shingle_sets(data, offsets, width):
                keys, sizes = set_keys(hashes, bounds), np.diff(bounds)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                bit = (hashes >> np.uint64(20)).astype(np.int64) % PARITY_BITS
                parity = np.bincount(owner * PARITY_BITS + bit, minlength=len(sizes) * PARITY_BITS) & 1
                parity = np.packbits(parity.astype(np.uint8).reshape(-1, PARITY_BITS), axis=1)
                folded = np.bitwise_xor.reduce(np.ascontiguousarray(parity).view(np.int64).reshape(len(sizes), -1, FOLDED), axis=1)
                for i in _first_of_key(keys, seen):
                    np.add.at(counts, _counter(hashes[bounds[i] : bounds[i + 1]]), 1)
                none = [None] * len(sizes)
                yield batch(_SETS, rows.slice(at, len(sizes)), sizes, keys, [p.tobytes() for p in parity], list(folded), none, none)
        for c in range(len(counts) // CHUNK):
            piece = counts[c * CHUNK : (c + 1) * CHUNK]
            if piece.any():
                yield batch(_SETS, [None], [None], [None], [None], [None], [c], [piece.astype("<i4").tobytes()])

    return run


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64)


def _add_counts(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for piece in frame["counts"]:
        total += np.frombuffer(piece, "<i4")
    return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})


def _frequencies(sets: DataFrame) -> np.ndarray:
    """The counter table: at most 64 rows of 32 KB whatever the data."""
    pieces = sets.where("chunk is not null").select("chunk", "counts")
    # Groups of tasks add up first, so that no task reads the counters of all.
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("counts"), F.lit(16)).cast("int"))
    wide = pieces.groupBy("chunk", "g").applyInPandas(_widen, "chunk int, counts binary")
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    for chunk, counts in wide.groupBy("chunk").applyInPandas(_add_wide, "chunk int, counts binary").collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, "<i8")
    return out


def _widen(frame: pd.DataFrame) -> pd.DataFrame:
    return _add_counts(frame)


def _add_wide(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(piece, "<i8") for piece in frame["counts"])
    return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "counts": [total.tobytes()]})


def _prefixes(width: int, num: int, den: int, frequencies):
    """Prefix postings of each set a task meets for the first time, rare n-grams first."""

    def run(batches):
        table = frequencies.value
        usual = 2 * int(table.mean()) + 1
        seen: set[int] = set()
        for b in batches:
            data, offsets = utf8(b.column(0))
            for _, hashes, bounds in shingle_sets(data, offsets, width):
                keys = set_keys(hashes, bounds)
                out = []
                for i in _first_of_key(keys, seen):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    n = len(own)
                    take = n - -(-num * n // den) + 1
                    count = table[_counter(own)]
                    order = (count.astype(np.uint64) << np.uint64(40)) | (mix64(own) >> np.uint64(24))
                    place = np.argsort(order, kind="stable")[:take]  # ties by hash, alike in every set
                    salts = np.maximum(1, (count[place] - usual) // GROUP + 1)
                    salt = np.int64(keys[i] & 0x7FFFFFFF) % salts
                    out.append((own[place].view(np.int64), salt, salts, np.full(len(place), keys[i]),
                                np.full(len(place), n), np.arange(len(place))))
                if out:
                    yield batch(_POSTINGS, *(np.concatenate(c).astype(t.to_pandas_dtype()) for c, t in zip(zip(*out), _POSTINGS.types)))

    return run


def _share(num: int, den: int):
    """Of postings sorted by (gram, salt, key): those that may link with another of their group, or of a
    salted n-gram, each with its group's pivot. A group that a batch cuts waits for the next batch."""

    def run(batches):
        rest = None
        for b in _chained(batches):
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else None
            if rest is not None:
                cols = rest if cols is None else [np.concatenate(x) for x in zip(rest, cols)]
            if cols is None or not len(cols[0]):
                continue
            gram, salt, _, key = cols[:4]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
            end = len(gram) if b is None else np.flatnonzero(new)[-1]
            rest = None if b is None else [c[end:] for c in cols]
            fresh = new[:end].copy()
            fresh[1:] |= key[1:end] != key[:end][:-1]
            fresh = np.flatnonzero(fresh)
            group = np.cumsum(new)[fresh]
            cols = [c[fresh] for c in cols]
            take = np.flatnonzero(_may_link(group, cols[4], cols[5], num, den) | (cols[2] > 1))
            if len(take):
                starts = np.flatnonzero(np.diff(group[take], prepend=0))
                pivot = np.repeat(take[starts], np.diff(np.append(starts, len(take))))
                yield batch(_SHARED, *(c[take] for c in cols), *(c[pivot] for c in cols[3:]))

    return run


def _may_link(group: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which postings, by ascending (group, key), have another one in their group that sizes and places let them link with.
    A pair needs no meeting where the smaller set's place is behind its shorter prefix: it shares an earlier n-gram, if it links.
    Of a group of more than BESIDE + 1 sets all stay."""
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    short = pos < n - (2 * num * n + num + den - 1) // (num + den) + 1
    sizes = np.bincount(group)[group]
    may = sizes > BESIDE + 1
    for d in range(1, min(int(sizes.max(initial=1)), BESIDE + 1)):
        i = np.flatnonzero((group[d:] == group[:-d]) & (sizes[d:] <= BESIDE + 1))
        j = i + d
        near = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
        possible = np.minimum(pos[i], pos[j]) + 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
        fits = near & ((den + num) * possible >= num * (n[i] + n[j])) & np.where(n[i] <= n[j], short[i], short[j])
        may[i[fits]] = True
        may[j[fits]] = True
    return may


def _chained(batches):
    yield from batches
    yield None


def _pair(frame: DataFrame, *more: str) -> DataFrame:
    """Rows with two sides (key, n, pos) and (pkey, pn, ppos) as (a, b, na, nb, pa, pb), a < b."""
    turn = F.col("key") < F.col("pkey")
    pick = lambda x, y: F.when(turn, F.col(x)).otherwise(F.col(y))
    return frame.select(*more, pick("key", "pkey").alias("a"), pick("pkey", "key").alias("b"),
                        pick("n", "pn").alias("na"), pick("pn", "n").alias("nb"),
                        pick("pos", "ppos").alias("pa"), pick("ppos", "pos").alias("pb"))


def _similar_length(num: int, den: int):
    return F.expr(f"{den}L * least(na, nb) >= {num}L * greatest(na, nb)")


def _reachable(overlap: str, num: int, den: int):
    """Whether sets with at most ``overlap`` common n-grams can be similar enough."""
    return F.expr(f"{den + num}L * ({overlap}) >= {num}L * (na + nb)")


def _suffix_filter(num: int, den: int):
    """Drops pairs whose parity maps differ in too many bits: sets that differ in d n-grams differ in
    at most d bits, so what lies behind the prefixes cannot overlap enough."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (4, 5))
            apart = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            # The overlap is at most (n - apart) / 2.
            keep = (den + num) * (n - apart) >= 2 * num * n
            yield b.filter(pa.array(keep)).select([0, 1])

    return run


def _verify(width: int, num: int, den: int):
    """Pairs whose whole sets are similar enough."""

    def run(batches):
        known: dict[int, np.ndarray] = {}

        def shingles(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                raw = np.frombuffer(text.encode(), np.uint8)
                known[key] = next(shingle_sets(raw, np.array([0, len(raw)]), width))[1]
            return known[key]

        for b in batches:
            keep = []
            for a, c, ta, tb in slowly(*b.columns):
                x, y = shingles(a, ta), shingles(c, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def similarity_classes(docs: DataFrame, row: str = "doc_id", text: str = "text", width: int = 4,
                       num: int = 85, den: int = 100) -> DataFrame:
    """(row, n_shingles, component_id) for every row of ``docs``.

    Documents link when ``den`` times the size of the intersection of their shingle sets is at
    least ``num`` times that of the union; component_id is the smallest row id reachable by links.
    Null, empty and blank texts have n_shingles 0 and stand alone. Rows that repeat, with equal
    ids or not, are each returned. A null id is kept; the component then takes the smallest known
    id, or null. Other columns of ``docs`` are ignored, whatever their names. No rows, no rows.
    """
    out = _classes(docs, row, text, width, num, den)
    return out.select(F.col("row").alias(row), F.col("n").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, row: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """(row, n, key, root, component_id) of every row, ``key`` that of its set and ``root`` that of its class."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text"))
    sets = stored(docs.mapInArrow(_read_sets(width), "row long, n long, key long, parity binary, folded array<long>, chunk int, counts binary"), "sets")
    rows = sets.where("chunk is null").select("row", "n", "key", "parity", "folded")
    nodes = stored(rows.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.first("parity").alias("parity"), F.first("folded").alias("folded")), "nodes")
    frequencies = spark.sparkContext.broadcast(_frequencies(sets))
    # Few or short sets take few tasks; many or long ones all that the shuffles deal out.
    many = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("grams")).first()
    tasks = tasks_for(spark, max(many.rows, (many.grams or 0) // ROW_GRAMS))
    postings = docs.select("text").mapInArrow(
        _prefixes(width, num, den, frequencies), "gram long, salt int, salts int, key long, n int, pos int")
    shared = stored(
        postings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "key").mapInArrow(
            _share(num, den), "gram long, salt int, salts int, key long, n int, pos int, pkey long, pn int, ppos int"), "shared")

    # One common n-gram at places pa, pb: so much can be common before, at and behind it.
    possible = "least(pa, pb) + 1 + least(na - pa - 1, nb - pb - 1)"
    heads = shared.where("salts > 1").select("gram", "pkey", "pn", "ppos").distinct()
    first = heads.groupBy("gram").agg(F.min(F.struct("pkey", "pn", "ppos")).alias("p"))
    heads = heads.select("gram", F.col("pkey").alias("key"), F.col("pn").alias("n"), F.col("ppos").alias("pos")).join(
        first, "gram").select("key", "n", "pos", "p.pkey", "p.pn", "p.ppos")
    stars = _pair(shared.select("key", "n", "pos", "pkey", "pn", "ppos").union(heads)).where("a <> b")
    stars = stars.where(_similar_length(num, den)).where(_reachable(possible, num, den))
    tried = stored(stars.select("a", "b", "na", "nb").distinct().coalesce(tasks), "tried")
    roots = components(_verified(docs, nodes, tried, width, num, den, tasks), tasks)

    # Sets outside their n-gram's main component meet a member of it that is drawn for the n-gram.
    rows_left = _open(shared.select("gram", "key", "n", "pos").distinct(), roots, tasks)
    for turn in range(DRAWN_ROUNDS):
        drawn = rows_left.where("root = main").groupBy("gram").agg(
            F.min_by(F.struct("key", "n", "pos"), F.xxhash64("gram", "key", F.lit(turn))).alias("p"))
        drawn = rows_left.where("root <> main").join(drawn, "gram").select(
            "key", "n", "pos", F.col("p.key").alias("pkey"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
        drawn = _pair(drawn).where(_similar_length(num, den)).where(_reachable(possible, num, den))
        drawn = drawn.select("a", "b", "na", "nb").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        drawn = stored(drawn.coalesce(tasks), "tried")
        tried = tried.union(drawn)
        roots = components(roots.union(_verified(docs, nodes, drawn, width, num, den, tasks)).toDF("a", "b"), tasks)
        rows_left = _open(rows_left.select("gram", "key", "n", "pos"), roots, tasks)

    # Whatever still lies in different components and shares a prefix n-gram. Of the smaller set (of equal
    # ones, that of the smaller key) a shorter prefix does.
    # A set's own open n-grams are at most its prefix.
    before = F.collect_list("gram").over(Window.partitionBy("key").orderBy("pos").rowsBetween(-EARLIER, -1))
    rows_left = rows_left.withColumn("before", before).join(nodes.select("key", "folded"), "key")
    minor = rows_left.where("root <> main").select(
        "gram", *[F.col(c).alias(f"p{c}") for c in ("key", "n", "pos", "root", "folded", "before")])
    near = F.expr(f"{den}L * least(n, pn) >= {num}L * greatest(n, pn)")
    both_minor = (F.col("root") == F.col("main")) | (F.col("key") < F.col("pkey"))
    smaller = (F.col("n") < F.col("pn")) | ((F.col("n") == F.col("pn")) & (F.col("key") < F.col("pkey")))
    short = lambda n, pos: F.expr(f"{pos} < {n} - ({2 * num}L * {n} + {num + den - 1}) div {num + den} + 1")
    in_short = F.when(smaller, short("n", "pos")).otherwise(short("pn", "ppos"))
    reach = F.expr(f"{den + num}L * (least(pos, ppos) + 1 + least(n - pos - 1, pn - ppos - 1)) >= {num}L * (n + pn)")
    apart = " + ".join(f"bit_count(folded[{k}] ^ pfolded[{k}])" for k in range(FOLDED))
    alike = F.expr(f"{den + num}L * (n + pn - ({apart})) >= {2 * num}L * (n + pn)")
    met_before = F.arrays_overlap("before", "pbefore")
    across = rows_left.join(minor, "gram").where(
        (F.col("root") != F.col("proot")) & near & both_minor & in_short & reach & alike & ~met_before)
    across = _pair(across).select("a", "b", "na", "nb").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    roots = components(roots.union(_verified(docs, nodes, across, width, num, den, tasks)).toDF("a", "b"), tasks)

    placed = nodes.select("key", "row").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = stored(placed.groupBy("root").agg(F.min("row").alias("component_id")).coalesce(tasks), "least")
    placed = stored(placed.join(least, "root").select("key", "root", "component_id").coalesce(tasks), "classes")
    out = rows.select("row", "n", "key").join(placed, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("row"))
    return out.select("row", "n", "key", "root", component.alias("component_id"))


def _open(rows: DataFrame, roots: DataFrame, tasks: int) -> DataFrame:
    """Those of ``rows`` (gram, key, n, pos) whose n-gram is still shared by several components (``roots``: node, root),
    with the component and the one that most of the n-gram's sets are in."""
    placed = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = stored(placed.coalesce(tasks), "placed")
    main = placed.groupBy("gram", "root").agg(F.count("*").alias("c")).groupBy("gram").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("gram", "main")
    return stored(placed.join(main, "gram").coalesce(tasks), "open")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, num: int, den: int, tasks: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter leaves and the whole sets confirm, confirmed anew at each use, in at most ``tasks`` tasks."""
    parts = nodes.select("key", "parity")
    pairs = pairs.join(parts.toDF("a", "parts_a"), "a").coalesce(tasks).join(parts.toDF("b", "parts_b"), "b").coalesce(tasks)
    pairs = pairs.select("a", "b", "na", "nb", "parts_a", "parts_b").mapInArrow(_suffix_filter(num, den), "a long, b long")
    pairs = stored(pairs, "pairs")
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = stored(nodes.select("key", "row").join(keys, "key").coalesce(tasks), "wanted")
    # A row id may repeat with other texts, so the key is made anew and must agree.
    texts = docs.join(broadcast_if_small(wanted.withColumnRenamed("row", "of")), F.col("row").eqNullSafe(F.col("of")))
    texts = stored(texts.select("key", "text").mapInArrow(_confirm(width), "key long, text string"), "texts").dropDuplicates(["key"])
    full = pairs.join(texts.toDF("b", "text_b"), "b").coalesce(tasks).join(texts.toDF("a", "text_a"), "a").coalesce(tasks)
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(width, num, den), "a long, b long")


def _confirm(width: int):
    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            keep = np.zeros(b.num_rows, bool)
            for at, hashes, bounds in shingle_sets(data, offsets, width):
                keys = set_keys(hashes, bounds)
                keep[at : at + len(keys)] = keys == b.column(0).slice(at, len(keys)).to_numpy()
            yield b.filter(pa.array(keep))

    return run


def keep_one(docs: DataFrame, row: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without those documents whose class has another one with a smaller id (five words
    and 0.8 unless told otherwise). Texts without words and rows without id all stay, but rows that repeat with
    one id and such a text stay once. If an id repeats with several texts, each is judged in its own class, and of
    those in one class one stays. All columns of ``docs`` stay as they are."""
    classes = stored(_classes(docs, row, text, width, num, den).withColumnRenamed("row", "__id"), "kept")
    classes = classes.where("__id is not null")
    again = stored(classes.groupBy("__id").count().where("count > 1").select("__id"), "again")
    gone = stored(classes.where("n > 0 and __id <> component_id").select("__id").distinct(), "gone")
    # Of a class's smallest id the smallest key stays.
    chosen = classes.where("n > 0 and __id = component_id").join(again, "__id", "left_semi").groupBy("__id", "root").agg(
        F.min("key").alias("__key")).select("__id", "__key")
    again, same = broadcast_if_small(again), F.col(row) == F.col("__id")
    once = docs.join(again, same, "left_anti").join(broadcast_if_small(gone), same, "left_anti")
    several = docs.join(again, same, "left_semi")
    schema = T.StructType([*docs.schema.fields, T.StructField("__of", T.LongType()), T.StructField("__empty", T.StringType())])
    keyed = several.withColumn("__text", F.col(text)).mapInArrow(_with_key(width), schema)
    kept = keyed.join(chosen, (F.col(row) == F.col("__id")) & (F.col("__of") == F.col("__key")), "left_semi").union(keyed.where("__of = 0"))
    return once.union(kept.dropDuplicates([row, "__of", "__empty"]).select(*docs.columns))


def _with_key(width: int):
    """Rows whose last column is their text, with the key of its set instead, and the text again if its set is empty."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(b.num_columns - 1))
            keys = np.concatenate([np.zeros(0, np.int64), *(set_keys(h, bounds) for _, h, bounds in shingle_sets(data, offsets, width))])
            texts = pa.array([t if k == 0 else None for k, (t,) in zip(keys.tolist(), slowly(b.column(b.num_columns - 1)))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(keys), texts], names=[*b.schema.names[:-1], "__of", "__empty"])

    return run
