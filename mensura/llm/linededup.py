"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of white space with A-Z lower-cased; it stands as a 128-bit digest (two
longs). The index keeps three tables in a folder that all executors share:

* ``refs``: one row per key and document that holds it, with what happened to it (1 added, -1 taken back);
* ``counts``: per key the exact number of documents that hold it and the largest of them;
* ``filters``: per shard of the keys two cuckoo filters, ``seen`` (keys with a document) and ``shared`` (keys
  that enough documents hold). A cuckoo filter can delete, so both follow the exact counts down as well as up.

Adding documents asks the shard's ``seen`` filter first: a key that it does not have is new, and only the
others are looked up in the exact tables. Deleting takes references back, counts the touched keys anew from
what is left and deletes keys that lost their last document, or fell below the limit, from the filters. So
after any order of both the index equals one built from the remaining documents. Cleaning asks the ``shared``
filters while lines are read, and looks up only what they let through. A filter may say yes wrongly, which
the exact tables correct, and never no.

Every change is a generation of its own: its tables are written first and a commit record last, so a run that
is lost halfway leaves nothing that a reader sees, and repeating it is harmless.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, mix64, small_batches, utf8

#: Keys that a shard should hold.
SHARD_KEYS = 100_000
#: Filters of all shards up to so many bytes go to the tasks that read lines; beyond, lines are looked up without them.
FILTER_BYTES = 64 << 20
#: Share of a filter's slots that may be used before it is built anew, larger.
FULL = 0.85
SLOTS = 4
#: Rounds of moving fingerprints before a filter counts as full.
ROUNDS = 500

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_REFS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text", pa.int64())])
_CLEAN = pa.schema([("doc", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


class CuckooFilter:
    """A set of 128-bit keys as 16-bit fingerprints, four to a bucket, each in one of two buckets.

    ``table`` has a power of two of buckets. Adding equal keys twice stores two fingerprints; deleting a key
    takes one away and must be done only for keys that were added.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """An empty filter with room for ``keys`` and as many again."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, 2 * keys / (SLOTS * FULL))))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        mark = (h2 & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        bucket = (mix64(h1 ^ (h2 >> np.uint64(16))) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, bucket

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, bucket = self._places(h1, h2)
        there = (self.table[bucket] == mark[:, None]).any(axis=1)
        return there | (self.table[self._other(bucket, mark)] == mark[:, None]).any(axis=1)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Adds all keys; False (and an unusable filter) if they do not fit."""
        mark, bucket = self._places(h1, h2)
        if len(self) + len(mark) > FULL * self.table.size:
            return False
        for turn in range(ROUNDS):
            mark, bucket = self._put(mark, bucket)
            if not len(mark):
                return True
            if turn:
                # One key of each bucket takes the place of another, which moves on.
                _, first = np.unique(bucket, return_index=True)
                slot = (mix64(bucket[first].astype(np.uint64) + np.uint64(turn << 32)) % np.uint64(SLOTS)).astype(np.int64)
                at = bucket[first]
                out = self.table[at, slot].copy()
                self.table[at, slot] = mark[first]
                mark[first] = out
            bucket = self._other(bucket, mark)
        return False

    def _put(self, mark: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places what finds a free slot in its bucket; returns the rest."""
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0)) if len(bucket) else np.zeros(0, int)
        rank = np.arange(len(bucket)) - start
        used = self.table[bucket] != 0
        fits = rank < SLOTS - used.sum(axis=1)
        slot = np.argsort(used[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
        self.table[bucket[fits], slot] = mark[fits]
        return mark[~fits], bucket[~fits]

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        mark, bucket = self._places(h1, h2)
        other = self._other(bucket, mark)
        while len(mark):
            here = self.table[bucket] == mark[:, None]
            at = np.where(here.any(axis=1), bucket, other)
            here = self.table[at] == mark[:, None]
            if not here.any(axis=1).all():
                raise ValueError("a key was deleted that is not in the filter")
            slot = here.argmax(axis=1)
            # Keys that chose one slot go one after another.
            _, first = np.unique(at * SLOTS + slot, return_index=True)
            self.table[at[first], slot[first]] = 0
            rest = np.ones(len(mark), bool)
            rest[first] = False
            mark, bucket, other = mark[rest], bucket[rest], other[rest]


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key; None if the key has fewer than ``min_chars`` code points."""
    line = line.strip(BLANK)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def _texts(column: pa.Array):
    data, offsets = utf8(column)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]].tobytes()


def _line_refs(min_chars: int, filters=None):
    """(h1, h2, doc, text) for each distinct key of a row (doc, text); with ``filters`` those that they let through."""

    def run(batches):
        for b in batches:
            docs, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
            keys, owner, held = [], [], 0
            for i, text in enumerate(_texts(b.column(1))):
                own = {k for line in text.split(b"\n") if (k := _key(line, min_chars)) is not None}
                keys.extend(own)
                owner.extend([i] * len(own))
                held += len(own)
                if held >= 65_536 or i + 1 == len(docs):
                    if keys:
                        yield from _passed(keys, [docs[k] for k in owner], [hashes[k] for k in owner], filters)
                    keys, owner, held = [], [], 0

    return run


def _passed(keys: list[bytes], docs: list, texts: list, filters):
    h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    rows = batch(_REFS, h[:, 0], h[:, 1], docs, texts)
    yield rows if filters is None else rows.filter(pa.array(filters.value.has(h[:, 0], h[:, 1])))


class _Filters:
    """The filters of one kind by shard."""

    def __init__(self, shards: int, tables: dict[int, bytes]):
        self.shards, self.tables, self.read = shards, tables, {}

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        shard = h1 % self.shards
        out = np.zeros(len(h1), bool)
        for s in np.unique(shard).tolist():
            if s in self.tables:
                if s not in self.read:
                    self.read[s] = CuckooFilter.read(self.tables[s])
                own = shard == s
                out[own] = self.read[s].has(h1[own], h2[own])
        return out

    def __reduce__(self):
        return _Filters, (self.shards, self.tables)


_KEYED = "shard long, h1 long, h2 long, before long, docs long, seen binary, shared binary"


def _by_shard(keys: DataFrame, filters: DataFrame | None, work, schema: str) -> DataFrame:
    """``work(shard, (seen, shared) or None, arrays of keys)`` for each shard, its filter row read before its keys.
    Keys are distinct, so shards are alike in size."""
    rows = keys.select("shard", "h1", "h2", "before", "docs", F.lit(None).cast("binary").alias("seen"), F.lit(None).cast("binary").alias("shared"))
    if filters is not None:
        none = [F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "before", "docs")]
        rows = rows.union(filters.select("shard", *none, "seen", "shared"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("seen").isNull())

    def run(batches):
        shard, held, old = None, [], None
        for b in batches:
            places = b.column(0).to_numpy()
            for at in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places)) + 1) if len(places) else []:
                part = b.slice(int(at[0]), len(at))
                if places[at[0]] != shard:
                    if shard is not None:
                        yield work(shard, old, _arrays(held))
                    shard, held, old = int(places[at[0]]), [], None
                if part.column(5)[0].as_py() is not None:
                    old = CuckooFilter.read(part.column(5)[0].as_py()), CuckooFilter.read(part.column(6)[0].as_py())
                    part = part.slice(1)
                held.append(part.select([1, 2, 3, 4]))
        if shard is not None:
            yield work(shard, old, _arrays(held))

    return rows.mapInArrow(run, schema)


def _arrays(parts: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([p.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]) for c in range(4)]


class LineIndex:
    """The lines of a corpus by the documents that hold them; ``open`` finds an index again in its folder."""

    def __init__(self, spark: SparkSession, folder: str, min_chars: int = 20, min_docs: int = 3):
        self.spark, self.folder, self.min_chars, self.min_docs = spark, folder, min_chars, min_docs
        self.generations: list[str] = []
        self.shards, self.filter_folder = 0, None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index as of its last commit; changes that were not committed are not seen."""
        last = spark.read.parquet(f"{folder}/commits/*").orderBy(F.desc(F.size("generations"))).first()
        index = cls(spark, folder, last["min_chars"], last["min_docs"])
        index.generations, index.shards, index.filter_folder = list(last["generations"]), last["shards"], last["filter_folder"]
        return index

    # Tables.

    def _read(self, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, generation int")
        for g, name in enumerate(self.generations):
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/{name}").withColumn("generation", F.lit(g)))
        return out

    def refs(self) -> DataFrame:
        """(h1, h2, doc): every key with every document that holds it now."""
        rows = self._read("refs", "h1 long, h2 long, doc long, op int")
        if len(self.generations) > 1:
            rows = rows.groupBy("h1", "h2", "doc").agg(F.max_by("op", "generation").alias("op"))
        return rows.where("op > 0").select("h1", "h2", "doc")

    def counts(self) -> DataFrame:
        """(h1, h2, docs, top): how many documents hold a key now, and the largest of them."""
        rows = self._read("counts", "h1 long, h2 long, docs long, top long")
        if len(self.generations) > 1:
            last = F.max_by(F.struct("docs", "top"), "generation").alias("c")
            rows = rows.groupBy("h1", "h2").agg(last).select("h1", "h2", "c.docs", "c.top")
        return rows.where("docs > 0").select("h1", "h2", "docs", "top")

    def filters(self) -> DataFrame | None:
        if self.filter_folder is None:
            return None
        return self.spark.read.schema("shard long, seen binary, shared binary").parquet(f"{self.folder}/filters/{self.filter_folder}")

    # Changes.

    def _name(self) -> str:
        return f"{len(self.generations):06d}-{uuid.uuid4().hex[:12]}"

    def _write(self, df: DataFrame, kind: str, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{kind}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{kind}/{name}")

    def _commit(self, name: str, filter_folder: str, shards: int) -> None:
        generations = [*self.generations, name]
        row = (generations, shards, filter_folder, self.min_chars, self.min_docs)
        record = self.spark.createDataFrame([row], "generations array<string>, shards long, filter_folder string, min_chars int, min_docs int")
        record.coalesce(1).write.parquet(f"{self.folder}/commits/{name}")
        self.generations, self.shards, self.filter_folder = generations, shards, filter_folder

    def line_refs(self, docs: DataFrame, row: str, text: str, screen=None) -> DataFrame:
        """(h1, h2, doc, text) of the rows' lines; ``text`` is a hash of the row's whole text."""
        small_batches(self.spark)
        rows = docs.select(F.col(row).cast("long").alias("doc"), F.col(text).cast("string").alias("t"))
        rows = rows.select("doc", "t", F.xxhash64("t").alias("h"))
        return rows.mapInArrow(_line_refs(self.min_chars, screen), "h1 long, h2 long, doc long, text long")

    def insert(self, docs: DataFrame, row: str = "doc_id", text: str = "text") -> None:
        """Adds documents. A document that is there already, or repeats, counts once per key; a null id is a
        document like others, below all of them. Rows without long lines add nothing."""
        name = self._name()
        refs = self.line_refs(docs, row, text).select("h1", "h2", "doc").distinct()
        refs = self._write(refs, "arriving", name)
        found = refs.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("top"))
        if not self.generations:
            self._finish(name, refs.withColumn("op", F.lit(1)), found.withColumn("before", F.lit(0).cast("long")))
            return
        # The filters tell new keys, whose counts are those of the arriving documents.
        keys = found.withColumn("shard", F.pmod("h1", F.lit(self.shards))).withColumn("before", F.lit(0).cast("long"))
        seen = self._write(_by_shard(keys, self.filters(), _screen, "h1 long, h2 long"), "screened", name)
        fresh = found.join(seen, ["h1", "h2"], "left_anti").withColumn("before", F.lit(0).cast("long"))
        # All others are looked up: references that are there stay as they are.
        known = refs.join(seen, ["h1", "h2"], "left_semi")
        there = self.refs().toDF("k1", "k2", "kdoc")
        same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("doc").eqNullSafe(F.col("kdoc"))
        known = self._write(known.join(there, same, "left_anti"), "known", name)
        more = known.groupBy("h1", "h2").agg(F.count("*").alias("more"), F.max("doc").alias("new_top"))
        more = more.join(self.counts(), ["h1", "h2"], "left").select(
            "h1", "h2", (F.col("more") + F.coalesce("docs", F.lit(0))).alias("docs"), F.greatest("top", "new_top").alias("top"),
            F.coalesce("docs", F.lit(0).cast("long")).alias("before"))
        added = refs.join(seen, ["h1", "h2"], "left_anti").union(known)
        self._finish(name, added.withColumn("op", F.lit(1)), fresh.unionByName(more))

    def delete(self, docs: DataFrame, row: str = "doc_id") -> None:
        """Takes documents back by their ids; texts are not needed. Unknown and repeated ids do no harm."""
        if not self.generations:
            return
        name = self._name()
        ids = docs.select(F.col(row).cast("long").alias("gone")).distinct()
        refs = self.refs()
        gone = self._write(refs.join(ids, F.col("doc").eqNullSafe(F.col("gone")), "left_semi"), "arriving", name)
        touched = gone.select("h1", "h2").distinct()
        left = refs.join(touched, ["h1", "h2"], "left_semi").join(ids, F.col("doc").eqNullSafe(F.col("gone")), "left_anti")
        left = left.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("top"))
        before = self.counts().select("h1", "h2", F.col("docs").alias("before"))
        counts = touched.join(before, ["h1", "h2"]).join(left, ["h1", "h2"], "left").fillna(0, ["docs"])
        self._finish(name, gone.withColumn("op", F.lit(-1)), counts)

    def _finish(self, name: str, refs: DataFrame, counts: DataFrame) -> None:
        """Writes the tables of a generation, brings the filters to its counts and commits."""
        self._write(refs.select("h1", "h2", "doc", "op"), "refs", name)
        changed = self._write(counts.select("h1", "h2", "docs", "top", "before"), "counts", name)
        if self.generations:
            keys = changed.withColumn("shard", F.pmod("h1", F.lit(self.shards)))
            filters = self._write(_by_shard(keys, self.filters(), _update(self.min_docs), "shard long, seen binary, shared binary"), "filters", name)
            # A shard without changes keeps its filters; one that is full has none and all are built anew, larger.
            if filters.where("seen is null").limit(1).count() == 0:
                self._commit(name, name, self.shards)
                return
        built = f"{name}-built"
        generations = self.generations
        self.generations = [*generations, name]
        keys = self.counts().withColumn("before", F.lit(0).cast("long"))
        shards = max(1, -(-keys.count() // SHARD_KEYS))
        keys = keys.withColumn("shard", F.pmod("h1", F.lit(shards)))
        self._write(_by_shard(keys, None, _update(self.min_docs), "shard long, seen binary, shared binary"), "filters", built)
        self.generations = generations
        self._commit(name, built, shards)

    # Results.

    def _shared(self):
        """The ``shared`` filters for the tasks that read lines, if their measured size allows it."""
        filters = self.filters()
        if filters is None:
            return None
        if (filters.agg(F.sum(F.length("shared"))).first()[0] or 0) > FILTER_BYTES:
            return None
        return self.spark.sparkContext.broadcast(_Filters(self.shards, {r["shard"]: bytes(r["shared"]) for r in filters.select("shard", "shared").collect()}))

    def clean(self, docs: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
        """(row, n_lines, n_dropped, kept): each text without those lines whose key at least ``min_docs``
        documents hold, unless the row's is the largest document that holds it.

        Other lines stay in order, joined by newlines. Null and empty texts are one empty line. Rows that
        repeat come back as often; a null id is below all others, so it keeps no shared line; a document that
        is not in the index is no holder either. Other columns are ignored, whatever their names.
        """
        small_batches(self.spark)
        shared = self.counts().where(F.col("docs") >= self.min_docs).select("h1", "h2", "top")
        drops = self.line_refs(docs, row, text, self._shared()).join(shared, ["h1", "h2"])
        drops = drops.where(~F.col("doc").eqNullSafe(F.col("top")))
        # At most as many keys as the text has lines; texts of one id are told apart by their hash.
        drops = drops.groupBy(F.col("doc").alias("of"), F.col("text").alias("of_text")).agg(
            F.collect_set(F.struct("h1", "h2")).alias("keys"))
        drops = drops.select("of", "of_text", F.col("keys.h1").alias("k1"), F.col("keys.h2").alias("k2"))
        rows = docs.select(F.col(row).cast("long").alias("doc"), F.col(text).cast("string").alias("t"))
        same = F.col("doc").eqNullSafe(F.col("of")) & (F.xxhash64("t") == F.col("of_text"))
        rows = rows.join(drops, same, "left").select("doc", "t", "k1", "k2")
        out = rows.mapInArrow(_drop(self.min_chars), "doc long, n_lines long, n_dropped long, kept string")
        return out.withColumnRenamed("doc", row)


def _screen(shard: int, old, keys: list[np.ndarray]) -> pa.RecordBatch:
    h1, h2 = keys[:2]
    there = old[0].has(h1, h2) if old is not None else np.zeros(len(h1), bool)
    return pa.RecordBatch.from_arrays([pa.array(h1[there]), pa.array(h2[there])], names=["h1", "h2"])


def _update(min_docs: int):
    """The filters of a shard after its keys went from ``before`` to ``docs`` documents; nulls if they are full."""

    def work(shard: int, old, keys: list[np.ndarray]) -> pa.RecordBatch:
        h1, h2, before, docs = keys
        out, fine = [], True
        for k, least in enumerate((1, min_docs)):
            came, went = (before < least) & (docs >= least), (before >= least) & (docs < least)
            own = old[k] if old is not None else CuckooFilter.sized(int(came.sum()))
            own.delete(h1[went], h2[went])
            fine = own.add(h1[came], h2[came]) and fine
            out.append(own)
        data = [o.bytes() if fine else None for o in out]
        return pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.array([d], pa.binary()) for d in data)], names=["shard", "seen", "shared"])

    return work


def _drop(min_chars: int):
    def run(batches):
        for b in batches:
            ids = b.column(0)
            lines, dropped, kept = [], [], []
            for text, k1, k2 in zip(_texts(b.column(1)), b.column(2), b.column(3)):
                own = text.split(b"\n")
                lines.append(len(own))
                if k1.is_valid:
                    gone = np.column_stack([k1.values.to_numpy(), k2.values.to_numpy()]).astype("<i8")
                    gone = {g.tobytes() for g in gone}
                    own = [line for line in own if _key(line, min_chars) not in gone]
                dropped.append(lines[-1] - len(own))
                kept.append(b"\n".join(own))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=_CLEAN)

    return run
