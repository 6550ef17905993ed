"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs (lines, cut again at sentence ends and every 64 characters); the n-th
occurrence of a paragraph has one 64-bit digest. A sketch of ``m`` cells adds each digest to three
cells. Subtracting the sketches of two versions cancels what they share; peeling cells that hold a
single digest recovers the paragraphs of either side. If cells remain, both sketches are made
again four times larger. Sketches of a whole batch are made and peeled together with numpy.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, mix64, slowly, small_batches

#: Cells of the sketch that is kept as a fingerprint, and the hashes of a digest.
CELLS, HASHES = 15, 3
#: Ranges into which ids are cut at most. A range is streamed, so a long one needs no more memory.
RANGES = 4096
#: Characters of the documents that are sketched together.
RUN_CHARS = 1 << 20
_PARAGRAPH = re.compile(r"[^\n.!?]{1,64}[.!?\n]*|[.!?\n]+")

_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                  ("only_here", pa.int64()), ("only_edited", pa.int64())])


def digests(text: str) -> np.ndarray:
    """Digests of the paragraphs; a paragraph that repeats has another digest each time."""
    times: dict[str, int] = {}
    parts = _PARAGRAPH.findall(text)
    out, before = np.empty(len(parts), np.uint64), np.empty(len(parts), np.uint64)
    for i, part in enumerate(parts):
        before[i] = seen = times.get(part, 0)
        times[part] = seen + 1
        out[i] = xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"))
    with np.errstate(over="ignore"):
        return mix64(out + before * np.uint64(0x9E3779B97F4A7C15))


class Sketches:
    """``docs`` sketches of ``cells`` cells each: counts, digest sums and check sums (all mod 2^64)."""

    def __init__(self, docs: int, cells: int):
        self.docs, self.cells = docs, cells
        self.count = np.zeros(docs * cells, np.int64)
        self.total = np.zeros(docs * cells, np.uint64)
        self.check = np.zeros(docs * cells, np.uint64)

    def places(self, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Cells of each key: one in each third of its owner's sketch."""
        third = self.cells // HASHES
        hashed = mix64(keys)
        return np.stack([owner * self.cells + j * third + (mix64(hashed + np.uint64(j)) % np.uint64(third)).astype(np.int64)
                         for j in range(HASHES)])

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        factor = sign.astype(np.uint64)  # -1 is 2^64 - 1
        with np.errstate(over="ignore"):
            checks = mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * factor
            for at in self.places(owner, keys):
                np.add.at(self.count, at, sign)
                np.add.at(self.total, at, keys * factor)
                np.add.at(self.check, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, sign) of the recovered digests, and which sketches are empty afterwards."""
        found = []
        live = np.arange(self.docs)
        while len(live):
            cell = (live[:, None] * self.cells + np.arange(self.cells)).ravel()
            cell = cell[np.abs(self.count[cell]) == 1]
            with np.errstate(over="ignore"):
                factor = self.count[cell].astype(np.uint64)
                keys = self.total[cell] * factor
                pure = self.check[cell] == mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * factor
            cell, keys = cell[pure], keys[pure]
            owner, sign = cell // self.cells, self.count[cell]
            # A digest may stand alone in several of its cells: take it once.
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            owner, keys, sign = owner[fresh], keys[fresh], sign[fresh]
            if not len(keys):
                break
            self.add(owner, keys, -sign)
            found.append((owner, keys, sign))
            live = np.unique(owner)
        empty = ~(self.count.reshape(self.docs, -1).any(axis=1) | self.total.reshape(self.docs, -1).any(axis=1))
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return (*(np.concatenate(c) for c in zip(*found)),) + (empty,) if found else (*none, empty)


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pair of versions, the digests only in the left and only in the right one."""
    out: list = [None] * len(left)
    todo, cells = np.arange(len(left)), CELLS
    while len(todo):
        sketch = Sketches(len(todo), cells)
        for side, sign in ((left, 1), (right, -1)):
            sizes = [len(side[i]) for i in todo]
            if sum(sizes):
                sketch.add(np.repeat(np.arange(len(todo)), sizes), np.concatenate([side[i] for i in todo]), sign)
        owner, keys, signs, empty = sketch.peel()
        order = np.argsort(owner, kind="stable")
        owner, keys, signs = owner[order], keys[order], signs[order]
        bounds = np.searchsorted(owner, np.arange(len(todo) + 1))
        for k in np.flatnonzero(empty):
            own, sign = keys[bounds[k] : bounds[k + 1]], signs[bounds[k] : bounds[k + 1]]
            out[todo[k]] = (own[sign > 0], own[sign < 0])
        todo, cells = todo[~empty], cells * 4
        for i in [i for i in todo if cells > 60 + 64 * (len(left[i]) + len(right[i]))]:
            # A digest that occurs twice in one text (a hash collision) never peels: compare the sets.
            out[i] = (np.setdiff1d(left[i], right[i]), np.setdiff1d(right[i], left[i]))
        todo = np.array([i for i in todo if out[i] is None], np.int64)
    return out


def fingerprints(sides: list[np.ndarray]) -> list[str]:
    """The first sketch of each text: paragraphs, then count, sum and check of each cell."""
    sketch = Sketches(len(sides), CELLS)
    sizes = [len(s) for s in sides]
    if sum(sizes):
        sketch.add(np.repeat(np.arange(len(sides)), sizes), np.concatenate(sides), 1)
    cell = np.zeros((len(sides), CELLS), np.dtype([("count", "<u2"), ("total", "<u8"), ("check", "<u4")]))
    cell["count"], cell["total"] = sketch.count.reshape(cell.shape) & 0xFFFF, sketch.total.reshape(cell.shape)
    cell["check"] = (sketch.check & np.uint64(0xFFFFFFFF)).reshape(cell.shape)
    return [f"{n}:" + base64.b64encode(c.tobytes()).decode() for n, c in zip(sizes, cell)]


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[list[float], list]:
    """Jaccard similarity of paragraphs from the recovered differences; two empty texts are alike."""
    found = differences(left, right)
    out = []
    for a, b, (x, y) in zip(left, right, found):
        both = len(a) - len(x)
        every = both + len(x) + len(y)
        out.append(both / every if every else 1.0)
    return out, found


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprint(batches):
    """Rows sorted by (part, borrowed, order): a row's successor is the next one of its part."""
    held: list[tuple[int, str]] = []
    part, last, size = None, None, 0

    def flush(rows):
        if len(rows) > 1:
            texts = [t for _, t in rows]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            own, new = [digests(t) for t in texts], [digests(t) for t in changed]
            near_new, found = likeness(own[:-1], new)
            near_next, _ = likeness(own[:-1], own[1:])
            yield batch(_OUT, [k for k, _ in rows[:-1]], [len(t) for t in texts[:-1]],
                        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                        fingerprints(own[:-1]), fingerprints(new), near_new, near_next,
                        [len(x) for x, _ in found], [len(y) for _, y in found])

    for b in batches:
        for key, text, of, borrowed in slowly(*b.columns):
            if of != part:
                yield from flush(held)
                held, part, last, size = [], of, False, 0
            if last:
                continue  # only the first borrowed row is a successor
            last = borrowed
            held.append((key, text or ""))
            size += len(text or "")
            if size > RUN_CHARS:
                yield from flush(held)
                held, size = held[-1:], len(held[-1][1])
    yield from flush(held)


def version_fingerprints(docs: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited version, and how alike both and the next are.

    (row, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, only_here,
    only_edited); the next document follows by ascending id, after the last comes the first. Ties of ids
    are ordered by text, a null id comes first, null texts are empty. A single document is its own next
    one. Other columns are ignored. No rows, no rows.

    Documents move once: ids are cut into ranges at counted quantiles, each range also gets ("borrows")
    the first document of the next range that has any.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(row).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = F.coalesce("doc_id", F.lit(_LEAST)).alias("o")
    # Two ranges per input split; the bounds only balance the work.
    wanted = min(RANGES, 2 * max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    shares = [i / wanted for i in range(1, wanted)]
    bounds = docs.agg(F.percentile_approx(order, shares, 20 * wanted).alias("q")).first().q
    bounds = np.array(sorted(set(bounds or [])), np.int64)
    firsts = docs.select(order).mapInArrow(_firsts(bounds), "part int, o long").groupBy("part").agg(F.min("o").alias("o")).orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], _schema(row))
    # A part's first document is also sent to the part before; that of the first to the last.
    lends = {f.part: (f.o, firsts[i - 1].part) for i, f in enumerate(firsts)}
    moved = docs.mapInArrow(_deal(bounds, lends), "doc_id long, text string, part int, borrowed boolean")
    moved = moved.repartition("part").sortWithinPartitions("part", "borrowed", "doc_id", "text")
    return moved.mapInArrow(_fingerprint, _schema("doc_id")).withColumnRenamed("doc_id", row)


_LEAST = -(1 << 63)


def _firsts(bounds: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                o = b.column(0).to_numpy()
                part = np.searchsorted(bounds, o, "left")
                order = np.lexsort((o, part))
                first = order[np.unique(part[order], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(o[first])], names=["part", "o"])

    return run


def _deal(bounds: np.ndarray, lends: dict[int, tuple[int, int]]):
    def run(batches):
        for b in batches:
            o = b.column(0).fill_null(_LEAST).to_numpy()
            part = np.searchsorted(bounds, o, "left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32()), pa.array(np.zeros(len(o), bool))],
                                             names=["doc_id", "text", "part", "borrowed"])
            lent = [i for i, (x, p) in enumerate(zip(o.tolist(), part.tolist())) if lends[p][0] == x]
            if lent:
                to = pa.array([lends[part[i]][1] for i in lent], pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(lent)) for c in b.columns), to, pa.array(np.ones(len(lent), bool))],
                                                 names=["doc_id", "text", "part", "borrowed"])

    return run


def _schema(row: str) -> str:
    return (f"`{row}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, only_here long, only_edited long")
