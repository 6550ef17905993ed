"""Cuckoo filters, and the line index after additions and deletions against a plain reading of what remains."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from mensura.llm import linededup
from mensura.llm.linededup import CuckooFilter, LineIndex

SCHEMA = "doc_id long, text string, doc int, kept string, keys int, h1 long, top string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, 1, "k", 2, 3, "t") for k, t in rows], SCHEMA)


def brute(corpus, rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    holders = defaultdict(set)
    for k, text in corpus:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(k)
    top = {k: max(d for d in own if d is not None) for k, own in holders.items() if len(own) >= min_docs}
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == k]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def cleaned(index, spark, rows):
    return Counter(tuple(r) for r in index.clean(docs_of(spark, rows)).collect())


def test_filter_adds_finds_and_deletes():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, (2, 30_000))
    own = CuckooFilter.sized(15_000)
    assert own.add(*keys[:, :10_000]) and own.add(*keys[:, 10_000:15_000])
    assert own.has(*keys[:, :15_000]).all() and own.has(*keys[:, 15_000:]).mean() < 0.001
    own.delete(*keys[:, :10_000])
    again = CuckooFilter.read(own.bytes())
    assert len(again) == 5_000 and again.has(*keys[:, 10_000:15_000]).all() and again.has(*keys[:, :10_000]).mean() < 0.001
    full = CuckooFilter(np.zeros((64, 4), np.uint16))
    assert full.add(*keys[:, :200]) and full.has(*keys[:, :200]).all() and not full.add(*keys[:, 200:300])
    same = np.full(4, 7)
    assert again.add(same, same)  # alike keys take a place each
    again.delete(same, same)
    assert not again.has(same[:1], same[:1]).any() and len(again) == 5_000
    with pytest.raises(ValueError):
        again.delete(same, same)


def corpus():
    rng = np.random.default_rng(9)
    lines = [f"Line number {i} that many documents share" for i in range(30)] + ["short", "", "   ", "Ünïcödé line of twenty", "ünïcödé line ä"]
    rows = []
    for k in range(60):
        own = [lines[j] for j in rng.integers(0, len(lines), int(rng.integers(0, 9)))]
        own = [" \t" + x.upper() + "\r" if rng.random() < 0.2 and x.isascii() else x for x in own]
        rows.append((k, "\n".join([*own, "LICENSE: this line is in every document", f"line of document {k} on its own"])))
    rows += [(None, rows[3][1]), (None, None), (70, None), (71, ""), (72, "\n\n"), (5, rows[5][1]), (5, "other text of five\n" + rows[8][1]),
             (73, "x" * 100_000 + "\n" + "LICENSE: this line is in every document\n" * 500)]
    return rows


@pytest.mark.parametrize("shard_keys,filter_bytes", [(100_000, 1 << 26), (5, 1 << 26), (100_000, 0)])
def test_index_follows_additions_and_deletions(spark, tmp_path, monkeypatch, shard_keys, filter_bytes):
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(linededup, "FILTER_BYTES", filter_bytes)
    rows = corpus()
    index = LineIndex(spark, str(tmp_path / "index"))
    index.insert(docs_of(spark, rows[:25]).repartition(3))
    assert cleaned(index, spark, rows[:25]) == brute(rows[:25], rows[:25])
    index.insert(docs_of(spark, rows[20:]))  # five of them are there already
    assert cleaned(index, spark, rows) == brute(rows, rows)
    gone = {k for k in range(0, 60, 2)} | {73, 999}
    index.delete(docs_of(spark, [(k, "texts are not needed") for k in gone] + [(2, None)]))
    left = [r for r in rows if r[0] not in gone]
    again = LineIndex.open(spark, str(tmp_path / "index"))
    assert cleaned(again, spark, left) == brute(left, left)
    assert cleaned(again, spark, rows) == brute(left, rows)
    # Taken back and added again, the index is as before.
    again.insert(docs_of(spark, [r for r in rows if r[0] in gone]))
    assert cleaned(again, spark, rows) == brute(rows, rows)
    held = {(r.h1, r.h2) for r in again.refs().collect()}
    assert {(r.h1, r.h2) for r in again.counts().collect()} == held
    again.delete(docs_of(spark, rows))
    assert again.counts().count() == 0 and again.refs().count() == 0
    assert cleaned(again, spark, rows) == brute([], rows)
    seen = again.filters().collect()
    assert all(len(CuckooFilter.read(bytes(r[c]))) == 0 for r in seen for c in ("seen", "shared"))


def test_filters_follow_the_counts_and_grow(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "index"))
    index.insert(docs_of(spark, [(1, "a first line of some length")]))
    size = index.filters().first()["seen"]
    index.insert(docs_of(spark, [(k, f"line {k} of a larger batch\nand one that all of them hold") for k in range(2, 400)]))
    row = index.filters().first()
    assert len(row["seen"]) > len(size)
    assert len(CuckooFilter.read(bytes(row["seen"]))) == 400 and len(CuckooFilter.read(bytes(row["shared"]))) == 1


def test_uncommitted_generations_are_not_seen_and_empty_tables(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "index"))
    empty = docs_of(spark, [])
    index.delete(empty)
    assert cleaned(index, spark, []) == Counter()
    rows = [(k, "one line that is long enough") for k in range(4)]
    assert cleaned(index, spark, rows) == brute([], rows)
    index.insert(empty)
    index.insert(docs_of(spark, rows))
    index._write(index.refs().selectExpr("h1", "h2", "9 as doc", "1 as op"), "refs", "000002-lost")
    again = LineIndex.open(spark, str(tmp_path / "index"))
    assert cleaned(again, spark, rows) == brute(rows, rows)
