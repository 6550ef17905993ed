"""The exact maximum-similarity join against all pairs on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.operators import similarity

SCHEMA = "id {}, bits array<int>, own string, score double, block int"


def table(spark, rows, kind="long"):
    return spark.createDataFrame([(k, b, "x", 1.0, 2) for k, b in rows], SCHEMA.format(kind))


def brute(test, train, bits):
    clean = lambda b: {x for x in b or [] if x is not None and 0 <= x < bits}
    out = []
    for k, b in test:
        own, best = clean(b), (0.0, None)
        for other, c in train:
            theirs = clean(c)
            if other is None or not own & theirs:
                continue
            s = len(own & theirs) / len(own | theirs)
            if s > best[0] or (s == best[0] and other < best[1]):
                best = (s, other)
        out.append((k, len(own), *best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows,visit_rows", [(20_000, 20_000), (7, 11), (1, 1000)])
def test_nearest_training_row_equals_all_pairs(spark, monkeypatch, block_rows, visit_rows):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(similarity, "VISIT_ROWS", visit_rows)
    rng = np.random.default_rng(8)
    share = 1 / np.arange(1, 201)

    def some(n, base):
        out = []
        for i in range(n):
            own = rng.choice(200, int(rng.integers(0, 40)), replace=False, p=share / share.sum()).tolist()
            out.append((base + i, own + own[:2]))
        return out

    big = 1 << 60  # keys beyond the whole numbers of a double
    train = some(50, big) + [(big + 100 + i, [1, 2, 3, 150]) for i in range(20)] + [(None, [5, 6]), (big + 500, None)]
    test = some(40, 0) + [(90, [1, 2, 3, 150]), (91, [199]), (92, []), (93, None), (94, [None, 7, -3, 5000]), (95, [1, 2]), (95, [1, 2])]
    got = similarity.max_similarity(table(spark, test), table(spark, train), "id", "bits", 256)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(test, train, 256)


@pytest.mark.parametrize("shared_bits", [0.0, 1e9])
def test_products_and_lists_find_the_same_rows(monkeypatch, shared_bits):
    """Both ways inside a block against all pairs; sizes call for every number of counts in a product's number."""
    monkeypatch.setattr(similarity, "SHARED_BITS", shared_bits)
    monkeypatch.setattr(similarity, "TILE_ROWS", 16)
    monkeypatch.setattr(similarity, "CHUNK_ROWS", 50)
    monkeypatch.setattr(similarity, "PACKED", ((3, 8), (6, 4), (8, 3), (12, 2), (24, 1)))
    rng = np.random.default_rng(5)
    bits = 5000
    sets = [np.sort(rng.choice(bits, int(n), replace=False)).astype(np.int16) for n in [*rng.integers(1, 900, 150), *[5] * 40, 4200, 4500]]
    sets += [sets[3], sets[3], np.array([4999], np.int16)]
    keys = rng.permutation(len(sets)) + (1 << 60)
    asked = [sets[3], sets[7][1:], sets[190], sets[191], *sets[150:170], np.array([0], np.int16), np.array([], np.int16)]
    asked += [np.sort(rng.choice(bits, int(n), replace=False)).astype(np.int16) for n in rng.integers(1, 900, 30)]
    known = [0.0] * len(asked)
    known[4], known[5] = 1.0, 0.9  # found elsewhere: only rows that are no worse come back
    train = pd.DataFrame({"key": keys, "set": sets})
    got = similarity._search(bits)(train, pd.DataFrame({"row": range(len(asked)), "set": asked, "score": known}))
    want = []
    for i, (own, least) in enumerate(zip(asked, known)):
        own = set(own.tolist())
        met = [(-len(own & set(s.tolist())) / len(own | set(s.tolist())), k) for k, s in zip(keys, sets) if own & set(s.tolist())]
        if met and -min(met)[0] >= least:
            want.append((i, -min(met)[0], min(met)[1]))
    assert sorted(got.itertuples(index=False, name=None)) == want


def test_rows_that_share_bits_are_counted_by_products(monkeypatch):
    """Sets of many frequent bits meet nearly all others: no list is read for them, one row at a time."""
    def lists(*_):
        raise AssertionError("inverted lists were built")

    monkeypatch.setattr(similarity, "_Block", lists)
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.choice(2048, 250, replace=False)).astype(np.int16) for _ in range(60)]
    train = pd.DataFrame({"key": range(40), "set": sets[:40]})
    got = similarity._search(2048)(train, pd.DataFrame({"row": range(20), "set": sets[40:], "score": 0.0}))
    assert len(got) == 20 and (got["score"] > 0).all()


def test_text_keys_and_empty_tables(spark):
    test, train = [("b", [1, 2]), ("a", [])], [("y", [2, 1]), ("x", [1, 2]), ("z", [1])]
    got = similarity.max_similarity(table(spark, test, "string"), table(spark, train, "string"), "id", "bits", 64)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0.0, None), ("b", 2, 1.0, "x")]
    none = similarity.max_similarity(table(spark, test, "string"), table(spark, [], "string"), "id", "bits", 64)
    assert {(r.id, r.similarity, r.nearest) for r in none.collect()} == {("a", 0.0, None), ("b", 0.0, None)}
    assert similarity.max_similarity(table(spark, []), table(spark, [(1, [1])]), "id", "bits", 64).count() == 0


def test_bands_and_hashed_bits(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.1, 3.0), (0.95, 5.0), (1.0, 7.0), (None, 9.0)], "s double, e double")
    got = {r.band: (r.n, r.mean_value) for r in similarity.similarity_bands(df, "s", "e").collect()}
    assert got == {0: (1, 1.0), 1: (1, 3.0), 9: (2, 6.0)}
    bits = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>").select(similarity.hashed_bits(F.col("w"), 64).alias("b"))
    first, second = (r.b for r in bits.collect())
    assert first == sorted(set(first)) and len(first) == 2 and all(0 <= x < 64 for x in first) and second == []


def test_blocks_go_to_few_tasks():
    """A block is copied for every ``VISIT_ROWS`` test rows, a test row for every block it visits: both are large."""
    assert similarity.VISIT_ROWS >= 100_000 and similarity.BLOCK_ROWS >= 50_000


def test_few_training_rows_use_all_cores(spark):
    """One small block is visited in several tasks, which adaptive execution does not merge."""
    rows = spark.range(400).select(F.col("id").alias("k"), F.array((F.col("id") % 31).cast("int"), (F.col("id") % 7 + 40).cast("int")).alias("b"))
    out = similarity.max_similarity(rows.where("k >= 200"), rows.where("k < 200"), "k", "b", 64)
    assert out.where("similarity = 1.0 AND nearest % 31 = k % 31 AND nearest % 7 = k % 7").count() == out.where("similarity = 1.0").count() > 0
    visits = rows.select(F.col("k").alias("row"), F.col("b").alias("set"), F.lit(0).alias("block"), F.lit(0.0).alias("score"))
    blocks = rows.select(F.col("k").alias("key"), F.col("b").alias("set"), F.lit(0).alias("block"))
    best = similarity._round(visits, blocks, 1, 24, 64, "row long, score double, nearest long")
    assert best.rdd.getNumPartitions() >= 24 and best.count() == 400
