import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.functions.quantiles import signed_rank_p, t_quantile
from mensura.operators import contrasts as c
from mensura.operators.joins import near_signature_pairs

FIELDS, TIMES = ["f1", "f2", "f3"], ["t"]


def world(seed=3, n_sources=24, n_entities=60):
    """Sources of two collections (one holds most of them); two entities occur everywhere."""
    rng = random.Random(seed)
    sources, records = [], []
    for s in range(n_sources):
        fields = [rng.choice([None, "x", "y"]) for _ in FIELDS]
        sources.append((f"s{s:02d}", "c1" if s % 6 else "c2", *fields, rng.choice([None, "15"])))
        size = rng.choice([5, 19, 20, 25, 40])
        chosen = {"e00", "e01"} | {f"e{e:02d}" for e in rng.sample(range(2, n_entities), size - 2)}
        for e in chosen:
            for _ in range(rng.choice([1, 1, 2])):
                records.append((f"s{s:02d}", e, round(rng.gauss(6, 1), 2), f"g{int(e[1:]) % 7}" if e != "e05" else " "))
    return sources, records


def brute_pairs(sources, records, minimum):
    found = {}
    entities = {}
    for s, e, *_ in records:
        entities.setdefault(s, set()).add(e)
    for a, b in itertools.combinations(sorted(sources), 2):
        if a[1] != b[1]:
            continue
        diff = [f for f, x, y in zip(FIELDS, a[2:5], b[2:5]) if x != y]
        extra = a[5] != b[5]
        shared = len(entities[a[0]] & entities[b[0]])
        if shared >= minimum and (len(diff) == 1 or (not diff and extra)):
            found[a[0], b[0]] = (diff[0] if diff else "t", shared)
    return found


def frames(spark, sources, records):
    s = spark.createDataFrame(sources, "source string, coll string, f1 string, f2 string, f3 string, t string")
    r = spark.createDataFrame(records, "source string, entity string, value double, grp string")
    return s, r


@pytest.mark.parametrize("minimum", [2, 8, 20])
@pytest.mark.parametrize("path", ["window", "slots"])
def test_pairs_equal_brute_force(spark, request, minimum, path):
    if path == "slots":
        request.getfixturevalue("slots_only")
    sources, records = world()
    s, r = frames(spark, sources, records)
    got = near_signature_pairs(r, s, "source", "coll", "entity", FIELDS, TIMES, minimum)
    named = c.name_contrasts(got, FIELDS, TIMES).collect()
    assert {(x.source_a, x.source_b): (x.differing_field, x.n_shared) for x in named} == brute_pairs(sources, records, minimum)


def test_paired_contrasts_against_pandas(spark):
    sources, records = world(seed=8)
    s, r = frames(spark, sources, records)
    out = c.paired_contrasts(r, s, "source", "coll", "entity", "value", "grp", FIELDS, TIMES, 8, replicates=2000).toPandas()
    assert len(out) == len(brute_pairs(sources, records, 8)) > 0
    pdf = pd.DataFrame(records, columns=["source", "entity", "value", "grp"])
    med = pdf.groupby(["source", "entity"])["value"].median()
    for row in out.itertuples():
        a, b = med[row.source_a], med[row.source_b]
        common = a.index.intersection(b.index)
        d = b[common] - a[common]
        groups = pd.Series([f"g{int(e[1:]) % 7}" if e != "e05" else None for e in common], index=common)
        per_group = d.groupby(groups).median()
        assert row.n_entities == len(d) and row.n_groups == len(per_group)
        assert row.delta_mean == pytest.approx(d.mean()) and row.delta_median == pytest.approx(d.median())
        positive = (d > 0).mean()
        assert row.sign_consistency == pytest.approx(max(positive, 1 - positive))
        assert row.dominant_direction == ("B_higher" if positive >= 0.5 else "A_higher")
        assert row.group_median_median == pytest.approx(per_group.median()) and row.group_mean == pytest.approx(per_group.mean())
        half = t_quantile(0.975, len(d) - 1) * d.std(ddof=1) / np.sqrt(len(d))
        assert row.mean_low_entity == pytest.approx(d.mean() - half) and row.mean_high_entity == pytest.approx(d.mean() + half)
        assert row.median_low_entity <= row.delta_median <= row.median_high_entity
        assert row.rank_correlation == pytest.approx(a[common].rank().corr(b[common].rank()), abs=1e-9)


def test_t_quantile_known_values():
    # A published pair: n 169, mean 0.31745562, sd 0.26210067 → interval 0.27765291 … 0.35725833.
    half = t_quantile(0.975, 168) * 0.2621006703762225 / np.sqrt(169)
    assert 0.31745562130177496 - half == pytest.approx(0.2776529088367383, abs=1e-9)
    half = t_quantile(0.975, 130) * 0.3247167924552216 / np.sqrt(131)
    assert -0.4037022900763358 - half == pytest.approx(-0.4598302041549046, abs=1e-9)
    assert t_quantile(0.975, 1) == pytest.approx(12.706204736, abs=1e-6)
    assert t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)


def test_signed_rank_p_small_and_large():
    assert signed_rank_p(21.0, 6, 0, True) == pytest.approx(2 / 2**6)
    assert signed_rank_p(10.0, 6, 0, True) == pytest.approx(2 * sum(
        1 for s in itertools.product([0, 1], repeat=6) if sum(r for r, on in zip(range(1, 7), s) if on) <= 10) / 64, abs=1e-12)
    # W = 0 at n = 100 without ties: z = -(2525) / sqrt(100·101·201/24)
    assert signed_rank_p(0.0, 100, 0, False) == pytest.approx(3.89e-18, rel=0.02)


@pytest.mark.parametrize("path", ["window", "slots"])
def test_signed_rank_statistic(spark, request, path):
    if path == "slots":
        request.getfixturevalue("slots_only")
    d = [0.0, 0.5, -0.5, 1.0, 2.0, -3.0, 2.0, None]
    df = spark.createDataFrame([("p", x) for x in d], "k string, d double")
    row = c.signed_rank(df, ["k"], "d").first()
    assert (row.n_zero, row.n_nonzero, row.w_plus) == (1, 6, 1.5 + 3 + 4.5 + 4.5)
    assert row.tie_term == 2 * (8 - 2)


@pytest.mark.parametrize("n", [3, 4, 15, 40])
@pytest.mark.parametrize("path", ["window", "slots"])
def test_bootstrap_follows_resampling(spark, request, n, path):
    if path == "slots":
        request.getfixturevalue("slots_only")
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 1)
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    row = c.bootstrap_median(df, ["k"], "v", 10_000).first()
    boot = np.median(rng.choice(values, size=(40_000, n)), axis=1)
    low, high = np.percentile(boot, [2.5, 97.5])
    step = 0.12 * (values.max() - values.min())
    assert row.n_units == n and row.n_replicates == 10_000
    assert abs(row.ci_low - low) <= step and abs(row.ci_high - high) <= step
    again = c.bootstrap_median(df.repartition(3), ["k"], "v", 10_000).first()
    assert (again.ci_low, again.ci_high) == (row.ci_low, row.ci_high)


def test_bootstrap_needs_three_units(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "k string, v double")
    got = {r.k: r for r in c.bootstrap_median(df, ["k"], "v", 500).collect()}
    assert got["a"].method == "insufficient" and got["a"].ci_low is None
    assert got["b"].method == "bootstrap" and got["b"].ci_low >= 1.0


def test_blank_group_takes_no_part(spark):
    df = spark.createDataFrame([("a", "b", None, 1.0), ("a", "b", "g", 2.0), ("a", "b", "g", 4.0)], "source_a string, source_b string, group string, delta double")
    row = c.cluster_summary(c.cluster_medians(df)).first()
    assert (row.n_groups, row.group_mean) == (1, 3.0)
    assert c.paired_summary(df).select(F.col("n_entities")).first()[0] == 3


def test_alike_sources_are_no_candidates(spark):
    """Many sources described alike that share one entity, and two that differ in one field and share 25."""
    from mensura.operators import joins

    rows = [(s, e) for s in range(400) for e in ["all", *(f"{s}-{i}" for i in range(30))]]
    rows += [(s, f"pair-{i}") for s in (1000, 1001) for i in range(25)]
    records = spark.createDataFrame(rows, "source int, entity string")
    described = [(s, "c", "x", 1, None) for s in range(400)] + [(1000, "c", "x", 1, "t"), (1001, "c", None, 1, "t")]
    sources = spark.createDataFrame(described, "source int, collection string, f string, g int, time string")
    found = joins.near_signature_pairs(records, sources, "source", "collection", "entity", ["f", "g"], ["time"], 20)
    assert [(r.source_a, r.source_b, r["diff"], r.n_shared) for r in found.collect()] == [(1000, 1001, ["f"], 25)]
    joined = records.join(sources, "source").select("source", "entity", "collection", F.inline(joins.masked_signatures(["f", "g"], ["time"])))
    other = joined.select(F.col("source").alias("other"), "entity", "collection", "mask", "code", F.col("left_out").alias("out"))
    assert joined.join(other, ["entity", "collection", "mask", "code"]).where("source < other AND left_out <> out").count() == 25


def test_pairs_meet_by_entity_as_they_do_by_walking(spark):
    """Deltas of sources that meet on collection and entity are those of pairs joined to all entities of A, and few rows meet."""
    rows = [(s, e, float(s * e % 7), "g") for s in range(12) for e in range(s * 40, s * 40 + 90)]
    records = spark.createDataFrame(rows, "source int, entity int, value double, grp string")
    pairs = spark.createDataFrame([(s, s + 1, "c") for s in range(11)], "source_a int, source_b int, coll string")
    met = c.pair_deltas(pairs, records, "source", "entity", "value", "grp", "coll")
    walked = c.pair_deltas(pairs, records, "source", "entity", "value", "grp")
    assert sorted(map(tuple, met.select(*walked.columns).collect())) == sorted(map(tuple, walked.collect()))
    medians = records.select("source", "entity", F.col("value").alias("m"))
    assert not c._meetings(pairs, medians, "source", "entity", "coll")
    apart = records.withColumn("entity", F.col("entity") + F.col("source") * 50)
    many = spark.createDataFrame([(a, b, "c") for a in range(12) for b in range(a + 1, 12)], "source_a int, source_b int, coll string")
    assert c._meetings(many, apart.select("source", "entity", F.col("value").alias("m")), "source", "entity", "coll")
    both = [c.pair_deltas(many, apart, "source", "entity", "value", None, x) for x in (None, "coll")]
    assert both[0].count() == both[1].select(*both[0].columns).intersectAll(both[0]).count()


def test_pairs_of_sources_described_twice(spark):
    """Copies of a description count the shared entities again; a second description of a source is a row of its own."""
    records = spark.createDataFrame([(s, e) for s in (1, 2, 3) for e in range(25)], "source int, entity int")
    rows = [(1, "c", "x", 1, 0), (1, "c", "x", 1, 0), (2, "c", "y", 1, 0), (3, "c", "y", 2, 0), (3, "d", "x", 2, 0)]
    sources = spark.createDataFrame(rows, "source int, collection string, f string, g int, time int")
    got = near_signature_pairs(records, sources, "source", "collection", "entity", ["f", "g"], ["time"], 20)
    assert sorted((r.source_a, r.source_b, r.collection, r["diff"], r.n_shared) for r in got.collect()) == [
        (1, 2, "c", ["f"], 50), (1, 2, "c", ["f"], 50), (2, 3, "c", ["g"], 25)]
