"""Near misses around one template meet about once a pair, no link is lost, and each class keeps one document."""

from collections import Counter

import numpy as np
import pytest

from mensura.llm import jaccard
from test_llm import BASE, brute_classes, docs_of


def near_misses(n, edits, words=120, seed=6):
    """Texts that differ from a template, and so from each other, in some words."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        own = [f"w{i}" for i in range(words)]
        for at in rng.integers(0, words, int(rng.integers(*edits))):
            own[at] = f"x{rng.integers(1 << 40)}"
        rows.append((k, " ".join(own), "a"))
    return rows


@pytest.mark.parametrize("earlier", [1, 8])
def test_all_links_are_found_among_near_misses(spark, monkeypatch, earlier):
    monkeypatch.setattr(jaccard, "EARLIER", earlier)
    rows = near_misses(150, (0, 12))
    got = jaccard.similarity_classes(docs_of(spark, rows), width=5, num=80)
    assert Counter(tuple(r) for r in got.collect()) == brute_classes(rows, 5, 80, 100)


def test_many_near_misses_are_tried_once(spark, monkeypatch):
    tried = []

    def count(docs, nodes, pairs, *more):
        tried.append({(r.a, r.b) for r in pairs.select("a", "b").collect()})
        return real(docs, nodes, pairs, *more)

    real = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", count)
    rows = near_misses(5_000, (9, 14))
    got = jaccard.similarity_classes(docs_of(spark, rows), width=5, num=80)
    # All are too far from each other to link: some five edits on either side of the template would do.
    assert sum(r.component_id != r.doc_id for r in got.collect()) <= 5
    assert sum(map(len, tried)) == len(set().union(*tried))


def test_an_id_with_several_texts(spark):
    other = " ".join(f"z{i}" for i in range(60))
    rows = [(1, BASE, "a"), (5, BASE + " more", "a"), (5, other, "b"), (7, other.upper(), "a"), (8, None, "a"), (8, None, "a"), (8, "", "a"),
            (9, "a b c", "a"), (9, "A  B C", "a"), (9, "d e f", "a"), (None, BASE, "a"), (None, None, "a")]
    kept = jaccard.keep_one(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    short = [t for k, t in got if k == 9]
    assert len(short) == 2 and "d e f" in short
    assert [g for g in got if g[0] != 9] == sorted([(1, BASE), (5, other), (8, None), (8, ""), (None, BASE), (None, None)], key=repr)
