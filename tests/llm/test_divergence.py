"""The divergence audit against a direct count, with blocks and tiles of all sizes and odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mensura.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, block string, share int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, "t", 1, "b", 2) for i, r in enumerate(rows)], SCHEMA)


def brute(rows, at_least, top=50):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= at_least]
        groups = {s: counts[lang, s] for a, s in counts if a == lang}
        whole = Counter()
        for own in groups.values():
            whole.update(own)
        v = len(kept)

        def share(own):
            n = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 5) // (n + 5 * v) for t in kept}

        q, shares = share(whole), {s: share(own) for s, own in groups.items()}
        for s in groups:
            pairs = sorted((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            out += [(lang, s, "pair", o.decode(), -f, i) for i, (f, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - shares[s][t], t.encode()) for t in kept if groups[s][t] and shares[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -f, i) for i, (f, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def corpus(seed=2):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["Über", "naïve", "日本", "A", "b"]
    shares = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(150):
        own = rng.choice(words, int(rng.integers(0, 200)), p=shares / shares.sum())
        rows.append((" ".join(own) + (" B1b_c.C" if i % 3 else ""), ["en", "de", None][i % 8 // 3], f"s{min(i % 17, 6)}"))
    return rows


@pytest.mark.parametrize("tile,widths,held", [(64, divergence.WIDTHS, 300_000), (2, ((2, 64), (4, 8)), 50), (3, (), 300_000), (64, ((1e9, 64),), 7)])
def test_shares_equal_a_direct_count(spark, monkeypatch, tile, widths, held):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "WIDTHS", widths)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus()
    got = divergence.source_divergence(docs_of(spark, rows).repartition(3), at_least=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_odd_rows_ties_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 100)
    rows = [(None, "en", "a"), ("", "en", "b"), ("1 2 3 @", None, None), (None, None, "x"), ("same same", "en", "c"), ("same same", "en", "c"),
            ("same", "en", "é"), ("long " * 5000 + "Tail", "en", "c"), ("tail long", "en", "b"), ("alone", "xx", "only")]
    got = divergence.source_divergence(docs_of(spark, rows), at_least=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2)
    assert divergence.source_divergence(docs_of(spark, [])).count() == 0
    none_kept = divergence.source_divergence(docs_of(spark, rows)).collect()
    assert {r.value for r in none_kept} == {0} and len(none_kept) == 4 * 3 + 2
