"""Shapes that once crashed: cycles and deep trees of messages, deep pages, long hosts, added tokens. Bins against a plain list version."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mensura.llm import chat, htmltext, packing, urlfilter

MESSAGES = "tree string, node {0}, parent {0}, role string, text string, score double"


def paths_of(messages, best=1):
    got = chat.format_reply_trees(messages, best).select("tree", "path", chat.read_back(F.col("formatted")).alias("turns"))
    return {(r.tree, r.path): [t.text for t in r.turns] for r in got.collect()}


def plain_paths(rows, best):
    """Every path by walking up from every leaf, ranked by mean score and leaf."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        found = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            way, at = [], leaf
            while at in own and len(way) <= len(own):
                way.append(own[at])
                at = own[at][2]
            if len(way) <= len(own):
                found.append((-sum(r[5] for r in way) / len(way), leaf, [r[4] for r in reversed(way)]))
        for k, (_, _, texts) in enumerate(sorted(found)[:best], 1):
            out[tree, k] = texts
    return out


def test_reply_trees_equal_plain_walks(spark):
    rng = random.Random(4)
    rows = []
    for tree in range(12):
        for node in range(1, rng.randrange(2, 40)):
            parent = rng.choice([None, node - 1, node - 1, rng.randrange(0, node)])  # 0 is not known: a root
            rows.append((f"t{tree}", node, parent, "user", f"m{node}", float(rng.randrange(-8, 9))))
    messages = spark.createDataFrame(rows, MESSAGES.format("long"))
    for best in (1, 3):
        assert paths_of(messages, best) == plain_paths(rows, best)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cycles_and_repeated_rows(spark, kind):
    key = (lambda n: n) if kind == "long" else (lambda n: None if n is None else f"n{n}")
    said = [("c", 1, 2), ("c", 2, 1), ("c", 3, 2), ("c", 4, 4), ("c", 5, None), ("c", 6, 5), ("d", 1, 2), ("d", 2, 1),
            ("e", 1, None), ("e", 2, 1), ("e", 2, 1), ("e", 3, 1)]
    rows = [(t, key(n), key(p), "user", f"{t}{n}", 0.0) for t, n, p in said] + [(None, key(1), None, "user", "x", 0.0), ("f", None, None, "user", "x", 0.0)]
    got = paths_of(spark.createDataFrame(rows, MESSAGES.format(kind)))
    assert got == {("c", 1): ["c5", "c6"], ("e", 1): ["e1", "e2"]}


def test_a_long_way_up(spark):
    rows = [("t", k, k - 1 if k else None, "user", str(k), 0.0) for k in range(700)]
    assert paths_of(spark.createDataFrame(rows, MESSAGES.format("long"))) == {("t", 1): [str(k) for k in range(700)]}


@pytest.mark.parametrize("levels", [10, 1200, 20_000])
def test_deep_pages_are_read(spark, levels):
    deep = "<div>" * levels + "<p>low &amp; deep" + "</p></div>" * levels
    marked = f"<body><div>menu</div><article>top{deep}end</article></body>"
    assert htmltext.main_text(marked) == "top\nlow & deep\nend"
    assert htmltext.main_text(f"<body><nav>no</nav>{deep}<b>a</b> b</body>") == "low & deep\na b"
    if levels < 20_000:
        pages = spark.createDataFrame([(k, f"http://h/{k}", marked) for k in range(3)], "page_id long, url string, html string")
        assert [r.text for r in htmltext.extract_main_text(pages).collect()] == ["top\nlow & deep\nend"] * 3


def test_long_hosts_have_few_keys(spark):
    host = "a." * 8000 + "example.com"
    assert sorted(urlfilter.url_keys(host, "/en/x", [4], 2)) == ["com\n/en/", "example.com\n/en/"]
    assert urlfilter.url_keys("com", "/en/", [1], 3) == ["com\n/"] and urlfilter.url_keys("com", "/", [1], 0) == []
    urls = [(1, f"http://{host}/en/x"), (2, f"http://{host}.org/en/x"), (3, "http://" + "." * 9000)]
    rules = [("block", "example.com", "/en/"), ("block", "b.c.example.com", "/")]
    got = urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: (None, "allow")}


def test_added_tokens_are_one_token():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x\n", "<|endoftext", "<|endoftext |>", "", "ä <|user|>", "x" * 3000 + "<|endoftext|>"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert packing.encoder(path)(texts) == want
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.BYTE_BPE_ADDED)(texts) == want


def plain_two_fit(lengths, size):
    """The same rule on a sorted list: fill greedily, then try all pairs for the smallest of the bin."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], size
        while fits := [x for x in left if x <= gap]:
            own.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        if gap and len(own) > 1:
            small = own[-1]
            pairs = [(a + b, max(a, b), min(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small]
            if pairs:
                _, a, b = max(pairs)
                left.remove(a)
                left.remove(b)
                left = sorted([*left, small])
                own[-1:] = [a, b]
        bins.append(sorted(own))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(40))
def test_best_two_fit_equals_a_plain_list_version(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    lengths = rng.integers(1, size + 1, int(rng.integers(0, 50))).tolist()
    which, offsets = packing.best_two_fit(lengths, size)
    bins = {}
    for n, k, at in sorted(zip(lengths, which.tolist(), offsets.tolist()), key=lambda x: x[2]):
        assert at == sum(bins.setdefault(k, []))
        bins[k].append(n)
    assert sorted(map(sorted, bins.values())) == plain_two_fit(lengths, size)
