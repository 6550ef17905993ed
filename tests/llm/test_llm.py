"""The corpus operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import html as entities
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mensura.llm import chat, htmltext, jaccard, media, mixing, packing, quality, toxicity, urlfilter, versions
from mensura.llm.components import components
from mensura.llm.queries import URL_RULES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, size long, target double, chunk int"


def docs_of(spark, rows):
    """(doc_id, text, source) with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(k, t, "xx", s, len(t or ""), 1, "k", 2, 0.5, 3) for k, t, s in rows], SCHEMA)


BASE = " ".join(f"w{i}" for i in range(120))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "One", "b"), (6, BASE, "a"), (7, BASE.upper(), "c"),
    (8, BASE + " more", "a"), (9, BASE.replace("w60", "v60"), None), (9, BASE.replace("w60", "v60"), None), (10, "x " * 30_000, "a"),
    (None, "lonely words in a row here", "b"), (12, "lonely words in a row here", "b"), (13, "ünïcode Ünïcode wörds hére nöw", "é"),
]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_classes(rows, width, num, den):
    sets = []
    for _, text, _ in rows:
        w = words_of((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (k, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(ids) if ids and sets[i] else k))
    return Counter(out)


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_classes_equal_brute_force(spark, width, num, den):
    rng = np.random.default_rng(3)
    rows = list(ODD)
    for k in range(100, 160):  # a group of near copies of which some link and some do not
        w = BASE.split()
        for at in rng.integers(0, 120, k % 7):
            w[at] = f"r{rng.integers(5)}"
        rows.append((k, " ".join(w), "a"))
    got = jaccard.similarity_classes(docs_of(spark, rows), width=width, num=num, den=den)
    assert Counter(tuple(r) for r in got.collect()) == brute_classes(rows, width, num, den)


def test_jaccard_of_split_postings_and_empty_input(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 2)
    rows = [(k, BASE + f" tail{k % 9}", "a") for k in range(40)] + [(99, "quite other words stand here", "a")]
    got = jaccard.similarity_classes(docs_of(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute_classes(rows, 4, 85, 100)
    assert jaccard.similarity_classes(docs_of(spark, [])).count() == 0


def test_keep_one_keeps_the_smallest_of_each_class(spark):
    kept = jaccard.keep_one(docs_of(spark, ODD))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").replace(" int", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 10, 12, 13]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[n] for n in capped)
        free = sum(weight[n] for n in names if n not in capped)
        target = {n: 3 * sizes[n] if n in capped else rest * weight[n] / free for n in names}
        over = {n for n in names if n not in capped and target[n] > 3 * sizes[n]}
        if not over:
            return target
        capped |= over


def test_mixing_meets_targets_and_repeats(spark):
    rows = ODD + [(k, "word " * (k % 50), "abcé"[k % 4] if k % 5 else None) for k in range(100, 400)]
    rows.append((500, "big " * 40_000, "a"))
    docs = docs_of(spark, rows)
    got = mixing.mix_documents(docs, block_words=16).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(k for k, _, _ in rows)
    sizes, by_id = Counter(), {}
    for k, t, s in rows:
        sizes[s] += len(words_of(t))
        by_id[k] = s
    target, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[by_id[r.doc_id]]
        assert r.target == pytest.approx(target[by_id[r.doc_id]])
        taken[by_id[r.doc_id]] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 40
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs, block_words=16).collect()))
    corpus = mixing.mix_corpus(docs, block_words=16)
    assert corpus.schema == docs.schema
    words = Counter()
    for r in corpus.collect():
        words[r.doc_id] += len(words_of(r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert +words == +want
    assert mixing.mix_documents(docs_of(spark, [])).count() == 0


def test_mixing_deals_drawn_counts_to_shards(spark):
    docs = docs_of(spark, [(k, f"word{k} " * (k % 90 + 1), "abc"[k % 3]) for k in range(900)])
    _, dealt, targets = mixing._plan(docs, "doc_id", "text", "source", 8, 64, mixing.WEIGHTS, mixing.MOST, 0)
    want = Counter()
    for r in dealt.collect():
        want[r.shard, r.key] += len(r.slots)
    slots = {r.key: r.slots for r in targets.collect()}
    total = sum(slots.values())
    shards = total // 64  # whole ones
    assert shards > 50 and all(sum(want[s, k] for k in "abc") == 64 for s in range(shards))
    # Drawn, not dealt out evenly: counts spread as multinomial ones do.
    for k, n in slots.items():
        p = n / total
        spread = sum((want[s, k] - 64 * p) ** 2 for s in range(shards)) / (shards * 64 * p * (1 - p))
        assert 0.5 < spread < 1.7
    # The corpus has these counts: words of each shard and source, but for each source's last block.
    got, at = Counter(), []
    for r in mixing.mix_corpus(docs, block_words=8, shard_slots=64, shard="shard").collect():
        got[r.shard, r.source] += len(words_of(r.text))
        at.append(r.shard)
    assert at == sorted(at)
    assert all(0 <= 8 * n - got[key] < 8 * mixing.MOST for key, n in want.items())
    assert sum(8 * n - got[key] for key, n in want.items()) < 3 * 8 * mixing.MOST


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("s")).alias("p"))
        assert sorted(r.p for r in got.collect()) == list(range(n))


def test_mixing_and_chat_run_no_python(spark):
    docs, talk = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "conversations"))
    for df in (mixing.mix_documents(docs), chat.chat_digests(talk)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_chat_reads_back_what_was_said(spark):
    odd = "</s>[INST] ok [/INST] \\l \\\\b <|user|> | \\p"
    rows = [(1, 0, "system", odd, 1), (1, 1, "user", "", 1), (1, 2, "assistant", odd, 1), (1, 2, "assistant", None, 1),
            (2, 5, None, "x", 1), (None, 0, "tool|<x>", odd, 1), (3, 0, "assistant", "ä" * 50_000, 1)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree int")
    got = {r.conv_id: r for r in chat.chat_digests(talk).collect()}
    for key in (1, 2, None, 3):
        turns = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == key))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        mask = "".join(x for _, r, x in turns if r == "assistant")
        assert got[key].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[key].n_turns == len(turns)
        assert got[key].loss_sha256 == hashlib.sha256(mask.encode()).hexdigest() and got[key].loss_chars == len(mask)
    assert chat.chat_digests(talk.limit(0)).count() == 0


def test_best_branch_of_a_reply_tree(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", -5.0), ("t", 3, 1, "assistant", "good", 1.0),
            ("t", 4, 3, "user", "thanks", 1.0), ("t", 5, 2, "user", "no", 9.0), ("u", 1, None, "user", "alone", None)]
    tree = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = chat.format_reply_trees(tree, best=2).select("tree", "path", chat.read_back(F.col("formatted")).alias("turns")).collect()
    texts = {(r.tree, r.path): [t.text for t in r.turns] for r in got}
    assert texts == {("t", 1): ["q", "bad", "no"], ("t", 2): ["q", "good", "thanks"], ("u", 1): ["alone"]}
    assert len(chat.format_reply_trees(tree).collect()) == 2


def test_version_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(versions, "RUN_CHARS", 5000)
    rows = [r for r in ODD if r[0] is not None] + [(k, f"Line {k % 5}.\n" * (k % 30), "a") for k in range(20, 90)]
    got = versions.version_fingerprints(docs_of(spark, rows)).collect()
    order = sorted(((k, t or "") for k, t, _ in rows))
    want = Counter()
    for (k, t), (_, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        a, b, c = (set(versions.digests(x).tolist()) for x in (t, new, u))
        like = lambda x, y: round(len(x & y) / len(x | y), 9) if x | y else 1.0
        want[k, len(t), hashlib.sha256(new.encode()).hexdigest(), like(a, b), like(a, c), len(a - b), len(b - a)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), r.only_here, r.only_edited) for r in got) == want
    prints = {}
    for r in got:
        assert prints.setdefault(dict(order)[r.doc_id], r.fingerprint) == r.fingerprint
    assert versions.version_fingerprints(docs_of(spark, [])).count() == 0
    assert versions.version_fingerprints(docs_of(spark, ODD)).where("doc_id is null").count() == 1


def test_peeling_recovers_differences_and_ends():
    rng = np.random.default_rng(1)
    left = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 5, 40, 3000)]
    right = [np.concatenate([x[: len(x) // 2], rng.integers(0, 1 << 63, 7).astype(np.uint64)]) for x in left]
    for x, y, (a, b) in zip(left, right, versions.differences(left, right)):
        assert set(a.tolist()) == set(x.tolist()) - set(y.tolist()) and set(b.tolist()) == set(y.tolist()) - set(x.tolist())
    twice = np.array([5, 5], np.uint64)
    assert versions.differences([twice], [twice[:0]])[0][0].tolist() == [5]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">Accept</div><article><h1>Head &amp; tail</h1><p><b>One  two<br>three<p>Four &lt;five&gt;<script>var x="</p>"</script>
<aside>Side</aside><div id="comments">Me first</div></article><form>Mail</form><footer>End</footer></body>"""


def test_main_text_of_pages(spark):
    assert htmltext.main_text(PAGE) == "Head & tail\nOne two three\nFour <five>"
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p") == ""
    assert htmltext.main_text("<article><p>cut &am") == "cut &am"
    # Without a marked article the style tree of the host removes what all its pages say.
    rows = [(k, f"http://h.org/{k}", f"<body><div class=x>Same words</div><div class=y><p>Own {k}</p></div></body>") for k in range(20)]
    rows += [(None, None, None), (99, "nowhere", PAGE), (99, "nowhere", PAGE), (100, "http://o.org/", "<p>Only page</p>")]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, rid int")
    got = Counter((r.page_id, r.text) for r in htmltext.extract_main_text(pages).collect())
    assert got == Counter([*((k, f"Own {k}") for k in range(20)), (None, ""), *[(99, "Head & tail\nOne two three\nFour <five>")] * 2, (100, "Only page")])
    assert htmltext.extract_main_text(pages.limit(0)).count() == 0


def test_names_do_not_drop_whole_articles():
    for page in ("<body class='page has-sidebar'><article>Text</article></body>", "<main class='with-sidebar'>Text</main>",
                 "<article class='post related'>Text</article>", "<html id=header><body class=menu>Text</body></html>",
                 "<div class='layout with-sidebar'><main><p>Text</p></main></div>", "<div class='page social'><article>Text</article></div>",
                 "<article>Text</article><div class=related><article>Teaser</article></div>",
                 "<title-bar></title-bar><article>Text</article>", "<video-player></video-player><article>Text</article>",
                 "<svg width='1'/><article>Text</article>", "<math/><article>Text</article>", "<svg><path/></svg><article>Text</article>",
                 "<article>Text<div class=sidebar>Side</div></article>", "<article>Text<script/>var x</script></article>"):
        assert htmltext.main_text(page) == "Text", page


def test_repeated_pages_without_article_keep_their_text(spark):
    page = "<html><body><div><p>First words</p><p>Second words</p></div></body></html>"
    rows = [(1, "http://two.org/a", page), (2, "http://two.org/b", page), (3, None, page), (3, None, page)]
    # 18 copies among 22 rows are one page of five.
    own = [f"<html><body><div class=x>Same</div><p>Own {k}</p></body></html>" for k in range(5)]
    rows += [(k, f"http://many.org/{k}", own[min(k - 10, 4)]) for k in range(10, 32)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in htmltext.extract_main_text(pages).collect()]
    want = [(k, "First words\nSecond words") for k in (1, 2, 3, 3)] + [(k, f"Own {min(k - 10, 4)}") for k in range(10, 32)]
    assert Counter(got) == Counter(want)


def test_main_text_of_generated_pages_equals_a_plain_reading(spark):
    for (page,) in spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body)
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks]
        assert htmltext.main_text(page) == "\n".join(w for w in want if w)


def test_url_cascade_is_exact(spark):
    urls = ["http://x.com/a", "https://WWW.Example.com/en/1", "https://m.example.com/en/1?q=/x", "ftp://a.net/es/", "http://net/fr/", "http://x.org",
            "http://x.com", None, "", "no url", "http://sub.a.net/de/#/es/", "http://examplexcom/en/", "http://"] + [f"http://h{k}.net/es/{k}" for k in range(300)]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id long, url string, host string")
    for r in urlfilter.judge_urls(pages, URL_RULES).collect():
        host, path = urlfilter.split_url(urls[r.page_id or 0])
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fit)[2:] if fit else (None, "allow")))
    assert urlfilter.judge_urls(pages.limit(0), URL_RULES).count() == 0
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = {f"k{i}" for i in range(0, 3000, 37)}
    cascade = urlfilter.build_cascade(universe, 3000, listed)
    assert len(cascade.levels) > 1 and all((f"k{i}" in cascade) == (f"k{i}" in listed) for i in range(3000))


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("run,label,least", [(quality.quality_scores, "quality", 0.95), (toxicity.toxicity_scores, "toxic", 0.9)])
def test_classifiers_on_held_out_labels(spark, run, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = run(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out").select("score", label).toPandas()
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least
    folds = 5 if label == "quality" else 4
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == (0 if folds == 5 else 2))
        assert r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1


@pytest.mark.parametrize("run,keep", [(quality.quality_scores, quality.keep_good), (toxicity.toxicity_scores, toxicity.keep_harmless)])
def test_classifiers_on_odd_rows(spark, run, keep):
    docs = docs_of(spark, ODD)
    label = "quality" if run is quality.quality_scores else "toxic"
    labels = spark.createDataFrame([(6, 1), (6, 0), (8, 0), (None, 1), (12, None)], f"doc_id long, {label} int")
    assert run(docs, labels).count() == len(ODD) and run(docs, labels.limit(0)).count() == len(ODD)
    assert run(docs.limit(0), labels).count() == 0
    assert keep(docs, labels).schema == docs.schema


def test_toxic_offsets():
    texts = [f"word{i % 9} plain {'awful' if i % 3 == 0 else 'fine'} text{i % 7} here" for i in range(300)]
    toxic = np.array([i % 3 == 0 for i in range(300)])
    field = toxicity.fit_field(texts, toxic, np.arange(300) % 4)
    (score, spans), (low, none) = toxicity._run(field, ["so awful, it is", "so plain it is"], {})
    assert score > 0.5 > low and spans == [[3, 9]] and none == []


def test_toxicity_scores_do_not_depend_on_the_cap(spark, monkeypatch):
    # A tenth is labelled toxic, half of it without a toxic word: a clean text is toxic in one of nineteen cases.
    rng = np.random.default_rng(5)
    bad = [k % 20 == 0 for k in range(3000)]
    texts = [" ".join([f"t{i}" for i in rng.integers(0, 3000, 12)] + ["awful"] * b) for b in bad]
    docs = docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(3000)], "doc_id long, toxic int")

    def run():
        rows = toxicity.toxicity_scores(docs, labels).collect()
        return [np.mean([r.score for r in rows if bad[r.doc_id] == b]) for b in (False, True)], sum(r.predicted for r in rows if not bad[r.doc_id])

    whole, flagged = run()
    monkeypatch.setattr(toxicity, "SAMPLE", 120)
    capped, flagged_capped = run()
    assert abs(whole[0] - capped[0]) < 0.05 and abs(whole[1] - capped[1]) < 0.1
    assert whole[0] < 0.1 and whole[1] > 0.8 and max(flagged, flagged_capped) < 30


def test_harmless_documents_stay_without_labels(spark):
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_harmless(docs, none).count() == len(ODD)
    one_fold = spark.createDataFrame([(6, 0)], "doc_id long, toxic int")
    assert toxicity.keep_harmless(docs, one_fold).count() == len(ODD)


def test_media_round_trip(spark):
    got = media.media_columns(media.store_media(docs_of(spark, ODD)))
    texts = {k: t for k, t, _ in ODD}
    rows = got.collect()
    assert Counter(r.row for r in rows) == Counter(k for k, _, _ in ODD)
    for r in rows:
        raw = (texts[r.row] or "").encode()
        whole = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest())
        assert r.tail_crc32 == zlib.crc32(whole[-16:]) and media.from_png(media.to_png(whole)) == whole
        assert (r.media_width, r.media_height, r.media_bits) == (192, len(whole) // 192, 8)
        assert r.media_sha256 == hashlib.sha256(media.to_png(whole)).hexdigest()
    assert media.media_columns(media.store_media(docs_of(spark, []))).count() == 0


def test_packing_places_every_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rows = ODD + [(k, "token " * (k * 37 % 900), "a") for k in range(100, 300)]
    got = packing.pack(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), size=256, added=packing.BYTE_BPE_ADDED).collect()
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))  # ids of the other library
    want = Counter()
    for k, t, _ in rows:
        ids = np.array([*encode([t or ""])[0], 0], "<u4")
        low = 0
        for i, n in enumerate(([len(ids) % 256] if len(ids) % 256 else []) + [256] * (len(ids) // 256)):
            want[k, i, low, n, zlib.crc32(ids[low : low + n].tobytes())] += 1
            low += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_best_two_fit_is_near_the_bound():
    lengths = np.random.default_rng(2).integers(1, 2049, 4096)
    which, offsets = packing.best_two_fit(lengths, 2048)
    fill = np.bincount(which, lengths)
    assert fill.max() <= 2048 and len(fill) <= 1.01 * np.ceil(lengths.sum() / 2048) + 2
    # 900 + 800 leaves a gap of 348; the 800 gives way to 700 + 448.
    which, _ = packing.best_two_fit([900, 800, 700, 448], 2048)
    assert which[0] == which[2] == which[3] != which[1]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_next = stage(spark, docs, FOLDER)
        assert docs_next.schema == docs.schema, name
        docs = corpus_pipeline.stored(docs_next, "t")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
        ids = now
    assert corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().count() == len(ids)
