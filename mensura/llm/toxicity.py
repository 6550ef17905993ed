"""Toxicity: a linear-chain conditional random field over words.

Labels are given per document, so words are labelled first: a word, or the beginning of a word, that
many toxic and hardly any other labelled documents hold marks toxic words in toxic documents; in documents
labelled 0 no word is toxic. The field learns from these sequences (hashed word, prefix and suffix
features, transitions between two states), and forward-backward gives each word's marginal. A document's score
is a logistic curve over its largest marginal and their sum, fitted to documents that the field did
not learn from; words with a marginal of at least 0.5 are the offending spans.

The fit uses a bounded sample of labelled rows: at most ``SAMPLE`` documents of each label with at most
``SAMPLE_CHARS`` characters, chosen by a hash of the id. In the curve a sampled document weighs as many as it stands
for, so scores do not depend on how much of a label the sample holds. Every document is scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import batch, mix64, slowly, small_batches, stored
from .quality import training_fold

SAMPLE, SAMPLE_CHARS = 3000, 20_000
BITS, FEATURES = 18, 8
#: Least toxic documents that hold a toxic word or beginning, the odds of harmless to toxic ones (of equally many
#: of both), and how many words may be taken for toxic by chance.
SEED_DOCS, SEED_SHARE, SEED_CHANCE = 3, 0.05, 0.05
STARTS = (4, 5, 6, 7)
#: Words of documents that are decoded together, and of which emissions are remembered.
RUN_WORDS, REMEMBERED = 1 << 19, 1 << 18

_EDGES = ".,;:!?\"'()[]{}<>*#$%&-_"
_WORD = re.compile(r"\S+")


def plain(word: str) -> str:
    return word.strip(_EDGES).lower()


def features(word: str) -> list[int]:
    """Hashed features: the word, its beginnings of 3 to 7 characters, its last 3, and any word."""
    w = plain(word)
    parts = ("w" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5], "6" + w[:6], "7" + w[:7], "e" + w[-3:], "any")
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for p in parts]


@dataclass
class Field:
    """Weights of the features and exponentials of the transition weights."""

    weights: np.ndarray
    moves: np.ndarray  # moves[i, j]: weight of going from state i to j; state 1 is toxic
    curve: np.ndarray  # constant, largest marginal's log odds, log of the sum, log of the words

    def emissions(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            at = np.array([features(w) for w in new])
            known.update(zip(new, self.weights[at].sum(axis=1).tolist()))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        return [m for m, _ in _decode(sequences, self.moves, False)]

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = _summary(marginals)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _summary(marginals: list[np.ndarray]) -> np.ndarray:
    top = np.array([m.max() if len(m) else 0.0 for m in marginals])
    total = np.array([m.sum() for m in marginals])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.column_stack([np.ones(len(top)), np.log(top / (1 - top)), np.log1p(total), np.zeros(len(top))])


def _decode(sequences: list[np.ndarray], moves: np.ndarray, pairs: bool):
    """Marginals of state 1, and expected counts of the moves if ``pairs``, of each sequence.

    Sequences of similar length are decoded side by side; forward and backward values are kept as the ratio
    of the two states, which neither overflows nor vanishes.
    """
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    out: list = [(np.zeros(0), np.zeros((2, 2)))] * len(sequences)
    t = np.exp(np.clip(moves, -20, 20))
    at = 0
    while at < len(order):
        if not len(sequences[order[at]]):
            at += 1
            continue
        to, shortest = at, len(sequences[order[at]])
        while to < len(order) and len(sequences[order[to]]) <= 1.3 * shortest + 16 and (to - at + 1) * len(sequences[order[to]]) <= RUN_WORDS:
            to += 1
        to = max(to, at + 1)
        own = order[at:to]
        sizes = np.array([len(sequences[i]) for i in own])
        n = sizes.max()
        x = np.ones((n, len(own)))
        for k, i in enumerate(own):
            x[: sizes[k], k] = np.exp(np.clip(sequences[i], -30, 30))
        forward, backward = np.empty_like(x), np.ones_like(x)
        forward[0] = x[0] * t[0, 1] / t[0, 0]
        for k in range(1, n):
            f = forward[k - 1]
            forward[k] = np.minimum(x[k] * (t[0, 1] + t[1, 1] * f) / (t[0, 0] + t[1, 0] * f), 1e30)
        for k in range(n - 2, -1, -1):
            b = x[k + 1] * backward[k + 1]
            backward[k] = np.where(k + 1 < sizes, (t[1, 0] + t[1, 1] * b) / (t[0, 0] + t[0, 1] * b), 1.0)
        odds = forward * backward
        marginal = odds / (1 + odds)
        for k, i in enumerate(own):
            counts = np.zeros((2, 2))
            if pairs and sizes[k] > 1:
                f, b, e = forward[: sizes[k] - 1, k], backward[1 : sizes[k], k], x[1 : sizes[k], k]
                joint = np.array([[t[0, 0] + 0 * f, t[0, 1] * e * b], [t[1, 0] * f, t[1, 1] * f * e * b]])
                counts = (joint / joint.sum(axis=(0, 1))).sum(axis=2)
            out[i] = (marginal[: sizes[k], k], counts)
        at = to
    return out


def _coded(names: list[str | None]) -> np.ndarray:
    """Numbers of equal names; None is -1."""
    codes: dict[str, int] = {}
    return np.array([-1 if n is None else codes.setdefault(n, len(codes)) for n in names], np.int64)


def _families(ids: list[np.ndarray], toxic: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Documents of one label whose least hash of four words in a row agrees are one: words that
    copies of one document share must not count as often as there are copies."""
    found: dict[tuple[int, bool], list[np.ndarray]] = {}
    for own, y in zip(ids, toxic):
        with np.errstate(over="ignore"):
            runs = np.zeros(max(1, len(own) - 3), np.uint64)
            for j in range(min(4, len(own))):
                runs += own[j : j + len(runs)].astype(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        found.setdefault((int(mix64(runs).min()), bool(y)), []).append(own)
    return [np.concatenate(v) for v in found.values()], np.array([y for _, y in found], bool)


def _marked(vocabulary: list[str], ids: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The words that tell toxic documents from others, by themselves or by how they begin."""
    ids, toxic = _families(ids, toxic)
    share = toxic.mean() if len(toxic) else 0.5
    marked = np.zeros(len(vocabulary), bool)
    if not 0 < share < 1:
        return marked
    names = [plain(w) for w in vocabulary]
    kinds = [_coded([n if len(n) > 2 else None for n in names])]
    kinds += [_coded([n[:k] if len(n) > k else None for n in names]) for k in STARTS]
    counts = [np.zeros((2, k.max(initial=-1) + 1)) for k in kinds]
    for own, y in zip(ids, toxic):
        own = np.unique(own)
        for k, c in zip(kinds, counts):
            seen = np.unique(k[own])
            c[int(y), seen[seen >= 0]] += 1
    frequent = np.sort(np.concatenate([c.sum(axis=0) for c in counts]))
    for k, (no, yes) in zip(kinds, counts):
        n = no + yes
        # Chernoff bound on as many toxic documents by chance, times the marks that are as frequent.
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(yes > 0, yes * np.log(yes / n / share), 0.0) + np.where(no > 0, no * np.log(no / n / (1 - share)), 0.0)
        rivals = np.maximum(1, len(frequent) - np.searchsorted(frequent, n, "left"))
        sure = (yes >= SEED_DOCS) & (yes > n * share) & (no * share <= SEED_SHARE * yes * (1 - share)) & (gain >= np.log(rivals / SEED_CHANCE))
        marked |= (k >= 0) & np.append(sure, False)[k]
    return marked


def fit_field(texts, toxic: np.ndarray, folds: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0), epochs: int = 5, rate: float = 0.3, keep: float = 1e-4) -> Field:
    """From labelled texts; the documents of the last of the ``folds`` fit the curve only, in which a harmless and
    a toxic one weigh ``stands_for``."""
    numbers: dict[str, int] = {}
    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t.split()), np.int32) for t in texts]
    vocabulary = list(numbers)
    del numbers
    learn = folds != folds.max() if len(set(folds.tolist())) > 1 else np.ones(len(ids), bool)
    marked = _marked(vocabulary, [d for d, u in zip(ids, learn) if u], toxic[learn])
    at = np.array([features(w) for w in vocabulary], np.int32).reshape(-1, FEATURES)
    field = Field(np.zeros(1 << BITS), np.zeros((2, 2)), np.array([0.0, 1.0, 0.0, 0.0]))
    field.moves[:, 1] = -1.0
    # Toxic documents without a marked word have unknown labels.
    used = [i for i in np.flatnonzero(learn) if len(ids[i]) and (not toxic[i] or marked[ids[i]].any())]
    used.sort(key=lambda i: xxhash.xxh3_64_intdigest(str(i)))
    squares, move_squares = np.full(1 << BITS, 1e-2), np.full((2, 2), 1.0)
    for _ in range(epochs):
        for low in range(0, len(used), 128):
            own = used[low : low + 128]
            flat = np.concatenate([ids[i] for i in own])
            unique, inverse = np.unique(flat, return_inverse=True)
            emission = field.weights[at[unique]].sum(axis=1)
            bounds = np.cumsum([0, *(len(ids[i]) for i in own)])
            decoded = _decode([emission[inverse[a:b]] for a, b in zip(bounds, bounds[1:])], field.moves, True)
            wrong = np.concatenate([(marked[ids[i]] & bool(toxic[i])) - m for i, (m, _) in zip(own, decoded)])
            per_word = np.bincount(inverse, wrong, len(unique))
            gradient = np.zeros(1 << BITS)
            np.add.at(gradient, at[unique].ravel(), np.repeat(per_word, FEATURES))
            move = np.zeros((2, 2))
            for i, (_, counts) in zip(own, decoded):
                y = (marked[ids[i]] & bool(toxic[i])).astype(int)
                np.add.at(move, (y[:-1], y[1:]), 1)
                move -= counts
            touched = gradient != 0
            gradient[touched] -= keep * len(own) * field.weights[touched]
            squares += gradient**2
            field.weights += rate * gradient / np.sqrt(squares)
            move_squares += move**2
            field.moves += rate * move / np.sqrt(move_squares)
    check = np.flatnonzero(~learn) if not learn.all() else np.arange(len(ids))
    if len(check):
        x = _summary(field.marginals([field.weights[at[ids[i]]].sum(axis=1) for i in check]))
        field.curve = _curve(x, toxic[check].astype(float), np.where(toxic[check], stands_for[1], stands_for[0]))
    return field


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A weighted logistic regression with a little shrinkage."""
    c = np.zeros(x.shape[1])
    pull = np.array([1e-3, 0.05, 0.05, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x.T * w) @ x + np.diag(pull), x.T @ (weight * (y - p)) - pull * c)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return c


def train(docs: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held_out: int = 2) -> Field:
    """Fit on the sample of labelled rows outside the held-out fold. Rows without id, text or label teach
    nothing; of several labels of one id the largest counts."""
    small_batches(docs.sparkSession)
    labels = labels.select(F.col(row).alias("id"), F.col(label).cast("int").alias("label"))
    labels = labels.where("id is not null and label in (0, 1)").where(training_fold("id", folds) != held_out)
    labels = stored(labels.groupBy("id").agg(F.max("label").alias("label")), "labels")
    # A share of each label's ids, by their hash, that holds about a quarter more than the sample.
    share = {r["label"]: min(1.0, 1.25 * SAMPLE / r["count"]) for r in labels.groupBy("label").count().collect()}
    drawn = F.pmod(F.xxhash64("id", F.lit("drawn")), F.lit(1_000_000))
    labels = labels.where(F.lit(False) if not share else F.coalesce(*(F.when((F.col("label") == k) & (drawn < round(v * 1_000_000)), True) for k, v in share.items())))
    known = docs.select(F.col(row).cast("long").alias("id"), F.col(text).alias("t")).where(F.length("t").between(1, SAMPLE_CHARS))
    # What is drawn is bounded; it gives the sample and how many usable rows of each label there are.
    known = stored(known.join(broadcast_if_small(labels), "id").withColumn("h", F.xxhash64("id")), "known")
    usable = {r["label"]: r["count"] / share[r["label"]] for r in known.groupBy("label").count().collect()}
    rows = [r for k in (0, 1) for r in known.where(F.col("label") == k).orderBy("h", "t").limit(SAMPLE).select("t", "label", training_fold("id", folds).alias("f")).toLocalIterator()]
    toxic = np.array([r["label"] for r in rows], bool)
    stands_for = tuple(usable.get(k, 0) / max(1, int((toxic == k).sum())) for k in (0, 1))
    return fit_field([r["t"] for r in rows], toxic, np.array([r["f"] for r in rows], int), stands_for) if rows else Field(
        np.zeros(1 << BITS), np.zeros((2, 2)), np.array([-30.0, 0.0, 0.0, 0.0]))  # nothing learnt: nothing is toxic


def _run(field: Field, texts, known: dict[str, float]):
    """Score and offending spans of each text, decoded in runs of bounded size; ``known`` remembers emissions."""
    held: list[np.ndarray] = []
    whole: list[str | None] = []
    size = 0

    def flush():
        marginals = field.marginals(held)
        for text, m, score in zip(whole, marginals, field.scores(marginals).tolist()):
            spans = []
            if len(m) and m.max() >= 0.5:
                bad = set(np.flatnonzero(m >= 0.5).tolist())
                spans = [[w.start(), w.end()] for i, w in enumerate(_WORD.finditer(text)) if i in bad]
            yield score, spans

    for text in texts:
        words = (text or "").split()
        whole.append(text)
        held.append(field.emissions(words, known))
        size += len(words)
        if size > RUN_WORDS:
            yield from flush()
            held, whole, size = [], [], 0
    if held:
        yield from flush()


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("offsets", pa.list_(pa.list_(pa.int32())))])


def toxicity_scores(docs: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """(row, held_out, score, predicted, offsets) for every row of ``docs``, from its text alone.

    offsets are the [start, end) character places of offending words. Null and empty texts have no words and
    the score of a marginal of 0. Repeated rows are each scored; a null id is kept and counts as not
    held out. Other columns are ignored. No rows, no rows.
    """
    field = train(docs, labels, row, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches):
        known: dict[str, float] = {}
        for b in batches:
            found = list(_run(shared.value, (t for t, in slowly(b.column(1))), known))
            if found:
                yield batch(_SCORES, b.column(0), *zip(*found))

    scores = docs.select(F.col(row).cast("long"), F.col(text)).mapInArrow(score, "doc_id long, score double, offsets array<array<int>>")
    held = F.coalesce(training_fold("doc_id", 4) == 2, F.lit(False))
    return scores.select(F.col("doc_id").alias(row), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offsets")


def keep_harmless(docs: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, row, text, label))

    def keep(batches):
        known: dict[str, float] = {}
        for b in batches:
            scores = [s for s, _ in _run(shared.value, (t for t, in slowly(b.column(b.schema.get_field_index(text)))), known)]
            if scores:
                yield b.filter(pa.array(np.array(scores) < threshold))

    return docs.mapInArrow(keep, docs.schema)
