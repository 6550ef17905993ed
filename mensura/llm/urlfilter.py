"""URL filter by a Bloom filter cascade: exact membership over the corpus's keys without joins.

A rule (host, path) fits a url whose host is the rule's or below it and whose path starts with the
rule's. The keys of a url are its host's suffixes combined with the starts of its path of those lengths
that rules have; the keys of all urls and of the rules are the universe. Level 0 of a cascade holds
the listed keys; every further level holds what the level before lets through wrongly, alternately
of the unlisted and of the listed keys, until nothing is left. A key of the universe is then listed
exactly if the first level that refuses it has an odd number. Level 0 is sized so that it lets through
about as many unlisted keys as there are listed ones: the levels together grow with the rules, not with
the corpus, and only they are sent to the tasks.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, stored

_VERDICTS = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(_LOWER), path[:end]


def url_keys(host: str, path: str, lengths: list[int], most: int) -> list[str]:
    """Candidate keys, the longest first; of equally long ones that of the longer host.

    ``most`` is the number of labels of the longest rule's host: no longer end of a host can be listed.
    """
    labels = host.rsplit(".", most)[-most:] if host and most else []
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    keys = [(len(h) + n, len(h), h + "\n" + path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [k for *_, k in sorted(keys, reverse=True)]


class Bloom:
    """A Bloom filter over strings, of ``bits`` bits with ``hashes`` hashes, salted by its level."""

    def __init__(self, expected: int, rate: float, level: int):
        rate = min(max(rate, 1e-9), 0.5)
        self.bits = max(64, math.ceil(-max(1, expected) * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(1, expected) * math.log(2)))
        self.hashes = min(self.hashes, 30)
        self.level, self.data = level, bytearray(-(-self.bits // 8))

    def _places(self, key: str):
        digest = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16, salt=str(self.level).encode()).digest()
        a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
        return ((a + i * b) % self.bits for i in range(self.hashes))

    def add(self, key: str) -> None:
        for p in self._places(key):
            self.data[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: str) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Cascade:
    def __init__(self, levels: list[Bloom] | None = None):
        self.levels = levels or []

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def build_cascade(universe: DataFrame, size: int, listed: set[str]) -> Cascade:
    """A cascade exact for ``universe`` (one string column ``key``, ``size`` rows) and ``listed``.

    What a level lets through wrongly is about as much as the list holds, so it may reach the driver.
    """
    if not listed:
        return Cascade()
    levels = [Bloom(len(listed), 0.7 * len(listed) / max(1, size), 0)]
    for key in listed:
        levels[0].add(key)

    def passed(batches):
        for b in batches:
            keys = [k for k in b.column(0).to_pylist() if k not in listed and k in levels[0]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    wrong = {r[0] for r in universe.mapInArrow(passed, "key string").distinct().toLocalIterator()}
    inside = set(listed)
    while wrong:
        level = Bloom(len(wrong), 0.5, len(levels))
        for key in wrong:
            level.add(key)
        levels.append(level)
        wrong, inside = {k for k in inside if k in level}, wrong
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], row: str = "page_id", url: str = "url",
               otherwise: str = "allow") -> DataFrame:
    """(row, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` are (verdict, host, path). The longest fitting rule decides (host and path together,
    then the longer host); without one, membership of no list means ``otherwise``. Null urls and those
    without ``://`` have an empty host and path and fit no rule. Repeated rows are each judged, a null id
    is kept, other columns are ignored. No rows, no rows.
    """
    pages = pages.select(F.col(row).cast("long").alias("page_id"), F.col(url).alias("url"))
    lengths = sorted({len(path) for _, _, path in rules})
    most = max((host.count(".") + 1 for _, host, _ in rules), default=0)
    lists = {v: {h + "\n" + p for w, h, p in rules if w == v} for v in ("allow", "block")}

    def keys_of(batches):
        for b in batches:
            keys = {k for u in set(b.column(0).to_pylist()) for k in url_keys(*split_url(u), lengths, most)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], names=["key"])

    universe = stored(pages.select("url").mapInArrow(keys_of, "key string").distinct(), "keys")
    size = universe.count()
    allow, block = (build_cascade(universe, size, lists[v]) for v in ("allow", "block"))

    def judge(batches):
        for b in batches:
            out = []
            for page, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host, path = split_url(u)
                rule, verdict = None, otherwise
                for key in url_keys(host, path, lengths, most):
                    if key in block or key in allow:
                        rule, verdict = key.replace("\n", "", 1), "block" if key in block else "allow"
                        break
                out.append((page, host, path, rule, verdict))
            if out:
                yield batch(_VERDICTS, *zip(*out))

    judged = pages.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("page_id", row)
