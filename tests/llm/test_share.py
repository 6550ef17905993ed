"""Which postings of the n-gram join are kept for meetings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from mensura.llm import jaccard

NUM, DEN = 85, 100


def _kept(postings, step):
    """Kept (gram, salt, key, pkey) of the postings (gram, salt, salts, key, n, pos), given in batches of ``step`` rows."""
    rows = sorted(postings, key=lambda r: (r[0], r[1], r[3]))
    batches = [jaccard.batch(jaccard._POSTINGS, *zip(*rows[i : i + step])) for i in range(0, len(rows), step)]
    out = pa.Table.from_batches(jaccard._share(NUM, DEN)(iter(batches)), jaccard._SHARED)
    return [(r["gram"], r["salt"], r["key"], r["pkey"]) for r in out.to_pylist()]


def _can_link(x, y):
    (_, _, _, kx, nx, px), (_, _, _, ky, ny, py) = x, y
    most = min(px, py) + 1 + min(nx - px - 1, ny - py - 1)
    n, pos = min((nx, kx, px), (ny, ky, py))[::2]
    least = -(-2 * NUM * n // (NUM + DEN))  # common n-grams that a link of the smaller set needs at least
    return DEN * min(nx, ny) >= NUM * max(nx, ny) and (DEN + NUM) * most >= NUM * (nx + ny) and pos <= n - least


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_only_postings_with_a_possible_partner_are_kept(step):
    rng = np.random.default_rng(5)
    postings = {}
    for _ in range(600):
        n = int(rng.integers(1, 60))
        key = int(rng.integers(-(1 << 40), 1 << 40))
        postings[int(rng.integers(0, 200)), key] = n, int(rng.integers(0, n - -(-NUM * n // DEN) + 1))
    rows = [(gram, 0, 1, key, n, pos) for (gram, key), (n, pos) in postings.items()]
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    wanted = []
    for gram, group in sorted(groups.items()):
        group.sort(key=lambda r: r[3])
        assert len(group) <= jaccard.BESIDE + 1
        stay = [x[3] for x in group if any(_can_link(x, y) for y in group if y is not x)]
        wanted += [(gram, 0, k, stay[0]) for k in stay]
    twice = rows + rows[::3]
    assert _kept(twice, step) == wanted
    assert 0 < len(wanted) < len(rows) / 2


def test_large_and_salted_groups_keep_all():
    large = [(1, 0, 1, k, 10 ** (1 + k % 5), 0) for k in range(jaccard.BESIDE + 2)]
    salted = [(2, k % 2, 2, k, 10 ** (k + 1), 0) for k in range(3)]
    alone = [(3, 0, 1, 7, 10, 0), (3, 0, 1, 7, 10, 0)]
    assert _kept(large + salted + alone, 4) == [(1, 0, k, 0) for k in range(jaccard.BESIDE + 2)] + [(2, 0, 0, 0), (2, 0, 2, 0), (2, 1, 1, 1)]
