"""Hashed word shingles of whole texts, computed for many documents at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

#: Documents are cut into runs of about so many bytes and documents; one longer document is a run of its own.
RUN_BYTES, RUN_DOCS = 1 << 19, 512

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for slot, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and, per document, how many words it has. Words never cross documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of documents as (index of the first, hashes, bounds): document ``i`` of a run has the
    ascending distinct shingle hashes ``hashes[bounds[i]:bounds[i + 1]]``.

    A-Z are lower-cased. A text of fewer than ``width`` words has one shingle, its whole word
    sequence; a text without words has none.
    """
    at, docs = 0, len(offsets) - 1
    while at < docs:
        to = int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1
        to = min(max(to, at + 1), docs, at + RUN_DOCS)
        low = offsets[at]
        hashes, bounds = _run(data[low : offsets[to]], offsets[at : to + 1] - low, width)
        yield at, hashes, bounds
        at = to


def _run(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = _word_hashes(data, offsets)
    docs = len(counts)
    word_ends = np.cumsum(counts)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        odd = [np.uint64(pow(_BASE, 3 * j + 2, 1 << 64)) for j in range(width)]
        full = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for j in range(width):
            full += hashes[j : j + len(full)] * odd[j]
        out = np.empty(bounds[-1], np.uint64)
        # The position of each shingle's first word: document start plus place in the document.
        first_words = np.repeat(word_ends - counts - bounds[:-1], sizes) + np.arange(bounds[-1])
        whole = np.repeat(counts >= width, sizes)
        out[whole] = full[first_words[whole]]
        for d in np.flatnonzero((counts > 0) & (counts < width)):
            own = hashes[word_ends[d] - counts[d] : word_ends[d]]
            out[bounds[d]] = np.uint64(len(own)) + (own * np.array(odd[: len(own)])).sum(dtype=np.uint64)
    out = mix64(out)
    for d in range(docs):
        out[bounds[d] : bounds[d + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[bounds]


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, equal for equal sets; 0 for the empty set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        sizes = np.diff(bounds).astype(np.uint64)
        keys = mix64(sums[bounds[1:]] - sums[bounds[:-1]] + sizes * np.uint64(_BASE))
    return np.where(sizes == 0, np.uint64(0), np.where(keys == 0, np.uint64(1), keys)).view(np.int64)
