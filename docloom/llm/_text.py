"""Vectorised text primitives on UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: The bytes between words: a space and the controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any bits of the result may be used."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with which ``span_hash`` gives the hash of any slice of ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    scaled = data.astype(np.uint64)
    scaled += np.uint64(1)
    scaled *= powers(len(data))[0][: len(data)]
    np.cumsum(scaled, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not white space."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(IS_SPACE[data], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends = word_spans(data)
    return span_hash(prefix_hash(data), starts, ends)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; none where there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * np.uint64(pow(_BASE, 2 * k + 1, 1 << 64))
    return mix(total)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word runs, A-Z lowered.

    A text of fewer words counts as one run; one without words has an empty set.
    """
    words = word_hashes(text, lower=True)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(width, len(words))) ^ np.uint64(0 if len(words) >= width else len(words)))
