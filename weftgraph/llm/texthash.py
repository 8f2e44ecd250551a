"""Vectorised word and shingle hashes of one text (64 bits, same on every worker).

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Its hash is
a polynomial over a fixed random byte table, read off prefix sums modulo 2**64;
shingle hashes mix the word hashes of a window. Two different windows of a
corpus share a hash with probability about 2**-64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240607)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[65:91] = TABLE[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: Bytes of text that are hashed at once; the arrays take about 50 bytes for each.
STRETCH = 1 << 17
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int):
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 14)
            up, down = np.full(m, BASE, dtype=np.uint64), np.full(m, BASE_INV, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    """The hashes of a text's words, in order. Long texts go in stretches that end
    between words; a word's hash does not depend on its place."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if len(b) <= STRETCH:
        return _word_hashes(b, lower)
    parts, at = [], 0
    while at < len(b):
        end = at + STRETCH
        while end < len(b) and not (spaces := IS_SPACE[b[end : end + 4096]]).any():
            end += 4096
        if end < len(b):
            end += int(spaces.argmax())
        parts.append(_word_hashes(b[at:end], lower))
        at = end
    return np.concatenate(parts)


def _word_hashes(b: np.ndarray, lower: bool) -> np.ndarray:
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    inside = ~IS_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _POWERS.of(len(b))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((LOWER_TABLE if lower else TABLE)[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words, in order; none if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = words[:m] * GRAM[0]
    for j in range(1, n):
        acc = acc + words[j : j + m] * GRAM[j]
    return mix(acc)


def shingle_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of lower-cased (A-Z) text;
    a text of fewer words has one shingle, its whole sequence; none without words."""
    words = word_hashes(raw, lower=True)
    if not len(words):
        return words
    return np.unique(windows(words, min(n, len(words))) ^ _U(0 if len(words) >= n else len(words)))
