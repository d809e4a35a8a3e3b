"""Vectorised word and shingle hashes over batches of texts (numpy, used inside Spark tasks).

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A word's hash
is a polynomial over random byte codes, taken from one prefix sum over the whole batch, then mixed
with the word's length.  Hashes have 64 bits: two different values among m collide with
probability of about m*m / 2**65.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODES = _CODES[_LOWER]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): text i has the words offsets[i]:offsets[i+1]."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    inside = _IS_WORD[raw]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * power[: len(raw)], out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends_of_text)])


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole word
    sequence as its one shingle, a text without words has none."""
    words, offsets = word_hashes(texts)
    n = len(words)
    rolled = np.full(max(0, n - width + 1), width, np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0x2545F4914F6CDD1D) + words[k : k + len(rolled)])
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def batches_of_bytes(texts: list[bytes], most: int = 1 << 18):
    """Slices of the list whose texts have about ``most`` bytes together (one text at least)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
