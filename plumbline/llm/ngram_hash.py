"""64-bit hashes of word n-grams of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to the n-th."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose low bits depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the word n-grams of each text.

    Words are runs of other bytes than space and 0x09 to 0x0D; A-Z count as a-z. A text with 1 to
    n - 1 words has one n-gram, all its words; one without words has none.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _power_tables(len(data) + 1)
    value = _BYTE[data] * power[: len(data)]
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    word = mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64) * _PLACE[63])
    del value, run, space
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)]) + 1
    first = np.searchsorted(start, bounds)
    if len(word) >= n:
        grams = word[: len(word) - n + 1] * _PLACE[0]
        for k in range(1, n):
            grams = grams + word[k : len(word) - n + 1 + k] * _PLACE[k]
        grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = (word[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _PLACE[60 + b - a - n : 61 + b - a - n]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
