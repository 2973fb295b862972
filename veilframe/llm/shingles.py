"""Word shingles of texts as sorted sets of 64-bit hashes, and their minimum hashes.

A word is a run of characters other than the six white-space characters; a shingle is
``k`` words in a row, or all words of a text that has fewer.  All texts of a batch are
hashed at once in flat numpy arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

K = 5
#: Minimum hashes per text.
HASHES = 128

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_draw = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _draw.integers(0, 1 << 64, 256, np.uint64)
_ODD = _draw.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_A = _draw.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_B = _draw.integers(0, 1 << 32, HASHES, np.uint32)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser (the one of splitmix64), element by element."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and where each text begins (and the
    end)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    word = ~_IS_SPACE[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = (total[ends] - total[starts]) * down[starts]
    hashes = mix(value ^ mix((ends - starts).astype(np.uint64)))
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: Sequence[str], k: int = K) -> list[np.ndarray]:
    """The set of shingles of each text, ascending; empty for a text without words."""
    words, bounds = word_hashes(texts)
    n = len(words)
    rows = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        rows += words[i : n - k + 1 + i] * _ODD[i]
    rows = mix(rows)
    found = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= k:
            found.append(np.unique(rows[begin : end - k + 1]))
        elif end > begin:
            some = words[begin:end] * _ODD[: end - begin]
            found.append(mix(some.sum(dtype=np.uint64, keepdims=True) + np.uint64(end - begin)))
        else:
            found.append(rows[:0])
    return found


def set_ids(sets: Sequence[np.ndarray]) -> list[bytes]:
    """16 bytes that tell sets apart (equal for equal sets)."""
    found = []
    for s in sets:
        one, two = mix(s).sum(dtype=np.uint64), mix(s ^ _ODD[60]).sum(dtype=np.uint64)
        found.append(one.tobytes() + (two + np.uint64(len(s))).tobytes())
    return found


def minimum_hashes(sets: Sequence[np.ndarray]) -> np.ndarray:
    """HASHES minimum hashes (unsigned 32-bit) per set; an empty set has the largest."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        some, size = [], 0
        while at < len(full) and (not some or size + len(sets[full[at]]) <= 1 << 15):
            some.append(full[at])
            size += len(sets[full[at]])
            at += 1
        low = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(sets[i]) for i in some])[:-1]
        block = np.empty((len(some), HASHES), np.uint32)
        held = np.empty_like(low)
        for j in range(HASHES):
            np.multiply(low, _A[j], out=held)
            np.add(held, _B[j], out=held)
            block[:, j] = np.minimum.reduceat(held, starts)
        out[some] = block
    return out
