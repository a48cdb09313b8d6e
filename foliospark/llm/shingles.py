"""Sets of hashed word shingles, a batch of texts at a time.

Words are runs of other bytes than ASCII white space, A-Z lower-cased. All words
of a batch are hashed at once: byte values times powers of an odd number are
summed over the whole batch, and a word's sum is a difference of two prefixes,
moved back to power 0. A shingle combines five mixed word hashes; equal hashes of
64 bits are taken for equal shingles.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
#: Bytes hashed at a time; a longer text is hashed alone.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_rng = np.random.default_rng(5)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
for _b in range(65, 91):
    _VALUES[_b] = _VALUES[_b + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WEIGHTS = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | _U(1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled, step = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * _U(step)
        filled += take
        step = step * step & (1 << 64) - 1
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _block(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])  # position of the newline after each text
    space = _SPACE[data]
    size = 1 << max(20, (len(data) - 1).bit_length())
    powers, back = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    sums = np.cumsum(_VALUES[data] * powers[: len(data)], dtype=np.uint64)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:])
    words = _mix((sums[ends] - sums[starts - 1]) * back[starts])
    upto = np.concatenate(([0], np.searchsorted(starts, ends_of_text)))
    n = max(0, len(words) - WORDS + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(WORDS):
        whole += words[j : j + n] * _WEIGHTS[j]
    whole = _mix(whole)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= WORDS:
            s = whole[a : b - WORDS + 1].copy()
            s.sort()
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(_mix((words[a:b] * _WEIGHTS[: b - a]).sum(keepdims=True, dtype=np.uint64) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words than a
    shingle is one shingle, a text without words has none."""
    out: list[np.ndarray] = []
    waiting: list[bytes] = []
    held = 0
    for t in texts:
        if waiting and held + len(t) > BLOCK - 2 * len(waiting) - 4:
            out += _block(waiting)
            waiting, held = [], 0
        waiting.append(t)
        held += len(t)
    return out + (_block(waiting) if waiting else [])
