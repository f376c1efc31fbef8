"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

SIZE = 5
#: Bytes of text hashed at once, unless one text alone has more.
PART_BYTES = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20231))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Random odd values of the bytes; a blank counts nothing.
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_BLANK] = 0
_PLACE = _RANDOM.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What a shingle of so many words starts from.
_COUNT = np.arange(SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: A byte's value counts times a power of the base by its place in the part; the
#: inverse base's power at a word's start makes that its place in the word.
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least the first ``n`` powers of an odd base modulo 2**64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, PART_BYTES + (1 << 16)), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes. ASCII letters are
    lowered; words are runs of non-blank bytes; a text with fewer than ``SIZE``
    words has its whole sequence as one shingle, one without words has none."""
    size = SIZE
    raw = [(t or "").encode().lower() for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    text_end = np.cumsum([len(r) + 1 for r in raw])
    blank = _BLANK[joined]
    starts = ~blank
    starts[1:] &= blank[:-1]
    first = np.flatnonzero(starts)
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in texts]
    size_all = len(joined)
    sums = np.add.reduceat(_BYTE[joined] * _powers(_BASE, size_all)[:size_all], first)
    words = mix(sums * _powers(pow(_BASE, -1, 1 << 64), size_all)[first])
    upto = np.searchsorted(first, text_end)
    out, at = [], 0
    span = len(words) - size + 1
    if span > 0:
        rolled = np.full(span, _COUNT[size])
        for j in range(size):
            rolled += words[j : j + span] * _PLACE[j]
        rolled = mix(rolled)
    for end in upto.tolist():
        n = end - at
        if n >= size:
            own = np.sort(rolled[at : end - size + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif n:
            own = _COUNT[n : n + 1] + (words[at:end] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(own))
        else:
            out.append(np.zeros(0, np.uint64))
        at = end
    return out


def parts(texts: Iterable[str | None], limit: int = PART_BYTES) -> Iterator[list]:
    part, size = [], 0
    for t in texts:
        n = len(t or "")
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """A 128-bit digest of a set; None for the empty set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None
