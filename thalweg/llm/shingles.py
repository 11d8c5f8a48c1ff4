"""Word shingles of whole texts as sets of 64-bit numbers, by numpy over many texts at once."""

from __future__ import annotations

import numpy as np

from .common import HELD, mix64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Space and the controls 9 to 13 part words; every other byte belongs to one.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Fixed odd multiplier of the polynomial hash, and its inverse modulo 2^64.
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = _POWERS[base] = _powers(base, max(n, 1 << 16))
        HELD["shingles"] = _POWERS.clear
    return got[:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order; A-Z count as a-z."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    return _hash_bytes(raw)


def _hash_bytes(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = len(raw)
    with np.errstate(over="ignore"):
        run = np.empty(n + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[raw] * _power_table(_R, n), out=run[1:])
        value = (run[ends] - run[starts]) * _power_table(_R_INV, n)[starts]
        return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text, as sorted 64-bit hashes.

    A text of fewer words is one shingle as a whole; a text without words has none.
    """
    return _shingles(word_hashes(text), k)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    if not len(words):
        return words
    k_here = min(k, len(words))
    n = len(words) - k_here + 1
    with np.errstate(over="ignore"):
        out = np.full(n, k_here, dtype=np.uint64)
        for j in range(k_here):
            out = mix64(out * np.uint64(_R) + words[j : j + n])
    return np.unique(out)


#: Bytes hashed at once.
CHUNK = 1 << 20


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """shingle_set() of each text, many hashed together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(texts)
    at, size, raws = [], 0, []

    def flush() -> None:
        nonlocal at, size, raws
        if not at:
            return
        raw = np.frombuffer(b" ".join(raws).translate(_LOWER), dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raws])
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        owner = np.searchsorted(ends, edge[::2], side="right")
        words = _hash_bytes(raw)
        cut = np.searchsorted(owner, np.arange(len(at) + 1))
        for i, lo, hi in zip(at, cut[:-1], cut[1:]):
            out[i] = _shingles(words[lo:hi], k)
        at, size, raws = [], 0, []

    for i, t in enumerate(texts):
        if not t:
            continue
        raw = t.encode("utf-8", "surrogatepass")
        at.append(i)
        raws.append(raw)
        size += len(raw)
        if size >= CHUNK:
            flush()
    flush()
    return out
