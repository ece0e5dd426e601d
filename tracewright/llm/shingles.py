"""Hashing the word shingles of whole texts with numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    """A random word for each byte value at each of 64 places in a word."""
    if seed not in _TABLES:
        _TABLES[seed] = mix(np.arange(64 * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1)).reshape(64, 256)
    return _TABLES[seed]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) of all texts, and the
    bounds of each text's words."""
    raw = [(t or "").encode().lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, space[:-1]
    start = np.flatnonzero(~space & before)
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    if not len(start):
        return np.zeros(0, np.uint64), bounds
    stop = np.flatnonzero(space & ~before)
    length = stop - start
    inside = data[~space]
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    codes = _table(seed)[place & 63, inside]
    if length.max() > 64:
        codes = codes * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return mix(np.add.reduceat(codes, np.cumsum(length) - length) + length.astype(np.uint64)), bounds


def shingle_sets(texts: list[str | None], seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle make one."""
    words, bounds = word_hashes(texts, seed)
    n = len(words) - SHINGLE + 1
    if n > 0:
        joined = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            joined = joined * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        joined = mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            x = np.sort(joined[a : b - SHINGLE + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix(np.array([h]) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
