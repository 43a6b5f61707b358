"""Vectorised polynomial (Rabin-Karp) hashes of words, word windows and byte windows.

All arithmetic is modulo 2**64 on numpy arrays. A prefix sum of `byte * P**i` gives the hash of any
slice as a difference times `P**-start`; a final mixing step spreads the bits, so that the high bits
of a hash can serve as its bucket.
"""

from __future__ import annotations

import numpy as np

P = 0x9E3779B97F4A7C15 | 1
Q = 0xD1342543DE82EF95 | 1
#: Bytes hashed at a time; bounds the temporaries to some ten times as much.
SLICE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int = P) -> tuple[np.ndarray, np.ndarray]:
    """Powers of `base` and of its inverse, at least n of each."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 4096)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        have = (tables[0], tables[1])
        if size <= 4 * SLICE:
            _tables[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each text, and the place where each text starts (and the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return buf, at


def _slices(buf: np.ndarray):
    """Slices of about SLICE bytes that end after a white space, so that no word is cut."""
    a, n = 0, len(buf)
    while a < n:
        b = min(n, a + SLICE)
        step = 4096
        while b < n and not SPACE[buf[b - 1]]:
            found = np.flatnonzero(SPACE[buf[b : b + step]])
            b = b + int(found[0]) + 1 if len(found) else min(n, b + step)
            step *= 2
        yield a, b
        a = b


def words(texts: list[bytes], fold: bool = False, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word `[^\\x20\\x09-\\x0D]+` of all texts, and for each text (and the end) the place of its first word.

    fold: lower-case A-Z first. gaps: the bytes that part words; white space must be among them.
    """
    buf, at = join(texts)
    hashes, starts = [], []
    for a, b in _slices(buf):
        part = buf[a:b]
        gap = gaps[part]
        if fold:
            part = LOWER[part]
        edge = np.diff(gap.view(np.int8), prepend=1, append=1)
        first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(first):
            continue
        power, inverse = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
        hashes.append(mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64)))
        starts.append(first + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def windows(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every window of k consecutive words of one text, and the place of its first word."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w[:n].copy()
    for j in range(1, k):
        h *= np.uint64(Q)
        h += w[j : j + n]
    ends = np.repeat(first[1:], np.diff(first))[:n]
    keep = np.flatnonzero(np.arange(n) + k <= ends)
    return mix(h[keep]), keep


def at(buf: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The hash of the `length` bytes from each of the sorted places."""
    out = np.zeros(len(places), np.uint64)
    step = max(SLICE, length)
    for a in range(0, len(buf), step):
        i, j = np.searchsorted(places, [a, a + step])
        if i == j:
            continue
        part = buf[a : a + step + length - 1]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        p = places[i:j] - a
        out[i:j] = mix((sums[p + length] - sums[p]) * inverse[p])
    return out


def grams(buf: np.ndarray, length: int) -> np.ndarray:
    """The upper half of the hash of the `length` bytes from every place."""
    out = np.zeros(max(0, len(buf) - length + 1), np.uint32)
    for a in range(0, len(out), SLICE):
        part = buf[a : a + SLICE + length - 1]
        n = len(part) - length + 1
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        out[a : a + n] = mix((sums[length:] - sums[:n]) * inverse[:n]) >> np.uint64(32)
    return out
