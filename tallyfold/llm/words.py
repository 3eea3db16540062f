"""Words of whole batches of text, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: A-Z become a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: 0-9, letters, and all of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

MUL = np.uint64(0x9E3779B97F4A7C15)
LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bounds(data: np.ndarray, off: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the place of its first word among them (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = word[data]
    first = np.empty(len(data) + 1, bool)
    first[0], first[-1] = True, True
    np.logical_not(inside[:-1], out=first[1:-1])
    last = np.empty(len(data) + 1, bool)
    last[0], last[-1] = True, True
    np.logical_not(inside[1:], out=last[1:-1])
    first[off] = True  # a word never goes on in the next text
    last[off] = True
    starts = np.flatnonzero(inside & first[:-1])
    ends = np.flatnonzero(inside & last[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. data is lower-cased already where case doesn't count."""
    import xxhash

    size = ends - starts
    out = size.astype(np.uint64)
    at = np.arange(len(starts)) if (size <= LONG).all() else np.flatnonzero(size <= LONG)
    j = 0
    while len(at):
        out[at] = (out[at] ^ data[starts[at] + j]) * MUL
        out[at] ^= out[at] >> np.uint64(29)
        j += 1
        at = at[size[at] > j]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return mix(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, at the place of the first."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = (out * MUL) ^ h[j : len(h) - n + 1 + j]
        out ^= out >> np.uint64(31)
    return mix(out)
