"""Sets of 5-word shingles of whole texts, as 64-bit hashes (numpy, one text at a time)."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)
#: One odd factor for each place in a shingle, and one for shorter texts.
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                                 0x85EBCA77C2B2AE63)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # bytes: A-Z only
    inside = ~_SPACE[data]
    if not inside.any():
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    # place of each byte in its word, over the bytes of words only
    flat = data[inside]
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(flat)) - np.repeat(begin, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    return mix(np.add.reduceat(_BYTE[flat] * power[place], begin) + lengths.astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of a shorter text its whole sequence; empty without words."""
    w = word_hashes(text or "")
    n = len(w)
    if not n:
        return w
    if n < WORDS:
        total = np.uint64(n)
        for k in range(n):
            total = total + w[k: k + 1] * _PLACE[k] * _STEP
        return mix(total)
    total = w[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        total += w[k: n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(mix(total))
