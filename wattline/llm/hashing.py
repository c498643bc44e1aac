"""Hashes of words and word runs, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def _mixed(i: int) -> int:
    """A fixed 64-bit number for ``i`` (the finish of a well-known mixing function)."""
    z = (i + 0x9E3779B97F4A7C15 * (i + 1)) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def seeds(count: int) -> np.ndarray:
    """Fixed 64-bit numbers to tell hash functions apart."""
    return np.array([_mixed(1000 + i) for i in range(count)], np.uint64)


def byte_values(lower: bool) -> np.ndarray:
    """A number per byte; 0 for white space (space and bytes 9 to 13).

    With ``lower``, A to Z count as a to z.
    """
    values = np.array([_mixed(i) | 1 for i in range(256)], np.uint64)
    if lower:
        values[65:91] = values[97:123]
    values[[32, 9, 10, 11, 12, 13]] = 0
    return values


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes], values: np.ndarray):
    """Hash, text number and byte span of every word of some texts.

    Spans count from the start of the texts joined with one byte between them; ``starts``
    holds where each text begins there.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths) - lengths
    codes = values[joined]
    inside = codes != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, begin, end, starts
    # Powers by place in the joined text would run over; count them from each word's start.
    longest = int((end - begin).max())
    powers = np.cumprod(np.full(longest, 0xD1342543DE82EF95, np.uint64))
    at = np.flatnonzero(inside)
    place = at - np.repeat(begin, end - begin)
    terms = codes[at] * powers[place]
    first = np.cumsum(end - begin) - (end - begin)
    hashes = mix(np.add.reduceat(terms, first) + (end - begin).astype(np.uint64))
    owner = np.searchsorted(starts, begin, "right") - 1
    return hashes, owner, begin, end, starts


def run_hashes(hashes: np.ndarray, owner: np.ndarray, width: int):
    """Hash and text number of every run of ``width`` words within one text."""
    if len(hashes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = mix(total + hashes[i : i + n] + np.uint64(2 * i + 1))
    whole = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return total[whole], owner[whole], whole
