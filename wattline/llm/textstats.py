"""Character, word and line statistics of many texts at once in numpy."""

from __future__ import annotations

import numpy as np

from wattline.llm.hashing import mix

LETTER, UPPER, DIGIT, SPACE, MARK, SIGN = 1, 2, 4, 8, 16, 32
# Code points with an entry of their own; all others count as letters.
KNOWN = 0x530
# Ordinary punctuation, which is no sign of trouble.
MARKS = ".,;:'’-\"()?!"


def _tables():
    kind = np.full(KNOWN + 1, LETTER, np.uint8)
    lower = np.arange(KNOWN + 1, dtype=np.uint32)
    for i in range(KNOWN):
        c = chr(i)
        kind[i] = (
            SPACE if c.isspace()
            else DIGIT if c.isdigit()
            else LETTER | (UPPER if c.isupper() else 0) if c.isalpha()
            else MARK if c in MARKS
            else SIGN
        )
        if len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    return kind, lower


class Texts:
    """Some texts as one array of code points, with a line end after each text."""

    def __init__(self, texts: list[str]):
        kind, lower = _tables()
        joined = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(self.codes, KNOWN)
        self.kind = kind[at]
        self.lower = np.where(at < KNOWN, lower[at], self.codes)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.cumsum(lengths) - lengths
        self.n = len(texts)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Text number of places in the joined array."""
        return np.searchsorted(self.starts, at, "right") - 1

    def runs(self, inside: np.ndarray):
        """Begin and end of each stretch where ``inside`` holds (never across texts)."""
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        return edge[0::2], edge[1::2]


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [begin, end), which may be empty."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[end] - total[begin]


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``codes`` over each [begin, end) with no empty span."""
    if not len(begin):
        return np.empty(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), 0xD1342543DE82EF95, np.uint64))
    terms = mix(codes[place + np.repeat(begin, size)].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(terms, first) + size.astype(np.uint64))
