"""Periodic runs of words in texts.

A run is a stretch of words with smallest period q (words q apart are identical) and at
least ``max(least, 2 * q)`` words that keeps its period in no longer stretch.  Every run is
found, in each text as a whole:

1. Stretches that cannot touch a run are set aside.  A run of at least 12 words holds a window of
   6 words that occurs again q words later, so only places between a window's occurrence and
   the end of its next one are kept.  Nothing that a run covers is lost.
2. Baier's grouping, the first phase of a suffix sorter, runs over what is left: suffixes
   are grouped by their first word, groups are taken from the highest down, and each group
   moves the suffixes just before its members into new groups, whose contexts grow by the
   group's own.  When a group is taken its context is the longest Lyndon word beginning at its members: the
   phase leaves the Lyndon array.  It runs under the order of the words and under the
   reverse order.
3. Every run holds a root that is the longest Lyndon word at its place under one of the two
   orders.  Each Lyndon word of the two arrays is extended to both sides as far as words
   repeat with its length as period.  The extensions come from names of all
   stretches of 1, 2, 4, ... words, which are exact (no fingerprints).

The work is linear but for the names, which need the logarithm of the longest stretch that is
left.  Texts are processed where they lie; nothing is shuffled.  A text of n words needs up
to about ``4 * n * log2(n)`` bytes for names and some hundred bytes a word for the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import chunks

# Words that a run has at least.
LEAST = 12
# Characters of texts that a task processes at once (single texts may be longer).
CHARS = 1_000_000
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

_BASE = np.uint64(0xD1342543DE82EF95)


def repeating_places(ids: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Whether each place lies between a window of words and the end of its next occurrence.

    Windows are compared by a hash: an accident only keeps more places.
    """
    n = len(ids) - window + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = keys * _BASE + ids[k : k + n].astype(np.uint64)
    whole = np.flatnonzero(owner[:n] == owner[window - 1 :])
    keys = (keys[whole] ^ (keys[whole] >> np.uint64(29))) * _BASE + owner[whole].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    begin, end = whole[order[:-1][same]], whole[order[1:][same]] + window
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) > 0


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, by Baier's grouping.

    ``ranks`` are from 0 without gaps; 0 ends a stretch and stands first and last.
    """
    place = ranks.tolist()
    order = np.argsort(ranks, kind="stable")
    sizes = np.bincount(ranks)
    members: list = [part.tolist() for part in np.split(order, np.cumsum(sizes)[:-1])]
    groups = len(members)
    length = [1] * groups
    # Neighbours of each group; nothing is above the highest one.
    up, down = [*range(1, groups), None], list(range(-1, groups - 1))
    taken = bytearray(len(place))
    before = [0] * len(place)
    out = [1] * len(place)
    g = groups - 1
    while g:
        here = [i for i in members[g] if place[i] == g]
        members[g] = None
        for i in here:
            taken[i] = 1
        step = length[g]
        counts: dict[int, int] = {}
        for i in here:
            out[i] = step
            j = i - 1
            while taken[j]:
                j = before[j]
            before[i] = j
            if place[j]:
                counts[j] = counts.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, copies in counts.items():
            moved.setdefault((copies, place[j]), []).append(j)
        # The more copies follow, the higher: later ones come right above the old group.
        for copies, old in sorted(moved, reverse=True):
            new = len(length)
            above = up[old]
            length.append(length[old] + copies * step)
            members.append(moved[copies, old])
            up.append(above)
            down.append(old)
            up[old] = new
            if above is not None:
                down[above] = new
            for j in moved[copies, old]:
                place[j] = new
        g = down[g]
    return np.array(out, np.int64)


def names_of(ranks: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ...: a number per stretch of 2^k words; equal numbers, equal words.

    A stretch that holds an end (rank 0) equals no other.
    """
    n = len(ranks)
    first = ranks.astype(np.int64)
    ends = np.flatnonzero(first == 0)
    first[ends] = first.max() + 1 + np.arange(len(ends))
    out = [first.astype(np.int32)]
    width = 1
    while 2 * width <= longest:
        a = out[-1]
        keys = a[: n - 2 * width + 1].astype(np.int64) << 32 | a[width : n - width + 1]
        out.append(np.unique(keys, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return out


def matches_right(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree from places ``i`` and ``j`` (greater) on."""
    begin, i, j = i, i.copy(), j.copy()
    for k in reversed(range(len(names))):
        a, last = names[k], len(names[k]) - 1
        ok = (j <= last) & (a[np.minimum(i, last)] == a[np.minimum(j, last)])
        i += ok.astype(np.int64) << k
        j += ok.astype(np.int64) << k
    return i - begin


def matches_left(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree before places ``i`` and ``j`` (greater)."""
    begin, i, j = i, i.copy(), j.copy()
    for k in reversed(range(len(names))):
        a, width = names[k], 1 << k
        ok = (i >= width) & (a[np.maximum(i - width, 0)] == a[np.maximum(j - width, 0)])
        i -= ok.astype(np.int64) << k
        j -= ok.astype(np.int64) << k
    return begin - i


def runs_of(ranks: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of stretches that rank 0 separates."""
    ends = np.flatnonzero(ranks == 0)
    longest = int(np.diff(ends).max(initial=1)) - 1
    if longest < least:
        return np.empty((0, 3), np.int64)
    names = names_of(ranks, longest)
    top = int(ranks.max())
    reverse = np.where(ranks > 0, top + 1 - ranks, 0)
    found = []
    for lengths in (lyndon_lengths(ranks), lyndon_lengths(reverse)):
        begin = np.flatnonzero(ranks > 0)
        root = lengths[begin]
        left = matches_left(names, begin, begin + root)
        right = matches_right(names, begin, begin + root)
        size = left + root + right
        ok = size >= np.maximum(least, 2 * root)
        found.append(np.stack([(begin - left)[ok], size[ok], root[ok]], 1))
    return np.unique(np.concatenate(found), axis=0)


def runs_of_sequences(ids: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Runs of several sequences of numbers, each as rows (start, length, period)."""
    lengths = np.array([len(x) for x in ids], np.int64)
    owner = np.repeat(np.arange(len(ids)), lengths)
    joined = np.concatenate(ids) if len(ids) else np.empty(0, np.int64)
    keep = repeating_places(joined, owner, least // 2)
    places = np.flatnonzero(keep)
    if not len(places):
        return [np.empty((0, 3), np.int64)] * len(ids)
    # An end goes before every stretch, and one after the last.
    fresh = np.ones(len(places), bool)
    fresh[1:] = (np.diff(places) > 1) | (owner[places[1:]] != owner[places[:-1]])
    target = np.arange(len(places)) + np.cumsum(fresh)
    ranks = np.zeros(len(places) + int(fresh.sum()) + 1, np.int64)
    ranks[target] = np.unique(joined[places], return_inverse=True)[1] + 1
    runs = runs_of(ranks, least)
    # Back to places in the joined sequences, then in each of them.
    origin = np.zeros(len(ranks), np.int64)
    origin[target] = places
    at = origin[runs[:, 0]]
    whose = owner[at]
    starts = np.cumsum(lengths) - lengths
    rows = np.stack([at - starts[whose], runs[:, 1], runs[:, 2]], 1)
    order = np.lexsort((rows[:, 2], rows[:, 0], whose))
    cuts = np.searchsorted(whose[order], np.arange(1, len(ids)))
    return np.split(rows[order], cuts)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of words that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(edges[:-1]) == 0)


def periodic_runs(
    docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None, least: int = LEAST
) -> DataFrame:
    """One row per document: doc_id, ``runs`` by start and period, and ``collapsed``.

    Words are maximal sequences without space and bytes 9 to 13.  ``collapsed`` is the text's words without those
    that a run repeats, joined by one space.  ``rewrite(doc_id, n)`` may give places of the
    n words that take the place of the original sequence.

    Null and empty texts and texts without words have no runs and an empty ``collapsed``.
    Repeated rows give equal rows; other columns are not read; an empty table gives no rows.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"].tolist()]
            doc_ids = [None if pd.isna(i) else int(i) for i in frame["doc_id"].tolist()]
            for part in chunks(texts, CHARS):
                known: dict[bytes, int] = {}
                words, ids = [], []
                for k in part:
                    own = texts[k].encode("utf-8", "surrogatepass").split()
                    order = rewrite(doc_ids[k], len(own)) if rewrite else None
                    if order is not None:
                        own = [own[i] for i in order.tolist()]
                    words.append(own)
                    ids.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
                rows = []
                for k, own, runs in zip(part, words, runs_of_sequences(ids, least)):
                    if len(runs):
                        own = [own[i] for i in kept_words(len(own), runs).tolist()]
                    rows.append(
                        (
                            doc_ids[k],
                            [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()],
                            b" ".join(own).decode("utf-8", "surrogatepass"),
                        )
                    )
                out = pd.DataFrame(rows, columns=["doc_id", "runs", "collapsed"])
                yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(batches, SCHEMA)


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word places of a text whose end repeats, for one document in ten.

    With h = crc32 of the decimal id and g = h // 10: where h % 10 is 0, words from
    a = g % n on repeat the first p = 1 + (n - a) // (3 + g % 8) of them.
    """
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the greatest run (ties: smallest start, then period) and digests of ``periodic_runs``."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    ranked = F.transform(
        "runs",
        lambda r: F.struct(
            r["length"].alias("size"), (-r["start"]).alias("early"), (-r["period"]).alias("short"), r.alias("run")
        ),
    )
    run = F.col("best")
    return found.withColumn("best", F.array_max(ranked)["run"]).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        run["start"].alias("start"),
        run["length"].alias("length"),
        run["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
