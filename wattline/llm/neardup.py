"""Near-duplicate groups by bottom-k sketches of one hash function.

1. A document's set holds the hashes of its distinct word runs; the ``k`` smallest are its
   sketch.  Documents with equal sets are one class from then on.
2. ``ROWS`` minima of the set under as many hash functions make a band, which two sets have in
   common with a chance of their similarity to the power of ``ROWS``.  Each band makes an
   inverted list.  There are so many that a pair at the wanted similarity has none in common
   with a chance of ``MISS``.  A run that many texts hold makes no long list by itself.
3. Each list has a hub, the member whose bands have the longest lists.  All members are
   compared with the hub: first estimated by the sketch of the union, then exactly on the
   full sets.  Members far from the hub are compared with the others of a short list in the
   same way.  Links make components.
4. Other pairs of a list matter only across components.  In lists up to ``LIST`` members
   they are compared one by one, a bounded number per member; differences from the hub are
   enough for that.  In longer ones, one of two members is outside the hub's component.  All
   such members are listed once under the first of their values, rare ones first, of which two
   linked sets share one (a prefix filter, which loses no link).  Members inside are listed
   only under values that those outside have.  Hubs whose members are all in one component need none.

A pair is dropped only if it cannot reach the similarity, if it has no band in common, or if
its sketches, smaller than the sets, fall short by more than ``SIGMAS`` standard deviations of
what the similarity gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import chunks, lean
from wattline.llm.components import components
from wattline.llm.hashing import byte_values, mix, run_hashes, seeds, word_hashes
from wattline.llm.tokens import forget
from wattline.sources.sinks import passing, remove, shared_dir, stage

K = 64
SIGMAS = 4.25
# Minima of a band, and the chance that a pair at the wanted similarity shares no band.
ROWS = 5
MISS = 1e-7
LIST = 64
# Characters that a worker holds as arrays at once; a longer text is held alone.
CHARS = 300_000
# Bytes of packed sets whose values a worker holds as arrays at once.
PACKED = 2_000_000
# Bound of the bitmaps that tell which texts to read once more: 16 MB.
MAX_BITS = 1 << 27
# Bits of each value that travel when whole sets are compared.
BITS = 40
# One set in so many is counted to learn which values are frequent.
SAMPLE = 8
# Stands for a missing id.
LAST = 2**63 - 1


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word runs of each text, as signed numbers.

    A text with fewer words than ``width`` has one run, all its words; one without words
    has none.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, owner, *_ = word_hashes(raw, byte_values(lower=True))
    runs, whose, _ = run_hashes(hashes, owner, width)
    count = np.bincount(owner, minlength=len(texts))
    for few in range(1, width):
        one, i, _ = run_hashes(hashes, owner, few)
        short = count[i] == few
        runs = np.concatenate((runs, one[short] * np.uint64(2 * few + 1)))
        whose = np.concatenate((whose, i[short]))
    runs = runs.view(np.int64)
    order = np.lexsort((runs, whose))
    runs, whose = runs[order], whose[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (whose[1:] != whose[:-1])
    runs, whose = runs[new], whose[new]
    return np.split(runs, np.searchsorted(whose, np.arange(1, len(texts))))


def bands_for(percent: int) -> int:
    """Bands of which a pair with this similarity shares one, but for a chance of ``MISS``."""
    return ceil(log(MISS) / log(1 - min(percent / 100, 0.99) ** ROWS))


def bands(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` bands of each set, each a hash of its number and of ``ROWS`` minima."""
    out = np.zeros((len(sets), count), np.int64)
    full = np.flatnonzero([len(x) for x in sets])
    if not len(full):
        return out
    values = np.concatenate([sets[i] for i in full]).view(np.uint64)
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    number = seeds(2 * ROWS * count)
    for band in range(count):
        found = np.full(len(full), band + 1, np.uint64)
        for i in range(ROWS * band, ROWS * (band + 1)):
            shuffled = (values ^ number[2 * i]) * (number[2 * i + 1] | np.uint64(1))
            found = mix(found + np.minimum.reduceat(shuffled, starts))
        out[full, band] = found.view(np.int64)
    return out


def _each(width: int):
    """Batches of (id, text) to lists of ids and sets."""

    def sets(batches: Iterator[pd.DataFrame]):
        forget()
        for pdf in batches:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for part in chunks(texts, CHARS):
                yield [ids[i] for i in part], shingle_sets([texts[i] for i in part], width)

    return sets


def sketches(docs: DataFrame, width: int, k: int, percent: int) -> DataFrame:
    """(id, n, digest, sketch, bands) per row; equal sets have equal digests."""
    sets = _each(width)

    def run(batches):
        for ids, found in sets(batches):
            yield pd.DataFrame(
                {
                    "id": ids,
                    "n": [len(s) for s in found],
                    "digest": [hashlib.md5(s.tobytes()).digest() for s in found],
                    "sketch": [s[:k] for s in found],
                    "bands": list(bands(found, count)),
                }
            )

    count = bands_for(percent)
    return docs.mapInPandas(lean(run), "id long, n long, digest binary, sketch array<long>, bands array<long>")


def packed(values: np.ndarray) -> bytes:
    """Sorted low ``BITS`` bits of the values, so much smaller than whole ones.

    Two sets are compared pair by pair: of n and m values, unequal ones agree in these bits
    with a chance of n m / 2 ** BITS, which then shifts the count by one.
    """
    low = np.unique(values & ((1 << BITS) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    short = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, : BITS // 8] = short
    return out.view("<i8").ravel()


def slot(size: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size))


def bits_of(ids: DataFrame, *keys: str, at=slot) -> tuple[int, np.ndarray]:
    """A bitmap that has every key of ``ids`` and few others: its length in bits and words.

    ``MAX_BITS`` bounds it.  A fuller one lets more strangers through, which are then read in
    vain but do no harm.
    """
    size = 1 << 16
    while size < MAX_BITS and size < 16 * ids.count():
        size *= 2
    slots = ids.select(at(size, *(keys or ("id",))).alias("at"))
    words = (
        slots.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
        .toPandas()
    )
    out = np.zeros(size >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return size, out


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def narrowed(df: DataFrame, wanted: DataFrame, *keys: str, made=None, schema: str | None = None) -> DataFrame:
    """The rows of ``df`` with keys in ``wanted``, and few others, without a shuffle.

    ``made`` turns them into rows of ``schema`` on the way, so that a task has one Python worker, not two.
    """
    size, mine = bits_of(wanted, *keys)
    made = made or (lambda pdf: pdf)

    def run(batches):
        forget()
        for pdf in batches:
            yield made(pdf[has(mine, pdf["at"].to_numpy())].drop(columns="at"))

    return df.withColumn("at", slot(size, *keys)).mapInPandas(lean(run), schema or df.schema)


def full_sets(docs: DataFrame, width: int, wanted: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, values, hub) of the documents in ``wanted`` and some others.

    The texts are read once more and stay where they are.  ``hub`` is true at least for the
    ids in ``hubs``.
    """
    size, mine = bits_of(wanted)
    hub_size, of_hubs = bits_of(hubs)
    sets = _each(width)

    def run(batches):
        def chosen():
            for pdf in batches:
                yield pdf[has(mine, pdf["at"].to_numpy())]

        hub_of = {}
        for pdf in chosen():
            hub_of = dict(zip(pdf["id"].tolist(), has(of_hubs, pdf["hub_at"].to_numpy()).tolist()))
            for ids, found in sets([pdf]):
                yield pd.DataFrame({"id": ids, "values": [packed(s) for s in found], "hub": [hub_of[i] for i in ids]})

    rows = docs.select("id", "text", slot(size, "id").alias("at"), slot(hub_size, "id").alias("hub_at"))
    return rows.mapInPandas(lean(run), "id long, values binary, hub boolean")


def listed(classes: DataFrame) -> DataFrame:
    """Inverted lists: (value, id, n, own) per band that several classes have.

    ``own`` is smallest for the class whose lists have the most members.
    """
    values = classes.select("id", "n", F.explode("bands").alias("value"))
    shared = stage(values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    mine = stage(values.join(shared, "value"))
    own = mine.groupBy("id").agg((-F.sum("df")).alias("own"))
    return mine.join(own, "id").select("value", "id", "n", "own")


def alike(pairs: DataFrame, sketches: DataFrame, percent: int, k: int) -> DataFrame:
    """``pairs`` (a, b) whose sketches allow the similarity: the union's sketch estimates it.

    ``sketches``: id, sketch; only those of the pairs are dealt, with whole values, whose
    low bits alone would be in another order.
    """
    t = percent / 100
    floor = t - SIGMAS * (t * (1 - t) / k) ** 0.5

    def small_of(pdf):
        return pd.DataFrame({"id": pdf["id"], "small": [np.asarray(x, "<i8").tobytes() for x in pdf["sketch"]]})

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["small_a"], pdf["small_b"], strict=True):
                # In the order by which sketches were chosen, so the first k are the union's sketch.
                both = np.concatenate((np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")))
                both.sort()
                again = both[1:] == both[:-1]  # in both sketches, so twice
                union = np.delete(both, np.flatnonzero(again))[:k]
                shared = both[1:][again]
                inside = np.searchsorted(shared, union[-1], "right") if len(union) else 0
                keep.append(len(union) > 0 and inside / len(union) >= floor)
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    small = stage(narrowed(sketches.select("id", "sketch"), ends, "id", made=small_of, schema="id long, small binary"))
    end = lambda x: small.select(F.col("id").alias(x), F.col("small").alias(f"small_{x}"))
    return pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b").mapInPandas(lean(run), "a long, b long")


def _judge_stars(percent: int):
    """Compare members with their hub exactly."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            linked, apart = [], []
            for x, y, both in zip(pdf["values"], pdf["hub_values"], pdf["n"] + pdf["hub_n"], strict=True):
                x, y = unpacked(x), unpacked(y)
                differ = np.setxor1d(x, y, assume_unique=True)
                linked.append(bool(close(len(differ), both, percent)))
                apart.append(differ)
            yield pdf[["hub", "hub_n", "id", "n", "long"]].assign(
                linked=linked,
                n_apart=[len(d) for d in apart],
                apart=[packed(d) if several else None for d, several in zip(apart, pdf["several"], strict=True)],
            )

    return run


def close(apart, both, percent: int):
    """Whether two sets that differ in ``apart`` values and have ``both`` are linked."""
    return (100 + percent) * apart <= (100 - percent) * both


STAR = "hub long, hub_n int, id long, n int, long boolean, linked boolean, n_apart int, apart binary"


def judged_stars(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``stars`` (hub, hub_n, id, n, long, several) compared with their hubs.

    ``apart`` holds the values only one of both sets has, if the hub has several members.
    """
    hubs = sets.filter("hub").select(F.col("id").alias("hub"), F.col("values").alias("hub_values"))
    both = stars.join(sets.select("id", "values"), "id").join(hubs, "hub")
    return both.mapInPandas(lean(_judge_stars(percent)), STAR)


def judged_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs`` (a, b), by their whole sets."""

    def run(batches):
        for pdf in batches:
            linked = []
            for x, y in zip(pdf["values_a"], pdf["values_b"], strict=True):
                x, y = unpacked(x), unpacked(y)
                linked.append(bool(close(len(np.setxor1d(x, y, assume_unique=True)), len(x) + len(y), percent)))
            yield pdf.loc[np.array(linked, bool), ["a", "b"]]

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = stage(narrowed(sets.select("id", "values"), ends, "id"))
    end = lambda x: some.select(F.col("id").alias(x), F.col("values").alias(f"values_{x}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").mapInPandas(lean(run), "a long, b long")


def judged_pairs(pairs: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among ``pairs`` (hub, a, b) of members of the hub's star.

    Both sets' differences from the hub are known, and the sets differ from each other in
    what only one of the differences has.
    """

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            apart = [
                len(np.setxor1d(unpacked(x), unpacked(y), assume_unique=True))
                for x, y in zip(pdf["apart_a"], pdf["apart_b"], strict=True)
            ]
            yield pdf.loc[close(np.array(apart, dtype=np.int64), pdf["both"].to_numpy(), percent), ["a", "b"]]

    ends = pairs.select("hub", F.explode(F.array("a", "b")).alias("id")).distinct()
    some = stage(narrowed(stars.select("hub", "id", "n", "apart"), ends, "hub", "id"))
    end = lambda x: some.select("hub", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("apart").alias(f"apart_{x}"))
    rows = pairs.join(end("a"), ["hub", "a"]).join(end("b"), ["hub", "b"])
    return rows.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"), "apart_a", "apart_b").mapInPandas(
        lean(run), "a long, b long"
    )


def may_link(a: str, b: str, percent: int) -> Column:
    """What sizes and distances from a common hub allow (the triangle inequality)."""
    n_a, n_b, d_a, d_b = F.col(f"n_{a}"), F.col(f"n_{b}"), F.col(f"n_apart_{a}"), F.col(f"n_apart_{b}")
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return sizes & ((100 + percent) * F.abs(d_a - d_b) <= (100 - percent) * (n_a + n_b))


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, a, b) of members of short lists that lie in two components.

    ``members``: value, hub, id, n, component, n_apart; the hub is not among them.
    """
    end = lambda x: members.select(
        "value", "hub", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "component", "n_apart")]
    )
    return (
        end("a")
        .join(end("b"), ["value", "hub"])
        .filter((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")))
        .filter(may_link("a", "b", percent))
        .select("hub", F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    )


def beside(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of short lists of which one at least is far from the hub.

    ``members``: value, id, n, known; the hub is not among them.
    """
    end = lambda x: members.select("value", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "known")])
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return (
        end("a")
        .filter("not known_a")
        .join(end("b"), "value")
        .filter(F.col("known_b") & (F.col("id_a") != F.col("id_b")) | (F.col("id_a") < F.col("id_b")))
        .filter(sizes)
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        .distinct()
    )


def own_slot(size: int, key: str) -> Column:
    """The slot of a value, which Python tasks compute as ``value % size``."""
    return F.pmod(F.col(key), F.lit(size))


def spread(values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of packed sets, the row of each, and the size of each row's set."""
    found = [unpacked(x) for x in values]
    sizes = np.array([len(x) for x in found], np.int64)
    return np.concatenate([np.empty(0, np.int64), *found]), np.repeat(np.arange(len(found)), sizes), sizes


def frequent(sets: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Bitmaps of the values that several, many, very many, ... of ``sets`` (id, values) have.

    Counted over one set in ``SAMPLE``.  They only say which values come last in an order,
    and any order gives the same links.
    """

    def run(batches):
        for pdf in batches:
            for part in chunks(pdf["values"], PACKED):
                yield pd.DataFrame({"value": spread(pdf["values"].iloc[part])[0]})

    some = sets.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("values")
    counts = stage(some.mapInPandas(lean(run), "value long").groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    most = counts.agg(F.max("df")).first()[0] or 0
    found, above = [], 2
    while above <= most:
        found.append(bits_of(counts.filter(F.col("df") >= above), "value", at=own_slot))
        above *= 4
    return found


FRONT = "id long, n int, component long, outside boolean, left int, value long"


def fronts(
    sets: DataFrame, percent: int, last: list[tuple[int, np.ndarray]], wanted: tuple[int, np.ndarray] | None = None
) -> DataFrame:
    """The first values of each of ``sets``, of which a linked set must have one among its own first.

    Linked sets have ``least`` values in common or more, so they share one of the first
    n - least + 1 of each, in any order that both keep: here rare values come first.  ``left``
    counts a value and those after it.  Values not in ``wanted`` make no rows.
    """

    def run(batches):
        for pdf in batches:
            for part in chunks(pdf["values"], PACKED):
                yield listed_first(pdf.iloc[part])

    def listed_first(pdf):
        value, row, sizes = spread(pdf["values"])
        often = np.zeros(len(value), np.int8)
        for size, bits in last:
            often += has(bits, value % size)
        order = np.lexsort((value, often, row))
        value, left = value[order], np.cumsum(sizes)[row] - np.arange(len(row))
        keep = 100 * left >= percent * sizes[row]
        if wanted is not None:
            keep &= has(wanted[1], value % wanted[0])
        out = pdf[["id", "component", "outside"]].assign(n=sizes).iloc[row[keep]]
        return out.assign(left=left[keep], value=value[keep])

    return sets.select("id", "component", "outside", "values").mapInPandas(lean(run), FRONT)


def rare_first(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` in two components that may be linked, one of them outside at least.

    ``members``: id, component, outside; ``sets``: id, values of at least those.
    """
    mine = stage(narrowed(sets.select("id", "values"), members, "id").join(members, "id"))
    last = frequent(mine)
    outer = stage(fronts(mine.filter("outside"), percent, last))
    # Others need only what those outside look for.
    inner = fronts(mine.filter("not outside"), percent, last, bits_of(outer, "value", at=own_slot))
    both = stage(outer.unionByName(inner))
    end = lambda front, x: front.select(
        "value", *[F.col(y).alias(f"{y}_{x}") for y in ("id", "n", "component", "outside", "left")]
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return (
        end(both.filter("outside"), "a")
        .join(end(both, "b"), "value")
        .filter("component_a != component_b and (not outside_b or id_a < id_b)")
        .filter(F.least("left_a", "left_b") * (100 + percent) >= percent * (n_a + n_b))
        .filter(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        .distinct()
    )


def links_between(classes: DataFrame, docs: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) that connect all classes which linked pairs connect.

    ``classes``: id, n, sketch, bands; ``docs``: id, text of at least those ids.
    """
    lists = stage(listed(classes))
    heads = stage(
        lists.groupBy("value")
        .agg(F.min(F.struct("own", "id", "n")).alias("head"), F.count("*").alias("members"))
        .filter("members > 1")
        .select("value", F.col("head.id").alias("hub"), F.col("head.n").alias("hub_n"), (F.col("members") > LIST).alias("long"))
    )
    members = stage(lists.join(heads, "value").filter("id != hub").select("value", "hub", "hub_n", "long", "id", "n"))
    stars = members.groupBy("hub", "hub_n", "id", "n").agg(F.max("long").alias("long"))
    sizes = members.groupBy("hub").agg((F.min("id") != F.max("id")).alias("several"))
    stars = stage(stars.join(sizes, "hub"))
    # Members whose sketch is far from the hub's have no need of whole sets in short lists.
    pair = [F.col("hub").alias("a"), F.col("id").alias("b")]
    near = stage(alike(stars.filter("not long").select(*pair), classes, percent, k))
    near = near.select(F.col("a").alias("hub"), F.col("b").alias("id")).withColumn("near", F.lit(True))
    known = F.col("long") | F.coalesce("near", F.lit(False))
    stars = stage(stars.join(near, ["hub", "id"], "left").withColumn("known", known).drop("near"))
    some = members.filter("not long").join(stars.select("hub", "id", "known"), ["hub", "id"])
    pairs = stage(beside(stage(some.select("value", "id", "n", "known")), percent))
    pairs = stage(alike(pairs, classes, percent, k))

    stars = stars.filter("known").drop("known")
    hubs = stage(stars.select(F.col("hub").alias("id")).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = stage(stars.select("id").unionByName(hubs).unionByName(ends).distinct())
    at = shared_dir(docs.sparkSession)
    sets = stage(full_sets(docs, width, wanted, hubs), at)
    stars = stage(judged_stars(stars, sets, percent))
    others = stage(judged_sets(pairs, sets, percent))
    links = stars.filter("linked").select(*pair).unionByName(others)

    labels = components(links).withColumnRenamed("node", "id")
    own_or = F.coalesce("component", "id").alias("component")
    marks = stage(
        stars.filter("apart is not null").select("hub", "id", "n_apart").join(labels, "id", "left").select("hub", "id", "n_apart", own_or)
    )
    short = members.filter("not long").join(marks, ["hub", "id"])
    mixed = short.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
    some = stage(short.join(mixed, "value", "left_semi").select("value", "hub", "id", "n", "component", "n_apart"))
    # Nothing is left to link among members of a long list that are all in the hub's component.
    far = stars.filter("long and apart is not null").select("hub", "id").join(labels, "id", "left").withColumn("component", own_or)
    of_hub = hubs.join(labels, "id", "left").select(F.col("id").alias("hub"), own_or.alias("hub_component"))
    far = stage(far.join(of_hub, "hub").withColumn("outside", F.col("component") != F.col("hub_component")))
    parted = far.filter("outside").select("hub").distinct()
    far = far.join(parted, "hub", "left_semi").groupBy("id", "component").agg(F.max("outside").alias("outside"))
    wide = stage(judged_sets(stage(rare_first(stage(far), sets, percent)), sets, percent))
    remove(docs.sparkSession, at)
    rest = stage(across(some, percent).groupBy("a", "b").agg(F.min("hub").alias("hub")))
    return links.unionByName(judged_pairs(rest, stars, percent)).unionByName(wide)


def near_duplicates(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    k: int = K,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Documents are linked when their sets of runs of ``width`` words have a Jaccard
    similarity of ``percent`` hundredths or more; components follow links, and the smallest
    doc_id of a component stays.  Null and empty texts and those without words have no
    runs and are linked with nothing.  Rows that share a doc_id are one document of the
    graph.  Rows without an id are linked like others but lose against every id.  An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.coalesce(F.col(id_).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    found = stage(sketches(rows, width, k, percent))
    heads = stage(found.filter("n > 0").groupBy("digest").agg(F.min("id").alias("head")))
    classes = found.join(heads, "digest").filter("id = head").select("id", "n", "sketch", "bands")
    labels = components(links_between(classes, rows, width, percent, k))
    named = stage(
        heads.join(labels.withColumnRenamed("node", "head"), "head", "left").select(
            "digest", F.coalesce("component", "head").alias("component")
        )
    )
    return (
        found.select("id", "n", "digest")
        .join(named, "digest", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .select(
            F.nullif(F.col("id"), F.lit(LAST)).alias("doc_id"),
            F.col("n").cast("long").alias("n_shingles"),
            F.nullif(F.col("component"), F.lit(LAST)).alias("component_id"),
            (F.col("id") == F.col("component")).alias("kept"),
        )
    )


def drop_near_copies(docs: DataFrame, id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    with passing(spark):
        near = near_duplicates(docs, id_, text, **options)
        gone = stage(near.filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), at)
    whole = docs.select(F.struct("*").alias("row"), F.col(id_).alias("own_id"))
    return whole.join(gone, F.col("own_id") == F.col("gone"), "left_anti").select("row.*")
