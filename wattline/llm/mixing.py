"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of tokens.  Document rates between 0 and ``cap`` are the
ones closest (in relative entropy, with the entropy of what is left to the cap) to an even
rate that meet the targets.  Their dual is convex with one multiplier per source, and its
solution is an exponential tilt by document size::

    rate = cap * w / (w + 1),   w = exp(multiplier * size / scale of the source)

Newton steps solve it: each is one pass over (source, size) that sums, per source, the
tokens at the current multipliers and their derivative.  Rates become whole copies so that
each source's tokens stay next to its target: documents are taken one copy up in an order
that a hash and the fractional rates give, as far as the target allows, then again among
the documents that still fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import WORD, sent
from wattline.sources.sinks import passing, shared_dir, stage

# Contract of the query: weights in order of the sources, share of all tokens, cap.
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
STEPS = 60
# Rounding order: keys of BITS bits, cut into slices of STEP bits twice; times it is gone
# through to fill what is left of the targets.
BITS, STEP, PASSES = 40, 12, 3
SLICES = 1 << STEP
# A mix is configured by source: one row each passes the driver and is broadcast.
MAX_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of words: places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets_of(sizes: np.ndarray, weights: np.ndarray, share: float, cap: float) -> np.ndarray:
    """Tokens per source: shares by weight of ``share`` times all tokens, none above cap.

    What a capped source cannot take is shared again by weight among the others.
    """
    target = np.zeros(len(sizes))
    limit = cap * sizes
    open_ = np.ones(len(sizes), bool)
    left = share * sizes.sum()
    while open_.any() and left > 0:
        part = left * weights[open_] / weights[open_].sum()
        over = part >= limit[open_]
        if not over.any():
            target[open_] = part
            break
        full = np.flatnonzero(open_)[over]
        target[full] = limit[full]
        left -= limit[full].sum()
        open_[full] = False
    return target


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, place) from (source, size, n); one row per source.

    Sources are ordered by code point, null last; ``weights`` repeat along that order.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")
    )
    per = per.limit(MAX_SOURCES + 1).toPandas()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"More than {MAX_SOURCES} sources: group them before mixing")
    per["name"] = [None if pd.isna(x) else x for x in per["source"]]
    # Strings of Python sort by code point.
    order = sorted(range(len(per)), key=lambda i: (per["name"][i] is None, per["name"][i] or ""))
    per = per.iloc[order].reset_index(drop=True)
    w = np.array([weights[i % len(weights)] for i in range(len(per))])
    target = targets_of(per["source_size"].to_numpy(float), w, share, cap)
    rows = [
        (i, x, int(s), float(t), float(s) / max(1, int(n)))
        for i, (x, s, n, t) in enumerate(zip(per["name"], per["source_size"], per["n"], target, strict=True))
    ]
    kinds = {"place": pa.int32(), "source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "scale": pa.float64()}
    return sent(spark, rows, **kinds)


def rate_of(multiplier: Column, size: Column, scale: Column, cap: float) -> Column:
    """The tilted rate; infinite multipliers give 0 or the cap."""
    return F.lit(cap) / (1 + F.exp(-multiplier * size / scale))


def solve(sizes: DataFrame, per_source: DataFrame, cap: float, steps: int = STEPS) -> DataFrame:
    """Multipliers that meet the targets: ``per_source`` with a column ``multiplier``.

    ``sizes`` is (place, size, n).  Equal sizes of a source are summed once before the steps.
    Newton steps that leave the bracket known so far are replaced by its middle.
    """
    spark = sizes.sparkSession
    counts = stage(sizes.filter("size > 0").groupBy("place", "size").agg(F.sum("n").alias("n")))
    known = per_source.toPandas()
    target, total = known["target"].to_numpy(), known["source_size"].to_numpy(float)
    multiplier = np.zeros(len(known))
    low, high = np.full(len(known), -np.inf), np.full(len(known), np.inf)
    full, none = target >= cap * total, target <= 0
    multiplier[full], multiplier[none] = np.inf, -np.inf
    open_ = ~(full | none)
    for _ in range(steps):
        if not open_.any():
            break
        state = sent(
            spark,
            [(int(p), float(m), float(s)) for p, m, s, o in zip(known["place"], multiplier, known["scale"], open_, strict=True) if o],
            place=pa.int32(),
            multiplier=pa.float64(),
            scale=pa.float64(),
        )
        rate = rate_of(F.col("multiplier"), F.col("size"), F.col("scale"), cap)
        tokens = F.col("n") * F.col("size")
        sums = (
            counts.join(F.broadcast(state), "place")
            .groupBy("place")
            .agg(
                F.sum(tokens * rate).alias("value"),
                F.sum(tokens * rate * (1 - rate / cap) * F.col("size") / F.col("scale")).alias("slope"),
            )
            .toPandas()
            .set_index("place")
        )
        for p in np.flatnonzero(open_):
            value, slope = sums.loc[p, "value"], sums.loc[p, "slope"]
            miss = value - target[p]
            if abs(miss) <= 1e-9 * target[p]:
                open_[p] = False
                continue
            if miss < 0:
                low[p] = multiplier[p]
            else:
                high[p] = multiplier[p]
            step = multiplier[p] - miss / slope if slope > 0 else np.nan
            if not (low[p] < step < high[p]):
                step = (low[p] + high[p]) / 2 if np.isfinite(low[p] + high[p]) else multiplier[p] + (4.0 if miss < 0 else -4.0)
            multiplier[p] = step
    rows = [(int(p), float(m)) for p, m in zip(known["place"], multiplier, strict=True)]
    return per_source.join(F.broadcast(sent(spark, rows, place=pa.int32(), multiplier=pa.float64())), "place")


def chance(*columns: Column) -> Column:
    """A number from 0 to below 1 that depends on the columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS)) / float(1 << BITS)


def ended(sums: DataFrame) -> DataFrame:
    """(place, room, slice): the first slice that does not fit whole, and the room in it.

    ``sums``: place, room, slice, tokens.  If all fit, the slice is ``SLICES``.
    """
    run = Window.partitionBy("place").orderBy("slice")
    until = sums.withColumn("until", F.sum("tokens").over(run))
    return until.groupBy("place").agg(
        F.coalesce(F.min(F.expr("if(until > room, slice, null)")), F.lit(SLICES)).alias("slice"),
        (F.first("room") - F.coalesce(F.max(F.expr("if(until <= room, until, null)")), F.lit(0))).alias("room"),
    )


def filled(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Mark as ``up`` the rows that fit into their place's room, in the order of ``key``.

    ``rows``: place, id, tokens, key, up; ``room``: place, room.  Sums by slices of the key
    say where the room ends; that slice is cut into slices once more, and the rows of the
    last one, about one in ``SLICES`` squared, are added up one by one.
    """
    high, low = F.shiftright("key", BITS - STEP), F.shiftright("key", BITS - 2 * STEP) % SLICES
    free = rows.join(F.broadcast(room), "place").filter("not up and tokens <= room and tokens > 0")
    sums = lambda df, by: df.groupBy("place", "room", by.alias("slice")).agg(F.sum("tokens").alias("tokens"))
    first = stage(ended(sums(free, high)))
    inside = free.drop("room").join(F.broadcast(first), "place").filter(high == F.col("slice")).drop("slice")
    second = stage(ended(sums(inside, low)))
    last = inside.drop("room").join(F.broadcast(second), "place").filter(low == F.col("slice"))
    run = Window.partitionBy("place").orderBy("key", "id", "tokens")
    tail = stage(last.withColumn("until", F.sum("tokens").over(run)).filter("until <= room").select("place", "id", "tokens"))
    edge = (
        room.withColumnRenamed("room", "fits")
        .join(first.select("place", F.col("slice").alias("first")), "place", "left")
        .join(second.select("place", F.col("slice").alias("second")), "place", "left")
    )
    in_tail = tail.withColumn("in_tail", F.lit(True))
    before = (high < F.col("first")) | ((high == F.col("first")) & (low < F.col("second")))
    return stage(
        rows.join(F.broadcast(edge), "place", "left")
        .join(in_tail, ["place", "id", "tokens"], "left")
        .withColumn(
            "up",
            F.col("up")
            | F.coalesce((F.col("tokens") > 0) & (F.col("tokens") <= F.col("fits")) & before, F.lit(False))
            | F.coalesce("in_tail", F.lit(False)),
        )
        .select(*rows.columns)
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    id_: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, n), one row per distinct document.

    ``n`` rows of ``docs`` have this doc_id, source and size; each is taken ``copies`` times,
    at most ``cap`` rounded up.  Null texts have size 0.  A null source is a source of its
    own, the last one.  Sources without words have target 0.  Documents without words are
    taken once.  An empty table gives no rows; other columns are not read.
    """
    sized = stage(
        docs.select(F.col(id_).alias("id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
        .groupBy("id", "source", "size")
        .agg(F.count("*").alias("n"))
    )
    per_source = source_targets(sized, weights, share, cap)
    same = F.col("source").eqNullSafe(F.col("of"))
    rows = stage(
        sized.join(F.broadcast(per_source.select("place", F.col("source").alias("of"))), same).select(
            "place", "id", "size", "n"
        )
    )
    solved = solve(rows, per_source, cap)
    rate = rate_of(F.col("multiplier"), F.col("size"), F.col("scale"), cap)
    fraction = F.col("rate") - F.col("base")
    rated = (
        rows.join(F.broadcast(solved.select("place", "multiplier", "scale")), "place")
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate))
        .withColumn("base", F.floor("rate"))
        .withColumn("key", ((chance("id", "size") - fraction + 1) / 2 * ((1 << BITS) - 1)).cast("long"))
        .withColumn("tokens", F.col("size") * F.col("n"))
        .withColumn("up", F.lit(False))
        .select("place", "id", "size", "n", "tokens", "base", "key", (fraction > 0).alias("open"), "up")
    )
    rated = stage(rated)
    left = lambda df: stage(
        df.groupBy("place")
        .agg(F.sum(F.col("tokens") * (F.col("base") + F.col("up").cast("int"))).alias("took"))
        .join(F.broadcast(per_source.select("place", "target")), "place")
        .select("place", F.greatest(F.lit(0), F.floor(F.col("target") - F.col("took"))).alias("room"))
    )
    fixed = rated.filter("not open")
    loose = rated.filter("open")
    for _ in range(PASSES):
        loose = filled(loose, left(rated.filter("not open").unionByName(loose)))
    names = per_source.select("place", "source", "source_size", "target")
    return (
        fixed.unionByName(loose)
        .join(F.broadcast(names), "place")
        .select(
            F.col("id").alias("doc_id"),
            "source",
            "size",
            "source_size",
            "target",
            (F.col("base") + F.col("up").cast("int")).cast("long").alias("copies"),
            "n",
        )
    )


def taken(mixed: DataFrame) -> DataFrame:
    """One row per row of the documents with the words the mix takes of it."""
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"),
    ).drop("nth")


def repeat(docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    with passing(spark):
        mixed = stage(
            mix(docs, id_=id_, text=text, source=source, **options)
            .filter("copies > 0")
            .select(
                F.col("doc_id").alias("mixed_id"),
                F.col("source").alias("mixed_source"),
                F.col("size").alias("mixed_size"),
                "copies",
            ),
            at,
        )
    whole = docs.select(
        F.struct("*").alias("row"),
        F.col(id_).alias("own_id"),
        F.col(source).cast("string").alias("own_source"),
        words(F.col(text)).alias("own_size"),
    )
    same = (
        F.col("own_id").eqNullSafe(F.col("mixed_id"))
        & F.col("own_source").eqNullSafe(F.col("mixed_source"))
        & (F.col("own_size") == F.col("mixed_size"))
    )
    return (
        whole.join(mixed, same)
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
        .select("row.*")
    )
