"""Exact medians of groups of any size.

A mergeable quantile sketch brackets the middle of each group, and one counting pass makes it exact:
values below the bracket are one count, those above another, and only the distinct values within,
about a thousandth of a group, are ranked.  A group of a third of all rows costs a task no more than
these.  (The built-in exact percentile would keep all distinct values of a group in one hash map.)

Should a bracket miss the middle or hold more than ``RANKED`` values, counts of rounded values narrow it
down: 12 significant bits, then 33, then the values themselves, no step with more than some two
million rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import period_index, step_micros
from ..sources.sinks import stage
from .blocks import key_list

# Buckets over which the rows of one group meet their group's facts.
BUCKETS = 4096
# Rows of one series within this span of time share a bucket.
SPAN = "30 days"

# Distinct values of one group that a task ranks.
RANKED = 2_000_000
# Rows of the largest group facts that are sent to all tasks, if the session allows their size.
BROADCAST_ROWS, FACT_BYTES = 100_000, 64
# Accuracy of the sketch, and shares of a group that are asked for: the n-th from the middle
# once a group has so many rows that the sketch cannot miss by as much.
ACCURACY = 10_000
SHARES = ((0, 0.0), (30, 0.4), (400, 0.49), (5_000, 0.499), (50_000, 0.4995))

# Values above this power of two are their own rounding (the split would overflow).
_HUGE = 2.0**930


def _rounded(v: Column, dropped_bits: int) -> Column:
    """``v`` rounded to ``53 - dropped_bits`` significant bits; monotone in ``v``."""
    spread = v * F.lit(2.0**dropped_bits + 1.0)
    return F.when(F.abs(v) >= _HUGE, v).otherwise(spread - (spread - v))


def time_bucket(df: DataFrame, ts: str = "timestamp") -> Column:
    """Bucket of a row by its time; rows without one are spread by their content."""
    spread = F.lit(-1) - F.pmod(F.xxhash64(*df.columns), F.lit(BUCKETS))
    return F.coalesce(period_index(ts, step_micros(SPAN)) + F.lit(1 << 40), spread)


def value_bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


def join_facts(
    df: DataFrame, facts: DataFrame, keys: str | Sequence[str], bucket: Column
) -> DataFrame:
    """Left join of one-row-per-group ``facts`` that spreads big groups over tasks.

    Facts meet the distinct (group, bucket) pairs of the rows first, and the rows meet
    those, so that no task receives a whole group.
    """
    keys = key_list(keys)
    marked = df.withColumn("__bucket", bucket)
    # The pairs are dealt by the bucket too, or their layout by group would be reused.
    pairs = marked.select(*keys, "__bucket").distinct().join(facts, keys, "left")
    pairs = pairs.repartition(*keys, "__bucket")
    return marked.join(pairs, [*keys, "__bucket"], "left").drop("__bucket")


def value_counts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return (
        df.select(*keys, value.cast("double").alias("__v"))
        .where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .groupBy(*keys, "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )


def _pick(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows of ``counts`` that hold the wanted ranks, with the rank inside the row."""
    upto = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("__upto") - F.col("__n")
    return (
        counts.withColumn("__upto", F.sum("__n").over(upto))
        .where((start <= F.col("__rank")) & (F.col("__rank") < F.col("__upto")))
        .withColumn("__rank", F.col("__rank") - start)
    )


def median_of_counts(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Median per group of a table of value counts (``__v``, ``__n``) of any size."""
    fine = counts.withColumn("__f", _rounded(F.col("__v"), 20))
    fine_counts = fine.groupBy(*keys, "__f").agg(F.sum("__n").alias("__n"))
    fine_counts = fine_counts.withColumn("__c", _rounded(F.col("__f"), 41))
    coarse = fine_counts.groupBy(*keys, "__c").agg(F.sum("__n").alias("__n"))

    total = F.sum("__n").over(Window.partitionBy(*keys))
    middle = F.array(
        F.struct(F.lit(0).alias("side"), F.floor((F.col("__t") - 1) / 2).alias("rank")),
        F.struct(F.lit(1).alias("side"), F.floor(F.col("__t") / 2).alias("rank")),
    )
    upto = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("__upto") - F.col("__n")
    in_coarse = (
        coarse.withColumns({"__upto": F.sum("__n").over(upto), "__t": total})
        .withColumn("__m", F.explode(middle))
        .where((start <= F.col("__m.rank")) & (F.col("__m.rank") < F.col("__upto")))
        .select(
            *keys, "__c", F.col("__m.side").alias("__side"), (F.col("__m.rank") - start).alias("__rank")
        )
    )
    in_fine = _pick(
        fine_counts.join(in_coarse, [*keys, "__c"]), [*keys, "__side"], "__f"
    ).select(*keys, "__side", "__f", "__rank")
    exact = _pick(fine.join(in_fine, [*keys, "__f"]), [*keys, "__side"], "__v")
    return exact.groupBy(*keys).agg(F.avg("__v").alias(name))


def attach(df: DataFrame, facts: DataFrame, keys: str | Sequence[str], bucket: Column, n_facts: int) -> DataFrame:
    """Left join of ``n_facts`` rows of facts: sent to all tasks while they are few, else ``join_facts``."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if n_facts <= BROADCAST_ROWS and FACT_BYTES * n_facts <= limit:
        return df.join(F.broadcast(facts), key_list(keys), "left")
    return join_facts(df, facts, keys, bucket)


def _brackets(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: rows, and two values that the middle is between (``__lo``, ``__hi``)."""
    shares = [p for _, p in SHARES] + [1 - p for _, p in SHARES]
    found = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), F.percentile_approx("__v", shares, ACCURACY).alias("__q")
    )
    lo, hi = F.get("__q", F.lit(0)), F.get("__q", F.lit(len(SHARES)))
    for i, (least, _) in enumerate(SHARES):
        enough = F.col("__rows") >= least
        lo = F.when(enough, F.get("__q", F.lit(i))).otherwise(lo)
        hi = F.when(enough, F.get("__q", F.lit(len(SHARES) + i))).otherwise(hi)
    return found.select(*keys, "__rows", lo.alias("__lo"), hi.alias("__hi"))


def _from_median(values: DataFrame) -> DataFrame:
    return values.withColumn("__v", F.abs(F.col("__v") - F.col("median"))).where(F.col("median").isNotNull())


def medians(values: DataFrame, keys: Sequence[str], name: str, around: tuple[DataFrame, int] | None = None):
    """Median per group of a stored table of ``keys`` and ``__v``, and the number of groups.

    With ``around``, a stored table with a ``median`` per group and its size, it is the median
    distance from that, which is kept.  Runs jobs when called; the result is a stored table.
    Groups with a null key have no median.
    """
    keys, spread = list(keys), values
    by, shape = keys, lambda df: df
    if around is not None:
        by, shape = [*keys, "median"], _from_median
        spread = shape(attach(values, around[0], keys, value_bucket("__v"), around[1]))
    brackets = stage(_brackets(spread, by))
    n_groups = brackets.count()
    known = shape(attach(values, brackets, keys, value_bucket("__v"), n_groups).where(F.col("__rows").isNotNull()))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    value = F.when(F.col("__v") < F.col("__lo"), low).when(F.col("__v") > F.col("__hi"), high).otherwise(F.col("__v"))
    counts = stage(known.groupBy(*by, value.alias("__v")).agg(F.count(F.lit(1)).alias("__n")))
    largest = counts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= RANKED:
        whole = Window.partitionBy(*by)
        upto = whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumns({"__upto": F.sum("__n").over(upto), "__rows": F.sum("__n").over(whole)})
        first, last = F.floor((F.col("__rows") - 1) / 2), F.floor(F.col("__rows") / 2)
        middle = ranked.where((F.col("__upto") > first) & (F.col("__upto") - F.col("__n") <= last))
        found = middle.groupBy(*by).agg(((F.min("__v") + F.max("__v")) / 2).alias(name))
    else:
        found = median_of_counts(counts, by, name)
    found = stage(found)
    if not found.where(F.isnan(name) | (F.abs(name) == high)).isEmpty():
        found = stage(median_of_counts(value_counts(spread, by, F.col("__v")), by, name))
    return found, n_groups


def median_and_mad(df: DataFrame, column: str, keys: str | Sequence[str] = "site_id") -> DataFrame:
    """Per group: ``median`` and ``mad``, the median absolute deviation from it.

    Runs jobs when called: values are stored once, as every step reads them; the result is a
    stored table with a row per group.
    """
    keys = key_list(keys)
    value = F.col(column).cast("double")
    values = stage(df.select(*keys, value.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")))
    return medians(values, keys, "mad", medians(values, keys, "median"))[0]


def with_facts(df: DataFrame, facts: DataFrame, keys: str | Sequence[str], bucket: Column) -> DataFrame:
    """``attach`` of a stored table of facts."""
    return attach(df, facts, keys, bucket, facts.count())
