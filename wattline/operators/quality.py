"""Data-quality reports: grid coverage, absent periods, null counts.

Coverage comes from presence bitmaps: 64 consecutive periods of a site are the bits of one number.  Readings
set their bit where they lie and the numbers are merged by ``bit_or``, so a regular series is dealt
as one row per 64 periods, not one per reading.  Both reports need nothing but that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import floor_div, step_micros
from ..sources.sinks import stage

# Periods of one bitmap, and bitmaps that one row of a series' outline is spread to at a time.
PERIODS, WIDE = 64, 1024


def presence(df: DataFrame, freq: str = "30min") -> DataFrame:
    """Bitmaps of the instants that have readings: site_id, phase, word, bits, n, lo, hi.

    ``phase`` is an instant's offset within a period, in microseconds, and ``word`` the number of its 64
    periods since 1970; bit i of ``bits`` is the i-th of them.  ``n`` counts rows, ``lo`` and ``hi`` are
    the first and last instant.  Readings off a site's grid have another phase.  Rows
    without a time are one row per site with nulls; those without a site are left out.
    """
    step = step_micros(freq)
    at = F.unix_micros("timestamp")
    slot = floor_div(at, step)
    return (
        df.where(F.col("site_id").isNotNull())
        .select(
            "site_id",
            "timestamp",
            F.pmod(at, F.lit(step)).alias("phase"),
            floor_div(slot, PERIODS).alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(PERIODS)).cast("int")).alias("bit"),
        )
        .groupBy("site_id", "phase", "word")
        .agg(
            F.bit_or("bit").alias("bits"),
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("lo"),
            F.max("timestamp").alias("hi"),
        )
    )


def coverage(present: DataFrame, freq: str = "30min", off_grid: bool = False) -> DataFrame:
    """``check_regular_index`` from a ``presence`` table."""
    step = step_micros(freq)
    phases = present.groupBy("site_id", "phase").agg(
        F.sum("n").alias("n"),
        # Rows without a time are alike: one and its repetitions.
        F.sum(F.coalesce(F.bit_count("bits"), F.lit(1))).alias("n_distinct"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    sites = phases.groupBy("site_id").agg(
        F.sum("n").alias("n_rows"),
        F.sum("n_distinct").alias("n_distinct"),
        F.sum(F.when(F.col("phase").isNotNull(), F.col("n_distinct"))).alias("n_dated"),
        F.min_by("n_distinct", "lo").alias("n_on_grid"),
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
    )
    span = F.unix_micros("end") - F.unix_micros("start")
    report = sites.withColumn("n_expected", floor_div(span, step) + 1)
    extra = [(F.col("n_dated") - F.col("n_on_grid")).alias("n_off_grid")] if off_grid else []
    return report.select(
        "site_id",
        "n_rows",
        "n_expected",
        (F.col("n_expected") - F.col("n_on_grid")).alias("n_missing"),
        (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicated"),
        "start",
        "end",
        *extra,
    )


def _expected(present: DataFrame, step: int) -> DataFrame:
    """Bitmaps of each site's full grid, from its first to its last reading: site_id, phase, word, wanted."""
    sites = (
        present.where(F.col("phase").isNotNull())
        .groupBy("site_id")
        .agg(F.unix_micros(F.min("lo")).alias("lo"), F.unix_micros(F.max("hi")).alias("hi"))
    )
    phase = F.pmod("lo", F.lit(step))
    first, last = floor_div(F.col("lo"), step), floor_div(F.col("hi") - F.col("phase"), step)
    outline = sites.withColumn("phase", phase).withColumns({"first": first, "last": last})
    outline = outline.withColumns({"from": floor_div(F.col("first"), PERIODS), "to": floor_div(F.col("last"), PERIODS)})
    # Two steps, so that no array gets long.
    many = outline.withColumn("many", F.explode(F.sequence("from", "to", F.lit(WIDE).cast("long"))))
    words = many.withColumn("word", F.explode(F.sequence("many", F.least(F.col("to"), F.col("many") + (WIDE - 1)))))
    skipped = F.greatest(F.col("first") - F.col("word") * PERIODS, F.lit(0)).cast("int")
    spare = F.greatest((F.col("word") + 1) * PERIODS - 1 - F.col("last"), F.lit(0)).cast("int")
    all_bits = F.lit(-1).cast("long")
    mask = F.call_function("shiftleft", all_bits, skipped).bitwiseAND(F.call_function("shiftrightunsigned", all_bits, spare))
    return words.select("site_id", "phase", "word", mask.alias("wanted"))


def absent(present: DataFrame, freq: str = "30min") -> DataFrame:
    """``missing_periods`` from a stored ``presence`` table."""
    step = step_micros(freq)
    both = _expected(present, step).join(
        present.where("phase is not null").select("site_id", "phase", "word", "bits"), ["site_id", "phase", "word"], "left"
    )
    bits = F.col("wanted").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))))

    def unset(i: Column) -> Column:
        return F.call_function("shiftright", F.col("open"), i).bitwiseAND(F.lit(1).cast("long")) == 1

    gaps = both.withColumn("open", bits).where("open <> 0")
    each = F.filter(F.sequence(F.lit(0), F.lit(PERIODS - 1)), unset)
    slots = gaps.select("site_id", "phase", "word", F.explode(each).alias("bit"))
    at = (F.col("word") * PERIODS + F.col("bit")) * F.lit(step).cast("long") + F.col("phase")
    return slots.select("site_id", F.timestamp_micros(at).alias("timestamp"))


def check_regular_index(df: DataFrame, freq: str = "30min", off_grid: bool = False) -> DataFrame:
    """Gaps and duplicates per site against the grid from its first to its last reading.

    No grid is built and no reading is dealt: distinct instants are the bits of ``presence``,
    and those on the grid are the ones sharing the phase of the first reading.
    ``off_grid`` adds ``n_off_grid``, the distinct instants off the grid.
    """
    return coverage(presence(df, freq), freq, off_grid)


def missing_periods(df: DataFrame, freq: str = "30min") -> DataFrame:
    """The grid instants of each site that have no reading.

    The presence bitmaps are stored when called; instants are only made where bits are missing.
    """
    return absent(stage(presence(df, freq)), freq)


def summarise_missing(df: DataFrame) -> DataFrame:
    """Null (or NaN) count and share in percent per column, most affected first."""
    names = df.columns
    floating = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }

    def absent(c: str):
        col = F.col(f"`{c}`")
        return col.isNull() | F.isnan(col) if c in floating else col.isNull()

    totals = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(absent(c)).alias(f"__m{i}") for i, c in enumerate(names)],
    )
    long = totals.select(
        "__rows",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"__m{i}").alias("n_missing"))
                    for i, c in enumerate(names)
                ]
            )
        ).alias("m"),
    )
    share = F.col("m.n_missing") / F.nullif(F.col("__rows"), F.lit(0)) * 100
    return long.select(
        "m.column_name",
        "m.n_missing",
        F.coalesce(F.bround(share, 2), F.lit(0.0)).alias("pct_missing"),
    ).orderBy(F.desc("n_missing"), "column_name")
