"""Cleaning: superseded readings, the regular grid, outlier flags, short gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div, step_micros
from . import blocks
from .blocks import BLOCK, POS, carry_known, with_positions
from .quantile import median_and_mad, time_bucket, with_facts

# Scales a median absolute deviation to a standard deviation (fixed value).
MAD_TO_SIGMA = 0.6745

# Longer than the range of timestamps, in microseconds.
_ALL_TIME = 400_000_000_000_000_000


def drop_duplicate_readings(
    df: DataFrame,
    order_by: str | Column | Sequence[str | Column] | None = None,
    keys: Sequence[str] = ("site_id", "timestamp"),
) -> DataFrame:
    """Keep the last reading per (site, timestamp).

    ``order_by`` says which reading is later (default: ``ingest_order`` when the
    table has it, else all other columns, so that the result never depends on how
    the table is laid out).  The choice is an aggregate, so copies are reduced before the shuffle and
    any number of copies of one reading is fine.
    """
    rest = [c for c in df.columns if c not in keys]
    if order_by is None:
        order_by = ["ingest_order"] if "ingest_order" in rest else rest
    elif isinstance(order_by, (str, Column)):
        order_by = [order_by]
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if not rest:
        return df.dropDuplicates(list(keys))
    latest = F.max_by(F.struct(*rest), F.struct(*order))
    return (
        df.groupBy(*keys)
        .agg(latest.alias("__last"))
        .select(*[F.col(c) if c in keys else F.col(f"__last.`{c}`").alias(c) for c in df.columns])
    )


def site_bounds(df: DataFrame) -> DataFrame:
    """First and last instant per site, in microseconds."""
    return (
        df.where(F.col("site_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("site_id")
        .agg(
            F.unix_micros(F.min("timestamp")).alias("__lo"),
            F.unix_micros(F.max("timestamp")).alias("__hi"),
        )
    )


def site_grid(df: DataFrame, freq: str = "30min") -> DataFrame:
    """Every (site_id, timestamp) from a site's first to its last reading.

    Instants are produced block by block and the blocks are spread over the
    cluster first, so one long series is not produced by one task.
    """
    step = step_micros(freq)
    span = step * blocks.BLOCK_ROWS
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = span * max(1, min(blocks.BLOCK_ROWS, _ALL_TIME // span))
    stretches = site_bounds(df).select(
        "site_id", "__hi", F.explode(F.sequence("__lo", "__hi", F.lit(stretch))).alias("__from")
    )
    last_start = F.least(F.col("__hi"), F.col("__from") + F.lit(stretch - span))
    starts = stretches.select(
        "site_id", "__hi", F.explode(F.sequence("__from", last_start, F.lit(span))).alias("__from")
    )
    last = F.least(F.col("__hi"), F.col("__from") + F.lit(span - step))
    instants = starts.repartition(tasks, "site_id", "__from").select(
        "site_id", F.explode(F.sequence("__from", last, F.lit(step))).alias("__at")
    )
    return instants.select("site_id", F.timestamp_micros("__at").alias("timestamp"))


def _block_heads(df: DataFrame, step: int, rows: int, lookback: int) -> DataFrame:
    """A row for every (site, block) of the grid: ``__at`` its first instant, ``__end`` its last.

    A block begins with the ``lookback`` instants before its own ``rows``.
    """
    span = step * rows
    bounds = site_bounds(df).withColumns(
        {"__from": floor_div(F.col("__lo"), span), "__to": floor_div(F.col("__hi"), span)}
    )
    # Two steps, so that no array gets longer than the root of the number of blocks.
    wide = 1024
    many = bounds.withColumn("__many", F.explode(F.sequence("__from", "__to", F.lit(wide).cast("long"))))
    last = F.least(F.col("__to"), F.col("__many") + (wide - 1))
    heads = many.withColumn(BLOCK, F.explode(F.sequence(F.col("__many"), last)))
    on_grid = lambda at: F.col("__lo") + floor_div(at - F.col("__lo"), step) * step
    starts = F.greatest(F.col("__lo"), on_grid(F.col(BLOCK) * span - lookback * step + (step - 1)))
    ends = F.least(on_grid(F.col("__hi")), on_grid((F.col(BLOCK) + 1) * span - 1))
    return heads.select("site_id", BLOCK, "__lo", starts.alias("__at"), ends.alias("__end")).where("__at <= __end")


def reindex_to_grid(df: DataFrame, freq: str = "30min") -> DataFrame:
    """Put each site on its full regular grid; gaps become rows of nulls.

    The grid is anchored at the site's first reading.  Readings off the grid
    disappear and columns other than the keys stay null in the gaps.  The table must
    hold one row per (site, timestamp); rows without a site or a time have no place.

    Readings and one head row per (site, block) share one exchange.  Every reading, and
    the head of its block, then produces its own instant and those up to the next reading
    of the block, so generated instants are never shuffled or joined.
    """
    return with_slots(place_on_grid(df, freq), freq).select(*_at_slots(df.columns))


def reindex_with_halo(df: DataFrame, freq: str, lookback: int) -> tuple[DataFrame, int]:
    """``with_halo`` of the rows of ``reindex_to_grid`` and their positions, at the cost of its one exchange.

    Readings are handed to the blocks that look back at them; the instants between are made in each.
    """
    slots = with_slots(_stretches(df, freq, lookback), freq)
    pos = floor_div(F.col("__slot"), step_micros(freq)).alias(POS)
    return slots.select(*_at_slots(df.columns), BLOCK, pos), blocks.block_rows(lookback)


def _at_slots(columns: Sequence[str]) -> list[Column]:
    """Readings at their own instants, nulls at the others."""
    own = F.col("__slot") == F.col("__at")
    value = {c: F.when(own, F.col(f"__row.`{c}`")) for c in columns if c not in ("site_id", "timestamp")}
    value |= {"site_id": F.col("site_id"), "timestamp": F.timestamp_micros("__slot")}
    return [value[c].alias(c) for c in columns]


def place_on_grid(df: DataFrame, freq: str) -> DataFrame:
    """Readings on the grid and heads of blocks, with the stretch of instants that each stands for.

    ``site_id``, ``__row`` (the other columns, null for a head), ``__at`` and ``__until``, the first and
    last instant of the stretch.  The stretches of a site are its grid.
    """
    return _stretches(df, freq).drop(BLOCK)


def _stretches(df: DataFrame, freq: str, lookback: int = 0) -> DataFrame:
    """``place_on_grid`` with ``__block``; each block also has the stretches of its look-back."""
    step = step_micros(freq)
    rows = blocks.block_rows(lookback)
    heads = _block_heads(df, step, rows, lookback)
    rest = [c for c in df.columns if c not in ("site_id", "timestamp")]
    at = F.unix_micros("timestamp")
    own = floor_div(at, step * rows)
    last = floor_div(at + F.lit(lookback * step).cast("long"), step * rows)
    readings = df.where(F.col("site_id").isNotNull() & F.col("timestamp").isNotNull()).select(
        "site_id",
        (F.explode(F.sequence(own, last)) if lookback else own).alias(BLOCK),
        at.alias("__at"),
        F.struct(*rest).alias("__row") if rest else F.lit(True).alias("__row"),
    )
    both = readings.unionByName(heads, allowMissingColumns=True).withColumn("__read", F.col("__row").isNotNull())
    # By a column, so that both windows share a sort.
    order = Window.partitionBy("site_id", BLOCK).orderBy("__read", "__at")
    head = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns({"__lo": head("__lo"), "__end": head("__end")}).where(
        F.pmod(F.col("__at") - F.col("__lo"), F.lit(step)) == 0
    )
    until = F.coalesce(F.lead("__at").over(order) - step, F.col("__end"))
    stretches = placed.withColumn("__until", until).where(F.col("__at") <= F.col("__until"))
    return stretches.select("site_id", BLOCK, "__row", "__at", "__until")


def with_slots(stretches: DataFrame, freq: str) -> DataFrame:
    """A row for every instant of the stretches, ``__slot``."""
    step = F.lit(step_micros(freq)).cast("long")
    return stretches.withColumn("__slot", F.explode(F.sequence("__at", "__until", step)))


def _is_outlier(value: Column, z_threshold: float) -> Column:
    deviation = F.lit(MAD_TO_SIGMA) * (value - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    return F.coalesce(F.abs(deviation) > F.lit(float(z_threshold)), F.lit(False))


def flag_outliers(df: DataFrame, column: str = "value", z_threshold: float = 5.0) -> DataFrame:
    """Add ``is_outlier``: robust z-score against the site's median beyond the limit.

    Flags only; a site whose median absolute deviation is zero has no outliers.
    """
    facts = median_and_mad(df.where(F.col("site_id").isNotNull()), column)
    df = df.drop("is_outlier")
    return (
        with_facts(df, facts, "site_id", time_bucket(df))
        .withColumn("is_outlier", _is_outlier(F.col(column), z_threshold))
        .drop("median", "mad")
    )


def _filled(column: str, max_gap: int, long_gaps: str) -> Column:
    into = F.col(POS) - F.col("__prev_pos")
    gap = F.col("__next_pos") - F.col("__prev_pos")
    line = F.col("__prev_val") + (F.col("__next_val") - F.col("__prev_val")) * into / F.nullif(
        gap, F.lit(0)
    )
    size = into if long_gaps == "partial" else gap - 1
    return F.when(F.col(column).isNotNull(), F.col(column)).when(size <= max_gap, line)


def _check_long_gaps(long_gaps: str) -> None:
    if long_gaps not in ("partial", "skip"):
        raise ValueError(f"long_gaps must be 'partial' or 'skip', not {long_gaps!r}")


def fill_blocks(
    df: DataFrame,
    column: str,
    max_gap: int,
    long_gaps: str,
    grid: str | None,
    outlier_z: float | None,
    register: DataFrame | None = None,
) -> DataFrame:
    """``interpolate_short_gaps`` with the rows still laid out by (site, ``__block``).

    The columns of ``register``, one row per site, are attached on the way.
    """
    _check_long_gaps(long_gaps)
    facts = None
    columns = list(df.columns)
    if outlier_z is not None:
        facts = median_and_mad(df, column)
        columns = [c for c in columns if c != "is_outlier"] + ["is_outlier"]
        df = df.drop("is_outlier")
    if register is not None:
        facts = register if facts is None else register.join(facts, "site_id", "full")
        columns += [c for c in register.columns if c not in columns]
    placed = with_positions(df, "site_id", "timestamp", grid)
    near = carry_known(placed, "site_id", column, facts)
    if outlier_z is not None:
        near = near.withColumn("is_outlier", _is_outlier(F.col(column), outlier_z))
    return near.withColumn(column, _filled(column, max_gap, long_gaps)).select(*columns, BLOCK)


def fill_stretches(
    stretches: DataFrame,
    columns: Sequence[str],
    column: str,
    max_gap: int,
    long_gaps: str,
    freq: str,
    outlier_z: float,
    register: DataFrame | None = None,
) -> DataFrame:
    """``fill_blocks`` of the grid of ``columns`` that stored ``place_on_grid`` stretches stand for.

    Whatever looks at other rows looks at readings: a gap's instants share their neighbours with
    the reading before it, and are made last, row by row.
    """
    _check_long_gaps(long_gaps)
    value = F.col(f"__row.`{column}`")
    readings = stretches.where(F.col("__row").isNotNull()).select("site_id", value.alias(column))
    facts = median_and_mad(readings, column)
    columns = [c for c in columns if c != "is_outlier"] + ["is_outlier"]
    if register is not None:
        facts = register.join(facts, "site_id", "full")
        columns += [c for c in register.columns if c not in columns]
    step = step_micros(freq)
    placed = stretches.withColumns({"__known": value, POS: floor_div(F.col("__at"), step)})
    near = carry_known(placed, "site_id", "__known", facts, own_next=False)
    own = F.col("__slot") == F.col("__at")
    made = {column: F.when(own, F.col("__known")), POS: floor_div(F.col("__slot"), step)}
    slots = with_slots(near, freq).withColumns(made)
    out = {c: F.when(own, F.col(f"__row.`{c}`")) for c in stretches.schema["__row"].dataType.names}
    out |= {
        "site_id": F.col("site_id"),
        "timestamp": F.timestamp_micros("__slot"),
        "is_outlier": _is_outlier(F.col(column), outlier_z),
        column: _filled(column, max_gap, long_gaps),
    }
    return slots.select(*[out.get(c, F.col(c)).alias(c) for c in columns], BLOCK)


def interpolate_short_gaps(
    df: DataFrame,
    column: str = "value",
    max_gap: int = 4,
    long_gaps: str = "partial",
    grid: str | None = None,
    outlier_z: float | None = None,
) -> DataFrame:
    """Fill gaps of nulls between two readings along a straight line, by row.

    The first ``max_gap`` rows of a gap are filled.  ``long_gaps="partial"`` does so
    in longer gaps too; ``"skip"`` leaves gaps longer than ``max_gap`` alone.
    Leading and trailing nulls stay.  ``grid`` names the frequency of a table that is
    already regular and saves numbering its rows.  With ``outlier_z`` the raw values
    are flagged first (as ``flag_outliers`` does) in the same pass.
    Rows without a site or a time are kept as they are.
    """
    return fill_blocks(df, column, max_gap, long_gaps, grid, outlier_z).drop(BLOCK)
