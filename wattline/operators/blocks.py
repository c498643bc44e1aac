"""Blocked panels: ordered work on a series without one task per series.

A window partitioned by site alone puts a whole series in one task, so a site
holding a third of all rows would set the run time of every lag, fill and rolling
feature.  Here each series is cut into *blocks* of consecutive rows, and the unit
of work is (site, block):

* ``with_positions`` numbers the rows of each series (0, 1, 2, ...).  On a regular
  grid the number is the period index of the timestamp and costs nothing;
  otherwise rows are counted per time bucket and the counts are summed up first.
* ``with_halo`` hands every row to its own block and, when it lies within the
  look-back of the next block, to that block as well.  Look-back windows are then
  exact inside a block; ``drop_halo`` removes the copies.
* ``carry_known`` brings the nearest known value before and after a block, however
  far away, from a summary holding one row per block.

Blocks hold ``BLOCK_ROWS`` rows or 16 look-backs, whichever is larger, so the
copies stay below one row in sixteen.  The only per-site windows run on block
summaries, which are that many times smaller than the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div, period_index, step_micros

POS = "__pos"
BLOCK = "__block"
BLOCK_ROWS = 65_536

# Time bucket used to number rows of a table that is not on a regular grid.  A day keeps
# both sides small: the rows of one bucket, and the buckets of one series.
BUCKET = "1 day"


def key_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def block_rows(lookback: int = 0) -> int:
    return max(BLOCK_ROWS, 16 * lookback)


def prefix_offsets(counts: DataFrame, keys: list[str], block: str, n: str) -> DataFrame:
    """Rows of the same series in earlier blocks, per (series, block)."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *keys, block, F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")).alias("__offset")
    )


# Rows without a key or a time belong to no series.  They have no position, and are dealt
# over so many blocks of their own, below all others.
LOOSE_BLOCKS = 1 << 20


def in_series(keys: Sequence[str], ts: str) -> Column:
    sound = F.col(ts).isNotNull()
    for c in keys:
        sound = sound & F.col(c).isNotNull()
    return sound


def loose_block(columns: Sequence[str]) -> Column:
    return (F.lit(-(1 << 40)) - F.pmod(F.xxhash64(*columns), F.lit(LOOSE_BLOCKS))).cast("long")


def with_positions(
    df: DataFrame,
    keys: str | Sequence[str] = "site_id",
    ts: str = "timestamp",
    grid: str | None = None,
    bucket: str = BUCKET,
) -> DataFrame:
    """Add ``__pos``, a long that grows by one from row to row of a series.

    ``grid`` names the frequency of a regular, gap-free table (the output of
    ``reindex_to_grid``).  Without it rows are numbered in time order; the table
    must hold one row per (series, timestamp) for the order to be defined.
    """
    keys = key_list(keys)
    sound = in_series(keys, ts)
    if grid is not None:
        return df.withColumn(POS, F.when(sound, period_index(ts, step_micros(grid))))
    number = F.when(sound, period_index(ts, step_micros(bucket))).otherwise(loose_block(df.columns))
    bucketed = df.withColumn("__bucket", number)
    counts = bucketed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = prefix_offsets(counts, keys, "__bucket", "__n")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(F.col(ts).asc_nulls_last())
    ranked = bucketed.withColumn("__rn", F.row_number().over(inside))
    joined = ranked.join(offsets, [*keys, "__bucket"], "left")
    return joined.withColumn(POS, F.when(sound, F.col("__offset") + F.col("__rn") - 1)).drop(
        "__bucket", "__rn", "__offset"
    )


def own_block(rows: int) -> Column:
    return floor_div(F.col(POS), rows)


def with_halo(df: DataFrame, lookback: int, lookahead: int = 0) -> tuple[DataFrame, int]:
    """Copy rows into every block that looks back (or ahead) at them.

    Rows without a position (no site, say) are kept and spread by their content.
    """
    rows = block_rows(max(lookback, lookahead))
    first = floor_div(F.col(POS) - lookahead, rows) if lookahead else own_block(rows)
    last = floor_div(F.col(POS) + lookback, rows) if lookback else own_block(rows)
    spread = F.array(loose_block(df.columns))
    blocks = F.when(F.col(POS).isNotNull(), F.sequence(first, last)).otherwise(spread)
    return df.withColumn(BLOCK, F.explode(blocks)), rows


def drop_halo(df: DataFrame, rows: int) -> DataFrame:
    return df.where(F.col(POS).isNull() | (F.col(BLOCK) == own_block(rows))).drop(BLOCK, POS)


def block_window(keys: str | Sequence[str]) -> Window:
    return Window.partitionBy(*key_list(keys), BLOCK).orderBy(POS)


def carry_known(
    df: DataFrame,
    keys: str | Sequence[str],
    column: str,
    facts: DataFrame | None = None,
    own_next: bool = True,
) -> DataFrame:
    """Add position and value of the previous and next known ``column``.

    Adds ``__prev_pos, __prev_val, __next_pos, __next_val`` (a known row is its own
    previous and, with ``own_next``, its own next), and ``__block``.  Needs ``__pos``.  ``facts``, one row per series, is attached
    to the block summary and so reaches the rows without a join on the series alone.
    """
    keys = key_list(keys)
    blocked = df.withColumn(BLOCK, F.coalesce(own_block(block_rows()), loose_block(df.columns)))
    known_pos = F.when(F.col(column).isNotNull(), F.col(POS))
    edges = blocked.groupBy(*keys, BLOCK).agg(
        F.max(known_pos).alias("__lp"),
        F.max_by(F.col(column), known_pos).alias("__lv"),
        F.min(known_pos).alias("__fp"),
        F.min_by(F.col(column), known_pos).alias("__fv"),
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    later = (
        Window.partitionBy(*keys)
        .orderBy(F.col(BLOCK).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(
        *keys,
        BLOCK,
        F.last("__lp", ignorenulls=True).over(earlier).alias("__cpp"),
        F.last("__lv", ignorenulls=True).over(earlier).alias("__cpv"),
        F.last("__fp", ignorenulls=True).over(later).alias("__cnp"),
        F.last("__fv", ignorenulls=True).over(later).alias("__cnv"),
    )
    if facts is not None:
        carried = carried.join(facts, keys, "left")
    up_to = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    down_to = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(F.col(POS).desc())
        .rowsBetween(Window.unboundedPreceding, 0 if own_next else -1)
    )
    near = blocked.withColumns(
        {
            "__pp": F.last(known_pos, ignorenulls=True).over(up_to),
            "__pv": F.last(column, ignorenulls=True).over(up_to),
            "__np": F.last(known_pos, ignorenulls=True).over(down_to),
            "__nv": F.last(column, ignorenulls=True).over(down_to),
        }
    )
    joined = near.join(carried, [*keys, BLOCK], "left")
    return joined.withColumns(
        {
            "__prev_pos": F.coalesce("__pp", "__cpp"),
            "__prev_val": F.coalesce("__pv", "__cpv"),
            "__next_pos": F.coalesce("__np", "__cnp"),
            "__next_val": F.coalesce("__nv", "__cnv"),
        }
    ).drop("__pp", "__pv", "__np", "__nv", "__cpp", "__cpv", "__cnp", "__cnv")
