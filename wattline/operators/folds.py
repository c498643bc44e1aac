"""Forward-chaining folds, the time split and complete cases.

Training sets of expanding folds are nested, so a row is described by two numbers:
the test fold it is in (``test_fold``, or null) and the first fold that trains on
it (``train_from``, or null).  Aggregates are taken once per ``train_from`` and
summed up over folds afterwards; rows are only repeated per fold when asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import utc_instant


def time_split(
    df: DataFrame, cutoff: str, timestamp_col: str = "timestamp"
) -> tuple[DataFrame, DataFrame]:
    """(before, from) a cutoff read as UTC."""
    cut = utc_instant(cutoff)
    return df.where(F.col(timestamp_col) < cut), df.where(F.col(timestamp_col) >= cut)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where none of ``columns`` is null or NaN."""
    return df.na.drop(subset=list(dict.fromkeys(columns)))


def _place(unit: str, timestamp_col: str, tie: Sequence[str]) -> Column:
    """Sort key of a row: its instant, and in row mode the tie-breakers too."""
    cols = [F.col(timestamp_col).alias("at")]
    if unit == "row":
        cols += [F.col(c).alias(f"tie{i}") for i, c in enumerate(tie)]
    return F.struct(*cols)


def fold_bounds(
    df: DataFrame,
    n_splits: int = 5,
    test_size: int = 336,
    gap: int = 0,
    timestamp_col: str = "timestamp",
    unit: str = "period",
    tie: Sequence[str] = ("site_id",),
) -> DataFrame:
    """One row holding the edges of every fold.

    ``unit="period"`` counts distinct timestamps; ``"row"`` counts rows in
    (timestamp, tie) order.  Columns ``start_i``, ``end_i``, ``train_i`` belong to the
    i-th newest fold (``train_i`` is its last training place, null when the fold has
    no training rows) and ``n_folds`` counts the usable folds.

    Only the latest ``n_splits * test_size + gap + 1`` places are ranked, so the
    ranking is bounded by the parameters and not by the table.
    """
    if unit not in ("period", "row"):
        raise ValueError(f"unit must be 'period' or 'row', not {unit!r}")
    places = df.where(F.col(timestamp_col).isNotNull()).select(
        _place(unit, timestamp_col, tie).alias("place")
    )
    if unit == "period":
        places = places.distinct()
    latest = places.orderBy(F.col("place").desc()).limit(n_splits * test_size + gap + 1)
    ranked = latest.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("place").desc()))
    )

    def at(rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("place")))

    edges = []
    for i in range(n_splits):
        edges += [
            at((i + 1) * test_size).alias(f"start_{i}"),
            at(i * test_size + 1).alias(f"end_{i}"),
            at((i + 1) * test_size + gap + 1).alias(f"train_{i}"),
        ]
    usable = sum((F.col(f"train_{i}").isNotNull().cast("int") for i in range(n_splits)), F.lit(0))
    return ranked.agg(*edges).withColumn("n_folds", usable)


def fold_columns(
    bounds: Column, place: Column, n_splits: int
) -> dict[str, Column]:
    """``test_fold`` and ``train_from`` of a row, from the edges of ``fold_bounds``."""
    test, train = F.lit(None).cast("int"), F.lit(None).cast("int")
    last = bounds["n_folds"] - 1
    for i in reversed(range(n_splits)):
        usable = bounds[f"train_{i}"].isNotNull()
        inside = (place >= bounds[f"start_{i}"]) & (place <= bounds[f"end_{i}"])
        test = F.when(usable & inside, last - i).otherwise(test)
    for i in range(n_splits):
        train = F.when(place <= bounds[f"train_{i}"], last - i).otherwise(train)
    return {"test_fold": test, "train_from": train}


def mark_folds(
    df: DataFrame,
    n_splits: int = 5,
    test_size: int = 336,
    gap: int = 0,
    timestamp_col: str = "timestamp",
    unit: str = "period",
    tie: Sequence[str] = ("site_id",),
) -> DataFrame:
    """Add ``test_fold``, ``train_from``, ``n_folds`` and the folds' edges ``__bounds``."""
    bounds = fold_bounds(df, n_splits, test_size, gap, timestamp_col, unit, tie)
    edges = bounds.select(F.struct("*").alias("b")).scalar()
    marked = df.withColumn("__bounds", edges).withColumn(
        "__place", _place(unit, timestamp_col, tie)
    )
    return (
        marked.withColumns(fold_columns(F.col("__bounds"), F.col("__place"), n_splits))
        .withColumn("n_folds", F.col("__bounds.n_folds"))
        .drop("__place")
    )


def rolling_origin_splits(
    df: DataFrame,
    n_splits: int = 5,
    test_size: int = 336,
    gap: int = 0,
    timestamp_col: str = "timestamp",
    unit: str = "period",
    tie: Sequence[str] = ("site_id",),
) -> DataFrame:
    """Rows of every fold, tagged with ``fold`` (0 = oldest) and ``part``.

    Folds without training rows are left out and do not use up a number.  A training
    row appears once per fold that trains on it.
    """
    marked = mark_folds(df, n_splits, test_size, gap, timestamp_col, unit, tie)
    trains = F.when(
        F.col("train_from").isNotNull(),
        F.transform(
            F.sequence(F.col("train_from"), F.col("n_folds") - 1),
            lambda f: F.struct(f.alias("fold"), F.lit("train").alias("part")),
        ),
    ).otherwise(F.array().cast("array<struct<fold:int,part:string>>"))
    tests = F.when(
        F.col("test_fold").isNotNull(),
        F.array(F.struct(F.col("test_fold").alias("fold"), F.lit("test").alias("part"))),
    ).otherwise(F.array().cast("array<struct<fold:int,part:string>>"))
    return marked.withColumn("__tag", F.explode(F.concat(trains, tests))).select(
        *df.columns, F.col("__tag.fold").alias("fold"), F.col("__tag.part").alias("part")
    )
