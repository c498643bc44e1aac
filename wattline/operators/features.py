"""Lag and rolling features of the target and of temperature."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from .lookback import Lag, Rolling, add_lookback


def target_lag_specs(target: str, lags: Sequence[int]) -> list[Lag]:
    return [Lag(target, n, f"{target}_lag_{n}") for n in lags]


def rolling_specs(
    column: str, windows: Sequence[int], stats: Sequence[str] = ("mean", "std"), shift: int = 1
) -> list[Rolling]:
    return [
        Rolling(column, n, stat, f"{column}_roll_{stat}_{n}", shift)
        for n in windows
        for stat in stats
    ]


def weather_specs(
    temp_col: str, lags: Sequence[int], windows: Sequence[int]
) -> list[Lag | Rolling]:
    return [*target_lag_specs(temp_col, lags), *rolling_specs(temp_col, windows, ("mean",))]


def add_target_lags(
    df: DataFrame,
    target: str = "value",
    lags: Sequence[int] = (1, 2, 48, 96, 336),
    group_col: str | Sequence[str] = "site_id",
    grid: str | None = None,
    reindex: bool = False,
) -> DataFrame:
    """Add ``<target>_lag_<n>``: the value ``n`` rows earlier at the same site.

    With ``reindex`` readings are put on ``grid`` first, as by ``reindex_to_grid``.
    """
    return add_lookback(df, target_lag_specs(target, lags), group_col, grid=grid, reindex=reindex)


def add_rolling_features(
    df: DataFrame,
    target: str = "value",
    windows: Sequence[int] = (48, 336),
    group_col: str | Sequence[str] = "site_id",
    stats: Sequence[str] = ("mean", "std"),
    shift: int = 1,
    grid: str | None = None,
    reindex: bool = False,
) -> DataFrame:
    """Add rolling statistics of the ``w`` rows ending ``shift`` rows earlier.

    Known values only; null below ``max(1, w // 4)`` of them.  The standard
    deviation is the sample one.  With ``reindex`` readings are put on ``grid`` first, as by
    ``reindex_to_grid``.
    """
    return add_lookback(df, rolling_specs(target, windows, stats, shift), group_col, grid=grid, reindex=reindex)


def add_weather_lags(
    df: DataFrame,
    temp_col: str = "temperature_c",
    lags: Sequence[int] = (1, 2, 4, 48),
    windows: Sequence[int] = (48, 336),
    grid: str | None = None,
) -> DataFrame:
    """Add lagged and rolling mean temperature."""
    return add_lookback(df, weather_specs(temp_col, lags, windows), "site_id", grid=grid)


def check_leakage(features: Iterable[str], target: str, gap: int, shift: int = 1) -> None:
    """Raise if a feature of the target looks at periods inside the blind gap."""
    late = []
    for name in features:
        head, _, tail = name.rpartition("_")
        if head == f"{target}_lag" and tail.isdigit() and int(tail) < gap:
            late.append(name)
        elif name.startswith(f"{target}_roll_") and shift < gap:
            late.append(name)
    if late:
        raise ValueError(f"Features see into the gap of {gap} periods: {late}")
