"""The model-ready feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import (
    add_calendar_features,
    add_cyclical_features,
    add_holiday_features,
)
from ..functions.time import step_micros, utc_instant
from ..functions.weather import add_degree_days
from ..operators.features import rolling_specs, target_lag_specs, weather_specs
from ..operators.lookback import Lag, add_lookback
from ..sources.sinks import write_panel

WEATHER_LAGS = (1, 2, 4, 48)
WEATHER_WINDOWS = (48, 336)


def build_features(
    df: DataFrame,
    target: str = "value",
    target_lags: Sequence[int] = (1, 48, 336),
    rolling_windows: Sequence[int] = (48, 336),
    use_weather: bool = True,
    temp_col: str = "temperature_c",
    holidays=None,
    grid: str | None = "30min",
    shift: int = 1,
    since: str | None = None,
) -> DataFrame:
    """Calendar, cyclical, holiday, degree, lag and rolling features.

    All look-back features share one exchange and one sort; the others are computed
    row by row after it.  ``grid`` is the frequency of the gap-free table the dataset
    job writes; ``None`` counts rows of any table instead.  With ``since`` only rows from
    that UTC time on are returned, and only as much history is read as they need.
    """
    specs = []
    weather = use_weather and temp_col in df.columns
    if weather:
        specs += weather_specs(temp_col, WEATHER_LAGS, WEATHER_WINDOWS)
    specs += target_lag_specs(target, target_lags)
    specs += rolling_specs(target, rolling_windows, shift=shift)
    if since is not None:
        if grid is None:
            raise ValueError("since needs a regular table (grid)")
        reach = max(s.periods if isinstance(s, Lag) else s.window + s.shift - 1 for s in specs)
        start = F.unix_micros(utc_instant(since)) - F.lit(reach * step_micros(grid))
        df = df.where(F.col("timestamp") >= F.timestamp_micros(start))
    out = add_lookback(df, specs, "site_id", grid=grid)
    if since is not None:
        out = out.where(F.col("timestamp") >= utc_instant(since))
    out = add_cyclical_features(add_calendar_features(out))
    out = add_holiday_features(out, holidays)
    if weather:
        out = add_degree_days(out, temp_col)
    return out.select(*_ordered(df.columns, out.columns, specs, weather))


def _ordered(given: list[str], made: list[str], specs, weather: bool) -> list[str]:
    """Input columns first, then features block by block."""
    looked = [s.name for s in specs]
    plain = [c for c in made if c not in given and c not in looked]
    return [*[c for c in given if c in made and c not in looked], *plain, *looked]


def write_features(df: DataFrame, path: str, **params) -> str:
    """Build the feature table and write it, clustered by site and time."""
    return write_panel(build_features(df, **params), path)
