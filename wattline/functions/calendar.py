"""Calendar features in local time, cyclical encodings, holiday flags."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .time import (
    DAY_MICROS,
    LOCAL_ZONE,
    MINUTE_MICROS,
    date_of,
    floor_div,
    local_date,
    local_micros,
)

CALENDAR = (
    "hour",
    "minute_of_day",
    "day_of_week",
    "day_of_year",
    "month",
    "year",
    "is_weekend",
)


def clock_columns(micros: Column) -> dict[str, Column]:
    """Minute of the day and date of a wall clock given in microseconds."""
    minute = floor_div(F.pmod(micros, F.lit(DAY_MICROS)), MINUTE_MICROS).cast("int")
    return {"minute_of_day": minute, "__date": date_of(micros)}


def add_calendar_features(
    df: DataFrame, timestamp_col: str = "timestamp", zone: str = LOCAL_ZONE
) -> DataFrame:
    """Add hour, minute_of_day, day_of_week (Monday is 0), day_of_year, month, year, is_weekend.

    Works on the microseconds of the local clock and on the local date, neither of
    which depends on the session time zone.
    """
    clock = df.withColumn("__local", local_micros(timestamp_col, zone)).withColumns(
        clock_columns(F.col("__local"))
    )
    weekday = F.weekday("__date")
    made = clock.withColumns(
        {
            "hour": floor_div(F.col("minute_of_day"), 60).cast("int"),
            "day_of_week": weekday,
            "day_of_year": F.dayofyear("__date"),
            "month": F.month("__date"),
            "year": F.year("__date"),
            "is_weekend": (weekday >= 5).cast("int"),
        }
    )
    kept = [c for c in df.columns if c not in CALENDAR]
    return made.select(*kept, *CALENDAR)


# Prefix -> (source column, length of the cycle).
CYCLES = {
    "tod": ("minute_of_day", 1440.0),
    "doy": ("day_of_year", 365.25),
    "dow": ("day_of_week", 7.0),
}


def add_cyclical_features(df: DataFrame) -> DataFrame:
    """Add sine and cosine of the position in the day, the year and the week."""
    out = {}
    for prefix, (source, length) in CYCLES.items():
        angle = F.lit(2 * pi) * F.col(source) / F.lit(length)
        out[f"{prefix}_sin"] = F.sin(angle)
        out[f"{prefix}_cos"] = F.cos(angle)
    return df.withColumns(out)


HOLIDAY_FLAGS = ("is_holiday", "is_day_before_holiday", "is_day_after_holiday")


def add_holiday_features(
    df: DataFrame,
    holidays: DataFrame | Iterable[date | str] | None = None,
    timestamp_col: str = "timestamp",
    zone: str = LOCAL_ZONE,
) -> DataFrame:
    """Flag holidays and the days either side, on the local date.

    A list of dates becomes a set lookup in the row; a table (its first column is the
    date) is joined once, with every holiday marking three dates.
    """
    if holidays is None:
        return df.withColumns({name: F.lit(0) for name in HOLIDAY_FLAGS})
    on, eve, after = HOLIDAY_FLAGS
    dated = df.drop(*HOLIDAY_FLAGS).withColumn("__date", local_date(timestamp_col, zone))
    if not isinstance(holidays, DataFrame):
        days = [F.lit(d).cast("date") for d in sorted({str(d)[:10] for d in holidays})]

        def flag(offset: int) -> Column:
            hit = F.date_add("__date", offset).isin(days) if days else F.lit(False)
            return F.coalesce(hit, F.lit(False)).cast("int")

        return dated.withColumns({on: flag(0), eve: flag(1), after: flag(-1)}).drop("__date")
    day = F.to_date(F.col(holidays.columns[0]))
    marks = (
        holidays.where(day.isNotNull())
        .select(day.alias("__h"))
        .select("__h", F.explode(F.array(*[F.lit(o) for o in (-1, 0, 1)])).alias("__o"))
        .groupBy(F.date_add("__h", F.col("__o")).alias("__date"))
        .agg(
            F.max((F.col("__o") == 0).cast("int")).alias("__on"),
            F.max((F.col("__o") == -1).cast("int")).alias("__eve"),
            F.max((F.col("__o") == 1).cast("int")).alias("__next"),
        )
    )
    zero = F.lit(0)
    return (
        dated.join(marks, "__date", "left")
        .withColumns(
            {
                on: F.coalesce("__on", zero),
                eve: F.coalesce("__eve", zero),
                after: F.coalesce("__next", zero),
            }
        )
        .drop("__date", "__on", "__eve", "__next")
    )
