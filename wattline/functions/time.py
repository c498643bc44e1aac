"""Time helpers that do not depend on the session time zone.

Every instant is a ``TIMESTAMP`` (UTC microseconds).  A *wall clock* is a
``TIMESTAMP_NTZ``.  Conversions go through the microsecond count, so the same
query gives the same answer under any ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/London"

DAY_MICROS = 86_400_000_000
MINUTE_MICROS = 60_000_000

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"

# Microseconds per frequency unit.
_UNIT_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "second": 1_000_000,
    "seconds": 1_000_000,
    "min": 60_000_000,
    "t": 60_000_000,
    "minute": 60_000_000,
    "minutes": 60_000_000,
    "h": 3_600_000_000,
    "hour": 3_600_000_000,
    "hours": 3_600_000_000,
    "d": 86_400_000_000,
    "day": 86_400_000_000,
    "days": 86_400_000_000,
    "w": 604_800_000_000,
    "week": 604_800_000_000,
    "weeks": 604_800_000_000,
}


def step_micros(freq: str) -> int:
    """Length of a fixed frequency such as ``30min``, ``1D`` or ``2 hours``."""
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq)
    if not match or match.group(2).lower() not in _UNIT_MICROS:
        raise ValueError(f"Not a fixed frequency: {freq!r}")
    step = int(match.group(1) or 1) * _UNIT_MICROS[match.group(2).lower()]
    if step <= 0:
        raise ValueError(f"Frequency must be positive: {freq!r}")
    return step


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(wall: str | Column) -> Column:
    """A UTC wall clock (``TIMESTAMP_NTZ``) as an instant."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _col(wall)))


def utc_wall(ts: str | Column) -> Column:
    """An instant as its UTC wall clock (``TIMESTAMP_NTZ``)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_col(ts)), F.expr(_EPOCH))


def local_micros(ts: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock of ``zone`` as microseconds since 1970 on that clock."""
    return F.unix_micros(F.from_utc_timestamp(_col(ts), zone))


def local_date(ts: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Date of an instant on the wall clock of ``zone``."""
    return date_of(local_micros(ts, zone))


def date_of(micros: Column) -> Column:
    """Date of a wall clock given in microseconds."""
    return F.date_from_unix_date(floor_div(micros, DAY_MICROS).cast("int"))


def local_wall(ts: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """An instant as the wall clock of ``zone`` (``TIMESTAMP_NTZ``)."""
    return utc_wall(F.from_utc_timestamp(_col(ts), zone))


def floor_div(value: Column, size: int) -> Column:
    """Integer floor division of a long column, also for negative values."""
    unit = F.lit(size).cast("long")
    return F.call_function("div", value - F.pmod(value, unit), unit)


def period_index(ts: str | Column, step: int) -> Column:
    """Number of the period holding ``ts``; consecutive along a regular grid."""
    return floor_div(F.unix_micros(_col(ts)), step)


def floor_to(ts: str | Column, freq: str) -> Column:
    """Start of the UTC period of length ``freq`` holding ``ts``."""
    micros = F.unix_micros(_col(ts))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(step_micros(freq))))


# A zone after a time of day: Z, or an offset with or without minutes and colon.
ZONED = r"(?i)^(.*\d:\d{2}\S*?)\s*(?:(Z|UTC)|([+-]\d{1,2}):?(\d{2})?)$"


def parse_instant(text: Column) -> Column:
    """ISO text as an instant: an offset is honoured, otherwise the text is UTC.

    ``+01``, ``+0100``, ``+01:00`` and ``Z`` are offsets; ``-01`` of a date is none, as no
    time stands before it.
    """
    text = F.trim(text)
    part = lambda i: F.regexp_extract(text, ZONED, i)
    zoned = text.rlike(ZONED)
    wall = F.when(zoned, part(1)).otherwise(text).cast("timestamp_ntz")
    hours = F.nullif(part(3), F.lit("")).cast("int")
    minutes = F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))
    ahead = F.coalesce(hours * 60 + F.when(part(3).startswith("-"), -minutes).otherwise(minutes), F.lit(0))
    micros = F.unix_micros(instant(wall)) - F.when(zoned, ahead).otherwise(F.lit(0)).cast("long") * F.lit(MINUTE_MICROS)
    return F.timestamp_micros(micros)


def utc_instant(text: str) -> Column:
    """A literal such as ``2025-01-01`` or ``2025-01-01 06:30`` read as UTC.

    An explicit offset (``+01:00``, ``+01``, ``Z``) after a time is honoured.
    """
    return parse_instant(F.lit(text))
