"""Rounding shared by the Spark and SQL sides of a registered query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import utc_wall


class Nudged(int):
    """Digits to round to after moving values off the halves.

    Means of decimal readings often lie exactly half way between two rounded values,
    where the last bit of a sum decides; a small common offset settles them.
    """

    @property
    def offset(self) -> str:
        return f"1.23e-{int(self) + 2}"


def sql_round(expression: str, digits: int) -> str:
    if isinstance(digits, Nudged):
        expression = f"{expression} + {digits.offset}"
    return f"round({expression}, {int(digits)})"


# Below this size of a scaled value its fraction is known to a thousandth.
_EXACT = float(1 << 40)


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of a floating column, in whole numbers where both surely agree.

    ``F.round`` goes through decimals, which costs more than the feature itself.  It stays for values
    close to a half, where the last bit decides, and for very large ones, infinities and NaN.
    """
    scale = F.lit(10.0**digits)
    scaled = F.abs(x) * scale
    fraction = F.pmod(scaled, F.lit(1.0))
    sure = (scaled < F.lit(_EXACT)) & (F.abs(fraction - F.lit(0.5)) > F.lit(1e-3))
    whole = F.floor(scaled + F.lit(0.5))
    return F.when(sure, F.when(x < 0, -whole).otherwise(whole) / scale).otherwise(F.round(x, digits))


def shown(df: DataFrame, **digits: int) -> DataFrame:
    """Instants as UTC wall clocks, floating columns rounded as asked."""
    cols: list[Column] = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            col = utc_wall(col)
        if f.name in digits:
            d = digits[f.name]
            col = col + F.lit(float(d.offset)) if isinstance(d, Nudged) else col
            col = rounded(col, int(d)) if isinstance(f.dataType, T.DoubleType) else F.round(col, int(d))
        cols.append(col.alias(f.name))
    return df.select(*cols)
