"""Table contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED_COLUMNS = ("site_id", "timestamp", "value")

METER = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
    ]
)

SITES = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("trust_name", T.StringType()),
        T.StructField("site_type", T.StringType()),
        T.StructField("gia_m2", T.DoubleType()),
        T.StructField("beds", T.IntegerType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

WEATHER = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("temperature_c", T.DoubleType()),
        T.StructField("humidity_pct", T.DoubleType()),
        T.StructField("wind_speed_ms", T.DoubleType()),
        T.StructField("solar_irradiance_wm2", T.DoubleType()),
    ]
)


def validate_schema(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    """Raise unless the required columns exist and ``timestamp`` is an instant.

    Looks at the schema only; no job runs.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    if "timestamp" in df.columns:
        kind = df.schema["timestamp"].dataType
        if isinstance(kind, T.TimestampNTZType):
            raise TypeError("'timestamp' must be tz-aware (an instant, stored in UTC)")
        if not isinstance(kind, T.TimestampType):
            raise TypeError("'timestamp' must be a timestamp")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating column: missing data has one form."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in floating})
