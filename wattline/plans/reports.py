"""Report tables: load profile, forecast against actual, residual histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_calendar_features
from ..functions.time import LOCAL_ZONE
from ..sources.sinks import stage


def load_profile(
    df: DataFrame, site_id: str | None = None, value: str = "value", zone: str = LOCAL_ZONE
) -> DataFrame:
    """Mean demand by local time of day, weekdays and weekends apart."""
    if site_id is not None:
        df = df.where(F.col("site_id") == site_id)
    dated = add_calendar_features(df.select("timestamp", value), "timestamp", zone)
    return (
        dated.groupBy((F.col("is_weekend") == 1).alias("is_weekend"), "minute_of_day")
        .agg(F.avg(value).alias("mean_value"))
        .select(
            "is_weekend",
            "minute_of_day",
            (F.col("minute_of_day") / 60).alias("hour_of_day"),
            "mean_value",
        )
    )


def forecast_vs_actual(predictions: DataFrame, timestamp_col: str = "timestamp") -> DataFrame:
    """Actual and forecast side by side, in time order within a site."""
    return predictions.select(
        "site_id", timestamp_col, F.col("y_true").alias("actual"), F.col("y_pred").alias("forecast")
    )


def residual_histogram(
    predictions: DataFrame, bins: int = 60, y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Counts of forecast minus actual in equal bins over its range.

    Every bin is half open but the last, which includes the maximum.  If all residuals
    are equal the range is widened by one half on either side.

    Predictions are computed once, when called: their residuals are stored as one narrow
    column, which the range and the counts are read from.
    """
    residual = (F.col(y_pred) - F.col(y_true)).alias("r")
    rows = stage(predictions.select(residual).where(F.col("r").isNotNull()))
    edges = rows.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    limits = edges.select(F.struct((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi")))
    lo, hi = F.col("limits.lo"), F.col("limits.hi")
    width = (hi - lo) / F.lit(float(bins))
    counted = (
        rows.withColumn("limits", limits.scalar())
        .select(
            F.least(F.floor((F.col("r") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spark = predictions.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.withColumn("limits", limits.scalar())
        .join(counted, "bin", "left")
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("bin_start"),
            (lo + (F.col("bin") + 1) * width).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
