"""Forecast errors as aggregate expressions and as reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import key_list
from ..operators.lookback import Lag, add_lookback

EPSILON = 1e-8
METRICS = ("mae", "rmse", "mape", "smape", "bias")


def _pair(y_true: str | Column, y_pred: str | Column) -> tuple[Column, Column]:
    return tuple(F.col(c) if isinstance(c, str) else c for c in (y_true, y_pred))


def mae(y_true="y_true", y_pred="y_pred") -> Column:
    """Mean absolute error."""
    y, p = _pair(y_true, y_pred)
    return F.avg(F.abs(y - p))


def rmse(y_true="y_true", y_pred="y_pred") -> Column:
    """Root of the mean squared error."""
    y, p = _pair(y_true, y_pred)
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y_true="y_true", y_pred="y_pred", epsilon: float = EPSILON) -> Column:
    """Mean absolute error in percent of the actual value."""
    y, p = _pair(y_true, y_pred)
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(epsilon))) * 100


def smape(y_true="y_true", y_pred="y_pred", epsilon: float = EPSILON) -> Column:
    """Mean absolute error in percent of the mean of actual and forecast size."""
    y, p = _pair(y_true, y_pred)
    return F.avg(F.abs(y - p) / F.greatest((F.abs(y) + F.abs(p)) / 2, F.lit(epsilon))) * 100


def bias(y_true="y_true", y_pred="y_pred") -> Column:
    """Mean of forecast minus actual; positive when the forecast is too high."""
    y, p = _pair(y_true, y_pred)
    return F.avg(p - y)


_EXPRESSIONS = {"mae": mae, "rmse": rmse, "mape": mape, "smape": smape, "bias": bias}


def metric_columns(y_true="y_true", y_pred="y_pred") -> list[Column]:
    """The five standard errors, in report order."""
    return [_EXPRESSIONS[name](y_true, y_pred).alias(name) for name in METRICS]


def all_metrics(
    df: DataFrame, by: str | Sequence[str] = (), y_true="y_true", y_pred="y_pred"
) -> DataFrame:
    """The five standard errors, pooled or per group."""
    return df.groupBy(*key_list(by)).agg(*metric_columns(y_true, y_pred))


def metrics_report(
    df: DataFrame, by: str = "site_id", y_true="y_true", y_pred="y_pred"
) -> DataFrame:
    """Errors per ``by`` and pooled (``level`` is ``site`` or ``pooled``) in one pass."""
    report = df.rollup(by).agg(
        F.grouping(by).alias("__pooled"),
        F.count(F.lit(1)).alias("n"),
        *metric_columns(y_true, y_pred),
    )
    level = F.when(F.col("__pooled") == 1, "pooled").otherwise("site")
    return report.select(level.alias("level"), by, "n", *METRICS)


def seasonal_scale(
    train: DataFrame,
    season_length: int = 336,
    by: str | Sequence[str] = (),
    value: str = "value",
    keys: str | Sequence[str] = "site_id",
    ts: str = "timestamp",
    grid: str | None = None,
) -> DataFrame:
    """Mean absolute seasonal difference of the history, per group (``scale``)."""
    lagged = add_lookback(train, [Lag(value, season_length, "__season")], keys, ts, grid)
    return lagged.groupBy(*key_list(by)).agg(
        F.avg(F.abs(F.col(value) - F.col("__season"))).alias("scale")
    )


def mase(
    predictions: DataFrame,
    train: DataFrame,
    season_length: int = 336,
    by: str | Sequence[str] = (),
    value: str = "value",
    keys: str | Sequence[str] = "site_id",
    ts: str = "timestamp",
    grid: str | None = None,
    on_zero: str = "raise",
    y_true="y_true",
    y_pred="y_pred",
) -> DataFrame:
    """Mean absolute error over the mean absolute seasonal difference of the history.

    Null when the history is shorter than a season.  A scale of zero raises, or
    gives null with ``on_zero="null"``.
    """
    if on_zero not in ("raise", "null"):
        raise ValueError(f"on_zero must be 'raise' or 'null', not {on_zero!r}")
    by = key_list(by)
    errors = predictions.groupBy(*by).agg(mae(y_true, y_pred).alias("__mae"))
    scales = seasonal_scale(train, season_length, by, value, keys, ts, grid)
    if by:
        both = errors.join(scales, by, "left")
    else:
        both = errors.withColumn("scale", scales.scalar())
    ratio = F.col("__mae") / F.nullif(F.col("scale"), F.lit(0.0))
    if on_zero == "raise":
        message = "MASE has no value: the history repeats every season without a change."
        ratio = F.when(F.col("scale") == 0, F.raise_error(F.lit(message)).cast("double")).otherwise(
            ratio
        )
    return both.select(*by, ratio.alias("mase"))
