"""Training, prediction and direct multi-step forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import step_micros
from ..models import Fitted, Forecaster, Ridge, build_model
from ..operators.blocks import block_window, drop_halo, with_halo, with_positions
from ..operators.folds import complete_cases, time_split
from ..sources.models import load_model, save_model
from ..sources.sinks import stage


def fit_until(
    df: DataFrame,
    features: Sequence[str],
    test_start: str,
    target: str = "value",
    model: str = "lightgbm",
    **params,
) -> Fitted:
    """Fit a registered model on the complete rows before ``test_start``."""
    before, _ = time_split(df, test_start)
    rows = complete_cases(before, [*features, target])
    return build_model(model, **params).fit(rows, features, target)


def train(
    df: DataFrame,
    path: str,
    features: Sequence[str],
    test_start: str,
    target: str = "value",
    model: str = "lightgbm",
    **params,
) -> str:
    """Fit as ``fit_until`` does and save the bundle under ``path``."""
    return save_model(df.sparkSession, fit_until(df, features, test_start, target, model, **params), path)


def predict(fitted: Fitted | str, df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Add ``prediction``; ``fitted`` is a model or the path of a saved bundle."""
    if isinstance(fitted, str):
        fitted = load_model(spark or df.sparkSession, fitted)
    return fitted.transform(df)


def direct_horizon_frame(
    df: DataFrame,
    horizon: int,
    target: str = "value",
    group_col: str = "site_id",
    grid: str | None = None,
    steps: Sequence[int] | None = None,
) -> DataFrame:
    """Training rows for direct forecasts: each origin row once per step ahead.

    Adds ``step`` and ``<target>_ahead``, the value ``step`` rows later at the same site;
    pairs whose later value is unknown are left out.
    """
    steps = list(steps or range(1, horizon + 1))
    placed, rows = with_halo(
        with_positions(df, group_col, "timestamp", grid), lookback=0, lookahead=max(steps)
    )
    w = block_window(group_col)
    pairs = F.array(
        *[
            F.struct(F.lit(h).alias("step"), F.lead(target, h).over(w).alias("ahead"))
            for h in steps
        ]
    )
    wide = drop_halo(placed.withColumn("__pairs", pairs), rows)
    return (
        wide.withColumn("__pair", F.explode("__pairs"))
        .where(F.col("__pair.ahead").isNotNull())
        .select(
            *df.columns,
            F.col("__pair.step").alias("step"),
            F.col("__pair.ahead").alias(f"{target}_ahead"),
        )
    )


class Direct:
    """One fitted model per step ahead; ``transform`` gives each row its step's forecast."""

    def __init__(self, features: Sequence[str], by_step: dict[int, Fitted]):
        self.features = list(features)
        self.by_step = by_step

    def transform(self, df: DataFrame) -> DataFrame:
        parts = [f.transform(df.where(F.col("step") == h)) for h, f in self.by_step.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def fit_direct(
    df: DataFrame,
    features: Sequence[str],
    horizon: int,
    target: str = "value",
    alpha: float = 1.0,
    grid: str | None = None,
    model: Forecaster | None = None,
) -> Fitted | Direct:
    """Direct forecasts: a model per step ahead (by default ridge with ``alpha``).

    Models that are fitted per group (``group_cols``) take the step as one more group and
    are fitted in one pass; any other model is fitted once per step.
    """
    ahead = f"{target}_ahead"
    frame = direct_horizon_frame(df, horizon, target, grid=grid)
    rows = complete_cases(frame, [*features, ahead])
    model = model or Ridge(alpha)
    if hasattr(model, "group_cols"):
        by_step = copy(model)
        by_step.group_cols = ("step", *model.group_cols)
        return by_step.fit(rows, features, ahead)
    rows = stage(rows)
    steps = range(1, horizon + 1)
    return Direct(features, {h: model.fit(rows.where(F.col("step") == h), features, ahead) for h in steps})


def forecast_horizon(
    fitted: Fitted | Direct, df: DataFrame, horizon: int, freq: str = "30min"
) -> DataFrame:
    """Forecast the next ``horizon`` periods of every site from its latest complete row."""
    rows = complete_cases(df, fitted.features)
    latest = (
        rows.groupBy("site_id")
        .agg(F.max_by(F.struct("timestamp", *fitted.features), "timestamp").alias("__last"))
        .select("site_id", "__last.*")
    )
    origins = latest.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = F.unix_micros("timestamp") + F.col("step") * F.lit(step_micros(freq)).cast("long")
    return (
        fitted.transform(origins)
        .withColumn("target_timestamp", F.timestamp_micros(ahead))
        .select("site_id", "timestamp", "step", "target_timestamp", "prediction")
    )
