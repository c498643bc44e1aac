"""Rolling-origin backtests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, metric_columns
from ..models import Forecaster
from ..models.base import PREDICTION, spread_to_folds
from ..operators.features import check_leakage
from ..operators.folds import complete_cases, mark_folds
from ..operators.lookback import Lag, add_lookback

REPORT = ("fold", "train_end", "test_start", "test_end", "n_train", "n_test", *METRICS, "n_pred")


def _marked(df, features, target, n_splits, test_size, gap, unit, timestamp_col):
    """Folds are laid over all rows first; incomplete rows drop out afterwards."""
    marked = mark_folds(df, n_splits, test_size, gap, timestamp_col, unit)
    return complete_cases(marked, [*features, target])


def backtest_predictions(
    model: Forecaster,
    df: DataFrame,
    features: Sequence[str] = (),
    target: str = "value",
    n_splits: int = 5,
    test_size: int = 336,
    gap: int = 0,
    unit: str = "period",
    timestamp_col: str = "timestamp",
    strict_leakage: bool = False,
) -> DataFrame:
    """Test rows of all folds: site_id, timestamp, fold, y_true, y_pred."""
    if strict_leakage:
        check_leakage(features, target, gap)
    marked = _marked(df, features, target, n_splits, test_size, gap, unit, timestamp_col)
    return _predictions(model, marked, features, target, timestamp_col)


def _predictions(model, marked, features, target, timestamp_col):
    scored = model.predict_folds(marked, features, target, timestamp_col)
    return scored.select(
        "site_id",
        timestamp_col,
        "fold",
        F.col(target).alias("y_true"),
        F.col(PREDICTION).alias("y_pred"),
    )


def backtest(
    model: Forecaster,
    df: DataFrame,
    features: Sequence[str] = (),
    target: str = "value",
    n_splits: int = 5,
    test_size: int = 336,
    gap: int = 0,
    unit: str = "period",
    by: Sequence[str] = (),
    season_length: int | None = None,
    grid: str | None = None,
    timestamp_col: str = "timestamp",
    strict_leakage: bool = False,
    extras: bool = False,
) -> DataFrame:
    """One row of errors per fold (and per ``by``), folds numbered from the oldest.

    Errors are over the ``n_pred`` of the ``n_test`` test rows that got a forecast.
    ``extras`` with ``season_length`` adds ``mase``.  Folds without complete rows are left out but
    keep their number.
    """
    if strict_leakage:
        check_leakage(features, target, gap)
    by = list(by)
    marked = _marked(df, features, target, n_splits, test_size, gap, unit, timestamp_col)
    predictions = _predictions(model, marked, features, target, timestamp_col)
    trained = (
        spread_to_folds(
            marked.where(F.col("train_from").isNotNull())
            .groupBy("train_from", "n_folds", *by)
            .agg(F.count(F.lit(1)).alias("n"), F.max(timestamp_col).alias("end"))
        )
        .groupBy("fold", *by)
        .agg(F.max("end").alias("train_end"), F.sum("n").alias("n_train"))
    )
    tested = predictions.groupBy("fold", *by).agg(
        F.min(timestamp_col).alias("test_start"),
        F.max(timestamp_col).alias("test_end"),
        F.count(F.lit(1)).alias("n_test"),
        *metric_columns(),
        F.count("y_pred").alias("n_pred"),
    )
    report = trained.join(tested, ["fold", *by])
    columns = ["fold", *by, *REPORT[1:]]
    if extras:
        if season_length is not None:
            lagged = add_lookback(
                marked, [Lag(target, season_length, "__season")], "site_id", timestamp_col, grid
            )
            step = F.abs(F.col(target) - F.col("__season"))
            scale = (
                spread_to_folds(
                    lagged.where(F.col("train_from").isNotNull())
                    .groupBy("train_from", "n_folds", *by)
                    .agg(F.sum(step).alias("total"), F.count(step).alias("n"))
                )
                .groupBy("fold", *by)
                .agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("scale"))
            )
            report = report.join(scale, ["fold", *by], "left").withColumn(
                "mase", F.col("mae") / F.nullif(F.col("scale"), F.lit(0.0))
            )
            columns.append("mase")
    return report.select(*columns).orderBy("fold", *by)
