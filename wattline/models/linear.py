"""Ridge regression from centred moments.

One aggregate collects means and covariances of all features per group (and fold); what is
left to solve is one small linear system per group, so a fit is a single pass whose shuffle
holds a row per group.  Training sets of nested folds come from the same pass: their parts,
one per fold at most, are merged around their common mean.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantile import join_facts, time_bucket, value_bucket
from .base import PREDICTION, Fitted, Forecaster, spread_to_folds


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def moments(
    rows: DataFrame, group: Sequence[str], features: Sequence[str], target: str
) -> DataFrame:
    """Per group an array ``__parts`` with one element: rows, means and covariances.

    Spark updates both around the running mean, so large offsets do not swallow small
    variations and no pass for the means is needed first.
    """
    columns = [F.col(c).cast("double") for c in [*features, target]]
    n = F.count(F.lit(1))
    means = F.array(*[F.avg(c) for c in columns])
    spreads = F.array(*[F.covar_pop(columns[i], columns[j]) for i, j in _pairs(len(columns))])
    return rows.groupBy(*group).agg(
        F.array(F.struct(n.alias("n"), means.alias("means"), spreads.alias("spreads"))).alias("__parts")
    )


def merged(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Put the parts of the same group together; there is one per fold at most."""
    return parts.groupBy(*group).agg(F.flatten(F.collect_list("__parts")).alias("__parts"))


def solve(parts: DataFrame, group: Sequence[str], k: int, alpha: float) -> DataFrame:
    """Intercept and coefficients per group, the systems of a batch at once."""
    schema = T.StructType(
        [
            *[parts.schema[c] for c in group],
            T.StructField("n_rows", T.LongType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        ]
    )
    names = [*group, "n_rows", "intercept", "coefficients"]
    at = np.array(_pairs(k + 1))

    def merge(several) -> tuple[int, np.ndarray, np.ndarray]:
        n = np.array([p["n"] for p in several], float)
        means = np.array([p["means"] for p in several], float)
        mean = n @ means / n.sum()
        spread = np.zeros((k + 1, k + 1))
        for count, own, p in zip(n, means, several):
            square = np.zeros((k + 1, k + 1))
            square[at[:, 0], at[:, 1]] = square[at[:, 1], at[:, 0]] = p["spreads"]
            spread += count * (square + np.outer(own - mean, own - mean))
        return int(n.sum()), mean, spread

    def solve_batches(batches):
        for batch in batches:
            out = batch[list(group)].copy()
            found = [merge(several) for several in batch["__parts"]]
            left = np.array([s[:k, :k] + alpha * np.eye(k) for _, _, s in found]).reshape(-1, k, k)
            right = np.array([s[:k, k] for _, _, s in found]).reshape(-1, k)
            try:
                coef = np.linalg.solve(left, right[:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:  # some system has no unique solution: the smallest one
                coef = np.array([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(left, right)])
            means = np.array([m for _, m, _ in found]).reshape(-1, k + 1)
            out["n_rows"] = [n for n, _, _ in found]
            out["intercept"] = means[:, k] - (means[:, :k] * coef).sum(axis=1)
            out["coefficients"] = pd.Series(list(coef), index=batch.index, dtype=object)
            yield out[names]

    return parts.where(F.col("__parts")[0]["n"] > 0).mapInPandas(solve_batches, schema)


def _bucket(df: DataFrame) -> Column:
    """How rows of one group are spread when they meet its coefficients."""
    return time_bucket(df) if "timestamp" in df.columns else value_bucket(*df.columns)


def _forecast(features: Sequence[str], intercept, coefficients):
    total = intercept
    for i, c in enumerate(features):
        total = total + coefficients[i] * F.col(c).cast("double")
    return total


class Ridge(Forecaster):
    """Linear regression with an L2 penalty on the (centred) coefficients.

    ``group_cols`` fits one model per group (``["site_id"]`` for local models);
    without it one model covers all rows.
    """

    kind = "ridge"

    def __init__(self, alpha: float = 1.0, group_cols: Sequence[str] = ()):
        self.alpha = float(alpha)
        self.group_cols = tuple(group_cols)

    def fit(self, train: DataFrame, features: Sequence[str], target: str = "value") -> Fitted:
        group = list(self.group_cols)
        table = solve(moments(train, group, features, target), group, len(features), self.alpha)
        return Fitted(self, features, target, {"coefficients": table})

    def apply(self, fitted: Fitted, df: DataFrame) -> DataFrame:
        table = fitted.tables["coefficients"]
        keep = [c for c in df.columns if c != PREDICTION]
        if self.group_cols:
            lookup = table.select(
                *self.group_cols, F.struct("intercept", "coefficients").alias("__fit")
            )
            joined = join_facts(df, lookup, list(self.group_cols), _bucket(df))
        else:
            joined = df.withColumn("__fit", table.select(F.struct("intercept", "coefficients")).scalar())
        forecast = _forecast(
            fitted.features, F.col("__fit.intercept"), F.col("__fit.coefficients")
        )
        return joined.withColumn(PREDICTION, forecast).select(*keep, PREDICTION)

    def predict_folds(self, marked, features, target, timestamp_col):
        group = list(self.group_cols)
        train = marked.where(F.col("train_from").isNotNull())
        parts = moments(train, ["train_from", "n_folds", *group], features, target)
        per_fold = merged(spread_to_folds(parts), ["fold", *group])
        table = solve(per_fold, ["fold", *group], len(features), self.alpha).select(
            "fold", *group, F.struct("intercept", "coefficients").alias("__fit")
        )
        if not group:
            table = F.broadcast(table)  # one row per fold
        test = marked.where(F.col("test_fold").isNotNull()).withColumn("fold", F.col("test_fold"))
        forecast = _forecast(features, F.col("__fit.intercept"), F.col("__fit.coefficients"))
        return (
            test.join(table, ["fold", *group], "left")
            .withColumn(PREDICTION, forecast)
            .drop("__fit")
        )
