"""What every forecaster offers.

``fit(train, features, target)`` returns a fitted forecaster and runs no job for the
aggregable models; ``transform(df)`` adds ``prediction``.  ``predict_folds`` fits and
predicts all folds of a marked frame (see ``operators.folds``) in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage

PREDICTION = "prediction"


class Forecaster:
    """A model with its parameters; ``kind`` is its name in the registry."""

    kind = ""

    def params(self) -> dict:
        return dict(vars(self))

    def fit(self, train: DataFrame, features: Sequence[str], target: str = "value") -> Fitted:
        raise NotImplementedError

    def predict_folds(
        self, marked: DataFrame, features: Sequence[str], target: str, timestamp_col: str
    ) -> DataFrame:
        """Test rows of all folds with ``fold`` and ``prediction``.

        The general form fits once per fold; the number of folds is a parameter.  The
        marked rows are written to the shared folder first, since every fold reads them.
        """
        marked = stage(marked)
        found = marked.select(F.max("n_folds")).first()[0] or 0
        parts = []
        for fold in range(found):
            test = marked.where(F.col("test_fold") == fold)
            train = marked.where(F.col("train_from") <= fold)
            if test.isEmpty() or train.isEmpty():
                continue
            fitted = self.fit(train, features, target)
            parts.append(fitted.transform(test).withColumn("fold", F.col("test_fold")))
        if not parts:
            empty = marked.where(F.lit(False))
            return empty.withColumns(
                {"fold": F.col("test_fold"), PREDICTION: F.lit(None).cast("double")}
            )
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


class Fitted:
    """A fitted model: its state is a set of small tables."""

    def __init__(self, model: Forecaster, features: Sequence[str], target: str, tables: dict):
        self.model = model
        self.features = list(features)
        self.target = target
        self.tables = tables

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.apply(self, df)


def spread_to_folds(per_start: DataFrame, n_folds: str = "n_folds") -> DataFrame:
    """Repeat per-``train_from`` aggregates for every fold that trains on them."""
    return per_start.withColumn(
        "fold", F.explode(F.sequence(F.col("train_from"), F.col(n_folds) - 1))
    )
