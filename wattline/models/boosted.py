"""Gradient-boosted trees on Spark ML, of balanced depth (``leafwise`` grows by leaf)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import remove, shared_dir, stage
from .base import PREDICTION, Fitted, Forecaster

_VECTOR = "__features"


class BoostedTrees(Forecaster):
    """Boosted regression trees with the usual parameter names.

    ``num_leaves`` becomes the depth of a balanced tree with that many leaves.
    Parameters with no counterpart (``subsample_freq``, ``n_jobs``, ``verbose``) are
    accepted and ignored.
    """

    kind = "gbt"

    def __init__(
        self,
        n_estimators: int = 100,
        learning_rate: float = 0.1,
        num_leaves: int = 31,
        min_child_samples: int = 20,
        subsample: float = 1.0,
        colsample_bytree: float = 1.0,
        random_state: int = 42,
        subsample_freq: int = 0,
        n_jobs: int = -1,
        verbose: int = -1,
    ):
        self.n_estimators = n_estimators
        self.learning_rate = learning_rate
        self.num_leaves = num_leaves
        self.min_child_samples = min_child_samples
        self.subsample = subsample
        self.colsample_bytree = colsample_bytree
        self.random_state = random_state
        self.subsample_freq = subsample_freq
        self.n_jobs = n_jobs
        self.verbose = verbose

    def _stages(self, features: Sequence[str], target: str) -> Pipeline:
        assembler = VectorAssembler(
            inputCols=list(features), outputCol=_VECTOR, handleInvalid="keep"
        )
        trees = GBTRegressor(
            featuresCol=_VECTOR,
            labelCol=target,
            predictionCol=PREDICTION,
            maxIter=self.n_estimators,
            stepSize=self.learning_rate,
            maxDepth=max(1, (self.num_leaves - 1).bit_length()),
            minInstancesPerNode=self.min_child_samples,
            subsamplingRate=self.subsample,
            featureSubsetStrategy="all" if self.colsample_bytree >= 1 else str(self.colsample_bytree),
            seed=self.random_state,
            checkpointInterval=10,
        )
        return Pipeline(stages=[assembler, trees])

    def fit(self, train: DataFrame, features: Sequence[str], target: str = "value") -> Fitted:
        spark = train.sparkSession
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        rows = train.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, target])])
        # Every round reads the rows: they are stored where all executors reach them.
        path = shared_dir(spark)
        fitted = self._stages(features, target).fit(stage(rows, path))
        remove(spark, path)
        out = Fitted(self, features, target, {})
        out.pipeline = fitted
        return out

    def apply(self, fitted: Fitted, df: DataFrame) -> DataFrame:
        scored = fitted.pipeline.transform(df.drop(PREDICTION))
        return scored.drop(_VECTOR)
