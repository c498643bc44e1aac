"""Model bundles: a directory with a one-row description, state tables and trees."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..models import Fitted, build_model

_META = "kind string, params string, features array<string>, target string, tables array<string>, trees boolean"


def save_model(spark: SparkSession, fitted: Fitted, path: str) -> str:
    """Write a fitted forecaster under ``path``."""
    path = str(path).rstrip("/")
    for name, table in fitted.tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    pipeline = getattr(fitted, "pipeline", None)
    if pipeline is not None:
        pipeline.write().overwrite().save(f"{path}/trees")
    row = (
        fitted.model.kind,
        json.dumps(fitted.model.params()),
        fitted.features,
        fitted.target,
        sorted(fitted.tables),
        pipeline is not None,
    )
    spark.createDataFrame([row], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_model(spark: SparkSession, path: str) -> Fitted:
    """Read a forecaster back, ready to ``transform``."""
    path = str(path).rstrip("/")
    meta = spark.read.parquet(f"{path}/meta").first()
    model = build_model(meta["kind"], **json.loads(meta["params"]))
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
    fitted = Fitted(model, meta["features"], meta["target"], tables)
    if meta["trees"]:
        fitted.pipeline = PipelineModel.load(f"{path}/trees")
    return fitted
