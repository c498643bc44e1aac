"""Sinks for panels and metrics, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Folders named within ``passing``.
_named: ContextVar[list[str] | None] = ContextVar("_named", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder, owned by the session.

    The session's ``spark.checkpoint.dir`` is used when set; only a session on one machine
    may leave it unset.  The folder is removed when the session's JVM ends; callers that
    are done earlier call ``remove``, or work within ``passing``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
        base = os.path.join(tempfile.gettempdir(), "wattline-checkpoints")
    path = f"{base.rstrip('/')}/wattline-{uuid.uuid4().hex}"
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    if _named.get() is not None:
        _named.get().append(path)
    return path


@contextmanager
def passing(spark: SparkSession):
    """Remove at the end, also after an error, all folders that ``shared_dir`` names meanwhile.

    A frame that outlasts it is staged within it, to a folder named before.
    """
    made: list[str] = []
    token = _named.set(made)
    try:
        yield
    finally:
        _named.reset(token)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``shared_dir`` named, once no frame reads it any more."""
    place, fs = _place(spark, path)
    fs.delete(place, True)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table once and read it back: cuts lineage and survives lost executors.

    Unlike a cached frame the copy is columnar, so every later read takes only the
    columns it needs, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_panel(
    df: DataFrame, path: str, cluster_by: tuple[str, ...] = ("site_id", "timestamp")
) -> str:
    """Write a panel with the rows of each file sorted by site and time.

    Tables come out of their last step spread by site and block; they are sorted where they
    are, so nothing is computed twice and a long site is written by several tasks.
    Row-group statistics let readers skip by site and by time.
    """
    df.sortWithinPartitions(*cluster_by).write.mode("overwrite").parquet(str(path))
    return str(path)


def write_metrics_csv(df: DataFrame, path: str) -> str:
    """Write a backtest report as CSV.

    A pooled report has a row per fold and becomes one file; one per site has as many files
    as tasks.
    """
    pooled = "site_id" not in df.columns
    (df.coalesce(1) if pooled else df).write.mode("overwrite").option("header", True).csv(str(path))
    return str(path)
