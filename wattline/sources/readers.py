"""Readers of the raw files and of processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import parse_instant
from ..schema import METER, SITES, WEATHER, nan_to_null


def _read_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with exactly this header; instants are parsed explicitly, NaN becomes null."""
    raw = T.StructType(
        [
            T.StructField(
                f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType
            )
            for f in schema.fields
        ]
    )
    df = (
        spark.read.schema(raw)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nanValue", "NaN")
        .csv(path if isinstance(path, list) else str(path))
    )
    parsed = {
        f.name: parse_instant(F.col(f.name))
        for f in schema.fields
        if isinstance(f.dataType, T.TimestampType)
    }
    return nan_to_null(df.withColumns(parsed) if parsed else df)


def read_hh_meter_data(spark: SparkSession, path) -> DataFrame:
    """Half-hourly meter exports: site_id, timestamp, value, unit, ingest_order.

    ``path`` may be a file, a directory, a glob or a list.  ``ingest_order`` ranks
    readings of the same period: the file name first (exports carry their extract
    date), then the place in the file.
    """
    df = _read_csv(spark, path, METER)
    order = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select(*METER.names, order.alias("ingest_order"))


def read_site_metadata(spark: SparkSession, path) -> DataFrame:
    """Site register, one row per site; a repeated site is an error."""
    sites = _read_csv(spark, path, SITES)
    rest = [c for c in SITES.names if c != "site_id"]
    grouped = sites.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("__n"), *[F.max(c).alias(c) for c in rest]
    )
    message = F.concat(F.lit("Duplicate site in register: "), F.col("site_id"))
    checked = F.when(F.col("__n") > 1, F.raise_error(message).cast("string")).otherwise(
        F.col("site_id")
    )
    return grouped.select(checked.alias("site_id"), *rest)


def read_weather(spark: SparkSession, path) -> DataFrame:
    """Weather observations or forecasts per site and instant."""
    return _read_csv(spark, path, WEATHER)


def read_holidays(spark: SparkSession, path) -> DataFrame:
    """Holiday calendar: a CSV with one date per line under a header."""
    return spark.read.schema("holiday date").option("header", True).csv(str(path))


def load_processed(spark: SparkSession, path) -> DataFrame:
    """Read a processed or feature table back."""
    return spark.read.parquet(str(path))
