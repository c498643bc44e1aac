"""Sessions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime settings the plans are written for; results are the same without them.
# hugeMethodLimit: the JVM does not compile methods beyond 8000 bytes, so the wide feature
# projections are better generated in parts (between no gain and twice as fast here).
# Readings take a few bytes in a shuffle, but become many rows of some hundred bytes each that a task
# sorts.  Exchanges are therefore dealt finely and joined to small parts, and files are read in small
# pieces, so that the memory of a task does not grow with the input.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4MB",
    "spark.sql.files.maxPartitionBytes": "16MB",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "wattline", cpus: int | str = 8) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", os.environ.get("WATTLINE_PARTITIONS", "8"))
        .config("spark.driver.memory", "12g")
        .config("spark.driver.extraJavaOptions", os.environ.get("WATTLINE_JAVA_OPTIONS", ""))
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "wattline-checkpoints"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
