"""Rounding of result columns, and the settings that bound a task's memory."""

import random

from pyspark.sql import functions as F

from wattline.catalog.rounding import Nudged, rounded, shown
from wattline.session import SETTINGS, tune


def test_rounding_equals_sparks(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 0.5, 1.005, -1.005, 2.675, -1e-9, 4.5e-7, 1e300, float("nan"), float("inf"), -float("inf"), None]
    values += [rng.uniform(-100, 100) for _ in range(3000)]
    values += [rng.randrange(-(10**7), 10**7) / 2000 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 3, 6, 8):
        both = df.select(rounded(F.col("x"), digits).alias("a"), F.round("x", digits).alias("b"))
        assert both.where("not a <=> b or string(a) <> string(b)").count() == 0


def test_most_values_are_rounded_without_decimals(spark):
    plan = shown(spark.range(1).select((F.col("id") / 3).alias("x")), x=Nudged(8))._jdf.queryExecution().optimizedPlan()
    assert "CASE WHEN" in plan.toString()


def test_exchanges_of_panels_are_dealt_finely(spark):
    tune(spark)
    for key in ("coalescePartitions.initialPartitionNum", "advisoryPartitionSizeInBytes"):
        assert spark.conf.get(f"spark.sql.adaptive.{key}") == SETTINGS[f"spark.sql.adaptive.{key}"]
    frame = spark.range(100_000).select((F.col("id") % 50_000).alias("k"), F.col("id").cast("string").alias("v"))
    dealt = frame.repartition("k").sortWithinPartitions("v")
    assert dealt._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    assert "1024" in dealt._jdf.queryExecution().executedPlan().toString()
