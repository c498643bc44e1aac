"""No task receives a whole site, whatever table its facts come from."""

import pytest
from pyspark.sql import functions as F

from wattline.models import Ridge, SeasonalNaive
from wattline.operators.cleaning import flag_outliers, interpolate_short_gaps
from wattline.operators.features import add_target_lags
from wattline.plans.dataset import join_sites
from wattline.sources.sinks import stage

PARTS = 8


@pytest.fixture
def spread(spark):
    """Eight partitions that neither coalescing nor broadcasts change."""
    settings = {
        "spark.sql.shuffle.partitions": str(PARTS),
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture
def hot(spread):
    """Nine tenths of the rows are one site's, over some forty years of half-hours."""
    site = F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    return stage(
        spread.range(120_000).select(
            site.alias("site_id"),
            F.timestamp_micros(F.col("id") * 10_800_000_000).alias("timestamp"),
            (F.col("id") * 37 % 1009).cast("double").alias("value"),
        )
    )


def largest(df) -> float:
    """Rows of the fullest task against the mean."""
    all_used = F.max(F.xxhash64(*df.columns))  # or the optimizer leaves out what is not asked for
    rows = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), all_used).collect()
    sizes = [r["n"] for r in rows]
    return max(sizes) / (sum(sizes) / PARTS)


def registers(spark, hot):
    plain = hot.groupBy("site_id").agg(F.count("*").alias("beds"))
    return {"aggregate": plain, "file": stage(plain), "expression": plain.withColumn("site_id", F.trim("site_id"))}


def test_outlier_flags(hot):
    assert largest(flag_outliers(hot)) < 2


@pytest.mark.parametrize("kind", ["aggregate", "file", "expression"])
def test_site_register(spark, hot, kind):
    assert largest(join_sites(hot, registers(spark, hot)[kind])) < 2


def test_position_naive(hot):
    fitted = SeasonalNaive(1500, align="position").fit(hot)
    assert largest(fitted.transform(hot)) < 2.5


def test_ridge_per_site(hot):
    rows = hot.withColumn("x", F.col("value") % 13)
    assert largest(Ridge(1.0, ["site_id"]).fit(rows, ["x"]).transform(rows)) < 2


@pytest.mark.parametrize("grid", [None, "30min"])
@pytest.mark.parametrize("lost", ["site_id", "timestamp"])
def test_rows_without_a_place(hot, lost, grid):
    """Most rows lack a site or a time: they are kept and stay spread."""
    loose = hot.withColumn(lost, F.when(F.col("value") < 100, F.col(lost)))
    for out in (add_target_lags(loose, lags=(1,), grid=grid), interpolate_short_gaps(loose, grid=grid)):
        assert out.count() == 120_000
        assert largest(out) < 2
