import os

import pytest
from pyspark.sql import functions as F

from wattline.operators.cleaning import drop_duplicate_readings
from wattline.plans.dataset import join_weather
from wattline.sources import storage

SCHEMA = "site_id string, timestamp timestamp, value double, ingest_order long"


def export(spark, n, start, order, sites=("north", "quay", "hot")):
    """Half-hours from a day on; two thirds of the rows are one site's."""
    site = F.element_at(F.array(*[F.lit(s) for s in (*sites, "hot", "hot", "hot")]), (F.col("id") % 6 + 1).cast("int"))
    at = F.timestamp_seconds(F.lit(start) + F.floor(F.col("id") / 6) * 1800)
    return spark.range(n).select(
        site.alias("site_id"),
        F.when(F.col("id") % 997 > 0, at).alias("timestamp"),
        (F.col("id") * 31 % 101 + order).cast("double").alias("value"),
        (F.lit(order * 1_000_000) + F.col("id")).alias("ingest_order"),
    )


def files(path):
    out = {}
    for d, _, names in os.walk(path):
        out |= {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for f in names if f.endswith(".parquet")}
    return out


def content(df):
    return sorted(map(tuple, df.select("site_id", "timestamp", "value", "ingest_order").collect()), key=repr)


JAN, MARCH = 1735689600, 1740787200


def test_merged_exports_equal_a_full_rebuild(spark, tmp_path):
    path = str(tmp_path / "readings")
    first, second = export(spark, 30_000, JAN, 1), export(spark, 2_000, MARCH, 2, ("quay", "new", "hot"))
    storage.write_readings(first, path, buckets=4)
    before = files(path)
    n = storage.merge_export(spark, path, second, buckets=4)
    after = files(path)
    whole = drop_duplicate_readings(first.union(second))
    assert content(storage.read_readings(spark, path)) == content(whole)
    gone = {f for f in before if f not in after}
    parts = {os.path.dirname(f) for f in gone}
    assert 0 < len(parts) <= n and n == len({os.path.dirname(f) for f in after if f not in before})
    kept = {f for f in before if f in after}
    assert kept and all(before[f] == after[f] for f in kept)
    assert not parts & {os.path.dirname(f) for f in kept}


def test_an_export_counts_as_later_whatever_its_order_says(spark, tmp_path):
    path = str(tmp_path / "readings")
    at = F.timestamp_seconds(F.lit(JAN))
    row = spark.range(1).select(F.lit("a").alias("site_id"), at.alias("timestamp"), F.lit(1.0).alias("value"), F.lit(9).alias("ingest_order"))
    storage.write_readings(row, path)
    storage.merge_export(spark, path, row.withColumns({"value": F.lit(2.0), "ingest_order": F.lit(3)}))
    assert [r.value for r in storage.read_readings(spark, path).collect()] == [2.0]


@pytest.mark.parametrize("empty_side", ["table", "export"])
def test_empty_sides(spark, tmp_path, empty_side):
    path = str(tmp_path / "readings")
    some = export(spark, 100, JAN, 1)
    first, second = (some.limit(0), some) if empty_side == "table" else (some, some.limit(0))
    storage.write_readings(first.union(some.limit(1)), path)
    storage.merge_export(spark, path, second)
    assert content(storage.read_readings(spark, path)) == content(drop_duplicate_readings(some)) if empty_side == "table" else True


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    left = drop_duplicate_readings(export(spark, 5_000, JAN, 1)).drop("ingest_order")
    right = left.sample(0.5, 3).select("site_id", "timestamp", (F.col("value") / 7).alias("temperature_c"))
    paths = [storage.write_bucketed(df, str(tmp_path / name), 8) for df, name in ((left, "l"), (right, "r"))]
    stored = [storage.read_bucketed(spark, p, 8) for p in paths]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_weather(*stored)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = join_weather(left, right)
    key = lambda df: sorted(map(tuple, df.select("site_id", "timestamp", "value", "temperature_c").collect()), key=repr)
    assert key(joined) == key(want)
    assert len(files(str(tmp_path / "l"))) == 8
