import datetime as dt

import numpy as np
import pandas as pd
import pytest
from panel_helpers import rows, to_spark
from pyspark.sql import functions as F

from wattline.operators.quality import check_regular_index, missing_periods, summarise_missing
from wattline.schema import nan_to_null, validate_schema


def test_schema_accepts_a_good_table(panel):
    validate_schema(panel)


def test_schema_names_missing_columns(panel):
    with pytest.raises(ValueError, match=r"Missing required columns: \['value'\]"):
        validate_schema(panel.drop("value"))


def test_schema_rejects_timestamps_without_a_zone(panel):
    naive = panel.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    with pytest.raises(TypeError, match="tz-aware"):
        validate_schema(naive)


def test_schema_rejects_text_timestamps(panel):
    with pytest.raises(TypeError, match="must be a timestamp"):
        validate_schema(panel.withColumn("timestamp", F.col("timestamp").cast("string")))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert nan_to_null(df).where("x IS NULL").count() == 2


def test_coverage_counts_removed_periods(spark, demand):
    report = rows(check_regular_index(to_spark(spark, demand.drop(demand.index[41:48]))), "site_id")
    whole = len(demand) // 2
    assert report.n_missing.tolist() == [7, 0]
    assert report.n_expected.tolist() == [whole, whole]
    assert report.n_rows.tolist() == [whole - 7, whole]


def test_coverage_duplicates_off_grid_and_single_rows(spark):
    base = pd.Timestamp("2025-01-01", tz="UTC")
    minutes = [0, 30, 30, 47, 90]
    pdf = pd.DataFrame(
        {
            "site_id": ["A"] * 5 + ["B"],
            "timestamp": [base + pd.Timedelta(minutes=m) for m in minutes] + [base],
            "value": 1.0,
        }
    )
    report = rows(check_regular_index(to_spark(spark, pdf), off_grid=True), "site_id")
    assert report.n_rows.tolist() == [5, 1]
    assert report.n_expected.tolist() == [4, 1]
    assert report.n_missing.tolist() == [1, 0]
    assert report.n_duplicated.tolist() == [1, 0]
    assert report.n_off_grid.tolist() == [1, 0]
    assert report.start[0] == base


def test_coverage_leaves_out_rows_without_a_site(spark):
    df = spark.createDataFrame(
        [(None, dt.datetime(2025, 1, 1), 1.0)], "site_id string, timestamp timestamp, value double"
    )
    assert check_regular_index(df).count() == 0


def test_missing_periods_lists_them(spark, demand):
    gone = demand.iloc[10:15]
    found = rows(missing_periods(to_spark(spark, demand.drop(gone.index))))
    assert found.timestamp.tolist() == gone.timestamp.tolist()


def test_missing_summary_counts_and_orders(spark, demand):
    pdf = demand.copy()
    pdf.loc[:6, "value"] = np.nan
    pdf.loc[:2, "unit"] = None
    out = summarise_missing(spark.createDataFrame(pdf)).collect()
    assert [(r.column_name, r.n_missing) for r in out[:2]] == [("value", 7), ("unit", 3)]
    assert out[0].pct_missing == round(7 / len(pdf) * 100, 2)
    assert [r.column_name for r in out[2:]] == ["site_id", "temperature_c", "timestamp"]


def test_missing_summary_of_an_empty_table(spark, panel):
    out = summarise_missing(panel.limit(0)).collect()
    assert {(r.n_missing, r.pct_missing) for r in out} == {(0, 0.0)}


def plain_coverage(pdf, step):
    """The report and the missing instants of every site, by sets."""
    report, missing = [], []
    for site, part in pdf.dropna(subset=["site_id"]).groupby("site_id"):
        at = [int(t) for t in part.micros.dropna()]
        lo, hi = min(at), max(at)
        grid = range(lo, hi + 1, step)
        known = set(at)
        on = sum(t in known for t in grid)
        distinct = len(known) + part.micros.isna().any()
        report.append((site, len(part), len(grid), len(grid) - on, len(part) - distinct, len(known) - on))
        missing += [(site, t) for t in grid if t not in known]
    return report, sorted(missing)


@pytest.mark.parametrize("step, freq", [(1_800_000_000, "30min"), (86_400_000_000, "1D"), (7_000, "7ms")])
def test_bitmaps_against_sets(spark, monkeypatch, step, freq):
    """Any phase, times before 1970, long gaps, duplicates, readings off the grid, rows without a time."""
    from wattline.operators import quality

    monkeypatch.setattr(quality, "WIDE", 3)
    rng = np.random.default_rng(step % 97)
    parts = []
    for k, site in enumerate("ABC"):
        slots = np.unique(np.concatenate([rng.integers(-300, 100, 150), [64 * k, 64 * k + 63], rng.integers(900, 960, 20)]))
        at = slots * step + k * (step // 3)
        off = at[rng.integers(0, len(at), 9)] + rng.integers(1, step, 9)
        at = np.concatenate([at, at[:7], at[:2], off[off > at.min()]])
        parts.append(pd.DataFrame({"site_id": site, "micros": at}))
    parts.append(pd.DataFrame({"site_id": ["A", "A", "B", None], "micros": [None, None, None, 5]}))
    pdf = pd.concat([p.astype(object) for p in parts], ignore_index=True)
    rows_ = [(s, None if pd.isna(m) else int(m)) for s, m in zip(pdf.site_id, pdf.micros)]
    df = spark.createDataFrame(rows_, "site_id string, m long").select("site_id", F.timestamp_micros("m").alias("timestamp")).repartition(3)
    report, missing = plain_coverage(pdf, step)
    got = check_regular_index(df, freq, off_grid=True).orderBy("site_id").collect()
    assert [(r.site_id, r.n_rows, r.n_expected, r.n_missing, r.n_duplicated, r.n_off_grid) for r in got] == report
    found = missing_periods(df, freq).select("site_id", F.unix_micros("timestamp").alias("m")).collect()
    assert sorted(map(tuple, found)) == missing


def test_presence_is_a_row_per_64_periods(spark, demand):
    from wattline.operators.quality import presence

    table = presence(to_spark(spark, demand))
    assert table.count() <= len(demand) / 64 + 2 * 2
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "partial_bit_or" in plan
