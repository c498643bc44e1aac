import re
import numpy as np
import pandas as pd
import pytest
from panel_helpers import gappy, rows, to_spark
from pyspark.sql import functions as F

from wattline.operators import quantile
from wattline.operators.cleaning import (
    drop_duplicate_readings,
    flag_outliers,
    interpolate_short_gaps,
    reindex_to_grid,
    site_grid,
)
from wattline.plans.dataset import build_dataset

T0 = pd.Timestamp("2025-01-01", tz="UTC")


def series(values, site="A", step=30):
    return pd.DataFrame(
        {
            "site_id": site,
            "timestamp": [T0 + pd.Timedelta(minutes=step * i) for i in range(len(values))],
            "value": np.array(values, dtype=float),
        }
    )


def test_last_export_wins_whatever_the_layout(spark):
    pdf = pd.concat([series([1.0, 2.0]), series([3.0]), series([9.0])], ignore_index=True)
    pdf["ingest_order"] = [1, 1, 3, 2]
    pdf["unit"] = ["a", "b", None, "d"]
    for shuffled in (pdf, pdf.iloc[::-1], pdf.iloc[[2, 0, 3, 1]]):
        out = rows(drop_duplicate_readings(to_spark(spark, shuffled)))
        assert out.value.tolist() == [3.0, 2.0]
        assert out.unit.tolist() == [None, "b"]  # the whole row is kept, nulls included


def test_dedup_without_an_order_column_is_still_deterministic(spark):
    pdf = pd.concat([series([1.0]), series([5.0]), series([3.0])], ignore_index=True)
    assert rows(drop_duplicate_readings(to_spark(spark, pdf))).value.tolist() == [5.0]


def test_dedup_reduces_before_the_shuffle(spark, panel):
    plan = drop_duplicate_readings(panel)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_grid_fills_gaps_drops_off_grid_and_keeps_site(spark):
    pdf = series([1.0, 2.0, 3.0, 4.0]).drop(index=[2])
    pdf["unit"] = "kWh"
    extra = pdf.iloc[[0]].assign(timestamp=T0 + pd.Timedelta(minutes=17), value=99.0)
    out = rows(reindex_to_grid(to_spark(spark, pd.concat([pdf, extra]))))
    assert out.value.fillna(-1).tolist() == [1.0, 2.0, -1, 4.0]
    assert out.unit.tolist() == ["kWh", "kWh", None, "kWh"]
    assert set(out.site_id) == {"A"}


def test_grid_is_anchored_at_the_first_reading(spark):
    pdf = series([1.0, 2.0, 3.0])
    pdf["timestamp"] += pd.Timedelta(minutes=7)
    out = rows(reindex_to_grid(to_spark(spark, pdf), "15min"))
    assert len(out) == 5
    assert out.timestamp[0] == T0 + pd.Timedelta(minutes=7)


def test_grid_across_many_blocks(spark, small_blocks):
    pdf = series([1.0] + [np.nan] * 498 + [2.0]).dropna()
    out = rows(site_grid(to_spark(spark, pdf)))
    expected = pd.date_range(T0, periods=500, freq="30min")
    assert out.timestamp.tolist() == expected.tolist()


def robust_flags(pdf, limit):
    def flag(s):
        mid = s.median()
        mad = (s - mid).abs().median()
        if not mad > 0:
            return pd.Series(False, index=s.index)
        return (0.6745 * (s - mid) / mad).abs() > limit

    return pdf.groupby("site_id")["value"].transform(flag).astype(bool)


def test_outliers_match_a_plain_calculation(spark):
    pdf = gappy()
    pdf.loc[pdf.index % 50 == 5, "value"] *= 3
    flat = series([5.0] * 9 + [500.0], site="FLAT")
    pdf = pd.concat([pdf, flat, series([1.0], "ONE"), series([np.nan], "NONE")], ignore_index=True)
    out = rows(flag_outliers(to_spark(spark, pdf), z_threshold=2.5))
    want = pdf.assign(f=robust_flags(pdf, 2.5)).sort_values(["site_id", "timestamp"])
    assert out.is_outlier.tolist() == want.f.tolist()
    assert out.is_outlier.sum() > 5
    assert not out[out.site_id == "FLAT"].is_outlier.any()


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e300])
def test_narrowing_finds_exact_medians(spark, scale):
    rng = np.random.default_rng(1)
    groups = {
        "odd": rng.normal(0, 1, 501),
        "even": rng.normal(-3, 1, 500),
        "ties": rng.integers(0, 3, 400).astype(float),
        "near": 1.0 + rng.integers(0, 1000, 301) * 2.0**-52,
        "two": np.array([-1.0, 2.0]),
        "one": np.array([7.5]),
        "mixed": np.concatenate([rng.normal(0, 1e6, 100), rng.normal(0, 1e-6, 101)]),
    }
    pdf = pd.concat(
        [pd.DataFrame({"g": g, "x": v * scale}) for g, v in groups.items()], ignore_index=True
    )
    out = quantile.median_and_mad(spark.createDataFrame(pdf), "x", "g").collect()
    got = {r.g: (r.median, r.mad) for r in out}
    for g, part in pdf.groupby("g"):
        mid = part.x.median()
        assert got[g] == (mid, (part.x - mid).abs().median()), g


@pytest.mark.parametrize("ranked", [2_000_000, 3])
@pytest.mark.parametrize("shares", [None, ((0, 0.5),)], ids=["bracket", "missed"])
def test_medians_of_large_groups(spark, monkeypatch, ranked, shares):
    """Brackets that hold, that hold too much, and that miss the middle give the same medians."""
    monkeypatch.setattr(quantile, "RANKED", ranked)
    if shares:
        monkeypatch.setattr(quantile, "SHARES", shares)
    rng = np.random.default_rng(8)
    groups = {
        "wide": rng.normal(50, 20, 60_000),
        "heavy": np.concatenate([np.full(20_000, 3.0), rng.normal(3, 1, 20_001)]),
        "steps": rng.integers(0, 7, 6_000).astype(float),
        "far": np.concatenate([np.zeros(2_000), np.full(2_000, 1e9)]),
        "infinite": np.array([-np.inf, 1.0, 2.0, np.inf, 5.0]),
        "nothing": np.full(3, np.nan),
    }
    pdf = pd.concat([pd.DataFrame({"g": g, "x": v}) for g, v in groups.items()], ignore_index=True)
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(None, 4.0)], "g string, x double"))
    got = {r.g: (r.median, r.mad) for r in quantile.median_and_mad(df, "x", "g").collect()}
    want = {g: (np.median(v), np.median(np.abs(v - np.median(v)))) for g, v in groups.items() if g != "nothing"}
    assert got == want


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    return sum("Exchange" in line for line in initial.splitlines())


def test_medians_take_few_exchanges(spark, monkeypatch):
    """Ten at most for median and deviation together, and none that grows with the path taken."""
    df = to_spark(spark, gappy(n=500))
    plans = []
    plain = quantile.stage
    monkeypatch.setattr(quantile, "stage", lambda df: plans.append(exchanges(df)) or plain(df))
    out = flag_outliers(df)
    assert sum(plans) <= 10 and exchanges(out) <= 2


def fill(values, max_gap, skip=False):
    """Straight-line filling by a plain loop."""
    out = list(values)
    known = [i for i, v in enumerate(values) if not np.isnan(v)]
    for a, b in zip(known, known[1:]):
        for i in range(a + 1, b):
            if (b - a - 1 if skip else i - a) <= max_gap:
                out[i] = values[a] + (values[b] - values[a]) * (i - a) / (b - a)
    return out


def test_interpolation_example(spark):
    n = np.nan
    pdf = series([n, 1, n, n, n, n, n, n, 8, n, 10, n, n])
    out = rows(interpolate_short_gaps(to_spark(spark, pdf), max_gap=4))
    want = [n, 1, 2, 3, 4, 5, n, n, 8, 9, 10, n, n]
    assert np.allclose(out.value, want, equal_nan=True)


@pytest.mark.parametrize("long_gaps", ["partial", "skip"])
@pytest.mark.parametrize("grid", [None, "30min"])
def test_interpolation_matches_a_loop_over_many_blocks(spark, small_blocks, long_gaps, grid):
    pdf = gappy()
    out = rows(interpolate_short_gaps(to_spark(spark, pdf), long_gaps=long_gaps, grid=grid))
    want = np.concatenate(
        [fill(p.value.to_numpy(), 4, long_gaps == "skip") for _, p in pdf.groupby("site_id")]
    )
    assert np.allclose(out.value, want, equal_nan=True)
    assert out.value.isna().sum() < pdf.value.isna().sum()


def test_interpolation_by_pandas(spark):
    pdf = gappy(seed=9)
    out = rows(interpolate_short_gaps(to_spark(spark, pdf), max_gap=3))
    want = pdf.groupby("site_id").value.transform(
        lambda s: s.interpolate(method="linear", limit=3, limit_area="inside")
    )
    assert np.allclose(out.value, want, equal_nan=True)


def test_interpolation_rejects_unknown_modes(panel):
    with pytest.raises(ValueError, match="long_gaps"):
        interpolate_short_gaps(panel, long_gaps="all")


def test_dataset_flags_raw_values_and_joins(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(50, 1, 200).round(2)
    values[[20, 21, 60, 61, 62, 63, 64, 65]] = np.nan
    values[100] = 400.0
    pdf = series(values).dropna()
    late = pdf.iloc[[5]].assign(value=51.5)
    meter = pd.concat([pdf, late], ignore_index=True)
    meter["ingest_order"] = range(len(meter))
    meter["unit"] = "kWh"
    sites = spark.createDataFrame([("A", "acute")], "site_id string, site_type string")
    weather = spark.createDataFrame(
        pd.DataFrame({"site_id": "A", "timestamp": [T0], "temperature_c": [4.0]})
    )
    out = rows(build_dataset(to_spark(spark, meter), sites, weather, outlier_z=8.0))
    assert out.columns.tolist() == [
        "site_id",
        "timestamp",
        "value",
        "unit",
        "is_outlier",
        "site_type",
        "temperature_c",
    ]
    assert len(out) == 200
    assert out.value[5] == 51.5
    assert out.is_outlier.sum() == 1 and out.is_outlier[100]
    assert out.value.isna().sum() == 2  # the last two of the long gap
    assert out.unit.isna().sum() == 8
    assert set(out.site_type) == {"acute"}
    assert out.temperature_c.notna().sum() == 1


def test_fused_flags_equal_the_separate_operator(spark):
    panel = to_spark(spark, gappy())
    fused = rows(interpolate_short_gaps(panel, grid="30min", outlier_z=2.0))
    apart = rows(flag_outliers(panel, z_threshold=2.0))
    assert fused.is_outlier.tolist() == apart.is_outlier.tolist()


def test_hot_site_is_spread_over_tasks(spark, monkeypatch):
    """One site with most rows is cut into blocks that land on different tasks."""
    from wattline.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    pdf = pd.concat([series(np.arange(4000.0)), series([1.0] * 10, "B")], ignore_index=True)
    grid = site_grid(to_spark(spark, pdf))
    per_task = grid.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 4
    assert max(r["count"] for r in per_task) < 2500


def test_weather_join_is_dealt_by_site_and_instant(spark, tmp_path):
    """No join of the dataset job deals panel rows by site alone."""
    meter = to_spark(spark, gappy().dropna().assign(unit="kWh"))
    weather = to_spark(spark, gappy(seed=8).rename(columns={"value": "temperature_c"}))
    weather.write.parquet(str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = build_dataset(meter, weather=stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"hashpartitioning\(site_id#\d+, timestamp#\d+", plan)


@pytest.mark.parametrize("long_gaps", ["partial", "skip"])
def test_dataset_stores_readings_and_fills_as_the_grid_would(spark, small_blocks, monkeypatch, long_gaps):
    stored = []
    monkeypatch.setattr("wattline.plans.dataset.stage", lambda df: stored.append(df) or df)
    pdf = gappy(n=200, sites=("A", "B"))
    pdf = pdf[(np.arange(len(pdf)) % 50 < 20) | (np.arange(len(pdf)) % 7 == 0)]  # half the instants have no row at all
    pdf.loc[pdf.index[5], "timestamp"] += pd.Timedelta(minutes=7)
    meter = to_spark(spark, pdf.assign(unit="kWh"))
    got = rows(build_dataset(meter, max_gap=3, long_gaps=long_gaps))
    grid = reindex_to_grid(meter, "30min")
    want = rows(interpolate_short_gaps(grid, max_gap=3, long_gaps=long_gaps, grid="30min", outlier_z=5.0))
    pd.testing.assert_frame_equal(got, want[got.columns])
    # A stored row is a reading or the head of a block; the instants between them are not stored.
    assert stored[0].count() < 0.75 * len(got)
