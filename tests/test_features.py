import numpy as np
import pandas as pd
import pytest
from panel_helpers import gappy, rows, to_spark
from pyspark.sql import functions as F

from wattline.functions.calendar import (
    add_calendar_features,
    add_cyclical_features,
    add_holiday_features,
)
from wattline.functions.time import floor_to, instant, step_micros, utc_instant, utc_wall
from wattline.functions.weather import add_degree_days
from wattline.operators.features import (
    add_rolling_features,
    add_target_lags,
    add_weather_lags,
    check_leakage,
)
from wattline.plans.features import build_features


def instants(spark, *texts):
    stamps = pd.to_datetime(list(texts), utc=True)
    return spark.createDataFrame(pd.DataFrame({"site_id": "A", "timestamp": stamps}))


@pytest.mark.parametrize(
    "text, micros",
    [("30min", 1_800_000_000), ("1D", 86_400_000_000), ("2 hours", 7_200_000_000), ("s", 1_000_000)],
)
def test_frequencies(text, micros):
    assert step_micros(text) == micros


@pytest.mark.parametrize("text", ["", "1 month", "0min", "x"])
def test_bad_frequencies(text):
    with pytest.raises(ValueError):
        step_micros(text)


def test_time_helpers_do_not_depend_on_the_session_zone(spark):
    def answers():
        df = spark.range(1).select(
            F.lit("2025-11-02 06:30:00").cast("timestamp_ntz").alias("wall")
        )
        at = df.select(instant("wall").alias("timestamp"))
        fields = add_calendar_features(at).select(
            utc_wall("timestamp").cast("string"), "hour", "day_of_year", "minute_of_day"
        )
        cut = spark.range(1).select(F.unix_micros(utc_instant("2025-01-01")))
        floored = at.select(F.unix_micros(floor_to("timestamp", "1h")))
        return fields.first(), cut.first()[0], floored.first()[0]

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = []
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.append(answers())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seen[0] == seen[1] == seen[2]
    assert seen[0][0][0] == "2025-11-02 06:30:00" and seen[0][0][1] == 6


def test_offsets_in_cutoffs_are_honoured(spark):
    a, b = spark.range(1).select(utc_instant("2025-07-01T01:00:00+01:00"), utc_instant("2025-07-01")).first()
    assert a == b


def test_calendar_matches_pandas_across_clock_changes(spark):
    ts = pd.date_range("2024-12-30", "2025-12-31", freq="30min", tz="UTC")
    ts = ts.append(pd.date_range("1969-12-30", "1970-01-02", freq="30min", tz="UTC"))
    out = rows(
        add_calendar_features(spark.createDataFrame(pd.DataFrame({"site_id": "A", "timestamp": ts})))
    )
    local = pd.Series(ts.sort_values()).dt.tz_convert("Europe/London").dt
    assert out.hour.tolist() == local.hour.tolist()
    assert out.minute_of_day.tolist() == (local.hour * 60 + local.minute).tolist()
    assert out.day_of_week.tolist() == local.dayofweek.tolist()
    assert out.day_of_year.tolist() == local.dayofyear.tolist()
    assert out.month.tolist() == local.month.tolist()
    assert out.year.tolist() == local.year.tolist()
    assert out.is_weekend.tolist() == (local.dayofweek >= 5).astype(int).tolist()


def test_days_with_46_and_50_periods(spark):
    ts = pd.date_range("2025-03-29", "2025-10-29", freq="30min", tz="UTC")
    df = spark.createDataFrame(pd.DataFrame({"site_id": "A", "timestamp": ts}))
    per_day = add_calendar_features(df).groupBy("day_of_year").count().toPandas()
    counts = per_day.set_index("day_of_year")["count"]
    assert counts[pd.Timestamp("2025-03-30").dayofyear] == 46
    assert counts[pd.Timestamp("2025-10-26").dayofyear] == 50


def test_cycles_lie_on_the_unit_circle(panel):
    out = add_cyclical_features(add_calendar_features(panel)).toPandas()
    for p in ("tod", "doy", "dow"):
        assert np.allclose(out[f"{p}_sin"] ** 2 + out[f"{p}_cos"] ** 2, 1)
    want = np.cos(2 * np.pi * out.day_of_year / 365.25)
    assert np.allclose(out.doy_cos, want)


HOLIDAYS = ["2025-12-25", "2025-12-26"]


@pytest.mark.parametrize("as_table", [False, True])
def test_holidays_use_the_local_date(spark, as_table):
    days = [f"2025-12-{d} 12:00" for d in (23, 24, 25, 26, 27, 28)]
    df = instants(spark, *days, "2025-12-24 23:30", "2025-12-26 23:59")
    holidays = spark.createDataFrame([(d,) for d in HOLIDAYS], "d string") if as_table else HOLIDAYS
    out = rows(add_holiday_features(df, holidays))
    assert out.is_holiday.tolist() == [0, 0, 0, 1, 1, 1, 0, 0]
    assert out.is_day_before_holiday.tolist() == [0, 1, 1, 1, 0, 0, 0, 0]
    assert out.is_day_after_holiday.tolist() == [0, 0, 0, 0, 1, 1, 1, 0]


def test_holidays_in_summer_time(spark):
    df = instants(spark, "2025-08-24 23:30", "2025-08-25 22:59", "2025-08-25 23:00")
    out = rows(add_holiday_features(df, ["2025-08-25"]))
    assert out.is_holiday.tolist() == [1, 1, 0]


def test_no_calendar_means_no_holidays(panel):
    out = add_holiday_features(panel).agg(F.sum("is_holiday"), F.sum("is_day_after_holiday"))
    assert out.first() == (0, 0)


def test_degrees_are_exclusive_and_null_safe(spark, panel):
    out = add_degree_days(panel).toPandas()
    assert (out.heating_degrees >= 0).all() and (out.cooling_degrees >= 0).all()
    assert ((out.heating_degrees > 0) & (out.cooling_degrees > 0)).sum() == 0
    odd = spark.createDataFrame([(None,), (15.5,), (20.0,)], "temperature_c double")
    got = [tuple(r)[1:] for r in add_degree_days(odd).collect()]
    assert got == [(None, None), (0.0, 0.0), (0.0, 4.5)]


def pandas_rolling(pdf, column, window, shift=1):
    return pdf.groupby("site_id")[column].transform(
        lambda s: s.shift(shift).rolling(window, min_periods=max(1, window // 4)).mean()
    ), pdf.groupby("site_id")[column].transform(
        lambda s: s.shift(shift).rolling(window, min_periods=max(1, window // 4)).std()
    )


@pytest.mark.parametrize("grid", [None, "30min"])
def test_lags_match_pandas_over_many_blocks(spark, small_blocks, grid):
    pdf = gappy()
    out = rows(add_target_lags(to_spark(spark, pdf), lags=(1, 2, 5, 48), grid=grid))
    for n in (1, 2, 5, 48):
        want = pdf.groupby("site_id").value.shift(n)
        assert np.allclose(out[f"value_lag_{n}"], want, equal_nan=True), n


def test_lags_count_rows_not_time_without_a_grid(spark):
    pdf = gappy().dropna()
    out = rows(add_target_lags(to_spark(spark, pdf), lags=(1, 48)))
    for n in (1, 48):
        assert np.allclose(out[f"value_lag_{n}"], pdf.groupby("site_id").value.shift(n), equal_nan=True)


def test_lags_across_time_buckets(spark):
    ts = pd.date_range("2019-11-01", periods=400, freq="3D", tz="UTC")
    pdf = pd.DataFrame({"site_id": "A", "timestamp": ts, "value": np.arange(400.0)})
    out = rows(add_target_lags(to_spark(spark, pdf), lags=(1, 30)))
    assert np.allclose(out.value_lag_30, pdf.value.shift(30), equal_nan=True)


@pytest.mark.parametrize("grid", [None, "30min"])
@pytest.mark.parametrize("shift", [1, 3])
def test_rolling_matches_pandas_over_many_blocks(spark, small_blocks, grid, shift):
    pdf = gappy()
    windows = (1, 3, 4, 13, 48)
    out = rows(
        add_rolling_features(to_spark(spark, pdf), windows=windows, grid=grid, shift=shift)
    )
    for n in windows:
        mean, std = pandas_rolling(pdf, "value", n, shift)
        assert np.allclose(out[f"value_roll_mean_{n}"], mean, equal_nan=True), n
        assert np.allclose(out[f"value_roll_std_{n}"], std, equal_nan=True, atol=1e-6), n


def test_rolling_extremes_match_pandas(spark, small_blocks):
    pdf = gappy()
    out = rows(
        add_rolling_features(to_spark(spark, pdf), windows=(5, 20), stats=("min", "max"), grid="30min")
    )
    for n in (5, 20):
        roll = pdf.groupby("site_id").value.transform(
            lambda s: s.shift(1).rolling(n, min_periods=max(1, n // 4)).max()
        )
        assert np.allclose(out[f"value_roll_max_{n}"], roll, equal_nan=True)


def test_rolling_example(spark):
    ts = pd.date_range("2025-01-01", periods=6, freq="30min", tz="UTC")
    pdf = pd.DataFrame(
        {"site_id": "A", "timestamp": ts, "value": [1.0, 2.0, np.nan, 4.0, 5.0, 0.0]}
    )
    out = rows(add_rolling_features(to_spark(spark, pdf), windows=(4,)))
    assert np.allclose(out.value_roll_mean_4, [np.nan, 1, 1.5, 1.5, 7 / 3, 11 / 3], equal_nan=True)
    assert np.allclose(
        out.value_roll_std_4[:5], [np.nan, np.nan, 0.7071068, 0.7071068, 1.5275252], equal_nan=True
    )


def test_a_spike_leaves_no_trace_after_its_window(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(1e6, 1, 400)
    v[50] = 1e15
    ts = pd.date_range("2025-01-01", periods=400, freq="30min", tz="UTC")
    pdf = pd.DataFrame({"site_id": "A", "timestamp": ts, "value": v})
    out = rows(add_rolling_features(to_spark(spark, pdf), windows=(48,), grid="30min"))
    want = [v[i - 48 : i].std(ddof=1) for i in range(100, 400)]
    assert np.allclose(out.value_roll_std_48[100:], want, rtol=1e-9)


def test_weather_lags(spark, small_blocks):
    pdf = gappy().rename(columns={"value": "temperature_c"})
    out = rows(add_weather_lags(to_spark(spark, pdf), lags=(1, 4), windows=(12,), grid="30min"))
    mean, _ = pandas_rolling(pdf, "temperature_c", 12)
    assert np.allclose(out.temperature_c_roll_mean_12, mean, equal_nan=True)
    assert np.allclose(
        out.temperature_c_lag_4, pdf.groupby("site_id").temperature_c.shift(4), equal_nan=True
    )
    assert "temperature_c_roll_std_12" not in out


def test_unknown_statistics_are_refused(panel):
    with pytest.raises(ValueError, match="median"):
        add_rolling_features(panel, stats=("median",))


def test_feature_table_matches_its_parts(spark, panel):
    table = rows(build_features(panel, holidays=["2025-01-01"]))
    lags = rows(add_target_lags(panel, lags=(1, 48, 336), grid="30min"))
    rolls = rows(add_rolling_features(panel, grid="30min"))
    for c in ("value_lag_1", "value_lag_48", "value_lag_336"):
        assert np.allclose(table[c], lags[c], equal_nan=True)
    for c in ("value_roll_mean_336", "value_roll_std_336", "value_roll_std_48"):
        assert np.allclose(table[c], rolls[c], equal_nan=True)
    assert table.columns.tolist()[:5] == ["site_id", "timestamp", "value", "unit", "temperature_c"]
    for c in ("hour", "tod_sin", "is_holiday", "heating_degrees", "temperature_c_lag_48"):
        assert c in table
    assert table.is_holiday.sum() == 96
    first = table[table.site_id == "north"].head(48)
    assert first.value_lag_48.isna().all()


def test_feature_table_without_weather(panel):
    names = build_features(panel.drop("temperature_c")).columns
    assert not [c for c in names if "degrees" in c or "temperature" in c]


def test_recent_features_equal_the_full_table(panel):
    full = rows(build_features(panel).where(F.col("timestamp") >= utc_instant("2025-02-01")))
    recent = rows(build_features(panel, since="2025-02-01"))
    pd.testing.assert_frame_equal(full, recent, check_exact=False, rtol=1e-9)


def test_no_feature_sees_the_present_or_the_future(spark, demand):
    """Changing one value changes no look-back feature up to and at that instant."""
    at = pd.Timestamp("2025-01-20 12:00", tz="UTC")
    other = demand.copy()
    hit = (other.site_id == "north") & (other.timestamp == at)
    other.loc[hit, ["value", "temperature_c"]] += 1000
    a, b = (rows(build_features(to_spark(spark, d))) for d in (demand, other))
    looked = [c for c in a if "_lag_" in c or "_roll_" in c]
    upto = (a.timestamp <= at) | (a.site_id == "quay")
    pd.testing.assert_frame_equal(a.loc[upto, looked], b.loc[upto, looked])
    assert not np.allclose(a.loc[~upto, looked], b.loc[~upto, looked], equal_nan=True)


def test_all_lookback_features_share_one_exchange(spark, panel, tmp_path):
    panel.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = build_features(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert plan.count("Sort [") == 1
    site = build_features(stored).where("site_id = 'north'")
    assert "EqualTo(site_id,north)" in site._jdf.queryExecution().executedPlan().toString()


def test_leakage_check():
    check_leakage(["value_lag_48", "tod_sin"], "value", 48)
    with pytest.raises(ValueError, match="value_lag_1"):
        check_leakage(["value_lag_1", "value_lag_48"], "value", 48)
    with pytest.raises(ValueError, match="value_roll_mean_336"):
        check_leakage(["value_roll_mean_336"], "value", 48)


def test_rows_without_a_site_are_kept_with_nulls(spark):
    pdf = gappy(n=20, sites=("A",))
    lost = pdf.iloc[[3, 4]].assign(site_id=None)
    df = to_spark(spark, pd.concat([pdf, lost], ignore_index=True))
    for grid in (None, "30min"):
        out = add_target_lags(df, lags=(1,), grid=grid).toPandas()
        assert len(out) == 22
        assert out[out.site_id.isna()].value_lag_1.isna().all()


def test_rows_without_a_time_are_in_no_series(spark):
    pdf = pd.DataFrame(
        {
            "site_id": "A",
            "timestamp": [pd.NaT, *pd.date_range("2025-01-01", periods=2, freq="30min", tz="UTC")],
            "value": [9.0, 1.0, 2.0],
        }
    )
    out = add_target_lags(to_spark(spark, pdf), lags=(1,)).toPandas().set_index("value")
    assert np.isnan(out.value_lag_1[9.0]) and out.value_lag_1[2.0] == 1.0


@pytest.mark.parametrize("lookback", [3, 11])
def test_readings_are_put_on_the_grid_within_the_look_back(spark, small_blocks, lookback):
    from wattline.operators.cleaning import reindex_to_grid

    rng = np.random.default_rng(lookback)
    stamps = pd.date_range("2024-12-30 00:10", periods=90, freq="30min", tz="UTC")
    known = [(s, t, float(rng.integers(0, 50))) for s in ("A", "B") for t in stamps[rng.random(90) < 0.3]]
    known += [("A", stamps[3] + pd.Timedelta("7min"), 5.0), ("C", stamps[50], None), (None, stamps[4], 1.0), ("B", None, 2.0)]
    far = pd.Timestamp("1969-12-30 23:40", tz="UTC")
    known += [("D", far, 1.0), ("D", far + pd.Timedelta("20h"), 2.0), ("D", far + pd.Timedelta("31h"), 3.0)]
    df = spark.createDataFrame(
        [(s, None if t is None else t.to_pydatetime(), v) for s, t, v in known], "site_id string, timestamp timestamp, value double"
    )
    on = {"grid": "30min"}
    both = []
    for table, more in ((reindex_to_grid(df), {}), (df, {"reindex": True})):
        rolled = add_rolling_features(table, windows=(2, lookback), stats=("mean", "std", "min"), **on, **more)
        lagged = add_target_lags(table, lags=(1, lookback), **on, **more)
        both.append((rolled, lagged))
    deals = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(site_id")
    assert [deals(fused) for fused in both[1]] == [deals(plain) - 1 for plain in both[0]]
    for plain, fused in zip(*both):
        assert fused.columns == plain.columns
        pd.testing.assert_frame_equal(rows(fused), rows(plain))


def test_reindex_needs_a_grid_and_sites(panel):
    with pytest.raises(ValueError):
        add_rolling_features(panel, reindex=True)
