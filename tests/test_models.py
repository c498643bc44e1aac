import numpy as np
import pandas as pd
import pytest
from panel_helpers import gappy, rows, to_spark
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from wattline.functions.calendar import add_calendar_features, add_cyclical_features
from wattline.models import (
    MODEL_REGISTRY,
    BoostedTrees,
    ProfileMean,
    Ridge,
    SeasonalNaive,
    build_model,
)
from wattline.operators.features import add_target_lags
from wattline.operators.folds import complete_cases, time_split
from wattline.plans.backtest import backtest, backtest_predictions
from wattline.plans.features import build_features
from wattline.plans.reports import forecast_vs_actual, load_profile, residual_histogram
from wattline.plans.training import (
    direct_horizon_frame,
    fit_direct,
    fit_until,
    forecast_horizon,
    predict,
    train,
)
from wattline.sources.models import load_model, save_model

CUT = "2025-02-12"


@pytest.fixture(scope="module")
def features(panel):
    df = build_features(panel).drop("unit")
    return df.cache()


def test_registry():
    assert sorted(MODEL_REGISTRY) == ["gbt", "lightgbm", "profile_mean", "ridge", "seasonal_naive"]
    assert build_model("ridge", alpha=2.0).alpha == 2.0
    with pytest.raises(KeyError, match="registered as 'x'"):
        build_model("x")
    with pytest.raises(ValueError, match="align"):
        SeasonalNaive(align="row")


def test_seasonal_naive_repeats_the_last_season(panel, demand):
    site = panel.where("site_id = 'north'")
    head = site.orderBy("timestamp").limit(336)
    out = rows(SeasonalNaive(336, align="position").fit(site).transform(head))
    want = demand[demand.site_id == "north"].value.tail(336)
    assert np.allclose(out.prediction, want)


def test_phase_alignment_keeps_the_weekday_after_a_gap(panel, demand):
    before, after = time_split(panel, CUT)
    late = after.where(F.col("timestamp") >= F.lit("2025-02-13"))
    out = rows(SeasonalNaive(336).fit(before).transform(late))
    known = demand.set_index(["site_id", "timestamp"]).value
    cut = pd.Timestamp(CUT, tz="UTC")
    for site, ts, p in out[["site_id", "timestamp", "prediction"]].iloc[::97].itertuples(index=False):
        back = ts
        while back >= cut:
            back -= pd.Timedelta(days=7)
        assert p == known[site, back]


def test_phase_alignment_without_history_is_null(spark):
    pdf = gappy(n=100, sites=("A",))
    before, after = pdf.iloc[:80], pdf.iloc[80:]
    out = rows(SeasonalNaive(336).fit(to_spark(spark, before)).transform(to_spark(spark, after)))
    assert out.prediction.isna().all()


def test_short_history_is_tiled_by_position(spark):
    ts = pd.date_range("2025-01-01", periods=10, freq="30min", tz="UTC")
    pdf = pd.DataFrame({"site_id": "A", "timestamp": ts, "value": np.arange(10.0)})
    model = SeasonalNaive(7, align="position").fit(to_spark(spark, pdf.iloc[:3]))
    out = rows(model.transform(to_spark(spark, pdf.iloc[3:])))
    assert out.prediction.tolist() == [0, 1, 2, 0, 1, 2, 0]


def test_profile_mean_is_the_cell_average(panel, demand):
    df = add_calendar_features(panel)
    out = rows(ProfileMean().fit(df).transform(df))
    want = out.groupby(["day_of_week", "minute_of_day"]).value.transform("mean")
    assert np.allclose(out.prediction, want) and len(out) == len(demand)


def test_unseen_cells_get_the_row_mean(panel):
    df = add_calendar_features(panel)
    fitted = ProfileMean().fit(df.where("day_of_week < 5 OR minute_of_day < 60"))
    out = fitted.transform(df.where("day_of_week = 6 AND minute_of_day >= 60")).select(
        "prediction"
    ).distinct().collect()
    want = df.where("day_of_week < 5 OR minute_of_day < 60").agg(F.avg("value")).first()[0]
    assert len(out) == 1 and out[0][0] == pytest.approx(want)


COLS = ["value_lag_48", "value_lag_336", "tod_sin", "heating_degrees"]


def closed_form(pdf, cols, target, alpha):
    x, y = pdf[cols].to_numpy(), pdf[target].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(cols)), xc.T @ yc)
    return y.mean() - x.mean(0) @ coef, coef


@pytest.mark.parametrize("alpha", [0.0, 1.0, 500.0])
def test_ridge_matches_the_closed_form(features, alpha):
    known = complete_cases(features, [*COLS, "value"])
    fit = Ridge(alpha).fit(known, COLS).tables["coefficients"].first()
    b0, b = closed_form(known.toPandas(), COLS, "value", alpha)
    assert fit.intercept == pytest.approx(b0, rel=1e-8)
    assert np.allclose(fit.coefficients, b, rtol=1e-8)


def test_ridge_agrees_with_spark_ml(features):
    known = complete_cases(features, [*COLS, "value"])
    n, sd = known.agg(F.count("*"), F.stddev_pop("value")).first()
    lr = LinearRegression(
        labelCol="value",
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        regParam=50.0 / n * sd,
    ).fit(VectorAssembler(inputCols=COLS, outputCol="features").transform(known))
    fit = Ridge(50.0).fit(known, COLS).tables["coefficients"].first()
    assert np.allclose(fit.coefficients, lr.coefficients.toArray(), rtol=1e-6)


def test_local_ridge_fits_every_site_on_its_own(features):
    known = complete_cases(features, [*COLS, "value"])
    table = Ridge(1.0, ["site_id"]).fit(known, COLS).tables["coefficients"].collect()
    pdf = known.toPandas()
    for r in table:
        _, b = closed_form(pdf[pdf.site_id == r.site_id], COLS, "value", 1.0)
        assert np.allclose(r.coefficients, b, rtol=1e-7)


def test_ridge_survives_large_offsets(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 400)
    pdf = pd.DataFrame({"x": x + 1e9, "value": 3 * x + 1e9 + rng.normal(0, 0.01, 400)})
    fit = Ridge(0.0).fit(spark.createDataFrame(pdf), ["x"]).tables["coefficients"].first()
    assert fit.coefficients[0] == pytest.approx(3, abs=1e-2)


@pytest.mark.parametrize("name", ["seasonal_naive", "profile_mean", "ridge"])
def test_bundles_predict_the_same_after_loading(features, tmp_path, name):
    fitted = fit_until(features, COLS, CUT, model=name)
    path = save_model(features.sparkSession, fitted, str(tmp_path / name))
    loaded = load_model(features.sparkSession, path)
    assert loaded.features == COLS and loaded.target == "value"
    assert loaded.model.params() == fitted.model.params()
    _, after = time_split(features, CUT)
    a, b = rows(fitted.transform(after)), rows(predict(path, after))
    assert np.allclose(a.prediction, b.prediction, equal_nan=True)


def test_trees_train_save_and_predict(features, tmp_path):
    params = {"n_estimators": 5, "num_leaves": 7, "learning_rate": 0.3, "subsample": 0.8, "n_jobs": 2}
    path = train(features, str(tmp_path / "m"), COLS, CUT, **params)
    before, after = time_split(complete_cases(features, [*COLS, "value"]), CUT)
    out = rows(predict(path, after))
    assert np.isfinite(out.prediction).all()
    seen = rows(predict(path, before))
    assert ((seen.prediction - seen.value) ** 2).mean() < seen.value.var()
    again = fit_until(features, COLS, CUT, **params)
    assert np.allclose(rows(again.transform(after)).prediction, out.prediction)


def test_leaves_become_depth():
    for leaves, depth in ((2, 1), (31, 5), (32, 5), (63, 6), (64, 6)):
        stages = BoostedTrees(num_leaves=leaves)._stages(["x"], "y").getStages()
        assert stages[1].getMaxDepth() == depth


FOLDS = {"n_splits": 3, "test_size": 336, "gap": 48}


def by_loop(pdf, predict_fold, n_splits=3, test_size=336, gap=48, cols=()):
    ticks = sorted(pdf.timestamp.unique())
    out = []
    for i in range(n_splits - 1, -1, -1):
        end = len(ticks) - i * test_size
        start = end - test_size
        if start - gap <= 0:
            continue
        tr = pdf[pdf.timestamp.isin(ticks[: start - gap])].dropna(subset=[*cols, "value"])
        te = pdf[pdf.timestamp.isin(ticks[start:end])].dropna(subset=[*cols, "value"])
        out.append((len(tr), len(te), np.abs(te.value - predict_fold(tr, te)).mean()))
    return out


def test_backtest_columns_and_profile_values(features):
    report = backtest(ProfileMean(), features, ["day_of_week", "minute_of_day"], **FOLDS)
    assert report.columns == [
        "fold", "train_end", "test_start", "test_end", "n_train", "n_test",
        "mae", "rmse", "mape", "smape", "bias", "n_pred",
    ]

    def profile(tr, te):
        cells = tr.groupby(["day_of_week", "minute_of_day"]).value.mean()
        keys = pd.MultiIndex.from_frame(te[["day_of_week", "minute_of_day"]])
        return cells.reindex(keys).fillna(tr.value.mean()).to_numpy()

    got = [(r.n_train, r.n_test, pytest.approx(r.mae)) for r in report.collect()]
    assert got == by_loop(rows(features), profile)


def test_backtest_ridge_matches_a_loop(features):
    cols = ["value_lag_48", "tod_sin"]

    def ridge(tr, te):
        b0, b = closed_form(tr, cols, "value", 2.0)
        return b0 + te[cols].to_numpy() @ b

    got = backtest(Ridge(2.0), features, cols, strict_leakage=True, **FOLDS).collect()
    want = by_loop(rows(features), ridge, cols=cols)
    assert [(r.n_train, r.n_test) for r in got] == [w[:2] for w in want]
    assert np.allclose([r.mae for r in got], [w[2] for w in want])


def test_backtest_position_matches_a_loop(spark, demand):
    pdf = demand[demand.site_id == "north"][["site_id", "timestamp", "value"]]
    pdf = pdf.drop(pdf.index[100:500:7])

    def naive(tr, te):
        last = tr.value.tail(336).to_numpy()
        return np.tile(last, -(-len(te) // len(last)))[: len(te)]

    model = SeasonalNaive(336, align="position")
    got = backtest(model, to_spark(spark, pdf), unit="row", **FOLDS).collect()
    want = by_loop(pdf, naive)
    assert np.allclose([(r.n_train, r.n_test, r.mae) for r in got], want)


def test_backtest_with_gaps_in_the_data(spark):
    pdf = gappy(n=400, sites=("A",))
    pdf.loc[200:230, "value"] = np.nan
    df = to_spark(spark, pdf)
    report = backtest(SeasonalNaive(48), df, n_splits=3, test_size=60, gap=0, extras=True)
    folds = report.collect()
    assert [r.fold for r in folds] == [0, 1, 2]
    assert all(r.n_pred <= r.n_test for r in folds)
    assert all(r.train_end < r.test_start for r in folds)


def test_backtest_empty_fold_is_left_out(spark):
    pdf = gappy(n=400, sites=("A",))
    pdf.loc[280:339, "value"] = np.nan
    report = backtest(SeasonalNaive(48), to_spark(spark, pdf), n_splits=3, test_size=60, gap=0)
    assert [r.fold for r in report.collect()] == [0, 2]


def test_backtest_per_site_and_mase(panel):
    model = SeasonalNaive(336)
    per_site = backtest(model, panel, by=["site_id"], **FOLDS).collect()
    assert [(r.fold, r.site_id) for r in per_site] == [
        (f, s) for f in range(3) for s in ("north", "quay")
    ]
    pooled = backtest(model, panel, season_length=336, grid="30min", extras=True, **FOLDS).collect()
    assert all(0.5 < r.mase < 1.5 for r in pooled)
    assert [r.n_train for r in pooled] == [
        sum(r.n_train for r in per_site if r.fold == f) for f in range(3)
    ]


def test_strict_leakage_stops_a_backtest(features):
    with pytest.raises(ValueError, match="gap"):
        backtest(Ridge(), features, ["value_lag_1"], gap=48, strict_leakage=True)


def test_any_model_with_fit_and_transform_can_be_backtested(features):
    report = backtest(
        BoostedTrees(n_estimators=2, num_leaves=4), features, COLS, n_splits=2, test_size=336, gap=48
    ).collect()
    assert [r.fold for r in report] == [0, 1]
    assert all(np.isfinite(r.mae) for r in report)


def test_direct_frame_and_forecast(spark, small_blocks):
    pdf = gappy(n=200)
    frame = rows(direct_horizon_frame(to_spark(spark, pdf), 5, grid="30min"), "site_id", "timestamp", "step")
    for h in (1, 5):
        ahead = pdf.groupby("site_id").value.shift(-h)
        want = pdf.assign(a=ahead).dropna(subset=["a"])
        got = frame[frame.step == h]
        assert got.value_ahead.tolist() == want.a.tolist()
        assert got.timestamp.tolist() == want.timestamp.tolist()


def test_horizon_forecast_fits_one_model_per_step(panel):
    lagged = add_target_lags(panel, lags=(47,), grid="30min")
    table = add_cyclical_features(add_calendar_features(lagged))
    cols = ["value", "value_lag_47", "tod_sin"]
    fitted = fit_direct(table, cols, 3, grid="30min")
    assert fitted.tables["coefficients"].count() == 3
    out = rows(forecast_horizon(fitted, table, 3), "site_id", "step")
    assert out.step.tolist() == [1, 2, 3] * 2
    assert ((out.target_timestamp - out.timestamp) == out.step * pd.Timedelta("30min")).all()
    assert np.isfinite(out.prediction).all()
    pdf = rows(table)
    pdf["ahead"] = pdf.groupby("site_id").value.shift(-2)
    known = pdf.dropna(subset=[*cols, "ahead"])
    b0, b = closed_form(known, cols, "ahead", 1.0)
    last = pdf[pdf.site_id == "quay"].iloc[-1]
    got = out[(out.site_id == "quay") & (out.step == 2)].prediction.iloc[0]
    assert got == pytest.approx(b0 + last[cols].to_numpy(float) @ b)


def test_load_profile_by_site(panel):
    out = load_profile(panel, "north").toPandas()
    assert len(out) == 96 and set(out.hour_of_day) == {m / 60 for m in range(0, 1440, 30)}
    noon = out[out.minute_of_day == 720].set_index("is_weekend").mean_value
    assert noon[True] < noon[False]


def test_forecast_against_actual(panel):
    out = forecast_vs_actual(backtest_predictions(SeasonalNaive(336), panel, **FOLDS))
    assert out.columns == ["site_id", "timestamp", "actual", "forecast"]
    assert out.count() == 3 * 336 * 2


def test_residual_histogram_matches_numpy(spark):
    rng = np.random.default_rng(4)
    y, p = rng.normal(0, 1, 2000), rng.normal(0.3, 1, 2000)
    df = spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": p}))
    out = rows(residual_histogram(df), "bin")
    counts, edges = np.histogram(p - y, bins=60)
    assert out.n.tolist() == counts.tolist()
    assert np.allclose(out.bin_start, edges[:-1]) and np.allclose(out.bin_end, edges[1:])


def test_residual_histogram_of_equal_residuals(spark):
    df = spark.createDataFrame([(1.0, 3.0)] * 7, "y_true double, y_pred double")
    out = rows(residual_histogram(df), "bin")
    counts, edges = np.histogram([2.0] * 7, bins=60)
    assert out.n.tolist() == counts.tolist()
    assert out.bin_start[0] == 1.5 and out.bin_end[59] == pytest.approx(2.5)
