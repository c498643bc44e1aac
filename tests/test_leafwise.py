import math
import random

import numpy as np
import pandas as pd
import pytest
from panel_helpers import rows, to_spark
from pyspark.sql import functions as F

from wattline.models import LeafwiseTrees
from wattline.models import leafwise
from wattline.operators.features import add_target_lags
from wattline.plans.backtest import backtest, backtest_predictions
from wattline.plans.training import fit_direct, forecast_horizon
from wattline.sources.models import load_model, save_model


def plain_boosting(x, y, edges, leaves, rounds, rate, least, used=None, chosen=None):
    """Best-first boosting on the same bins by plain loops; returns predictions and trees' leaf counts."""
    bins = np.zeros(x.shape, int)
    for f, e in enumerate(edges):
        known = ~np.isnan(x[:, f])
        bins[known, f] = 1 + np.searchsorted(e, x[known, f], "left")
    pred = np.full(len(y), y.mean())
    sizes = []
    for t in range(rounds):
        r = y - pred
        sample = np.ones(len(y), bool) if used is None else used(t)
        features = range(x.shape[1]) if chosen is None else chosen(t)

        def best(idx):
            idx = idx[sample[idx]]
            out = (0.0, None, None)
            if not len(idx):
                return out
            base = r[idx].sum() ** 2 / len(idx)
            for f in features:
                for b in range(bins[:, f].max() + 1):
                    low = bins[idx, f] <= b
                    n, m = low.sum(), (~low).sum()
                    if n < least or m < least:
                        continue
                    gain = r[idx][low].sum() ** 2 / n + r[idx][~low].sum() ** 2 / m - base
                    if gain > out[0] + 1e-9:
                        out = (gain, f, b)
            return out

        nodes = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(nodes) < leaves:
            k = max(range(len(nodes)), key=lambda k: nodes[k][0][0])
            (gain, f, b), idx = nodes[k]
            if f is None:
                break
            low = bins[idx, f] <= b
            nodes.pop(k)
            nodes += [(best(idx[low]), idx[low]), (best(idx[~low]), idx[~low])]
        for _, idx in nodes:
            own = idx[sample[idx]]
            pred[idx] += rate * r[own].mean() if len(own) else 0
        sizes.append(len(nodes))
    return pred, sizes


def noisy(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 7, n), rng.normal(size=n), rng.integers(0, 48, n), rng.normal(size=n)], 1).astype(float)
    y = 3 * (x[:, 0] > 4) + np.sin(x[:, 2] / 7) * x[:, 1] + 0.1 * rng.normal(size=n)
    x[rng.random(n) < 0.1, 1] = np.nan
    return x, y


COLS = ["a", "b", "c", "d"]


def frame(spark, x, y):
    pdf = pd.DataFrame(x, columns=COLS).assign(y=y, row=range(len(y)))
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, y double, row long")


def edges_of(spark, df, max_bin=255):
    """The fit's own bins: plain boosting then has to find the same trees."""
    named = df.select(F.lit(0).alias("first"), F.lit(0).alias("upto"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(COLS)])
    edges = leafwise.Trainer(LeafwiseTrees(max_bin=max_bin), spark, named, len(COLS), 1, False).bin_edges()
    assert all((np.diff(e) > 0).all() and len(e) < max_bin for e in edges)
    return edges


@pytest.mark.parametrize("leaves", [2, 5, 31])
def test_trees_equal_plain_best_first_boosting(spark, leaves):
    x, y = noisy()
    model = LeafwiseTrees(n_estimators=3, num_leaves=leaves, learning_rate=0.3, min_child_samples=7, max_bin=255)
    df = frame(spark, x, y).repartition(3)
    fitted = model.fit(df, COLS, "y")
    want, sizes = plain_boosting(x, y, edges_of(spark, df), leaves, 3, 0.3, 7)
    got = rows(fitted.transform(df), "row").prediction.to_numpy()
    assert np.allclose(got, want, atol=1e-6)
    trees = fitted.tables["trees"].first().trees
    assert [sum(f < 0 for f in t.feature) for t in trees] == sizes
    assert max(sizes) == leaves


def test_layout_does_not_matter(spark):
    x, y = noisy()
    model = LeafwiseTrees(n_estimators=2, num_leaves=15, subsample=0.7, subsample_freq=1, colsample_bytree=0.6)
    df = frame(spark, x, y)
    one = model.fit(df.coalesce(1), COLS, "y").tables["trees"].first()
    many = model.fit(df.repartition(5, "d"), COLS, "y").tables["trees"].first()
    assert one == many


def test_sampling_of_rows_and_features(spark):
    x, y = noisy()
    model = LeafwiseTrees(n_estimators=4, num_leaves=8, subsample=0.5, subsample_freq=2, colsample_bytree=0.5, random_state=5)
    fitted = model.fit(frame(spark, x, y), COLS, "y")
    trees = fitted.tables["trees"].first().trees
    for t, tree in enumerate(trees):
        used = {f for f in tree.feature if f >= 0}
        assert used <= set(random.Random(f"5/{t}").sample(range(4), 2))
    key = np.arange(100_000)
    first = leafwise.sampled(key, 5, 0, 0.5)
    assert abs(first.mean() - 0.5) < 0.01
    assert (leafwise.sampled(key, 5, 1, 0.5) != first).mean() > 0.4


def test_many_rounds_store_predictions_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(leafwise, "RESTAGE", 2)
    x, y = noisy(300)
    df = frame(spark, x, y)
    got = rows(LeafwiseTrees(n_estimators=5, num_leaves=4, min_child_samples=5).fit(df, COLS, "y").transform(df), "row")
    want, _ = plain_boosting(x, y, edges_of(spark, df), 4, 5, 0.1, 5)
    assert np.allclose(got.prediction, want, atol=1e-6)


def test_few_bins(spark):
    x, y = noisy()
    fitted = LeafwiseTrees(n_estimators=1, num_leaves=31, max_bin=8).fit(frame(spark, x, y), COLS, "y")
    tree = fitted.tables["trees"].first().trees[0]
    limits = {(f, t) for f, t in zip(tree.feature, tree.threshold) if f >= 0 and math.isfinite(t)}
    assert all(sum(f == k for f, _ in limits) <= 7 for k in range(4))


def test_odd_training_rows(spark):
    x, y = noisy(50)
    df = frame(spark, x, y)
    model = LeafwiseTrees(n_estimators=2, num_leaves=4, min_child_samples=2)
    nothing = model.fit(df.where("row < 0"), COLS, "y").transform(df)
    assert nothing.where("prediction is not null").count() == 0
    flat = model.fit(df.withColumn("y", F.lit(2.5)), COLS, "y").transform(df)
    assert {round(r.prediction, 6) for r in flat.collect()} == {2.5}
    one = model.fit(df.where("row = 0"), COLS, "y").transform(df)
    assert {round(r.prediction, 6) for r in one.collect()} == {round(y[0], 6)}
    empty = df.withColumns({c: F.lit(None).cast("double") for c in COLS})
    got = model.fit(empty, COLS, "y").transform(empty)
    assert {round(r.prediction, 6) for r in got.collect()} == {round(y.mean(), 6)}
    nan = model.fit(df.fillna(float("nan"), ["b"]), COLS, "y")
    assert nan.tables["trees"].first() == model.fit(df, COLS, "y").tables["trees"].first()
    with pytest.raises(ValueError, match="max_bin"):
        LeafwiseTrees(max_bin=256)


FOLDS = {"n_splits": 3, "test_size": 336, "gap": 48}


def test_folds_in_one_run_equal_fits_per_fold(spark, panel):
    df = add_target_lags(panel, lags=(48, 96), grid="30min").withColumn("slot", F.hour("timestamp"))
    cols = ["value_lag_48", "value_lag_96", "slot"]
    # With so few bins taken from whole days, edges are the same whichever rows they come from.
    df = df.withColumns({c: F.round(F.col(c) / 10) * 10 for c in cols[:2]})
    model = LeafwiseTrees(n_estimators=2, num_leaves=6, learning_rate=0.5)
    together = rows(backtest_predictions(model, df, cols, **FOLDS), "fold", "site_id", "timestamp")
    pdf = rows(df)
    ticks = sorted(pdf.timestamp.unique())
    for fold in range(3):
        end = len(ticks) - (2 - fold) * 336
        until = ticks[end - 336 - 48]
        train = pdf[pdf.timestamp < until].dropna(subset=[*cols, "value"])
        test = pdf[pdf.timestamp.isin(ticks[end - 336 : end])].dropna(subset=[*cols, "value"])
        x = train[cols].to_numpy(float)
        both = np.concatenate([x, test[cols].to_numpy(float)])
        fitted = model.fit(to_spark(spark, train), cols, "value")
        alone = rows(fitted.transform(to_spark(spark, test)))
        got = together[together.fold == fold]
        assert got.timestamp.tolist() == alone.timestamp.tolist() and len(both) > len(x)
        assert np.allclose(got.y_pred, alone.prediction, atol=1e-6)
    report = backtest(model, df, cols, **FOLDS).collect()
    assert [r.fold for r in report] == [0, 1, 2] and all(r.n_pred == r.n_test for r in report)


def test_steps_in_one_run_and_saved(spark, panel, tmp_path):
    df = add_target_lags(panel, lags=(1, 48), grid="30min")
    cols = ["value", "value_lag_48"]
    model = LeafwiseTrees(n_estimators=2, num_leaves=5, max_bin=32)
    fitted = fit_direct(df, cols, 3, model=model, grid="30min")
    assert fitted.tables["trees"].count() == 3
    out = rows(forecast_horizon(fitted, df, 3), "site_id", "step")
    assert len(out) == 6 and np.isfinite(out.prediction).all() and out.prediction.nunique() > 2
    plan = forecast_horizon(fitted, df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    path = save_model(spark, fitted, str(tmp_path / "steps"))
    again = rows(forecast_horizon(load_model(spark, path), df, 3), "site_id", "step")
    assert np.allclose(again.prediction, out.prediction)
    # The model of one step is what a fit on that step's rows gives.
    from wattline.plans.training import direct_horizon_frame

    one = direct_horizon_frame(df, 3, grid="30min").where("step = 2").dropna(subset=[*cols, "value_ahead"])
    alone = LeafwiseTrees(n_estimators=2, num_leaves=5, max_bin=255).fit(one, cols, "value_ahead")
    assert len(alone.tables["trees"].first().trees) == 2
