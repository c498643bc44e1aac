import pandas as pd
import pytest
from panel_helpers import gappy, to_spark
from pyspark.sql import functions as F

from wattline.operators.folds import complete_cases, rolling_origin_splits, time_split


def plain_folds(places, n_splits, test_size, gap):
    """(train, test) index ranges by counting from the end."""
    n, out = len(places), []
    for i in range(n_splits - 1, -1, -1):
        end = n - i * test_size
        start = end - test_size
        if start - gap > 0:
            out.append((places[: start - gap], places[start:end]))
    return out


def test_time_split_is_at_utc(spark):
    ts = pd.to_datetime(["2024-12-31 23:30", "2025-01-01 00:00", None], utc=True)
    df = spark.createDataFrame(pd.DataFrame({"timestamp": ts, "v": [1, 2, 3]}))
    before, after = time_split(df, "2025-01-01")
    assert [r.v for r in before.collect()] == [1]
    assert [r.v for r in after.collect()] == [2]


def test_complete_cases_drops_nulls_and_nans(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (None, 1.0), (float("nan"), 2.0), (3.0, None)], "a double, b double"
    )
    assert complete_cases(df, ["a"]).count() == 2
    assert complete_cases(df, ["a", "b", "a"]).count() == 1


@pytest.mark.parametrize("n_splits, size, gap", [(3, 48, 48), (5, 336, 48), (4, 20, 0), (2, 400, 5)])
def test_periods_are_counted_over_all_sites(spark, n_splits, size, gap):
    pdf = gappy(n=400).dropna()
    ticks = sorted(pdf.timestamp.unique())
    out = rolling_origin_splits(to_spark(spark, pdf), n_splits, size, gap).toPandas()
    out["timestamp"] = out.timestamp.dt.tz_localize("UTC")
    expected = plain_folds(ticks, n_splits, size, gap)
    assert out.fold.nunique() == len(expected)
    for fold, (train, test) in enumerate(expected):
        for part, want in (("train", train), ("test", test)):
            got = out[(out.fold == fold) & (out.part == part)]
            rows_wanted = pdf[pdf.timestamp.isin(want)]
            assert len(got) == len(rows_wanted)
            assert set(got.timestamp) == set(rows_wanted.timestamp)


def test_folds_never_look_ahead(panel):
    df = rolling_origin_splits(panel.where("site_id = 'north'"), 3, 48, 48)
    edges = df.groupBy("fold").agg(
        F.max(F.when(F.col("part") == "train", F.col("timestamp"))).alias("a"),
        F.min(F.when(F.col("part") == "test", F.col("timestamp"))).alias("b"),
    ).collect()
    assert len(edges) == 3
    assert all((r.b - r.a).total_seconds() == 49 * 1800 for r in edges)


def test_row_mode_counts_rows(spark):
    pdf = gappy(n=60).dropna().sort_values(["timestamp", "site_id"]).reset_index(drop=True)
    out = rolling_origin_splits(to_spark(spark, pdf), 3, 25, 10, unit="row").toPandas()
    out["key"] = out.site_id + out.timestamp.astype(str)
    pdf["key"] = pdf.site_id + pdf.timestamp.dt.tz_localize(None).astype(str)
    for fold, (train, test) in enumerate(plain_folds(pdf.key.tolist(), 3, 25, 10)):
        got = out[out.fold == fold]
        assert sorted(got[got.part == "train"].key) == sorted(train)
        assert sorted(got[got.part == "test"].key) == sorted(test)


def test_too_many_folds_leave_none(spark):
    assert rolling_origin_splits(to_spark(spark, gappy(n=60)), 2, 500, 0).count() == 0


def test_unknown_units_are_refused(panel):
    with pytest.raises(ValueError, match="unit"):
        rolling_origin_splits(panel, unit="day")


def test_ranking_is_bounded_by_the_parameters(panel):
    plan = rolling_origin_splits(panel, 3, 48, 48)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=193" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
