"""Queries that train trees by leaf, on tables of a few thousand rows built here."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.serializers import CloudPickleSerializer

from tools.check import compare
from wattline.models import LeafwiseTrees, leafwise


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder with events and lineitem, some rows of which come twice or have no value, and their views."""
    rng = np.random.default_rng(41)
    slots = np.flatnonzero(rng.random(1440) < 0.9).repeat(2)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(slots * 1800 + rng.integers(0, 1800, len(slots)), unit="s")
    value = 20 + 30 * (ts.hour >= 7) - 6 * (ts.dayofweek >= 5) + rng.normal(size=len(ts))
    events = pd.DataFrame(
        {"event_id": range(len(ts)), "ts": ts, "user_id": 1, "event_type": np.tile(["view", "click"], len(ts) // 2), "value": value}
    )
    days = rng.permutation(3 * 1200)[:2500]
    shipped = pd.Timestamp("1995-01-01") + pd.to_timedelta(days // 3, unit="D")
    lines = pd.DataFrame(
        {
            "l_orderkey": range(len(days)), "l_partkey": 1, "l_suppkey": days % 3, "l_linenumber": 1,
            "l_quantity": 10.0 + 5 * (shipped.month > 6) + 3 * (shipped.dayofweek > 3) + rng.normal(size=len(days)),
            "l_extendedprice": 1.0, "l_shipdate": shipped,
        }
    )
    folder, con = tmp_path_factory.mktemp("tables"), duckdb.connect()
    for name, table, column in (("events", events, "value"), ("lineitem", lines, "l_quantity")):
        table.loc[table.sample(15, random_state=1).index, column] = np.nan
        table = pd.concat([table, table.sample(50, random_state=2)])
        table.to_parquet(folder / f"{name}.parquet", index=False, coerce_timestamps="us")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["backtest_gbt", "backtest_gbt_tree", "forecast_horizon_gbt", "gbt_fit", "gbt_leafwise_tree"])
def test_query_equals_sql_on_rows_built_here(spark, tables, name):
    folder, con = tables
    _, text, same = compare(spark, con, name, str(folder))
    assert same and text.startswith("ok"), text


def test_tasks_get_neither_model_nor_session(spark, monkeypatch):
    """Functions go to the tasks by value, and a class would take along all that its methods refer to."""
    monkeypatch.setattr(leafwise, "RESTAGE", 1)
    sent, dumps = [], CloudPickleSerializer.dumps
    monkeypatch.setattr(CloudPickleSerializer, "dumps", lambda self, f: sent.append(dumps(self, f)) or sent[-1])
    df = spark.range(60).selectExpr("id % 5 AS a", "id % 5 + id / 100 AS y")
    model = LeafwiseTrees(n_estimators=2, num_leaves=3, min_child_samples=2, subsample=0.8, subsample_freq=1)
    assert len(model.fit(df, ["a"], "y").tables["trees"].first().trees) == 2
    # Bins, sums, splits of roots and of children, predictions so far.
    assert len(sent) >= 5 and not any(b"shared_dir" in f or b"LeafwiseTrees" in f for f in sent)
