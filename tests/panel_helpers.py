"""Helpers of the tests: frames to Spark and back, a panel with gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd


def to_spark(spark, pdf: pd.DataFrame):
    """A pandas frame with zoned timestamps as Spark rows (NaN becomes null)."""
    from wattline.schema import nan_to_null

    return nan_to_null(spark.createDataFrame(pdf))


def rows(df, *order: str) -> pd.DataFrame:
    """Collected rows in a fixed order with UTC timestamps."""
    out = df.toPandas()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime64"):
            out[c] = out[c].dt.tz_localize("UTC") if out[c].dt.tz is None else out[c]
    order = order or ("site_id", "timestamp")
    return out.sort_values(list(order)).reset_index(drop=True)


def gappy(seed: int = 3, n: int = 300, sites=("A", "B", "C")) -> pd.DataFrame:
    """Regular half-hours with many nulls, including long, leading and trailing runs."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, site in enumerate(sites):
        ts = pd.date_range("2025-03-29", periods=n, freq="30min", tz="UTC") + pd.Timedelta(
            hours=i
        )
        v = np.round(rng.normal(50, 10, n), 2)
        v[rng.random(n) < 0.3] = np.nan
        v[40:75] = np.nan
        v[: 3 * i] = np.nan
        v[n - 2 * i :] = np.nan
        parts.append(pd.DataFrame({"site_id": site, "timestamp": ts, "value": v}))
    return pd.concat(parts, ignore_index=True)
