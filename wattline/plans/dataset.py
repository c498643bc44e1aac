"""Raw readings to the processed demand table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.blocks import BLOCK
from ..operators.cleaning import drop_duplicate_readings, fill_stretches, place_on_grid
from ..operators.quantile import join_facts, time_bucket
from ..schema import nan_to_null, validate_schema
from ..sources.sinks import stage, write_panel


def join_sites(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Attach the site register.

    Left join, for which the readings are read twice.  Spark broadcasts a register whose
    size it knows to be small; a bigger one meets the readings of a site on several tasks.
    """
    return join_facts(df, sites, "site_id", time_bucket(df)).select(
        *df.columns, *[c for c in sites.columns if c != "site_id"]
    )


def join_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Attach weather at exactly the same site and instant."""
    return df.join(weather, ["site_id", "timestamp"], "left")


def build_dataset(
    meter: DataFrame,
    sites: DataFrame | None = None,
    weather: DataFrame | None = None,
    frequency: str = "30min",
    outlier_z: float = 5.0,
    max_gap: int = 4,
    long_gaps: str = "partial",
    order_by=None,
) -> DataFrame:
    """Deduplicate, grid, flag, fill, then join the register and the weather.

    Outliers are flagged on raw values, before gaps are filled.  The readings on the grid
    feed three branches (value counts, block summary, rows), so they are written once to
    the shared folder; everything after that is one plan.  The instants between
    them, which may be many times more, are made in its last step.
    """
    validate_schema(meter)
    readings = drop_duplicate_readings(nan_to_null(meter), order_by).drop("ingest_order")
    placed = stage(place_on_grid(readings, frequency))
    # The register travels with the block summary, like the facts of the outlier flags.
    demand = fill_stretches(placed, readings.columns, "value", max_gap, long_gaps, frequency, outlier_z, sites)
    columns = _others(demand)
    if sites is not None:
        columns = [c for c in columns if c not in sites.columns] + _others(sites)
    if weather is not None:
        demand = join_weather(demand.drop(BLOCK), weather)
        columns += _others(weather)
    return demand.select("site_id", "timestamp", *columns)


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("site_id", "timestamp", BLOCK)]


def write_dataset(meter: DataFrame, path: str, **params) -> str:
    """Build the processed table and write it, clustered by site and time."""
    return write_panel(build_dataset(meter, **params), path)
