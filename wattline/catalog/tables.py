"""Domain tables derived from the given tables, in Spark and in SQL.

Three panels: ``events`` (30-minute grid, five sites), ``orders`` (daily, 25 sites,
several years with clock changes) and ``lines`` (daily, one site per supplier, the one
that grows with the scale factor in rows and in sites).
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import floor_to, instant

FREQ = {"events": "30min", "orders": "1D", "lines": "1D"}

# Fixed holiday dates used by the holiday queries.
HOLIDAYS = ["2024-01-01"] + [
    f"{year}-{day}" for year in range(1995, 2002) for day in ("01-01", "12-25", "12-26")
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("site_id"),
        floor_to(instant("ts"), "30min").alias("timestamp"),
        "value",
        F.lit("kWh").alias("unit"),
        F.struct("ts", "event_id").alias("ingest_order"),
    )


def meter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").cast("string").alias("site_id"),
        instant("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("value"),
        F.lit("kWh").alias("unit"),
        F.struct("o_orderkey").alias("ingest_order"),
    )


def meter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("site_id"),
        instant("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("value"),
        F.lit("kWh").alias("unit"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias(
            "ingest_order"
        ),
    )


METERS = {"events": meter_events, "orders": meter_orders, "lines": meter_lines}


def sites_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event type, with sizes taken from the events."""
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("site_id"))
        .agg(
            F.concat(F.lit("Trust "), F.first("event_type")).alias("trust_name"),
            F.lit("acute").alias("site_type"),
            (F.count(F.lit(1)) * 10.0).cast("double").alias("gia_m2"),
            F.countDistinct("user_id").cast("int").alias("beds"),
            (F.lit(50.0) + F.min("user_id") / 128).alias("latitude"),
            (F.lit(-1.0) - F.max("user_id") / 1024).alias("longitude"),
        )
    )


def sites_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("site_id"),
        F.col("r_name").alias("trust_name"),
        F.col("n_name").alias("site_type"),
    )


def weather_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather at the periods that have events; other periods have none."""
    wall = floor_to(instant("ts"), "30min")
    cells = (
        read(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("site_id"), wall.alias("timestamp"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    )
    hour = F.hour("ts")
    season = F.sin(F.lit(2 * pi) * (F.dayofyear("ts") - 200) / 365.25)
    return cells.select(
        "site_id",
        "timestamp",
        F.round(10 + 6 * season + 4 * F.sin(F.lit(2 * pi) * (hour - 9) / 24), 6).alias(
            "temperature_c"
        ),
        F.round(60 + 20 * F.cos(F.lit(2 * pi) * hour / 24), 6).alias("humidity_pct"),
        F.round(3 + F.col("n") / 10, 6).alias("wind_speed_ms"),
        F.round(F.greatest(F.lit(0.0), 500 * F.sin(F.lit(2 * pi) * (hour - 6) / 24)), 6).alias(
            "solar_irradiance_wm2"
        ),
    )


_METER_SQL = {
    "events": """
meter AS (
  SELECT event_type AS site_id, time_bucket(INTERVAL 30 MINUTE, ts) AS timestamp, value,
         'kWh' AS unit, ROW(ts, event_id) AS o
  FROM events)""",
    "orders": """
meter AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS site_id, o_orderdate AS timestamp,
         o_totalprice AS value, 'kWh' AS unit, ROW(o_orderkey) AS o
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "lines": """
meter AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS site_id, l_shipdate AS timestamp,
         l_quantity AS value, 'kWh' AS unit,
         ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS o
  FROM lineitem)""",
}

_STEP_SQL = {
    "events": "INTERVAL 30 MINUTE",
    "orders": "INTERVAL 1 DAY",
    "lines": "INTERVAL 1 DAY",
}


def panel_sql(panel: str, max_gap: int = 4, skip_long: bool = False) -> str:
    """Common table expressions: meter, readings, grid, gridded, flagged, filled."""
    size = "next_pos - prev_pos - 1" if skip_long else "pos - prev_pos"
    return f"""WITH {_METER_SQL[panel].strip()},
readings AS (
  SELECT site_id, timestamp, value, unit FROM meter
  QUALIFY row_number() OVER (PARTITION BY site_id, timestamp ORDER BY o DESC) = 1),
bounds AS (
  SELECT site_id, min(timestamp) AS lo, max(timestamp) AS hi FROM readings GROUP BY site_id),
grid AS (
  SELECT site_id, unnest(generate_series(lo, hi, {_STEP_SQL[panel]})) AS timestamp FROM bounds),
gridded AS (
  SELECT g.site_id, g.timestamp, r.value, r.unit
  FROM grid g LEFT JOIN readings r ON g.site_id = r.site_id AND g.timestamp = r.timestamp),
med AS (SELECT site_id, median(value) AS m FROM gridded GROUP BY site_id),
mad AS (
  SELECT g.site_id, any_value(m) AS m, median(abs(value - m)) AS d
  FROM gridded g JOIN med ON g.site_id = med.site_id GROUP BY g.site_id),
flagged AS (
  SELECT g.*, coalesce(abs(0.6745 * (value - m) / nullif(d, 0)) > 5.0, false) AS is_outlier
  FROM gridded g LEFT JOIN mad ON g.site_id = mad.site_id),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) AS pos FROM flagged),
near AS (
  SELECT *,
    max(CASE WHEN value IS NOT NULL THEN pos END) OVER up AS prev_pos,
    last_value(value IGNORE NULLS) OVER up AS prev_val,
    min(CASE WHEN value IS NOT NULL THEN pos END) OVER down AS next_pos,
    first_value(value IGNORE NULLS) OVER down AS next_val
  FROM numbered
  WINDOW up AS (PARTITION BY site_id ORDER BY timestamp
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY site_id ORDER BY timestamp
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT site_id, timestamp,
    CASE WHEN value IS NOT NULL THEN value
         WHEN {size} <= {max_gap}
         THEN prev_val + (next_val - prev_val) * (pos - prev_pos) / (next_pos - prev_pos)
    END AS value, unit, is_outlier
  FROM near)"""


SITES_SQL = """
sites AS (
  SELECT event_type AS site_id, 'Trust ' || event_type AS trust_name, 'acute' AS site_type,
         count(*) * 10.0::DOUBLE AS gia_m2, CAST(count(DISTINCT user_id) AS INTEGER) AS beds,
         50.0::DOUBLE + min(user_id) / 128.0::DOUBLE AS latitude,
         -1.0::DOUBLE - max(user_id) / 1024.0::DOUBLE AS longitude
  FROM events GROUP BY event_type)"""

SITES_ORDERS_SQL = """
sites AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS site_id, r_name AS trust_name, n_name AS site_type
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

WEATHER_SQL = """
weather_cells AS (
  SELECT event_type AS site_id, time_bucket(INTERVAL 30 MINUTE, ts) AS timestamp,
         count(*) AS n FROM events GROUP BY ALL),
weather AS (
  SELECT site_id, timestamp,
    round(10 + 6 * sin(2 * pi() * (dayofyear(timestamp) - 200) / 365.25)
             + 4 * sin(2 * pi() * (hour(timestamp) - 9) / 24.0::DOUBLE), 6) AS temperature_c,
    round(60 + 20 * cos(2 * pi() * hour(timestamp) / 24.0::DOUBLE), 6) AS humidity_pct,
    round(3 + n / 10.0::DOUBLE, 6) AS wind_speed_ms,
    round(greatest(0.0, 500 * sin(2 * pi() * (hour(timestamp) - 6) / 24.0::DOUBLE)), 6)
      AS solar_irradiance_wm2
  FROM weather_cells)"""
