"""Registered queries: each a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import (
    add_calendar_features,
    add_cyclical_features,
    add_holiday_features,
)
from ..functions.metrics import all_metrics, mase, metrics_report
from ..functions.time import local_wall, utc_instant, utc_wall
from ..functions.weather import add_degree_days
from ..models import LeafwiseTrees, ProfileMean, Ridge, SeasonalNaive
from ..operators.cleaning import (
    drop_duplicate_readings,
    flag_outliers,
    interpolate_short_gaps,
    reindex_to_grid,
)
from ..operators.features import add_rolling_features, add_target_lags, add_weather_lags
from ..operators.folds import complete_cases, rolling_origin_splits, time_split
from ..operators.quality import check_regular_index, missing_periods, summarise_missing
from ..plans.backtest import backtest, backtest_predictions
from ..plans.dataset import build_dataset, join_sites, join_weather
from ..plans.features import build_features
from ..plans.reports import forecast_vs_actual, load_profile, residual_histogram
from ..plans.training import (
    direct_horizon_frame,
    fit_direct,
    fit_until,
    forecast_horizon,
    predict,
    train,
)
from ..sources.models import load_model, save_model
from ..sources.readers import (
    load_processed,
    read_hh_meter_data,
    read_holidays,
    read_site_metadata,
    read_weather,
)
from ..sources.sinks import shared_dir, stage, write_metrics_csv, write_panel
from ..sources.storage import merge_export, read_bucketed, read_readings, write_bucketed, write_readings
from . import tables as t
from .rounding import Nudged, shown, sql_round

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CUTOFF = "2024-01-22"
SPLIT_SQL = f"TIMESTAMP '{CUTOFF}'"
# Readings of the event and line panels are below 100, those of orders below 1,000,000.
FINE, COARSE = Nudged(8), Nudged(4)
FOLDS = {"n_splits": 5, "test_size": 336, "gap": 48}
FOLDS_DAILY = {"n_splits": 5, "test_size": 28, "gap": 7}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def readings(spark: SparkSession, sf: str, panel: str = "events") -> DataFrame:
    return drop_duplicate_readings(t.METERS[panel](spark, sf)).drop("ingest_order")


def gridded(spark: SparkSession, sf: str, panel: str = "events") -> DataFrame:
    return reindex_to_grid(readings(spark, sf, panel), t.FREQ[panel])


def filled(spark: SparkSession, sf: str, panel: str = "events") -> DataFrame:
    return interpolate_short_gaps(gridded(spark, sf, panel), grid=t.FREQ[panel])


# ---------------------------------------------------------------- sources and sinks


@register("read_meter", t.panel_sql("events") + " SELECT site_id, timestamp, value, unit FROM meter")
def _(spark, sf):
    path = shared_dir(spark)
    raw = t.meter_events(spark, sf).withColumn(
        "timestamp", F.date_format(utc_wall("timestamp"), "yyyy-MM-dd HH:mm:ss'+00:00'")
    )
    raw.drop("ingest_order").write.option("header", True).csv(f"{path}/hh_meter_data_2024-02-01.csv")
    return shown(read_hh_meter_data(spark, f"{path}/*").drop("ingest_order"))


@register(
    "read_meter_offsets", t.panel_sql("events") + " SELECT site_id, timestamp, value, unit FROM meter"
)
def _(spark, sf):
    """Times written in five ways: with hours, hours and minutes, Z and nothing after them."""
    path = shared_dir(spark)
    wall = lambda hours: F.timestamp_add("MINUTE", F.lit(int(60 * hours)), utc_wall("timestamp"))
    forms = [(0, "HH:mm:ss'+00:00'"), (1, "HH:mm:ss'+01'"), (-4, "HH:mm'-0400'"), (5.5, "HH:mm:ss.SSS'+05:30'"), (0, "HH:mm:ss'Z'"), (0, "HH:mm")]
    written = F.coalesce(
        *[
            F.when(
                F.pmod(F.unix_micros("timestamp") / 1_800_000_000, F.lit(len(forms))) == i,
                F.date_format(wall(hours), "yyyy-MM-dd " + form),
            )
            for i, (hours, form) in enumerate(forms)
        ]
    )
    raw = t.meter_events(spark, sf).withColumn("timestamp", written)
    raw.drop("ingest_order").write.option("header", True).csv(f"{path}/hh_meter_data_2024-02-01.csv")
    return shown(read_hh_meter_data(spark, f"{path}/*").drop("ingest_order"))


@register("read_sites", "WITH " + t.SITES_SQL.strip() + " SELECT * FROM sites")
def _(spark, sf):
    path = shared_dir(spark)
    t.sites_events(spark, sf).write.option("header", True).csv(path)
    return read_site_metadata(spark, path)


@register("read_weather", "WITH " + t.WEATHER_SQL.strip() + " SELECT * FROM weather")
def _(spark, sf):
    path = shared_dir(spark)
    text = t.weather_events(spark, sf).withColumn(
        "timestamp", F.date_format(utc_wall("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    text.write.option("header", True).csv(path)
    return shown(read_weather(spark, path))


@register(
    "load_processed",
    t.panel_sql("orders") + " SELECT site_id, timestamp, value FROM gridded WHERE value IS NOT NULL",
)
def _(spark, sf):
    path = write_panel(gridded(spark, sf, "orders"), shared_dir(spark))
    known = load_processed(spark, path).where(F.col("value").isNotNull())
    return shown(known.select("site_id", "timestamp", "value"))


@register(
    "write_roundtrip",
    t.panel_sql("lines") + " SELECT site_id, timestamp, value, unit FROM gridded",
)
def _(spark, sf):
    path = write_panel(gridded(spark, sf, "lines"), shared_dir(spark))
    return shown(load_processed(spark, path))


# ---------------------------------------------------------------- data quality


def _coverage_sql(panel: str) -> str:
    return (
        t.panel_sql(panel)
        + f"""
, spans AS (SELECT site_id, count(*) AS n_rows, count(DISTINCT timestamp) AS n_distinct,
               min(timestamp) AS lo, max(timestamp) AS hi FROM meter GROUP BY site_id),
present AS (SELECT g.site_id, count(*) AS n_expected,
              count(*) FILTER (WHERE r.site_id IS NULL) AS n_missing
            FROM grid g LEFT JOIN readings r ON g.site_id = r.site_id AND g.timestamp = r.timestamp
            GROUP BY g.site_id)
SELECT s.site_id, n_rows, n_expected, n_missing, n_rows - n_distinct AS n_duplicated,
       lo AS start, hi AS "end"
FROM spans s JOIN present p ON s.site_id = p.site_id"""
    )


for _panel, _key in (("events", "coverage_report"), ("lines", "coverage_report_daily")):

    @register(_key, _coverage_sql(_panel))
    def _(spark, sf, panel=_panel):
        return shown(check_regular_index(t.METERS[panel](spark, sf), t.FREQ[panel]))


@register(
    "coverage_off_grid",
    """
WITH meter AS (SELECT event_type AS site_id, time_bucket(INTERVAL 1 MINUTE, ts) AS timestamp FROM events),
lo AS (SELECT site_id, min(timestamp) AS lo FROM meter GROUP BY site_id)
SELECT meter.site_id, count(DISTINCT timestamp) FILTER (
         WHERE (epoch_us(timestamp) - epoch_us(lo)) % 1800000000 <> 0) AS n_off_grid
FROM meter JOIN lo ON meter.site_id = lo.site_id GROUP BY meter.site_id""",
)
def _(spark, sf):
    minutes = t.read(spark, sf, "events").select(
        F.col("event_type").alias("site_id"),
        t.floor_to(t.instant("ts"), "1min").alias("timestamp"),
    )
    return check_regular_index(minutes, "30min", off_grid=True).select("site_id", "n_off_grid")


@register(
    "missing_periods",
    t.panel_sql("events") + " SELECT site_id, timestamp FROM gridded WHERE value IS NULL",
)
def _(spark, sf):
    return shown(missing_periods(readings(spark, sf)))


@register(
    "missing_summary",
    t.panel_sql("orders")
    + """
, n AS (SELECT count(*) AS n, count(*) - count(site_id) AS a, count(*) - count(timestamp) AS b,
          count(*) - count(value) AS c, count(*) - count(unit) AS d FROM gridded),
long AS (SELECT n, unnest([{'k': 'site_id', 'm': a}, {'k': 'timestamp', 'm': b},
                           {'k': 'value', 'm': c}, {'k': 'unit', 'm': d}]) AS s FROM n)
SELECT s.k AS column_name, s.m AS n_missing, round_even(s.m / n * 100, 2) AS pct_missing FROM long""",
)
def _(spark, sf):
    return summarise_missing(gridded(spark, sf, "orders"))


# ---------------------------------------------------------------- cleaning

for _panel, _key in (
    ("events", "dedup_last"),
    ("orders", "dedup_last_daily"),
    ("lines", "dedup_last_lines"),
):

    @register(_key, t.panel_sql(_panel) + " SELECT site_id, timestamp, value, unit FROM readings")
    def _(spark, sf, panel=_panel):
        return shown(readings(spark, sf, panel))


for _panel, _key in (("events", "grid_reindex"), ("lines", "grid_reindex_lines")):

    @register(_key, t.panel_sql(_panel) + " SELECT site_id, timestamp, value, unit FROM gridded")
    def _(spark, sf, panel=_panel):
        return shown(gridded(spark, sf, panel))


for _panel, _key in (("events", "outlier_flags"), ("lines", "outlier_flags_lines")):

    @register(
        _key, t.panel_sql(_panel) + " SELECT site_id, timestamp, value, unit, is_outlier FROM flagged"
    )
    def _(spark, sf, panel=_panel):
        return shown(flag_outliers(stage(gridded(spark, sf, panel))))


@register(
    "interpolate_gaps",
    t.panel_sql("events")
    + f" SELECT site_id, timestamp, {sql_round('value', FINE)} AS value, unit FROM filled",
)
def _(spark, sf):
    return shown(interpolate_short_gaps(gridded(spark, sf), grid="30min"), value=FINE)


@register(
    "interpolate_gaps_skip",
    t.panel_sql("orders", max_gap=1, skip_long=True)
    + f" SELECT site_id, timestamp, {sql_round('value', COARSE)} AS value FROM filled",
)
def _(spark, sf):
    done = interpolate_short_gaps(gridded(spark, sf, "orders"), max_gap=1, long_gaps="skip")
    return shown(done.drop("unit"), value=COARSE)


_DEMAND = f"site_id, timestamp, {sql_round('value', FINE)} AS value, unit, is_outlier"


@register(
    "build_dataset",
    t.panel_sql("events")
    + ","
    + t.SITES_SQL
    + ","
    + t.WEATHER_SQL
    + f"""
SELECT f.site_id, f.timestamp, {sql_round("value", FINE)} AS value, unit, is_outlier, trust_name, site_type,
  gia_m2, beds, latitude, longitude, temperature_c, humidity_pct, wind_speed_ms,
  solar_irradiance_wm2
FROM filled f LEFT JOIN sites s ON f.site_id = s.site_id
LEFT JOIN weather w ON f.site_id = w.site_id AND f.timestamp = w.timestamp""",
)
def _(spark, sf):
    demand = build_dataset(
        t.meter_events(spark, sf), t.sites_events(spark, sf), t.weather_events(spark, sf)
    )
    return shown(demand, value=FINE)


@register("build_dataset_lines", t.panel_sql("lines") + f" SELECT {_DEMAND} FROM filled")
def _(spark, sf):
    demand = build_dataset(t.meter_lines(spark, sf), frequency="1D")
    return shown(demand, value=FINE)


# ---------------------------------------------------------------- joins


@register(
    "join_sites",
    t.panel_sql("orders")
    + ","
    + t.SITES_ORDERS_SQL
    + """
SELECT r.site_id, timestamp, value, unit, trust_name, site_type
FROM readings r LEFT JOIN sites s ON r.site_id = s.site_id""",
)
def _(spark, sf):
    return shown(join_sites(readings(spark, sf, "orders"), t.sites_orders(spark, sf)))


_WEATHER_JOIN_SQL = (
    t.panel_sql("events")
    + ","
    + t.WEATHER_SQL
    + """
SELECT g.site_id, g.timestamp, value, unit, temperature_c, humidity_pct, wind_speed_ms,
  solar_irradiance_wm2
FROM gridded g LEFT JOIN weather w ON g.site_id = w.site_id AND g.timestamp = w.timestamp"""
)


@register("join_weather", _WEATHER_JOIN_SQL)
def _(spark, sf):
    return shown(join_weather(gridded(spark, sf), t.weather_events(spark, sf)))


@register("join_weather_bucketed", _WEATHER_JOIN_SQL)
def _(spark, sf):
    """Both tables are stored by the same buckets first; the join then moves no row."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = []
    for df in (gridded(spark, sf), t.weather_events(spark, sf)):
        stored.append(read_bucketed(spark, write_bucketed(df, shared_dir(spark), buckets), buckets))
    return shown(join_weather(*stored))


@register(
    "late_export_merged",
    """
WITH exports AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS site_id, l_shipdate AS timestamp, l_quantity AS value, l_linenumber > 4 AS later,
    ROW(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS o
  FROM lineitem WHERE l_linenumber <= 4 OR l_shipdate >= TIMESTAMP '1998-01-01')
SELECT site_id, timestamp, value FROM exports
QUALIFY row_number() OVER (PARTITION BY site_id, timestamp ORDER BY later DESC, o DESC) = 1""",
)
def _(spark, sf):
    """Stored readings after a later export of the last months; only its partitions are rewritten."""
    meter = t.meter_lines(spark, sf).drop("unit")
    number = F.col("ingest_order.l_linenumber")
    path = write_readings(meter.where(number <= 4), shared_dir(spark), buckets=2)
    merge_export(spark, path, meter.where((number > 4) & (F.col("timestamp") >= utc_instant("1998-01-01"))), buckets=2)
    return shown(read_readings(spark, path).select("site_id", "timestamp", "value"))


# ---------------------------------------------------------------- calendar and weather

_LOCAL = "timezone('Europe/London', timezone('UTC', timestamp))"
_CALENDAR_SQL = f"""
  CAST(hour({_LOCAL}) AS INTEGER) AS hour,
  CAST(hour({_LOCAL}) * 60 + minute({_LOCAL}) AS INTEGER) AS minute_of_day,
  CAST(isodow({_LOCAL}) - 1 AS INTEGER) AS day_of_week,
  CAST(dayofyear({_LOCAL}) AS INTEGER) AS day_of_year,
  CAST(month({_LOCAL}) AS INTEGER) AS month,
  CAST(year({_LOCAL}) AS INTEGER) AS year,
  CAST(isodow({_LOCAL}) >= 6 AS INTEGER) AS is_weekend"""
_CYCLES_SQL = {
    "tod_sin": "sin(2 * pi() * minute_of_day / 1440.0::DOUBLE)",
    "tod_cos": "cos(2 * pi() * minute_of_day / 1440.0::DOUBLE)",
    "doy_sin": "sin(2 * pi() * day_of_year / 365.25::DOUBLE)",
    "doy_cos": "cos(2 * pi() * day_of_year / 365.25::DOUBLE)",
    "dow_sin": "sin(2 * pi() * day_of_week / 7.0::DOUBLE)",
    "dow_cos": "cos(2 * pi() * day_of_week / 7.0::DOUBLE)",
}
_CYCLE_ROUNDED = ", ".join(f"round({e}, 6) AS {c}" for c, e in _CYCLES_SQL.items())
_CYCLE_DIGITS = dict.fromkeys(_CYCLES_SQL, 6)
_HOLIDAY_SQL = ", ".join(f"DATE '{d}'" for d in t.HOLIDAYS)


def _flags_sql(day: str) -> str:
    return f"""
  CAST({day} IN ({_HOLIDAY_SQL}) AS INTEGER) AS is_holiday,
  CAST({day} + 1 IN ({_HOLIDAY_SQL}) AS INTEGER) AS is_day_before_holiday,
  CAST({day} - 1 IN ({_HOLIDAY_SQL}) AS INTEGER) AS is_day_after_holiday"""


@register(
    "local_time",
    t.panel_sql("orders") + f" SELECT site_id, timestamp, {_LOCAL} AS local_time FROM meter",
)
def _(spark, sf):
    meter = t.meter_orders(spark, sf).select("site_id", "timestamp")
    return shown(meter.withColumn("local_time", local_wall("timestamp")))


@register(
    "calendar_features",
    t.panel_sql("orders") + f" SELECT site_id, timestamp, value, {_CALENDAR_SQL} FROM meter",
)
def _(spark, sf):
    meter = t.meter_orders(spark, sf).select("site_id", "timestamp", "value")
    return shown(add_calendar_features(meter))


@register(
    "cyclical_features",
    t.panel_sql("orders")
    + f""", cal AS (SELECT site_id, timestamp, {_CALENDAR_SQL} FROM meter)
SELECT *, {_CYCLE_ROUNDED} FROM cal""",
)
def _(spark, sf):
    meter = t.meter_orders(spark, sf).select("site_id", "timestamp")
    return shown(add_cyclical_features(add_calendar_features(meter)), **_CYCLE_DIGITS)


@register(
    "holiday_flags",
    t.panel_sql("orders")
    + f" SELECT site_id, timestamp, {_flags_sql(f'CAST({_LOCAL} AS DATE)')} FROM meter",
)
def _(spark, sf):
    meter = t.meter_orders(spark, sf).select("site_id", "timestamp")
    return shown(add_holiday_features(meter, t.HOLIDAYS))


@register("holiday_flags_table", SQL["holiday_flags"])
def _(spark, sf):
    path = shared_dir(spark)
    days = t.meter_orders(spark, sf).select(F.explode(F.array(*[F.lit(str(d)) for d in t.HOLIDAYS])).alias("holiday"))
    days.distinct().write.option("header", True).csv(path)
    meter = t.meter_orders(spark, sf).select("site_id", "timestamp")
    return shown(add_holiday_features(meter, read_holidays(spark, path)))


@register(
    "degree_days",
    "WITH "
    + t.WEATHER_SQL.strip()
    + """
SELECT site_id, timestamp, temperature_c,
  round(greatest(15.5 - temperature_c, 0), 6) AS heating_degrees,
  round(greatest(temperature_c - 15.5, 0), 6) AS cooling_degrees
FROM weather""",
)
def _(spark, sf):
    weather = t.weather_events(spark, sf).select("site_id", "timestamp", "temperature_c")
    return shown(add_degree_days(weather), heating_degrees=6, cooling_degrees=6)


# ---------------------------------------------------------------- look-back features


def _lag_sql(column: str, lags) -> str:
    return ", ".join(f"lag({column}, {n}) OVER w AS {column}_lag_{n}" for n in lags)


def _roll_sql(column: str, windows, stats=("mean", "std"), digits: int = FINE) -> tuple[str, dict]:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    parts, rounds = [], {}
    for n in windows:
        frame = f"(PARTITION BY site_id ORDER BY timestamp ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for s in stats:
            name = f"{column}_roll_{s}_{n}"
            rounds[name] = digits
            gated = (
                f"CASE WHEN count({column}) OVER {frame} >= {max(1, n // 4)} "
                f"THEN {fn[s]}({column}) OVER {frame} END"
            )
            parts.append(f"{sql_round(gated, digits)} AS {name}")
    return ", ".join(parts), rounds


_W = "WINDOW w AS (PARTITION BY site_id ORDER BY timestamp)"
_LAGS = (1, 2, 48, 96, 336)
_EVENT_ROLL, _EVENT_ROLL_DIGITS = _roll_sql("value", (48, 336))
_DAILY_ROLL, _DAILY_ROLL_DIGITS = _roll_sql("value", (7, 28))
_ORDER_ROLL, _ORDER_ROLL_DIGITS = _roll_sql("value", (7, 28), digits=COARSE)
_EXT_ROLL, _EXT_DIGITS = _roll_sql("value", (5, 48), ("min", "max"))
_TEMP_ROLL, _TEMP_DIGITS = _roll_sql("temperature_c", (48, 336), ("mean",))


@register(
    "target_lags",
    t.panel_sql("events")
    + f" SELECT site_id, timestamp, value, {_lag_sql('value', _LAGS)} FROM gridded {_W}",
)
def _(spark, sf):
    panel = readings(spark, sf).drop("unit")
    return shown(add_target_lags(panel, lags=_LAGS, grid="30min", reindex=True))


@register(
    "target_lags_by_row",
    t.panel_sql("orders")
    + f" SELECT site_id, timestamp, value, {_lag_sql('value', (1, 7))} FROM readings {_W}",
)
def _(spark, sf):
    return shown(add_target_lags(readings(spark, sf, "orders").drop("unit"), lags=(1, 7)))


@register(
    "rolling_features",
    t.panel_sql("events") + f" SELECT site_id, timestamp, value, {_EVENT_ROLL} FROM gridded",
)
def _(spark, sf):
    panel = readings(spark, sf).drop("unit")
    return shown(add_rolling_features(panel, grid="30min", reindex=True), **_EVENT_ROLL_DIGITS)


@register(
    "rolling_features_by_row",
    t.panel_sql("orders") + f" SELECT site_id, timestamp, value, {_ORDER_ROLL} FROM readings",
)
def _(spark, sf):
    panel = readings(spark, sf, "orders").drop("unit")
    return shown(add_rolling_features(panel, windows=(7, 28)), **_ORDER_ROLL_DIGITS)


@register(
    "rolling_extremes",
    t.panel_sql("events") + f" SELECT site_id, timestamp, value, {_EXT_ROLL} FROM gridded",
)
def _(spark, sf):
    panel = readings(spark, sf).drop("unit")
    done = add_rolling_features(panel, windows=(5, 48), stats=("min", "max"), grid="30min", reindex=True)
    return shown(done, **_EXT_DIGITS)


@register(
    "rolling_features_lines",
    t.panel_sql("lines") + f" SELECT site_id, timestamp, value, {_DAILY_ROLL} FROM gridded",
)
def _(spark, sf):
    panel = readings(spark, sf, "lines").drop("unit")
    return shown(add_rolling_features(panel, windows=(7, 28), grid="1D", reindex=True), **_DAILY_ROLL_DIGITS)


_TEMPS_SQL = (
    t.panel_sql("events")
    + ","
    + t.WEATHER_SQL
    + """, temps AS (
  SELECT g.site_id, g.timestamp, temperature_c
  FROM gridded g LEFT JOIN weather w ON g.site_id = w.site_id AND g.timestamp = w.timestamp)"""
)


@register(
    "weather_lags",
    _TEMPS_SQL
    + f" SELECT site_id, timestamp, temperature_c, {_lag_sql('temperature_c', (1, 2, 4, 48))}, {_TEMP_ROLL} FROM temps {_W}",
)
def _(spark, sf):
    temps = join_weather(gridded(spark, sf), t.weather_events(spark, sf)).select(
        "site_id", "timestamp", "temperature_c"
    )
    return shown(add_weather_lags(temps, grid="30min"), **_TEMP_DIGITS)


def _feature_sql(source: str, weather: bool, lags, rolls: str, digits: int = FINE) -> str:
    temp = (
        f""", temperature_c,
  round(CASE WHEN temperature_c IS NOT NULL THEN greatest(15.5 - temperature_c, 0) END, 6) AS heating_degrees,
  round(CASE WHEN temperature_c IS NOT NULL THEN greatest(temperature_c - 15.5, 0) END, 6) AS cooling_degrees,
  {_lag_sql("temperature_c", (1, 2, 4, 48))}, {_TEMP_ROLL}"""
        if weather
        else ""
    )
    return f""", cal AS (SELECT *, {_CALENDAR_SQL} FROM {source})
SELECT site_id, timestamp, {sql_round("value", digits)} AS value, is_outlier,
  hour, minute_of_day, day_of_week, day_of_year, month, year, is_weekend,
  {_CYCLE_ROUNDED}, {_flags_sql(f"CAST({_LOCAL} AS DATE)")}{temp},
  {", ".join(f"{sql_round(f'lag(value, {n}) OVER w', digits)} AS value_lag_{n}" for n in lags)}, {rolls}
FROM cal {_W}"""


_DEGREES = {"heating_degrees": 6, "cooling_degrees": 6}


def _lag_digits(lags, digits: int = FINE) -> dict[str, int]:
    return {"value": digits, **{f"value_lag_{n}": digits for n in lags}}


@register(
    "build_features",
    t.panel_sql("events")
    + ","
    + t.WEATHER_SQL
    + """, demand AS (
  SELECT f.site_id, f.timestamp, value, is_outlier, temperature_c
  FROM filled f LEFT JOIN weather w ON f.site_id = w.site_id AND f.timestamp = w.timestamp)"""
    + _feature_sql("demand", True, _LAGS, _EVENT_ROLL),
)
def _(spark, sf):
    demand = build_dataset(t.meter_events(spark, sf), weather=t.weather_events(spark, sf))
    table = build_features(
        demand.select("site_id", "timestamp", "value", "is_outlier", "temperature_c"),
        target_lags=_LAGS,
        holidays=t.HOLIDAYS,
    )
    return shown(
        table,
        **_lag_digits(_LAGS),
        **_CYCLE_DIGITS,
        **_DEGREES,
        **_TEMP_DIGITS,
        **_EVENT_ROLL_DIGITS,
    )


for _panel, _key, _digits, _roll, _roll_digits in (
    ("orders", "build_features_daily", COARSE, _ORDER_ROLL, _ORDER_ROLL_DIGITS),
    ("lines", "build_features_lines", FINE, _DAILY_ROLL, _DAILY_ROLL_DIGITS),
):

    @register(
        _key,
        t.panel_sql(_panel) + _feature_sql("filled", False, (1, 7, 28), _roll, _digits),
    )
    def _(spark, sf, panel=_panel, digits=_digits, roll_digits=_roll_digits):
        demand = build_dataset(t.METERS[panel](spark, sf), frequency="1D")
        table = build_features(
            demand.drop("unit"),
            target_lags=(1, 7, 28),
            rolling_windows=(7, 28),
            holidays=t.HOLIDAYS,
            grid="1D",
        )
        return shown(table, **_lag_digits((1, 7, 28), digits), **_CYCLE_DIGITS, **roll_digits)


@register(
    "features_since",
    t.panel_sql("events")
    + f"""
, rolled AS (SELECT site_id, timestamp, value, {_lag_sql("value", (1, 48, 336))}, {_EVENT_ROLL} FROM gridded {_W})
SELECT * FROM rolled WHERE timestamp >= {SPLIT_SQL}""",
)
def _(spark, sf):
    wanted = ["site_id", "timestamp", "value", *[f"value_lag_{n}" for n in (1, 48, 336)]]
    recent = build_features(gridded(spark, sf), since=CUTOFF)
    return shown(recent.select(*wanted, *_EVENT_ROLL_DIGITS), **_EVENT_ROLL_DIGITS)


# ---------------------------------------------------------------- splits and folds


@register(
    "time_split",
    t.panel_sql("events")
    + f" SELECT site_id, timestamp, value, CASE WHEN timestamp < {SPLIT_SQL} THEN 'train' ELSE 'test' END AS part FROM readings",
)
def _(spark, sf):
    before, after = time_split(readings(spark, sf).drop("unit"), CUTOFF)
    both = before.withColumn("part", F.lit("train")).unionByName(
        after.withColumn("part", F.lit("test"))
    )
    return shown(both)


@register(
    "complete_cases",
    t.panel_sql("events")
    + f""", lagged AS (SELECT site_id, timestamp, value, lag(value, 336) OVER w AS value_lag_336 FROM gridded {_W})
SELECT * FROM lagged WHERE value IS NOT NULL AND value_lag_336 IS NOT NULL""",
)
def _(spark, sf):
    lagged = add_target_lags(gridded(spark, sf).drop("unit"), lags=(336,), grid="30min")
    return shown(complete_cases(lagged, ["value_lag_336", "value"]))


def _folds_sql(source: str, n_splits: int, test_size: int, gap: int, unit: str = "period") -> str:
    ticks = (
        f"SELECT DISTINCT timestamp FROM {source}"
        if unit == "period"
        else f"SELECT timestamp, site_id AS tie FROM {source}"
    )
    order = "timestamp" if unit == "period" else "timestamp, tie"
    same = "r.timestamp = k.timestamp" + ("" if unit == "period" else " AND r.site_id = k.tie")
    return f""", ticks AS ({ticks}),
ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place, count(*) OVER () AS n FROM ticks),
edges AS (
  SELECT i, n - (i + 1) * {test_size} AS t0, n - i * {test_size} AS t1,
         n - (i + 1) * {test_size} - {gap} AS tr
  FROM (SELECT max(n) AS n FROM ranked), range({n_splits}) AS r(i)),
folds AS (SELECT *, CAST(row_number() OVER (ORDER BY i DESC) - 1 AS INTEGER) AS fold FROM edges WHERE tr > 0),
trains AS (
  SELECT r.*, fold, k.place FROM {source} r JOIN ranked k ON {same} JOIN folds ON k.place < tr),
tests AS (
  SELECT r.*, fold, k.place FROM {source} r JOIN ranked k ON {same}
  JOIN folds ON k.place >= t0 AND k.place < t1),
ends AS (SELECT fold, max(k.timestamp) AS train_tick FROM folds JOIN ranked k ON k.place < tr GROUP BY fold)"""


_TAGGED = """
SELECT site_id, timestamp, value, fold, 'train' AS part FROM trains
UNION ALL SELECT site_id, timestamp, value, fold, 'test' AS part FROM tests"""

for _key, _unit, _size in (
    ("rolling_origin", "period", FOLDS),
    ("rolling_origin_rows", "row", {"n_splits": 3, "test_size": 700, "gap": 101}),
):

    @register(_key, t.panel_sql("events") + _folds_sql("readings", *_size.values(), _unit) + _TAGGED)
    def _(spark, sf, unit=_unit, size=_size):
        return shown(rolling_origin_splits(readings(spark, sf).drop("unit"), unit=unit, **size))


# ---------------------------------------------------------------- metrics and reports

_PAIRS_SQL = (
    t.panel_sql("events")
    + f""", lagged AS (SELECT site_id, timestamp, value AS y_true, lag(value, 48) OVER w AS y_pred FROM gridded {_W}),
pairs AS (SELECT * FROM lagged WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""
)
METRIC_DIGITS = dict.fromkeys(("mae", "rmse", "mape", "smape", "bias"), 6)
_METRICS_SQL = """
  round(avg(abs(y_true - y_pred)), 6) AS mae,
  round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse,
  round(avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-8)) * 100, 6) AS mape,
  round(avg(abs(y_true - y_pred) / greatest((abs(y_true) + abs(y_pred)) / 2, 1e-8)) * 100, 6) AS smape,
  round(avg(y_pred - y_true), 6) AS bias"""


def yesterday(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast of every reading by the reading one day earlier."""
    lagged = add_target_lags(gridded(spark, sf), lags=(48,), grid="30min")
    return complete_cases(
        lagged.select(
            "site_id",
            "timestamp",
            F.col("value").alias("y_true"),
            F.col("value_lag_48").alias("y_pred"),
        ),
        ["y_true", "y_pred"],
    )


@register("metrics_pooled", _PAIRS_SQL + f" SELECT {_METRICS_SQL} FROM pairs")
def _(spark, sf):
    return shown(all_metrics(yesterday(spark, sf)), **METRIC_DIGITS)


@register(
    "metrics_rollup",
    _PAIRS_SQL
    + f"""
SELECT CASE WHEN grouping(site_id) = 1 THEN 'pooled' ELSE 'site' END AS level, site_id,
  count(*) AS n, {_METRICS_SQL} FROM pairs GROUP BY ROLLUP (site_id)""",
)
def _(spark, sf):
    return shown(metrics_report(yesterday(spark, sf)), **METRIC_DIGITS)


@register(
    "metric_mase",
    _PAIRS_SQL
    + f""", test_error AS (
  SELECT site_id, avg(abs(y_true - y_pred)) AS e FROM pairs WHERE timestamp >= {SPLIT_SQL} GROUP BY site_id),
diffs AS (
  SELECT site_id, abs(value - lag(value, 336) OVER w) AS d FROM gridded WHERE timestamp < {SPLIT_SQL} {_W}),
scales AS (SELECT site_id, avg(d) AS s FROM diffs GROUP BY site_id)
SELECT t.site_id, round(e / nullif(s, 0), 6) AS mase
FROM test_error t LEFT JOIN scales s ON t.site_id = s.site_id""",
)
def _(spark, sf):
    _, test = time_split(yesterday(spark, sf), CUTOFF)
    history, _ = time_split(gridded(spark, sf), CUTOFF)
    return shown(mase(test, history, 336, by="site_id", grid="30min"), mase=6)


@register(
    "load_profile",
    t.panel_sql("orders")
    + f"""
SELECT isodow({_LOCAL}) >= 6 AS is_weekend,
  CAST(hour({_LOCAL}) * 60 + minute({_LOCAL}) AS INTEGER) AS minute_of_day,
  (hour({_LOCAL}) * 60 + minute({_LOCAL})) / 60.0::DOUBLE AS hour_of_day,
  round(avg(value), 6) AS mean_value
FROM readings GROUP BY ALL""",
)
def _(spark, sf):
    return shown(load_profile(readings(spark, sf, "orders")), mean_value=6)


@register(
    "load_profile_site",
    t.panel_sql("orders")
    + f"""
SELECT isodow({_LOCAL}) >= 6 AS is_weekend,
  CAST(hour({_LOCAL}) * 60 + minute({_LOCAL}) AS INTEGER) AS minute_of_day,
  (hour({_LOCAL}) * 60 + minute({_LOCAL})) / 60.0::DOUBLE AS hour_of_day,
  round(avg(value), 6) AS mean_value
FROM readings WHERE site_id = '7' GROUP BY ALL""",
)
def _(spark, sf):
    return shown(load_profile(readings(spark, sf, "orders"), "7"), mean_value=6)


@register(
    "load_profile_events",
    t.panel_sql("events")
    + f"""
SELECT isodow({_LOCAL}) >= 6 AS is_weekend,
  CAST(hour({_LOCAL}) * 60 + minute({_LOCAL}) AS INTEGER) AS minute_of_day,
  round((hour({_LOCAL}) * 60 + minute({_LOCAL})) / 60.0::DOUBLE, 6) AS hour_of_day,
  round(avg(value), 8) AS mean_value
FROM gridded GROUP BY ALL""",
)
def _(spark, sf):
    return shown(load_profile(gridded(spark, sf)), mean_value=8, hour_of_day=6)


@register(
    "residual_histogram",
    _PAIRS_SQL
    + """, res AS (SELECT y_pred - y_true AS r FROM pairs),
lim AS (SELECT CASE WHEN min(r) = max(r) THEN min(r) - 0.5 ELSE min(r) END AS lo,
               CASE WHEN min(r) = max(r) THEN max(r) + 0.5 ELSE max(r) END AS hi FROM res),
counted AS (
  SELECT least(floor((r - lo) / ((hi - lo) / 60.0::DOUBLE)), 59) AS bin, count(*) AS n
  FROM res, lim GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 60.0::DOUBLE), 8) AS bin_start,
  round(lo + (b.bin + 1) * ((hi - lo) / 60.0::DOUBLE), 8) AS bin_end, coalesce(n, 0) AS n
FROM lim, range(60) AS b(bin) LEFT JOIN counted c ON c.bin = b.bin""",
)
def _(spark, sf):
    return shown(residual_histogram(yesterday(spark, sf)), bin_start=8, bin_end=8)


# ---------------------------------------------------------------- baselines

_SEASON_SQL = """CAST(greatest(1, ceil((epoch_us({ts}) - epoch_us({end})) / ({size} * {step}))) AS BIGINT)
  * {size} * {step}"""


def _source_sql(ts: str, end: str, size: int, step: int) -> str:
    back = _SEASON_SQL.format(ts=ts, end=end, size=size, step=f"{step}::BIGINT")
    return f"epoch_us({ts}) - {back}"


_HALF_HOUR, _DAY = 1_800_000_000, 86_400_000_000

@register(
    "seasonal_naive",
    t.panel_sql("events")
    + f""", tr AS (SELECT * FROM readings WHERE timestamp < {SPLIT_SQL}),
te AS (SELECT * FROM readings WHERE timestamp >= {SPLIT_SQL}),
last AS (SELECT max(timestamp) AS e FROM tr)
SELECT te.site_id, te.timestamp, te.value, h.value AS prediction
FROM te CROSS JOIN last LEFT JOIN tr h ON h.site_id = te.site_id
  AND epoch_us(h.timestamp) = {_source_sql("te.timestamp", "e", 336, _HALF_HOUR)}""",
)
def _(spark, sf):
    before, after = time_split(readings(spark, sf).drop("unit"), CUTOFF)
    return shown(SeasonalNaive(336).fit(before).transform(after))


@register(
    "seasonal_naive_fallback",
    t.panel_sql("events")
    + f""", tr AS (SELECT * FROM readings WHERE timestamp < {SPLIT_SQL}),
te AS (SELECT * FROM readings WHERE timestamp >= {SPLIT_SQL}),
ended AS (SELECT max(timestamp) AS e FROM tr),
latest AS (SELECT site_id, epoch_us(timestamp) % (336 * {_HALF_HOUR}::BIGINT) AS place, arg_max(value, timestamp) AS v
  FROM tr GROUP BY ALL)
SELECT te.site_id, te.timestamp, te.value, coalesce(h.value, l.v) AS prediction
FROM te CROSS JOIN ended LEFT JOIN tr h ON h.site_id = te.site_id
  AND epoch_us(h.timestamp) = {_source_sql("te.timestamp", "e", 336, _HALF_HOUR)}
LEFT JOIN latest l ON l.site_id = te.site_id AND l.place = epoch_us(te.timestamp) % (336 * {_HALF_HOUR}::BIGINT)""",
)
def _(spark, sf):
    before, after = time_split(readings(spark, sf).drop("unit"), CUTOFF)
    return shown(SeasonalNaive(336, fallback="last").fit(before).transform(after))


_POSITION_SQL = (
    t.panel_sql("events")
    + f""", tr AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) AS back
  FROM readings WHERE timestamp < {SPLIT_SQL}),
hist AS (SELECT site_id, value, count(*) OVER (PARTITION BY site_id) AS len,
  count(*) OVER (PARTITION BY site_id) - back AS slot FROM tr WHERE back <= 336),
te AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp) - 1 AS pos
  FROM readings WHERE timestamp >= {SPLIT_SQL}),
len AS (SELECT site_id, max(len) AS len FROM hist GROUP BY site_id)
SELECT te.site_id, te.timestamp, te.value, h.value AS prediction
FROM te LEFT JOIN len ON te.site_id = len.site_id
LEFT JOIN hist h ON h.site_id = te.site_id AND h.slot = te.pos % len.len"""
)


def _position(spark, sf, season):
    before, after = time_split(readings(spark, sf).drop("unit"), CUTOFF)
    return shown(SeasonalNaive(season, align="position").fit(before).transform(after))


@register("seasonal_naive_position", _POSITION_SQL)
def _(spark, sf):
    return _position(spark, sf, 336)


@register("seasonal_naive_position_long", _POSITION_SQL.replace("back <= 336", "back <= 1500"))
def _(spark, sf):
    return _position(spark, sf, 1500)


_PROFILE_SQL = (
    t.panel_sql("events")
    + f""", cal AS (SELECT site_id, timestamp, value, {_CALENDAR_SQL} FROM readings),
tr AS (SELECT * FROM cal WHERE timestamp < {SPLIT_SQL}),
cells AS (SELECT day_of_week, minute_of_day, avg(value) AS m FROM tr GROUP BY ALL)
SELECT c.site_id, c.timestamp, c.value,
  round(coalesce(m, (SELECT avg(value) FROM tr)), 10) AS prediction
FROM cal c LEFT JOIN cells p ON c.day_of_week = p.day_of_week AND c.minute_of_day = p.minute_of_day
WHERE c.timestamp >= {SPLIT_SQL}"""
)


def _calendar_parts(spark, sf):
    return time_split(add_calendar_features(readings(spark, sf)), CUTOFF)


_SCORED = ("site_id", "timestamp", "value", "prediction")


@register("profile_mean", _PROFILE_SQL)
def _(spark, sf):
    before, after = _calendar_parts(spark, sf)
    return shown(ProfileMean().fit(before).transform(after).select(*_SCORED), prediction=10)


@register("model_roundtrip", _PROFILE_SQL)
def _(spark, sf):
    before, after = _calendar_parts(spark, sf)
    path = save_model(spark, ProfileMean().fit(before), shared_dir(spark))
    return shown(load_model(spark, path).transform(after).select(*_SCORED), prediction=10)


def _report_sql(source: str, preds: str, by: str = "") -> str:
    """Backtest report from ``trains`` and a ``preds`` relation with y_true, y_pred."""
    key = f", {by}" if by else ""
    on = f"a.fold = b.fold AND a.{by} = b.{by}" if by else "a.fold = b.fold"
    return f"""{preds},
tr_side AS (SELECT fold{key}, max(timestamp) AS train_end, count(*) AS n_train FROM trains GROUP BY ALL),
te_side AS (SELECT fold{key}, min(timestamp) AS test_start, max(timestamp) AS test_end,
  count(*) AS n_test, {_METRICS_SQL}, count(y_pred) AS n_pred FROM preds GROUP BY fold{key})
SELECT a.fold{", a." + by if by else ""}, train_end, test_start, test_end, n_train, n_test,
  mae, rmse, mape, smape, bias, n_pred
FROM tr_side a JOIN te_side b ON {on}"""


def _naive_preds(size: int, step: int) -> str:
    return f""", preds AS (
  SELECT te.fold, te.site_id, te.timestamp, te.value AS y_true, h.value AS y_pred
  FROM tests te JOIN ends e ON te.fold = e.fold
  LEFT JOIN trains h ON h.fold = te.fold AND h.site_id = te.site_id
    AND epoch_us(h.timestamp) = {_source_sql("te.timestamp", "train_tick", size, step)})"""


@register(
    "backtest_seasonal_naive",
    t.panel_sql("events")
    + _folds_sql("readings", **FOLDS)
    + _report_sql("readings", _naive_preds(336, _HALF_HOUR)),
)
def _(spark, sf):
    report = backtest(SeasonalNaive(336), stage(readings(spark, sf)), **FOLDS)
    return shown(report, **METRIC_DIGITS)


_FALLBACK_PREDS = (
    _naive_preds(336, _HALF_HOUR).replace("preds AS (", "plain AS (")
    + f""", latest AS (
  SELECT fold, site_id, epoch_us(timestamp) % (336 * {_HALF_HOUR}::BIGINT) AS place, arg_max(value, timestamp) AS v
  FROM trains GROUP BY ALL),
preds AS (
  SELECT p.fold, p.site_id, p.timestamp, p.y_true, coalesce(p.y_pred, l.v) AS y_pred
  FROM plain p LEFT JOIN latest l ON l.fold = p.fold AND l.site_id = p.site_id
    AND l.place = epoch_us(p.timestamp) % (336 * {_HALF_HOUR}::BIGINT))"""
)


@register(
    "backtest_seasonal_naive_fallback",
    t.panel_sql("events") + _folds_sql("readings", **FOLDS) + _report_sql("readings", _FALLBACK_PREDS),
)
def _(spark, sf):
    report = backtest(SeasonalNaive(336, fallback="last"), stage(readings(spark, sf)), **FOLDS)
    return shown(report, **METRIC_DIGITS)


@register(
    "backtest_seasonal_naive_sites",
    t.panel_sql("orders")
    + _folds_sql("readings", **FOLDS_DAILY)
    + _report_sql("readings", _naive_preds(7, _DAY), "site_id"),
)
def _(spark, sf):
    model = SeasonalNaive(7, freq="1D")
    report = backtest(
        model, stage(readings(spark, sf, "orders")), by=["site_id"], **FOLDS_DAILY
    )
    return shown(report, **dict.fromkeys(METRIC_DIGITS, 4))


SQL["backtest_seasonal_naive_sites"] = SQL["backtest_seasonal_naive_sites"].replace(", 6) AS", ", 4) AS")

_POSITION_PREDS = """, back AS (
  SELECT fold, site_id, value, row_number() OVER (PARTITION BY fold, site_id ORDER BY timestamp DESC) AS b
  FROM trains),
hist AS (SELECT fold, site_id, value, count(*) OVER (PARTITION BY fold, site_id) AS len,
  count(*) OVER (PARTITION BY fold, site_id) - b AS slot FROM back WHERE b <= 336),
lens AS (SELECT fold, site_id, max(len) AS len FROM hist GROUP BY ALL),
rowed AS (SELECT *, row_number() OVER (PARTITION BY fold, site_id ORDER BY timestamp) - 1 AS r FROM tests),
preds AS (
  SELECT te.fold, te.site_id, te.timestamp, te.value AS y_true, h.value AS y_pred
  FROM rowed te LEFT JOIN lens l ON l.fold = te.fold AND l.site_id = te.site_id
  LEFT JOIN hist h ON h.fold = te.fold AND h.site_id = te.site_id AND h.slot = te.r % l.len)"""


@register(
    "backtest_seasonal_naive_position",
    t.panel_sql("events")
    + _folds_sql("readings", **FOLDS, unit="row")
    + _report_sql("readings", _POSITION_PREDS),
)
def _(spark, sf):
    model = SeasonalNaive(336, align="position")
    report = backtest(model, stage(readings(spark, sf)), unit="row", **FOLDS)
    return shown(report, **METRIC_DIGITS)


_PROFILE_PREDS = """, cells AS (
  SELECT fold, day_of_week, minute_of_day, avg(value) AS m FROM trains GROUP BY ALL),
overall AS (SELECT fold, avg(value) AS g FROM trains GROUP BY fold),
preds AS (
  SELECT te.fold, te.site_id, te.timestamp, te.value AS y_true, coalesce(m, g) AS y_pred
  FROM tests te JOIN overall o ON te.fold = o.fold
  LEFT JOIN cells c ON c.fold = te.fold AND c.day_of_week = te.day_of_week
    AND c.minute_of_day = te.minute_of_day)"""


@register(
    "backtest_profile_mean",
    t.panel_sql("events")
    + f", cal AS (SELECT site_id, timestamp, value, {_CALENDAR_SQL} FROM readings)"
    + _folds_sql("cal", **FOLDS)
    + _report_sql("cal", _PROFILE_PREDS),
)
def _(spark, sf):
    panel = stage(add_calendar_features(readings(spark, sf)))
    report = backtest(
        ProfileMean(), panel, ["day_of_week", "minute_of_day"], **FOLDS
    )
    return shown(report, **METRIC_DIGITS)


@register(
    "backtest_mase",
    t.panel_sql("events")
    + _folds_sql("gridded", **FOLDS)
    + """, known_train AS (SELECT * FROM trains WHERE value IS NOT NULL),
preds AS (
  SELECT te.fold, te.site_id, te.timestamp, te.value AS y_true, h.value AS y_pred
  FROM tests te JOIN ends e ON te.fold = e.fold
  LEFT JOIN known_train h ON h.fold = te.fold AND h.site_id = te.site_id
    AND epoch_us(h.timestamp) = """
    + _source_sql("te.timestamp", "train_tick", 336, _HALF_HOUR)
    + """ WHERE te.value IS NOT NULL),
d AS (SELECT fold, abs(value - lag(value, 336) OVER (PARTITION BY fold, site_id ORDER BY timestamp)) AS d
  FROM known_train)
SELECT p.fold, round(avg(abs(y_true - y_pred)), 6) AS mae,
  round(avg(abs(y_true - y_pred)) / any_value(s.s), 6) AS mase
FROM preds p JOIN (SELECT fold, avg(d) AS s FROM d GROUP BY fold) s ON p.fold = s.fold GROUP BY p.fold""",
)
def _(spark, sf):
    report = backtest(
        SeasonalNaive(336), stage(gridded(spark, sf)), season_length=336, extras=True, **FOLDS
    )
    return shown(report.select("fold", "mae", "mase"), mae=6, mase=6)


@register(
    "forecast_vs_actual",
    t.panel_sql("events")
    + _folds_sql("readings", **FOLDS)
    + _naive_preds(336, _HALF_HOUR)
    + " SELECT site_id, timestamp, y_true AS actual, y_pred AS forecast FROM preds",
)
def _(spark, sf):
    return shown(forecast_vs_actual(backtest_predictions(SeasonalNaive(336), stage(readings(spark, sf)), **FOLDS)))


@register("metrics_csv_roundtrip", SQL["backtest_seasonal_naive"])
def _(spark, sf):
    report = backtest(SeasonalNaive(336), stage(readings(spark, sf)), **FOLDS)
    path = write_metrics_csv(shown(report, **METRIC_DIGITS), shared_dir(spark))
    return spark.read.schema(shown(report).schema).option("header", True).csv(path)


# ---------------------------------------------------------------- fitted models

RIDGE_FEATURES = ["value_lag_48", "tod_sin"]
ALPHA = 10.0


def lag_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Stored table: yesterday's reading and the time of day for every period of the grid."""
    lagged = add_target_lags(gridded(spark, sf).drop("unit"), lags=(48,), grid="30min")
    table = add_cyclical_features(add_calendar_features(lagged))
    return stage(table.select("site_id", "timestamp", "value", *RIDGE_FEATURES))


_FRAME_SQL = (
    t.panel_sql("events")
    + f""", cal AS (SELECT site_id, timestamp, value, lag(value, 48) OVER w AS x1, {_CALENDAR_SQL}
  FROM gridded {_W}),
frame AS (SELECT site_id, timestamp, value, x1, {_CYCLES_SQL["tod_sin"]} AS x2 FROM cal)"""
)


def _ridge_sql(source: str, group: str, target: str = "value") -> str:
    """Closed form of a two-feature ridge regression per group."""
    g, on = (f"{group}, ", f"USING ({group})") if group else ("", "ON true")
    by = f"GROUP BY {group}" if group else ""
    return f""", means AS (
  SELECT {g}avg(x1) AS m1, avg(x2) AS m2, avg({target}) AS my, count(*) AS n_rows FROM {source} {by}),
moments AS (
  SELECT {g}any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my,
    any_value(n_rows) AS n_rows,
    sum((x1 - m1) * (x1 - m1)) + {ALPHA} AS a, sum((x1 - m1) * (x2 - m2)) AS b,
    sum((x2 - m2) * (x2 - m2)) + {ALPHA} AS d,
    sum((x1 - m1) * ({target} - my)) AS u, sum((x2 - m2) * ({target} - my)) AS v
  FROM {source} JOIN means {on} {by}),
fit AS (
  SELECT {g}n_rows, (u * d - v * b) / (a * d - b * b) AS c1, (v * a - u * b) / (a * d - b * b) AS c2,
    my - m1 * (u * d - v * b) / (a * d - b * b) - m2 * (v * a - u * b) / (a * d - b * b) AS c0
  FROM moments)"""


_COMPLETE = "value IS NOT NULL AND x1 IS NOT NULL"
_RIDGE_FIT_SQL = (
    _FRAME_SQL
    + f", known AS (SELECT * FROM frame WHERE {_COMPLETE} AND timestamp < {SPLIT_SQL})"
    + _ridge_sql("known", "")
)


def _coefficients(table: DataFrame) -> DataFrame:
    return table.select(
        *[c for c in table.columns if c not in ("intercept", "coefficients")],
        F.round("intercept", 8).alias("intercept"),
        F.round(F.col("coefficients")[0], 8).alias("c1"),
        F.round(F.col("coefficients")[1], 8).alias("c2"),
    )


@register(
    "ridge_fit",
    _RIDGE_FIT_SQL
    + " SELECT n_rows, round(c0, 8) AS intercept, round(c1, 8) AS c1, round(c2, 8) AS c2 FROM fit",
)
def _(spark, sf):
    fitted = fit_until(lag_frame(spark, sf), RIDGE_FEATURES, CUTOFF, model="ridge", alpha=ALPHA)
    return _coefficients(fitted.tables["coefficients"])


@register(
    "ridge_fit_sites",
    _FRAME_SQL
    + f", known AS (SELECT * FROM frame WHERE {_COMPLETE})"
    + _ridge_sql("known", "site_id")
    + " SELECT site_id, n_rows, round(c0, 8) AS intercept, round(c1, 8) AS c1, round(c2, 8) AS c2 FROM fit",
)
def _(spark, sf):
    rows = complete_cases(lag_frame(spark, sf), [*RIDGE_FEATURES, "value"])
    return _coefficients(Ridge(ALPHA, ["site_id"]).fit(rows, RIDGE_FEATURES).tables["coefficients"])


@register(
    "train_predict",
    _RIDGE_FIT_SQL
    + f"""
SELECT site_id, timestamp, value, round(c0 + c1 * x1 + c2 * x2, 8) AS prediction
FROM frame, fit WHERE {_COMPLETE} AND timestamp >= {SPLIT_SQL}""",
)
def _(spark, sf):
    frame = lag_frame(spark, sf)
    path = train(frame, shared_dir(spark), RIDGE_FEATURES, CUTOFF, model="ridge", alpha=ALPHA)
    _, after = time_split(complete_cases(frame, [*RIDGE_FEATURES, "value"]), CUTOFF)
    return shown(predict(path, after).select(*_SCORED), prediction=8)


@register(
    "backtest_ridge",
    _FRAME_SQL
    + _folds_sql("frame", **FOLDS).replace("trains AS", "all_trains AS").replace("tests AS", "all_tests AS")
    + f""", trains AS (SELECT * FROM all_trains WHERE {_COMPLETE}),
tests AS (SELECT * FROM all_tests WHERE {_COMPLETE})"""
    + _ridge_sql("trains", "fold")
    + _report_sql(
        "frame",
        """, preds AS (SELECT te.fold, te.timestamp, te.value AS y_true,
    c0 + c1 * x1 + c2 * x2 AS y_pred FROM tests te JOIN fit ON te.fold = fit.fold)""",
    ),
)
def _(spark, sf):
    report = backtest(Ridge(ALPHA), lag_frame(spark, sf), RIDGE_FEATURES, **FOLDS)
    return shown(report, **METRIC_DIGITS)


_FIVE = ["value_lag_48", "tod_sin", "tod_cos", "dow_sin", "dow_cos"]


@register(
    "ridge_fit_five",
    _FRAME_SQL
    + f""", known AS (SELECT * FROM frame WHERE {_COMPLETE})
SELECT feature, 0.0::DOUBLE AS miss, (SELECT count(*) FROM known) AS n_rows
FROM (VALUES {", ".join(f"('{c}')" for c in ["intercept", *_FIVE])}) AS v(feature)""",
)
def _(spark, sf):
    """What the normal equations of a five-feature fit leave over, against their size."""
    lagged = add_target_lags(gridded(spark, sf).drop("unit"), lags=(48,), grid="30min")
    table = add_cyclical_features(add_calendar_features(lagged)).select("value", *_FIVE)
    rows = stage(complete_cases(table, [*_FIVE, "value"]))
    fitted = Ridge(ALPHA).fit(rows, _FIVE)
    kept = fitted.tables["coefficients"].select(F.struct("*")).scalar()
    rest = fitted.transform(rows).withColumn("__fit", kept).withColumn("__e", F.col("value") - F.col("prediction"))
    sums = [F.sum("__e").alias("e_intercept"), F.sum(F.abs("value")).alias("a_intercept")]
    for i, c in enumerate(_FIVE):
        penalty = F.lit(ALPHA) * F.max(F.col("__fit.coefficients")[i])
        sums += [
            (F.sum(F.col(c) * F.col("__e")) - penalty).alias(f"e_{c}"),
            F.sum(F.abs(F.col(c) * F.col("value"))).alias(f"a_{c}"),
        ]
    one = rest.agg(*sums, F.max("__fit.n_rows").alias("n_rows"))
    each = [
        F.struct(F.lit(c).alias("feature"), (F.abs(F.round(F.col(f"e_{c}") / F.col(f"a_{c}"), 8))).alias("miss"))
        for c in ("intercept", *_FIVE)
    ]
    return one.select(F.explode(F.array(*each)).alias("x"), "n_rows").select("x.*", "n_rows")


HORIZON = 48
_DIRECT_SQL = f""", steps AS (SELECT CAST(range AS INTEGER) + 1 AS step FROM range({HORIZON})),
direct AS (
  SELECT f.*, step, b.value AS value_ahead
  FROM frame f CROSS JOIN steps s JOIN gridded b
    ON b.site_id = f.site_id AND b.timestamp = f.timestamp + step * INTERVAL 30 MINUTE
  WHERE b.value IS NOT NULL)"""


@register(
    "direct_horizon_frame",
    _FRAME_SQL
    + _DIRECT_SQL
    + " SELECT site_id, timestamp, value, step, value_ahead FROM direct",
)
def _(spark, sf):
    panel = gridded(spark, sf).select("site_id", "timestamp", "value")
    return shown(direct_horizon_frame(panel, HORIZON, grid="30min"))


@register(
    "forecast_horizon",
    _FRAME_SQL
    + _DIRECT_SQL
    + ", pairs AS (SELECT * FROM direct WHERE x1 IS NOT NULL)"
    + _ridge_sql("pairs", "step", "value_ahead")
    + """, origin AS (
  SELECT * FROM frame WHERE x1 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) = 1)
SELECT site_id, timestamp, step, timestamp + step * INTERVAL 30 MINUTE AS target_timestamp,
  round(c0 + c1 * x1 + c2 * x2, 8) AS prediction
FROM origin CROSS JOIN fit""",
)
def _(spark, sf):
    frame = lag_frame(spark, sf)
    fitted = fit_direct(frame, RIDGE_FEATURES, HORIZON, alpha=ALPHA, grid="30min")
    return shown(forecast_horizon(fitted, frame, HORIZON), prediction=8)


_HORIZON_PROFILE = ["day_of_week", "minute_of_day"]


@register(
    "forecast_horizon_profile",
    t.panel_sql("events")
    + f""", frame AS (SELECT site_id, timestamp, value, {_CALENDAR_SQL} FROM gridded)"""
    + _DIRECT_SQL
    + """, cells AS (SELECT step, day_of_week, minute_of_day, avg(value_ahead) AS m FROM direct GROUP BY ALL),
origin AS (
  SELECT * FROM frame QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) = 1)
SELECT o.site_id, o.timestamp, s.step, o.timestamp + s.step * INTERVAL 30 MINUTE AS target_timestamp,
  round(coalesce(m, (SELECT avg(value_ahead) FROM direct)), 8) AS prediction
FROM origin o CROSS JOIN steps s LEFT JOIN cells c ON c.step = s.step
  AND c.day_of_week = o.day_of_week AND c.minute_of_day = o.minute_of_day""",
)
def _(spark, sf):
    frame = stage(add_calendar_features(gridded(spark, sf)).select("site_id", "timestamp", "value", *_HORIZON_PROFILE))
    model = ProfileMean(_HORIZON_PROFILE)
    fitted = fit_direct(frame, _HORIZON_PROFILE, HORIZON, grid="30min", model=model)
    return shown(forecast_horizon(fitted, frame, HORIZON), prediction=8)


def _stump_sql(source: str, target: str, name: str) -> str:
    """The best split of ``day_of_week`` by variance, and the mean on either side."""
    return f""", {name}_days AS (
  SELECT day_of_week AS d, count(*) AS n, sum({target}) AS s FROM {source} GROUP BY 1),
{name}_cuts AS (
  SELECT a.d, sum(b.n) FILTER (b.d <= a.d) AS nl, sum(b.s) FILTER (b.d <= a.d) AS sl,
    sum(b.n) FILTER (b.d > a.d) AS nr, sum(b.s) FILTER (b.d > a.d) AS sr
  FROM {name}_days a CROSS JOIN {name}_days b GROUP BY a.d),
{name} AS (
  SELECT d, sl / nl AS low, sr / nr AS high FROM {name}_cuts WHERE nl >= 20 AND nr >= 20
  ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1)"""


_STUMP_SQL = (
    t.panel_sql("events")
    + f""", cal AS (SELECT site_id, timestamp, value, {_CALENDAR_SQL} FROM readings),
tr AS (SELECT * FROM cal WHERE timestamp < {SPLIT_SQL})"""
    + _stump_sql("tr", "value", "one")
)
_FIRST = "CASE WHEN day_of_week <= one.d THEN one.low ELSE one.high END"
_STUMP_RATE = 0.3


def _stumps(spark, sf, rounds):
    frame = stage(add_calendar_features(readings(spark, sf)).select("site_id", "timestamp", "value", "day_of_week"))
    stumps = {"n_estimators": rounds, "learning_rate": _STUMP_RATE, "num_leaves": 2, "min_child_samples": 20}
    fitted = fit_until(frame, ["day_of_week"], CUTOFF, model="gbt", **stumps)
    _, after = time_split(frame, CUTOFF)
    return shown(predict(fitted, after).select(*_SCORED), prediction=8)


@register(
    "gbt_stump",
    _STUMP_SQL
    + f"""
SELECT site_id, timestamp, value, round({_FIRST}, 8) AS prediction
FROM cal, one WHERE timestamp >= {SPLIT_SQL}""",
)
def _(spark, sf):
    return _stumps(spark, sf, 1)


@register(
    "gbt_two_rounds",
    _STUMP_SQL
    + f""", rest AS (SELECT *, 2 * (value - {_FIRST}) AS r FROM tr, one)"""
    + _stump_sql("rest", "r", "two")
    + f"""
SELECT site_id, timestamp, value,
  round({_FIRST} + {_STUMP_RATE} * CASE WHEN day_of_week <= two.d THEN two.low ELSE two.high END, 8) AS prediction
FROM cal, one, two WHERE timestamp >= {SPLIT_SQL}""",
)
def _(spark, sf):
    return _stumps(spark, sf, 2)


# Trees grown by leaf.  The configured model (15 features, 63 leaves) with fewer rounds:
FIFTEEN = """tod_sin tod_cos dow_sin dow_cos doy_sin doy_cos is_weekend is_holiday heating_degrees cooling_degrees
value_lag_48 value_lag_96 value_lag_336 value_roll_mean_336 value_roll_std_336""".split()
TREES = {
    "n_estimators": 4, "learning_rate": 0.05, "num_leaves": 63, "min_child_samples": 40,
    "subsample": 0.8, "subsample_freq": 1, "colsample_bytree": 0.8,
}
TREE_FOLDS = {"n_splits": 5, "test_size": 96, "gap": 48}

_TREE_FRAME_SQL = (
    t.panel_sql("events")
    + ","
    + t.WEATHER_SQL
    + """, demand AS (
  SELECT f.site_id, f.timestamp, value, is_outlier, temperature_c
  FROM filled f LEFT JOIN weather w ON f.site_id = w.site_id AND f.timestamp = w.timestamp)"""
    + _feature_sql("demand", True, _LAGS, _EVENT_ROLL).replace("\nSELECT site_id", ", feats AS (\nSELECT site_id", 1)
    + ")"
)
_TREE_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ["value", *FIFTEEN])


def tree_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Stored table with the configured model's features."""
    demand = build_dataset(t.meter_events(spark, sf), weather=t.weather_events(spark, sf))
    table = build_features(
        demand.select("site_id", "timestamp", "value", "is_outlier", "temperature_c"), target_lags=_LAGS, holidays=t.HOLIDAYS
    )
    return stage(table.select("site_id", "timestamp", "value", *FIFTEEN))


@register(
    "gbt_fit",
    _TREE_FRAME_SQL
    + f"""SELECT is_test, count(*) AS n_rows, count(*) AS n_finite, NOT is_test AND count(*) >= 500 AS nearer_than_mean
FROM (SELECT timestamp >= {SPLIT_SQL} AS is_test FROM feats WHERE {_TREE_COMPLETE}) GROUP BY is_test""",
)
def _(spark, sf):
    """Rows with a finite forecast; over 500 training rows or more it has to be nearer than their mean."""
    frame = tree_frame(spark, sf)
    fitted = fit_until(frame, FIFTEEN, CUTOFF, **TREES)
    rows = predict(fitted, complete_cases(frame, [*FIFTEEN, "value"]))
    is_test = F.col("timestamp") >= utc_instant(CUTOFF)
    error = F.avg(F.pow(F.col("value") - F.col("prediction"), F.lit(2)))
    return rows.groupBy(is_test.alias("is_test")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs("prediction") < 1e300).alias("n_finite"),
        (~F.bool_or(is_test) & (F.count(F.lit(1)) >= 500) & (error < 0.99 * F.var_pop("value"))).alias("nearer_than_mean"),
    )


@register(
    "backtest_gbt",
    _TREE_FRAME_SQL
    + _folds_sql("feats", **TREE_FOLDS).replace("trains AS", "all_trains AS").replace("tests AS", "all_tests AS")
    + f""", trains AS (SELECT * FROM all_trains WHERE {_TREE_COMPLETE}),
preds AS (SELECT * FROM all_tests WHERE {_TREE_COMPLETE}),
tr_side AS (SELECT fold, max(timestamp) AS train_end, count(*) AS n_train FROM trains GROUP BY ALL),
te_side AS (SELECT fold, min(timestamp) AS test_start, max(timestamp) AS test_end, count(*) AS n_test FROM preds GROUP BY ALL)
SELECT fold, train_end, test_start, test_end, n_train, n_test, n_test AS n_pred, true AS finite
FROM tr_side JOIN te_side USING (fold)""",
)
def _(spark, sf):
    """Five folds of the configured model in one run: rows per fold, all with finite errors."""
    report = backtest(LeafwiseTrees(**TREES | {"n_estimators": 2}), tree_frame(spark, sf), FIFTEEN, **TREE_FOLDS)
    finite = F.col("mae") + F.col("rmse") + F.col("mape") + F.col("smape") + F.abs("bias") < 1e300
    return shown(
        report.select(
            "fold", "train_end", "test_start", "test_end", "n_train", "n_test", "n_pred", finite.alias("finite")
        )
    )


def _leafwise_sql(source: str, target: str, features: list[str], leaves: int, least: int, group: str = "0") -> str:
    """One tree per group, grown best leaf first, with the mean of the target in its leaves."""
    values = f"[{', '.join(features)}]"
    out = f""", t0 AS (SELECT *, {group} AS grp, 0 AS leaf, {target} - avg({target}) OVER (PARTITION BY {group}) AS r FROM {source})"""
    for k in range(1, leaves):
        out += f""", h{k} AS (
  SELECT grp, leaf, f, v, sum(r) AS s, count(*) AS n FROM (
    SELECT grp, leaf, r, unnest(range({len(features)})) AS f, unnest({values}) AS v FROM t{k - 1}) GROUP BY ALL),
c{k} AS (
  SELECT grp, leaf, f, v, sum(s) OVER up AS sl, sum(n) OVER up AS nl, sum(s) OVER one AS st, sum(n) OVER one AS nt
  FROM h{k} WINDOW one AS (PARTITION BY grp, leaf, f), up AS (PARTITION BY grp, leaf, f ORDER BY v)),
b{k} AS (
  SELECT grp, leaf AS old, f, v FROM c{k} WHERE nl >= {least} AND nt - nl >= {least}
  QUALIFY row_number() OVER (PARTITION BY grp
    ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt DESC) = 1),
t{k} AS (SELECT t.* REPLACE ({_next_leaf(features, k)} AS leaf) FROM t{k - 1} t JOIN b{k} b USING (grp))"""
    return out + f", fit AS (SELECT grp, leaf, avg({target}) AS m FROM t{leaves - 1} GROUP BY ALL)"


def _next_leaf(features: list[str], k: int) -> str:
    chosen = " ".join(f"WHEN {i} THEN t.{c}" for i, c in enumerate(features))
    return f"CASE WHEN t.leaf = b.old AND CASE b.f {chosen} END > b.v THEN {k} ELSE t.leaf END"


def _leafwise_score(source: str, features: list[str], leaves: int, group: str = "0") -> str:
    """Rows of ``source`` with their leaf's mean ``m``, as ``scored``."""
    out = f", s0 AS (SELECT *, {group} AS grp, 0 AS leaf FROM {source})"
    for k in range(1, leaves):
        out += f", s{k} AS (SELECT t.* REPLACE ({_next_leaf(features, k)} AS leaf) FROM s{k - 1} t JOIN b{k} b USING (grp))"
    return out + f", scored AS (SELECT s.*, m FROM s{leaves - 1} s JOIN fit USING (grp, leaf))"


_BY_DATE = ["day_of_week", "month", "year"]
_BY_CLOCK = ["day_of_week", "minute_of_day"]


def _one_tree(leaves: int, least: int) -> dict:
    return {"n_estimators": 1, "learning_rate": 1.0, "num_leaves": leaves, "min_child_samples": least}


@register(
    "gbt_leafwise_tree",
    t.panel_sql("lines")
    + f""", cal AS (SELECT site_id, timestamp, value, {_CALENDAR_SQL} FROM readings),
tr AS (SELECT * FROM cal WHERE value IS NOT NULL AND timestamp < TIMESTAMP '1997-01-01')"""
    + _leafwise_sql("tr", "value", _BY_DATE, 6, 20)
    + _leafwise_score("cal", _BY_DATE, 6)
    + " SELECT site_id, timestamp, round(m, 6) AS prediction FROM scored",
)
def _(spark, sf):
    """The first tree, of six leaves; later ones are held against plain boosting by the tests."""
    frame = stage(add_calendar_features(readings(spark, sf, "lines")).select("site_id", "timestamp", "value", *_BY_DATE))
    fitted = fit_until(frame, _BY_DATE, "1997-01-01", **_one_tree(6, 20))
    return shown(predict(fitted, frame).select("site_id", "timestamp", "prediction"), prediction=6)


@register(
    "backtest_gbt_tree",
    t.panel_sql("events")
    + f""", cal AS (SELECT site_id, timestamp, value, {_CALENDAR_SQL} FROM readings WHERE value IS NOT NULL)"""
    + _folds_sql("cal", **TREE_FOLDS)
    + _leafwise_sql("trains", "value", _BY_CLOCK, 4, 25, "fold")
    + _leafwise_score("tests", _BY_CLOCK, 4, "fold")
    + _report_sql("cal", ", preds AS (SELECT fold, timestamp, value AS y_true, m AS y_pred FROM scored)"),
)
def _(spark, sf):
    """All folds' first trees, which grow together, against a tree per fold in SQL."""
    frame = stage(
        add_calendar_features(readings(spark, sf).where("value is not null")).select("site_id", "timestamp", "value", *_BY_CLOCK)
    )
    report = backtest(LeafwiseTrees(**_one_tree(4, 25)), frame, _BY_CLOCK, **TREE_FOLDS)
    return shown(report, **METRIC_DIGITS)


@register(
    "forecast_horizon_gbt",
    t.panel_sql("events")
    + f""", frame AS (SELECT site_id, timestamp, value, {_CALENDAR_SQL} FROM gridded)"""
    + _DIRECT_SQL
    + _leafwise_sql("direct", "value_ahead", _BY_CLOCK, 3, 25, "step")
    + """, origin AS (
  SELECT o.*, s.step FROM (
    SELECT * FROM frame QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC) = 1) o CROSS JOIN steps s)"""
    + _leafwise_score("origin", _BY_CLOCK, 3, "step")
    + """ SELECT site_id, timestamp, step, timestamp + step * INTERVAL 30 MINUTE AS target_timestamp,
  round(m, 6) AS prediction FROM scored""",
)
def _(spark, sf):
    """A tree per step ahead; all steps are trained in one run and forecast in one scan."""
    frame = stage(add_calendar_features(gridded(spark, sf)).select("site_id", "timestamp", "value", *_BY_CLOCK))
    fitted = fit_direct(frame, _BY_CLOCK, HORIZON, grid="30min", model=LeafwiseTrees(**_one_tree(3, 25)))
    return shown(forecast_horizon(fitted, frame, HORIZON), prediction=6)
