import pandas as pd
import pytest
from panel_helpers import rows

from wattline.operators.cleaning import drop_duplicate_readings
from wattline.plans.dataset import write_dataset
from wattline.plans.features import write_features
from wattline.schema import METER, validate_schema
from wattline.sources.readers import (
    load_processed,
    read_hh_meter_data,
    read_holidays,
    read_site_metadata,
    read_weather,
)
from wattline.sources.sinks import shared_dir, stage, write_metrics_csv, write_panel

HEADER = "site_id,timestamp,value,unit\n"


def test_later_exports_supersede_earlier_ones(spark, tmp_path):
    first = HEADER + "A,2025-01-01T00:00:00Z,1.0,kWh\nA,2025-01-01T00:30:00Z,2.0,kWh\n"
    second = HEADER + "A,2025-01-01 01:30:00+01:00,9.0,kWh\nA,2025-01-01,NaN,kWh\n"
    (tmp_path / "hh_meter_data_2025-02-01.csv").write_text(first)
    (tmp_path / "hh_meter_data_2025-03-01.csv").write_text(second)
    meter = read_hh_meter_data(spark, str(tmp_path))
    validate_schema(meter)
    assert meter.select(*METER.names).schema == METER
    out = rows(drop_duplicate_readings(meter))
    assert out.value.fillna(-1).tolist() == [-1.0, 9.0]
    assert out.timestamp.tolist() == list(
        pd.date_range("2025-01-01", periods=2, freq="30min", tz="UTC")
    )


def test_the_last_of_equal_lines_wins(spark, tmp_path):
    lines = "".join(f"A,2025-01-01 00:00:00,{i},kWh\n" for i in range(50))
    (tmp_path / "m.csv").write_text(HEADER + lines)
    out = drop_duplicate_readings(read_hh_meter_data(spark, tmp_path / "m.csv")).collect()
    assert [r.value for r in out] == [49.0]


def test_text_times_are_utc_in_any_session_zone(spark, tmp_path):
    (tmp_path / "m.csv").write_text(HEADER + "A,2025-07-01 12:00,1,kWh\n")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        seen = set()
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.add(
                read_hh_meter_data(spark, tmp_path / "m.csv").selectExpr("unix_micros(timestamp)").first()[0]
            )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seen == {pd.Timestamp("2025-07-01 12:00", tz="UTC").value // 1000}


def test_a_foreign_header_is_an_error(spark, tmp_path):
    (tmp_path / "m.csv").write_text("site,when,value,unit\nA,2025-01-01,1,kWh\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_hh_meter_data(spark, tmp_path / "m.csv").collect()


SITES = "site_id,trust_name,site_type,gia_m2,beds,latitude,longitude\n"


def test_site_register(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SITES + "A,North,acute,1200.5,300,51.5,-0.1\nB,South,,,,,\n")
    out = rows(read_site_metadata(spark, tmp_path / "s.csv"), "site_id")
    assert out.beds.fillna(-1).tolist() == [300, -1] and out.gia_m2[0] == 1200.5


def test_site_register_rejects_repeated_sites(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SITES + "A,North,acute,1,1,1,1\nA,South,acute,1,1,1,1\n")
    with pytest.raises(Exception, match="Duplicate site in register: A"):
        read_site_metadata(spark, tmp_path / "s.csv").collect()


def test_weather_and_holidays(spark, tmp_path):
    names = "site_id,timestamp,temperature_c,humidity_pct,wind_speed_ms,solar_irradiance_wm2\n"
    (tmp_path / "w.csv").write_text(names + "A,2025-01-01T00:00:00Z,3.5,NaN,,0\n")
    r = read_weather(spark, tmp_path / "w.csv").first()
    assert (r.temperature_c, r.humidity_pct, r.wind_speed_ms, r.solar_irradiance_wm2) == (3.5, None, None, 0.0)
    (tmp_path / "h.csv").write_text("holiday\n2025-12-25\n")
    assert str(read_holidays(spark, tmp_path / "h.csv").first()[0]) == "2025-12-25"


def test_dataset_and_features_jobs(spark, tmp_path, panel, demand):
    meter = panel.select("site_id", "timestamp", "value", "unit")
    path = write_dataset(
        meter, str(tmp_path / "demand"), weather=panel.select("site_id", "timestamp", "temperature_c")
    )
    stored = load_processed(spark, path)
    assert stored.count() == len(demand)
    assert stored.columns == ["site_id", "timestamp", "value", "unit", "is_outlier", "temperature_c"]
    out = write_features(stored, str(tmp_path / "features"))
    assert "value_roll_std_336" in spark.read.parquet(out).columns


def test_a_long_site_is_written_by_several_tasks(spark, tmp_path, panel):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = write_panel(panel.where("site_id = 'north'"), str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = spark.read.parquet(path).selectExpr("_metadata.file_name f", "timestamp")
    assert stored.select("f").distinct().count() > 1


def test_stage_reads_back_the_same_rows(panel):
    a, b = rows(panel), rows(stage(panel))
    pd.testing.assert_frame_equal(a, b)


def test_shared_folder_is_the_cluster_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(base)
    assert shared_dir(spark) != shared_dir(spark)


def test_reports_per_site_are_written_in_parallel(spark, tmp_path):
    df = spark.range(8).selectExpr("cast(id as string) as site_id").repartition(3)
    path = write_metrics_csv(df, str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("*.csv"))) > 1
    assert spark.read.option("header", True).csv(path).count() == 8


def test_text_offsets(spark, tmp_path):
    want = pd.Timestamp("2025-05-31 23:00", tz="UTC")
    texts = ["2025-06-01 00:00:00+01", "2025-06-01T00:00+0100", "2025-06-01 00:00:00.000+01:00",
             "2025-05-31 23:00Z", "2025-05-31 23:00:00", "2025-05-31 18:30 -04:30", "2025-06-01 04:30+0530"]
    (tmp_path / "m.csv").write_text(HEADER + "".join(f"A,{t},{i},kWh\n" for i, t in enumerate(texts)))
    got = read_hh_meter_data(spark, tmp_path / "m.csv").selectExpr("unix_micros(timestamp) u").collect()
    assert {r.u for r in got} == {want.value // 1000}
    (tmp_path / "d.csv").write_text(HEADER + "A,2025-06-01,1,kWh\n")
    one = read_hh_meter_data(spark, tmp_path / "d.csv").selectExpr("unix_micros(timestamp) u").first().u
    assert one == pd.Timestamp("2025-06-01", tz="UTC").value // 1000


def test_metrics_csv_is_one_file(spark, tmp_path):
    path = write_metrics_csv(spark.range(3).repartition(3), str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("*.csv"))) == 1
    assert spark.read.option("header", True).csv(path).count() == 3
