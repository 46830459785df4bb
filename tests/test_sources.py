"""JSON, catalogs, health and the stream, from fixtures."""

import json

from pyspark.sql import functions as F

from stormgrid.functions import scalar
from stormgrid.sources import health, weather
from stormgrid.streaming import strikes


def test_nwp(spark):
    j = json.dumps({"hourly": {"time": ["2024-01-01T00:00"], "cape": [650.0], "convective_inhibition": [120.0], "freezing_level_height": [4500.0]}})
    r = weather.nwp(spark.createDataFrame([(j,)], "j string"), "j").first()
    assert (r["cape"], r["freezing_km"], r["charging_lower_km"]) == (650.0, 4.5, 6.0)


def test_weather(spark):
    j = json.dumps({"name": "Pune", "main": {"temp": 28.5, "humidity": 70}, "wind": {"speed": 4.2}, "weather": [{"main": "Rain"}]})
    f = json.dumps({"list": [{"dt": i, "main": {"temp": 1.0}} for i in range(12)]})
    r = weather.current(spark.createDataFrame([(j, f), ("{}", None)], "j string, f string"), "j", "f").collect()
    assert r[0]["wind_kmh"] == 15.1 and len(r[0]["forecast"]) == 8 and r[0]["condition"] == "Rain"
    assert r[1]["place"] == "Unknown" and r[1]["forecast"] == []


def test_hourly_and_daily(spark):
    j = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "rain": [1.0, None]}})
    h = weather.hourly(spark.createDataFrame([("Pune", j)], "city string, j string"), "j", ["rain"])
    assert h.count() == 2 and h.where("rain is null").count() == 1
    d = h.selectExpr("city", "'MH' state", "1.0D latitude", "2.0D longitude", "timestamp", "cast(null as double) precipitation", "rain", "1.0D wind_speed_10m", "2.0D wind_gusts_10m", "3.0D cape", "1 is_thunderstorm", "0.5D lightning_proxy")
    r = weather.daily(d).first()
    assert r["rain"] == 1.0 and r["precipitation"] == 0.0 and r["thunder_hours"] == 2
    assert weather.daily(d.withColumn("city", F.lit(None).cast("string"))).count() == 0


def test_catalog(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("id,img_type,file_name,file_index\nS1,vil,a.h5,0\nS1,ir069,b.h5,3\nS2,ir069,c.h5,1\n")
    c = weather.catalog_events(weather.catalog(spark, str(p)), ["vil", "ir069"]).collect()
    assert [r["id"] for r in c] == ["S1"] and c[0]["ir069"]["file_name"] == "b.h5"


def test_parse_time(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05",), ("2024-01-02 03:04:05",), ("02-JAN-2024T03:04:05",), ("x",)], "t string")
    out = [r[0] for r in df.select(weather.parse_time("t")).collect()]
    assert out[0] == out[1] and out[0] is not None and out[3] is None


def test_health(spark):
    p = spark.createDataFrame([("radar", '{"refl_sfc": []}', True, None), ("mosdac_dwr", '{"sweeps": []}', True, None), ("imd_dwr", '{"variables": []}', True, None), ("aws", '{"x": 1}', True, None), ("nwp", None, True, "timeout")], "source string, payload string, configured boolean, error string")
    got = {r["source"]: r["state"] for r in health.fetched(p, health.registry(spark)).collect()}
    assert got["radar"] == "LIVE" and got["aws"] == "DEGRADED" and got["nwp"] == "UNAVAILABLE" and got["insat"] == "NOT_CONFIGURED"
    assert got["mosdac_dwr"] == "DEGRADED" and got["imd_dwr"] == "LIVE"
    kept = spark.createDataFrame([("nwp", '{"status": "STALE", "values": {}}', True, None)], p.schema)
    assert health.fetched(kept, health.registry(spark)).where("source = 'nwp'").first()["state"] == "LIVE"
    assert spark.range(1).select(health.state(F.lit("LIVE"), F.lit(2000.0))).first()[0] == "STALE"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalar.clip_reflectivity(F.lit(-10.0))) == 0 and one(scalar.clip_reflectivity(F.lit(95.0))) == 75
    assert abs(one(scalar.decode_ir(F.lit(-7000.0))) - 203.15) < 1e-9 and one(scalar.compass(F.lit(350.0))) == "N"
    assert one(scalar.sigmoid(F.lit(0.0))) == 0.5


def test_duplicates_count_once(spark):
    e = spark.sql("select 1L event_id, timestamp'2024-01-01 00:01:00' ts, 1 row, 1 col union all select 1L, timestamp'2024-01-01 00:01:00', 1, 1")
    assert strikes.accumulate(e).first()["strikes"] == 1


def test_recent_strikes_are_all_kept(spark):
    k = spark.range(10_500).selectExpr("id as event_id", "timestamp_ltz'2024-01-15 11:00:00' as ts", "'IITM_LLN' as source")
    got = strikes.query(k, F.expr("timestamp_ltz'2024-01-15 12:00:00'"), 86_400.0, "IITM_LLN")
    assert got.count() == 10_500
