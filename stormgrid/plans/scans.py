"""Queries of satellite scans, the strike buffer and windows of splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.functions import geo
from stormgrid.operators import grid, splits
from stormgrid.plans import base as B
from stormgrid.plans import live
from stormgrid.sources import health, satellite, weather
from stormgrid.streaming import strikes as K

QUERIES, ORACLES = {}, {}
#: A grid wide enough for all strikes: centre and pixel in km; the first frame's time; frames of a month.
LAT, LON, WIDE, START, FRAMES = 22.0, 82.0, 50.0, 1_704_067_200, 8_928
#: Latitudes and longitudes of the imager's sector, which ends inside the target grid.
SECTOR = (19.0, 18.1, 73.4, 74.6)


def add(name, f, sql):
    QUERIES[name] = f
    ORACLES[name] = sql


def _flashes(s, d):
    offset = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - satellite.J2000
    return B.strikes(s, d).select("lat", "lon", offset.alias("offset_s"), (F.col("event_id") % 3).alias("quality"))


_ROW = "CAST(round_even(31.5e0 - (lat - 22.0e0) * 111.32e0 / 50.0e0, 0) AS INTEGER) AS row"
_COL = "CAST(round_even(31.5e0 + (lon - 82.0e0) * (111.32e0 * cos(radians(22.0e0))) / 50.0e0, 0) AS INTEGER) AS col"
add("flash_frames", lambda s, d: satellite.flash_frames(_flashes(s, d), START, FRAMES, LAT, LON, 1, WIDE), f"""WITH {B.STATIONS},
f AS (SELECT CAST(floor((epoch_us(ts) / 1e6 - 946728000 + (946728000 - {START})) / 300.0e0) AS BIGINT) AS frame, {_ROW}, {_COL} FROM k WHERE event_id % 3 <= 1)
SELECT frame, row, col, CAST(count(*) AS BIGINT) AS flashes FROM f
WHERE frame BETWEEN 0 AND {FRAMES - 1} AND row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 GROUP BY ALL""")


def _points_max(s, d):
    row, col = geo.to_rowcol(F.col("lat"), F.col("lon"), LAT, LON, pixel=WIDE)
    k = B.strikes(s, d).join(B.cells(s, d).select("event_id", F.when(F.col("event_id") % 11 == 0, -999.0).otherwise(F.col("v")).alias("dbz")), "event_id")
    return grid.scattered_max(k, row, col, ["source"], "dbz")


add("scattered_max", _points_max, f"""WITH {B.STATIONS},
p AS (SELECT source, {_ROW}, {_COL}, v AS dbz FROM k JOIN c USING (event_id) WHERE event_id % 11 <> 0)
SELECT source, row, col, max(dbz) AS dbz FROM p WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 GROUP BY ALL""")


def _kelvin(s, d):
    table = s.range(1024).select(F.col("id").alias("idx"), (340.0 - F.col("id") * 0.15).alias("kelvin"))
    counts = B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1200 - 50).alias("n"))
    return satellite.kelvin(counts, F.col("n"), table).select("l_orderkey", "l_linenumber", F.round("kelvin", 6).alias("kelvin"))


add("imager_kelvin", _kelvin, "SELECT l_orderkey, l_linenumber, round(340.0e0 - greatest(0, least(l_partkey % 1200 - 50, 1023)) * 0.15e0, 6) AS kelvin FROM lineitem")


def _sector(s, d):
    return satellite.linear_axes(s, B.day_grid(s, d), ["day"], "z", (64, 64), SECTOR, 18.5204, 73.8567)


_AXES = """t0 AS (SELECT CAST(a.i AS INTEGER) AS row, CAST(b.i AS INTEGER) AS col,
 (19.0e0 - (18.5204e0 + (31.5e0 - a.i) * (2.0e0 / 111.32e0))) / (19.0e0 - 18.1e0) * 63 AS r,
 (73.8567e0 + (b.i - 31.5e0) * (2.0e0 / (111.32e0 * cos(radians(18.5204e0)))) - 73.4e0) / (74.6e0 - 73.4e0) * 63 AS q FROM range(64) a(i), range(64) b(i)),
t AS (SELECT row, col, greatest(0, least(CAST(round_even(r, 0) AS INTEGER), 63)) AS fr, greatest(0, least(CAST(round_even(q, 0) AS INTEGER), 63)) AS fc,
 r BETWEEN 0 AND 63 AND q BETWEEN 0 AND 63 AS inside FROM t0)"""
add("linear_axis_regrid", _sector, f"WITH {B.GRID}, {_AXES} SELECT g.day, t.row, t.col, CASE WHEN inside THEN z END AS z FROM t JOIN g ON g.row = fr AND g.col = fc")


def _incoming(s, d):
    # seven digits, so that no current lies half-way between two tenths, where engines differ over a double's last bit
    k = B.strikes(s, d).join(B.cells(s, d).select("event_id", (F.col("v") * 0.377 + 0.0123456).alias("peak_current_ka")), "event_id")
    return K.ingested(k)


add("strike_ingest", _incoming, f"""WITH {B.STATIONS} SELECT event_id, left(source, 4) || '-' || CAST(epoch_us(ts) // 1000 % 1000000 AS VARCHAR) AS id, source,
 round_even(lat, 5) AS lat, round_even(lon, 5) AS lon, epoch_us(ts) / 1e6 AS "timestamp", stroke_type, round_even(v * 0.377e0 + 0.0123456e0, 1) AS peak_current_ka,
 CASE WHEN source = 'IITM_LLN' THEN 300.0e0 ELSE 450.0e0 END AS location_accuracy_m, CASE WHEN source = 'IITM_LLN' THEN 0.95e0 ELSE 0.92e0 END AS confidence
 FROM k JOIN (SELECT event_id, v FROM c) USING (event_id)""")

_KM = "sqrt(pow((lat - 18.5204e0) * 111.0e0, 2) + pow((lon - 73.8567e0) * 111.0e0 * cos(radians(18.5204e0)), 2))"
add("location_risk", lambda s, d: K.location_risk(B.strikes(s, d), F.expr("timestamp_ltz '2024-01-15 12:00:00'"), 18.5204, 73.8567, 432_000.0), f"""WITH {B.STATIONS},
a AS (SELECT event_id, {_KM} AS km FROM k WHERE (epoch_us({live._NOW}) - epoch_us(ts)) / 1e6 BETWEEN 0 AND 432000),
r AS (SELECT count(*) FILTER (WHERE km <= 15) AS near, count(*) FILTER (WHERE km <= 50) AS far, round_even(min(km), 1) AS nearest_km FROM a)
SELECT 18.5204e0 AS lat, 73.8567e0 AS lon, CAST(near AS BIGINT) AS near, CAST(far AS BIGINT) AS far, nearest_km,
 (SELECT event_id FROM a ORDER BY km, event_id LIMIT 1) AS nearest, CASE WHEN near > 0 THEN 'RED' WHEN far > 0 THEN 'ORANGE' ELSE 'GREEN' END AS level FROM r""")


def _split_windows(s, d):
    return splits.split_windows(live._split(s, d), live._spans(s, d), "day", 2, 6, 1)


add("split_windows", _split_windows, f"""WITH {B.CELLS}, {live._SPLIT}, d AS (SELECT day, min(frame) + 1 AS a, max(frame) - 1 - 17 AS b FROM c GROUP BY day)
SELECT split, day, unnest(generate_series(a, b, CASE WHEN split = 'train' THEN 2 ELSE 6 END)) AS t0 FROM d JOIN sp USING (day) WHERE b >= a""")


def _daily(s, d):
    o = B.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    x = B.table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.when(F.col("c") % 17 == 0, None).otherwise(F.concat(F.lit("city"), (F.col("c") % 5).cast("string")))
    num = lambda c: F.col(c).cast("double")
    return weather.daily(x.select(
        name.alias("city"), F.lit("state").alias("state"), (F.col("c") % 5 + 10.0).alias("latitude"), F.lit(75.0).alias("longitude"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.when(F.col("c") % 3 != 0, num("l_quantity")).alias("rain"), num("l_linenumber").alias("precipitation"), num("l_extendedprice").alias("wind_speed_10m"), num("l_tax").alias("wind_gusts_10m"),
        num("l_discount").alias("cape"), (F.col("l_linenumber") % 2).cast("int").alias("is_thunderstorm"), num("l_quantity").alias("lightning_proxy")))


add("weather_daily", _daily, """WITH x AS (SELECT *, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 17 <> 0)
SELECT 'city' || CAST(c % 5 AS VARCHAR) AS city, 'state' AS state, c % 5 + 10.0e0 AS latitude, 75.0e0 AS longitude, CAST(l_shipdate AS DATE) AS date,
 coalesce(sum(CASE WHEN c % 3 <> 0 THEN CAST(l_quantity AS DOUBLE) END), 0.0e0) AS rain, sum(CAST(l_linenumber AS DOUBLE)) AS precipitation, max(CAST(l_extendedprice AS DOUBLE)) AS max_wind,
 max(CAST(l_tax AS DOUBLE)) AS max_gust, max(CAST(l_discount AS DOUBLE)) AS max_cape, CAST(sum(l_linenumber % 2) AS BIGINT) AS thunder_hours, max(CAST(l_quantity AS DOUBLE)) AS max_proxy FROM x GROUP BY ALL""")

# What each source sent in the example, whether it is configured, and its error.
PAYLOADS = [
    ("radar", '{"refl_sfc": 1}', True, None),
    ("insat", '{"other": 1}', True, None),
    ("lightning", '{"strikes": []}', True, "timeout"),
    ("aws", None, True, None),
    ("nwp", '{"status": "STALE", "values": {}}', True, None),
    ("mosdac_dwr", '{"data": 1}', False, None),
]


def _health(s, d):
    p = s.createDataFrame(PAYLOADS, "source string, payload string, configured boolean, error string")
    return health.fetched(p, health.registry(s)).select("source", "state", F.size("channels").alias("channels"))


add("source_health", _health, """SELECT * FROM (VALUES ('radar', 'LIVE', 4), ('insat', 'DEGRADED', 1), ('lightning', 'UNAVAILABLE', 1), ('aws', 'UNAVAILABLE', 0), ('nwp', 'LIVE', 0),
 ('mosdac_dwr', 'NOT_CONFIGURED', 2), ('imd_dwr', 'NOT_CONFIGURED', 1)) t(source, state, channels)""")
