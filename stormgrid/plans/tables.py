"""Queries of the archive loader, regridding, city tables, and the features of a cell table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import geo
from stormgrid.operators import features, grid
from stormgrid.plans import base as B
from stormgrid.sources import archive, weather

QUERIES, ORACLES = {}, {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


# an archive event a day: rasters of 32 x 32 pixels of 4 km, an hour a frame; infrared on two days of three, flashes on four of five

NATIVE = archive.Native((32, 4.0), (32, 4.0), (16, 8.0), tuple(3600.0 * k for k in range(24)))


def archive_cells(s, d):
    e = B.table(s, d, "events").select(F.to_date("ts").alias("id"), F.hour("ts").alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 86_400).alias("t"), (F.col("user_id") % 32).cast("int").alias("row"), (F.get_json_object("props", "$.k").cast("long") % 32).cast("int").alias("col"), "value", "event_type")
    day = F.dayofmonth("id")
    kinds = F.array(F.when(day % 7 != 0, F.lit("vil")), F.when(day % 3 != 0, F.lit("ir107")), F.when(day % 5 != 0, F.lit("lght")))
    catalog = e.select("id").distinct().withColumn("img_type", F.explode(kinds)).where("img_type IS NOT NULL")
    p = e.groupBy("id", "frame", "row", "col").agg(F.max("value").alias("v"))
    raw = p.select("id", "frame", "row", "col", F.explode(F.array(F.struct(F.lit("vil").alias("img_type"), (F.col("v") / 2.0).alias("raw")), F.struct(F.lit("ir107").alias("img_type"), (-F.col("v") * 20.0).alias("raw")))).alias("x")).select("id", "frame", "row", "col", "x.*").where(~((F.col("img_type") == "ir107") & (day % 3 == 0)))
    flashes = e.where("event_type = 'error'").select("id", "t", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), (F.col("col") % 16).cast("double").alias("x"), (F.col("row") % 16).cast("double").alias("y"))
    return archive.load(catalog, raw, flashes, NATIVE)


def _archive(s, d):
    c = archive_cells(s, d)
    return c.groupBy("event_id", "frame").agg(F.count(F.lit(1)).alias("n"), *(x for k in S.CHANNELS for x in (F.count(k).alias(f"n_{k}"), F.round(F.sum(k), 3).alias(f"sum_{k}"))), F.round(F.sum("y"), 3).alias("strikes"))


_SFC = "least(greatest(10.0e0 * log10(greatest(pow(greatest(vil, 1e-6) / (3.44e-6 * 5.0e0 * 1000.0e0), 1.75e0), 1e-3)), -32.0e0), 80.0e0)"
add("archive_cells", _archive, f"""WITH e AS (SELECT CAST(ts AS DATE) AS id, CAST(hour(ts) AS INTEGER) AS frame, CAST(user_id % 32 AS INTEGER) AS row, CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 32 AS INTEGER) AS col, value, event_type FROM events WHERE day(ts) % 7 <> 0),
p AS (SELECT id, frame, row, col, max(value) AS v FROM e GROUP BY ALL),
v AS (SELECT id, frame, row * 2 + a.i AS row, col * 2 + b.i AS col, CASE WHEN v / 2.0e0 <= 5 THEN 0.0e0 WHEN v / 2.0e0 <= 18 THEN (v / 2.0e0 - 2.0e0) / 90.66e0 ELSE exp((v / 2.0e0 - 83.9e0) / 38.9e0) END AS vil,
 CASE WHEN day(id) % 3 <> 0 THEN -v * 20.0e0 * 0.01e0 + 273.15e0 END AS ir_tb FROM p, range(2) a(i), range(2) b(i)),
l AS (SELECT k.id, CAST(f.i AS INTEGER) AS frame, r.i * 4 + a.i AS row, q.i * 4 + b.i AS col, coalesce(n, 0) / 16.0e0 AS light_dens FROM (SELECT DISTINCT id FROM e WHERE day(id) % 5 <> 0) k, range(24) f(i), range(16) r(i), range(16) q(i), range(4) a(i), range(4) b(i)
 LEFT JOIN (SELECT id, frame, row % 16 AS row, col % 16 AS col, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY ALL) x ON x.id = k.id AND x.frame = f.i AND x.row = r.i AND x.col = q.i),
j AS (SELECT coalesce(v.id, l.id) AS id, coalesce(v.frame, l.frame) AS frame, coalesce(v.row, l.row) AS row, coalesce(v.col, l.col) AS col, vil, ir_tb, light_dens FROM v FULL JOIN l ON v.id = l.id AND v.frame = l.frame AND v.row = l.row AND v.col = l.col),
t AS (SELECT *, CASE WHEN day(id) % 3 <> 0 THEN ir_tb ELSE 290.0e0 END AS ir FROM j),
u AS (SELECT *, CASE WHEN vil IS NOT NULL AND ir IS NOT NULL THEN {_SFC} END AS refl_sfc, CASE WHEN vil IS NOT NULL AND ir IS NOT NULL THEN least(greatest(CASE WHEN vil >= 0.5 THEN (300.0e0 - ir) / 6.5e0 - 1.5e0 ELSE 0.0e0 END, 0.0e0), 20.0e0) END AS echo_top FROM t),
w AS (SELECT *, CASE WHEN echo_top <= 6.5 THEN -32.0e0 WHEN echo_top IS NOT NULL THEN least(greatest(refl_sfc - (25.0e0 - 20.0e0 * (0.65e0 * least(greatest((echo_top - 6.5e0) / 4.0e0, 0), 1) + 0.35e0 * least(greatest((250.0e0 - ir) / 40.0e0, 0), 1))), -32.0e0), 80.0e0) END AS refl_m10 FROM u),
x AS (SELECT id, frame, row, col, light_dens AS y, {', '.join(f'CASE WHEN {c} BETWEEN {lo}e0 AND {hi}e0 THEN {c} END AS {c}' for c, (lo, hi) in S.RANGES.items())} FROM w),
sd AS (SELECT *, CASE WHEN count(refl_sfc) OVER (PARTITION BY id, row, col) >= 3 THEN stddev_pop(refl_sfc) OVER (PARTITION BY id, row, col) END AS sd FROM x),
k AS (SELECT *, coalesce(refl_sfc >= 35 AND echo_top <= 1.5 AND sd <= 1.5, false) AS cl FROM sd),
z AS (SELECT id, frame, y, ir_tb, light_dens, {', '.join(f'CASE WHEN NOT cl THEN {c} END AS {c}' for c in ('refl_sfc', 'refl_m10', 'echo_top', 'vil'))} FROM k)
SELECT id AS event_id, frame, count(*) AS n, {', '.join(f'count({c}) AS n_{c}, round(sum({c}), 3) AS sum_{c}' for c in S.CHANNELS)}, round(sum(coalesce(y, 0)), 3) AS strikes FROM z GROUP BY ALL""")


# padding: 16 x 16 pixels of 8 km and of 4 km onto the 128 km domain

def _padded(s, d):
    c = B.cells(s, d).groupBy("day", (F.col("row") % 16).alias("row"), (F.col("col") % 16).alias("col")).agg(F.max("v").alias("v"))
    return grid.to_config_grid(c, ["day"], "v", 16, 4.0).where("v IS NOT NULL").select("day", "row", "col", F.round("v", 6).alias("v"))


add("config_grid", _padded, f"""WITH {B.CELLS}, p AS (SELECT day, row % 16 AS row, col % 16 AS col, max(v) AS v FROM c GROUP BY ALL)
SELECT day, CAST((row + 8) * 2 + a.i AS INTEGER) AS row, CAST((col + 8) * 2 + b.i AS INTEGER) AS col, round(v, 6) AS v FROM p, range(2) a(i), range(2) b(i)""")
_LAT, _LON = 18.0, 78.0


def _regrid(s, d):
    k = B.strikes(s, d).select(F.to_date("ts").alias("day"), (_LAT + (F.col("lat") - 22.0) / 20.0).alias("lat"), (_LON + (F.col("lon") - 82.0) / 20.0).alias("lon"), (F.col("event_id") % 1000).cast("double").alias("v"))
    return grid.nearest_regrid(k, ["day"], "v", _LAT, _LON).select("day", "row", "col", F.round("v", 6).alias("v"))


add("nearest_regrid", _regrid, f"""WITH {B.STATIONS}, q AS (SELECT CAST(ts AS DATE) AS day, {_LAT}e0 + (lat - 22.0e0) / 20.0e0 AS lat, {_LON}e0 + (lon - 82.0e0) / 20.0e0 AS lon, event_id % 1000 AS v FROM k),
m AS (SELECT day, CAST(round_even(31.5e0 - (lat - {_LAT}e0) * {geo.KM_GRID}e0 / 2.0e0, 0) AS INTEGER) AS row, CAST(round_even(31.5e0 + (lon - {_LON}e0) * ({geo.KM_GRID}e0 * cos(radians({_LAT}e0))) / 2.0e0, 0) AS INTEGER) AS col, avg(v) AS v FROM q GROUP BY ALL)
SELECT x.day, CAST(r.i AS INTEGER) AS row, CAST(c.i AS INTEGER) AS col, round(v, 6) AS v FROM (SELECT DISTINCT day FROM q) x, range(64) r(i), range(64) c(i) LEFT JOIN m ON m.day = x.day AND m.row = r.i AND m.col = c.i""")

# city tables: a payload a nation and day, its orders as hours; half the nations from another fetch, one without coordinates


def city_hours(s, d):
    o = B.table(s, d, "orders").join(B.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(B.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    h = F.struct((k % 24).alias("h"), k.alias("k"), F.date_format(F.make_timestamp(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), k % 24, F.lit(0), F.lit(0)), "yyyy-MM-dd'T'HH:mm").alias("time"), (k % 37 / 2.0).alias("precipitation"), F.when(k % 5 != 0, k % 11 / 4.0).alias("rain"), F.when(k % 9 == 0, 95).when(k % 10 == 0, 99).otherwise(3).alias("weathercode"),
                 (k % 80 / 1.0).alias("windspeed_10m"), (k % 90 / 1.0).alias("windgusts_10m"), (k % 40 / 1.0).alias("temperature_2m"), (k % 100 / 1.0).alias("relativehumidity_2m"), F.when(k % 4 != 0, k % 4000 / 1.0).alias("cape"), (k % 7 / 1.0).alias("lifted_index"), (k % 50 / 1.0).alias("convective_inhibition"))
    p = o.groupBy("n_nationkey", "n_name", F.to_date("o_orderdate").alias("day")).agg(F.array_sort(F.collect_list(h)).alias("x"))
    column = lambda n: F.transform("x", lambda e: e[n])
    arrays = F.struct(*(column(n).alias(n) for n in ("time", *weather._FETCHED)))
    p = p.select(F.col("n_name").alias("city"), F.lit("state").alias("state"), F.when(F.col("n_nationkey") != 7, F.col("n_nationkey") + 8.0).alias("latitude"), F.lit(75.0).alias("longitude"), F.to_json(F.struct(arrays.alias("hourly")), {"ignoreNullFields": "false"}).alias("json"), (F.col("n_nationkey") % 2).alias("half"))
    p = weather.cities(p)
    return weather.together([weather.city_hourly(p.where(F.col("half") == i), "json") for i in (0, 1)])


_HOURS = """x AS (SELECT make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey % 24, 0, 0.0) AS timestamp, n_name AS city, 'state' AS state, n_nationkey + 8.0e0 AS latitude, 75.0e0 AS longitude, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 7),
y AS (SELECT timestamp, city, state, latitude, longitude, k % 37 / 2.0e0 AS precipitation, CASE WHEN k % 5 <> 0 THEN k % 11 / 4.0e0 END AS rain, CASE WHEN k % 9 = 0 THEN 95 WHEN k % 10 = 0 THEN 99 ELSE 3 END AS weather_code, k % 80 / 1.0e0 AS wind_speed_10m, k % 90 / 1.0e0 AS wind_gusts_10m,
 k % 40 / 1.0e0 AS temperature_2m, k % 100 / 1.0e0 AS humidity_2m, CASE WHEN k % 4 <> 0 THEN k % 4000 / 1.0e0 END AS cape, k % 7 / 1.0e0 AS lifted_index, k % 50 / 1.0e0 AS convective_inhibition FROM x),
h AS (SELECT *, CAST(weather_code IN (95, 96, 99) AS INTEGER) AS is_thunderstorm, round_even(0.6e0 * least(coalesce(cape, 0), 3000) / 3000.0e0 + 0.3e0 * least(coalesce(precipitation, 0), 20) / 20.0e0 + 0.1e0 * CAST(weather_code IN (95, 96, 99) AS INTEGER), 4) AS lightning_proxy FROM y)"""
add("city_hours", lambda s, d: city_hours(s, d).groupBy("city", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("hours"), F.sum("is_thunderstorm").alias("thunder"), F.round(F.sum("rain"), 4).alias("rain"), F.count("cape").alias("capes"), F.round(F.sum("lightning_proxy"), 4).alias("proxy"), F.max("wind_gusts_10m").alias("gust"), F.min(F.hour("timestamp")).alias("first_hour")),
    f"WITH {_HOURS} SELECT city, CAST(timestamp AS DATE) AS day, count(*) AS hours, CAST(sum(is_thunderstorm) AS BIGINT) AS thunder, round(sum(rain), 4) AS rain, count(cape) AS capes, round(sum(lightning_proxy), 4) AS proxy, max(wind_gusts_10m) AS gust, CAST(min(hour(timestamp)) AS INTEGER) AS first_hour FROM h GROUP BY ALL")
add("background_density", lambda s, d: B.stations(s, d).select("s_suppkey", F.round(weather.background_density(F.col("lat"), F.col("lon")), 3).alias("density")), f"WITH {B.STATIONS} SELECT s_suppkey, greatest(round_even(0.5e0 + 2.5e0 * exp(-((lat - 20.0e0) * (lat - 20.0e0) + (lon - 82.0e0) * (lon - 82.0e0)) / 50.0e0), 3), 0.05e0) AS density FROM st")


# the twenty features of a day's grid as frames of one event, and each by itself against the strikes

def _features(s, d):
    g = B.day_grid(s, d)
    z = F.col("z")
    return g.select(F.lit(1).alias("event_id"), F.date_diff("day", F.lit("2024-01-01").cast("date")).alias("frame"), "row", "col", F.when(z > 0, z).alias("refl_sfc"), F.when(z > 2, z * 0.9).alias("refl_m10"), F.when(z > 0, z / 4.0).alias("echo_top"), (z / 2.0).alias("vil"), (290.0 - z).alias("ir_tb"), F.col("strikes").cast("double").alias("light_dens"))


add("feature_stack", lambda s, d: features.build(_features(s, d)).groupBy("frame").agg(*(F.round(F.sum(c), 3).alias(c) for c in features.NAMES)))


def _ranked(s, d):
    f = _features(s, d)
    return features.rank_features(features.build(f), f.select("event_id", "frame", "row", "col", (F.col("light_dens") >= 1).alias("label")))


add("feature_ranking", _ranked)
