"""As-of, split, station, live and source queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.functions import scalar
from stormgrid.operators import asof, spatial, splits
from stormgrid.plans import base as B
from stormgrid.sources import weather
from stormgrid.streaming import strikes as K

QUERIES, ORACLES = {}, {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _targets(s, d):
    c = B.cells(s, d)
    return c.where("kind = 'purchase'").select("event_id", "row", "ts"), c.where("kind = 'view'").groupBy("row", "ts").agg(F.max("v").alias("v"))


def _asof(s, d, linear=False):
    t, src = _targets(s, d)
    return asof.asof(t, src, ["row"], "ts", "v", 43_200.0, linear).select("event_id", F.round("v", 6).alias("v"), F.round("age_s", 3).alias("age_s"))


_SRC = B.CELLS + ", t AS (SELECT event_id, row, ts FROM c WHERE kind = 'purchase'), s AS (SELECT row, ts, max(v) AS v FROM c WHERE kind = 'view' GROUP BY ALL)"
_AGE = "(epoch_us(t.ts) - epoch_us(s.ts)) / 1e6"
add("asof_hold", _asof, f"WITH {_SRC} SELECT t.event_id, CASE WHEN {_AGE} <= 43200 THEN round(s.v, 6) END AS v, round({_AGE}, 3) AS age_s FROM t ASOF LEFT JOIN s ON t.row = s.row AND t.ts >= s.ts")
add("asof_linear", lambda s, d: _asof(s, d, True), f"""WITH {_SRC}, a AS (SELECT t.event_id, t.row, t.ts, s.v, s.ts AS ts0, {_AGE} AS age FROM t ASOF LEFT JOIN s ON t.row = s.row AND t.ts >= s.ts),
b AS (SELECT a.*, n.v AS v1, n.ts AS ts1 FROM a ASOF LEFT JOIN s n ON a.row = n.row AND a.ts < n.ts)
SELECT event_id, round(CASE WHEN age <= 43200 THEN CASE WHEN v1 IS NULL OR ts1 <= ts0 THEN v ELSE v + (v1 - v) * (epoch_us(ts) / 1e6 - epoch_us(ts0) / 1e6) / (epoch_us(ts1) / 1e6 - epoch_us(ts0) / 1e6) END END, 6) AS v, round(age, 3) AS age_s FROM b""")


def _spans(s, d):
    return B.cells(s, d).groupBy("day").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


_W = B.CELLS + ", d AS (SELECT day, min(frame) AS a, max(frame) AS b FROM c GROUP BY day), w AS (SELECT day, unnest(generate_series(a + {g}, b - {g} - 17, {st})) AS t0 FROM d WHERE b - {g} - 17 >= a + {g})"
add("window_enumerate", lambda s, d: splits.windows(_spans(s, d), "day", 6, 2), f"WITH {_W.format(g=2, st=6)} SELECT day, t0 FROM w")
add("sequence_cut", lambda s, d: splits.sequences(B.cells(s, d).select("day", "frame", "event_id", "v"), splits.windows(_spans(s, d), "day", 12), "day").groupBy("day", "t0").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"), F.max("step").alias("last_step")),
    f"WITH {_W.format(g=0, st=12)} SELECT w.day, w.t0, CAST(count(*) AS BIGINT) AS n, max(v) AS top, CAST(max(frame - t0) AS INTEGER) AS last_step FROM w JOIN c ON c.day = w.day AND c.frame BETWEEN w.t0 AND w.t0 + 17 GROUP BY ALL")


def _split(s, d):
    return splits.split_events(B.cells(s, d), "day", "chronological")


_SPLIT = "n0 AS (SELECT day, row_number() OVER (ORDER BY day) AS i, (SELECT count(DISTINCT day) FROM c) AS n FROM (SELECT DISTINCT day FROM c)), n1 AS (SELECT *, greatest(1, least(CAST(round_even(0.65e0 * n, 0) AS BIGINT), n - 2)) AS tr FROM n0), n2 AS (SELECT *, greatest(1, least(CAST(round_even(0.15e0 * n, 0) AS BIGINT), n - tr - 1)) AS va FROM n1), sp AS (SELECT day, CASE WHEN i <= tr THEN 'train' WHEN i <= tr + va THEN 'val' ELSE 'test' END AS split FROM n2)"
add("split_events", _split, f"WITH {B.CELLS}, {_SPLIT} SELECT day, split FROM sp")


def _samples(s, d):
    c = B.cells(s, d).groupBy("day", "frame").agg(F.count_if(F.col("strike")).alias("pos"), F.count(F.lit(1)).alias("px"))
    return splits.problems(splits.stats(c.join(_split(s, d), "day"), ["split"], "day", "pos", "px")).withColumn("problems", F.concat_ws(";", "problems"))


add("split_stats", _samples, f"""WITH {B.CELLS}, {_SPLIT}, a AS (SELECT day, frame, count(*) FILTER (WHERE strike) AS pos, count(*) AS px FROM c GROUP BY ALL),
b AS (SELECT split, day, count(*) AS n, sum(pos) AS p, sum(px) AS px, count(*) FILTER (WHERE pos > 0) AS lit FROM a JOIN sp USING (day) GROUP BY ALL),
t AS (SELECT split, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(p) AS BIGINT) AS positives, round(CAST(sum(p) AS DOUBLE) / nullif(CAST(sum(px) AS DOUBLE), 0), 6) AS base_rate, round(CAST(sum(lit) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS lit_samples, CAST(count(*) FILTER (WHERE p > 0) AS BIGINT) AS lit_events, round(CAST(max(p) AS DOUBLE) / nullif(CAST(sum(p) AS DOUBLE), 0), 6) AS largest_share FROM b GROUP BY split)
SELECT *, concat_ws(';', CASE WHEN positives = 0 THEN 'no positives' END, CASE WHEN positives BETWEEN 1 AND 499 THEN 'fewer than 500 positives' END, CASE WHEN largest_share >= 1 THEN 'all from one event' END) AS problems FROM t""")
add("split_overlap", lambda s, d: splits.overlapping(_split(s, d).unionByName(_split(s, d).where("split = 'val'").withColumn("split", F.lit("test"))), "day"), f"WITH {B.CELLS}, {_SPLIT}, u AS (SELECT * FROM sp UNION ALL SELECT day, 'test' FROM sp WHERE split = 'val') SELECT day, CAST(count(DISTINCT split) AS BIGINT) AS splits FROM u GROUP BY day HAVING count(DISTINCT split) > 1")


def _leak(s, d):
    w = splits.windows(_spans(s, d), "day", 1)
    return splits.leakage(w.where("t0 % 5 <> 0"), w.where("t0 % 5 = 0"), "day")


add("naive_leakage", _leak, f"WITH {_W.format(g=0, st=1)}, n AS (SELECT t.day, t.t0, min(abs(t.t0 - r.t0)) AS m FROM w t LEFT JOIN w r ON r.day = t.day AND r.t0 % 5 <> 0 AND abs(t.t0 - r.t0) < 40 WHERE t.t0 % 5 = 0 GROUP BY ALL) SELECT CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE m < 18) AS BIGINT) AS leaking, round(CAST(count(*) FILTER (WHERE m < 18) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS part FROM n")

_NEAR = "n AS (SELECT s_suppkey, count(*) FILTER (WHERE km <= 15) AS near, count(*) AS far, min(km) AS km FROM (SELECT s_suppkey, sqrt(pow((k.lat - st.lat) * 111.0e0, 2) + pow((k.lon - st.lon) * 111.0e0 * cos(radians(st.lat)), 2)) AS km FROM st JOIN k ON abs(k.lat - st.lat) < 1) WHERE km <= 50 GROUP BY ALL), r AS (SELECT st.s_suppkey, CAST(coalesce(near, 0) AS BIGINT) AS near, CAST(coalesce(far, 0) AS BIGINT) AS far, round(km, 3) AS nearest_km FROM st LEFT JOIN n USING (s_suppkey))"
add("station_risk", lambda s, d: spatial.near_strikes(B.stations(s, d), B.strikes(s, d), "s_suppkey"), f"WITH {B.STATIONS}, {_NEAR} SELECT * FROM r")
add("station_alert_level", lambda s, d: spatial.station_alerts(B.stations(s, d), B.strikes(s, d), "s_suppkey").groupBy("level").agg(F.count(F.lit(1)).alias("stations")), f"WITH {B.STATIONS}, {_NEAR} SELECT CASE WHEN near > 0 THEN 'RED' WHEN far > 0 THEN 'ORANGE' ELSE 'GREEN' END AS level, CAST(count(*) AS BIGINT) AS stations FROM r GROUP BY ALL")
add("box_strikes", lambda s, d: B.strikes(s, d).where(spatial.in_box(18.5, 78.0, 2.0)).groupBy("stroke_type").agg(F.count(F.lit(1)).alias("n")), f"WITH {B.STATIONS} SELECT stroke_type, CAST(count(*) AS BIGINT) AS n FROM k WHERE abs(lat - 18.5e0) <= 2 AND abs(lon - 78.0e0) <= 2 GROUP BY ALL")
_NOW = "TIMESTAMP '2024-01-15 12:00:00'"
add("recent_strikes", lambda s, d: K.query(B.strikes(s, d), F.expr("timestamp_ltz '2024-01-15 12:00:00'"), 86_400.0, "IITM_LLN").select("event_id", "ts", "source"), f"WITH {B.STATIONS} SELECT event_id, ts, source FROM k WHERE source = 'IITM_LLN' AND epoch_us({_NOW}) - epoch_us(ts) BETWEEN 0 AND 86400000000")
add("newest_per_source", lambda s, d: K.newest(B.strikes(s, d), ["source"], 25).select("event_id", "source"), f"WITH {B.STATIONS} SELECT event_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id) AS n FROM k) WHERE n <= 25")


def _proxy(s, d):
    k = B.strikes(s, d).withColumn("day", F.to_date("ts")).withColumns({"lat": 18.5204 + (F.col("lat") - 22.0) / 25.0, "lon": 73.8567 + (F.col("lon") - 82.0) / 25.0})
    return K.proxy_reflectivity(k, ["day"], 18.5204, 73.8567)


_PS = "(coalesce(lag({v}) OVER (PARTITION BY day, {f} ORDER BY {m}), {v}) + 2 * {v} + coalesce(lead({v}) OVER (PARTITION BY day, {f} ORDER BY {m}), {v})) / 4 AS {o}"
_PROXY = f"""{B.STATIONS}, pr AS (SELECT CAST(ts AS DATE) AS day, CAST(round_even(32.0e0 - (18.5204e0 + (lat - 22.0e0) / 25.0e0 - 18.5204e0) * 111.0e0 / 2.0e0, 0) AS INTEGER) AS row, CAST(round_even(32.0e0 + (73.8567e0 + (lon - 82.0e0) / 25.0e0 - 73.8567e0) * (111.0e0 * cos(radians(18.5204e0))) / 2.0e0, 0) AS INTEGER) AS col, CASE WHEN stroke_type = 'CG' THEN 1.0e0 ELSE 1.5e0 END AS w FROM k),
pd AS (SELECT x.day, CAST(r.i AS INTEGER) AS row, CAST(q.i AS INTEGER) AS col, coalesce(den, 0.0e0) AS den FROM (SELECT DISTINCT day FROM pr WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63) x, range(64) r(i), range(64) q(i) LEFT JOIN (SELECT day, row, col, sum(w) AS den FROM pr GROUP BY ALL) y ON y.day = x.day AND y.row = r.i AND y.col = q.i),
p1 AS (SELECT *, {_PS.format(v='den', f='row', m='col', o='s')} FROM pd), p2 AS (SELECT day, row, col, {_PS.format(v='s', f='col', m='row', o='density')} FROM p1),
p3 AS (SELECT *, CASE WHEN density > 0 THEN least(greatest(18.0e0 + 22.0e0 * log10(1.0e0 + 3.0e0 * density), 0.0e0), 65.0e0) ELSE 0.0e0 END AS dbz FROM p2)"""
add("proxy_reflectivity", lambda s, d: _proxy(s, d).select("day", "row", "col", F.round("density", 6).alias("density"), F.round("dbz", 5).alias("dbz")), f"WITH {_PROXY} SELECT day, row, col, round(density, 6) AS density, round(dbz, 5) AS dbz FROM p3")
add("lattice_cells", lambda s, d: spatial.lattice_cells(_proxy(s, d), ["day"], "dbz", 18.5204, 73.8567).select("day", "row", "col", F.round("dbz", 5).alias("dbz"), "severity", F.round("lat_45m", 4).alias("lat_45m")), f"WITH {_PROXY} SELECT day, row, col, round(dbz, 5) AS dbz, CASE WHEN dbz >= 38 THEN 'SEVERE' WHEN dbz >= 25 THEN 'MODERATE' ELSE 'NORMAL' END AS severity, round(round_even(round_even(18.5204e0 + (32.0e0 - row) * 2.0e0 / 111.0e0, 5) + 12.0e0 * 0.75e0 / 111.0e0, 5), 4) AS lat_45m FROM p3 WHERE row % 4 = 0 AND col % 4 = 0 AND dbz >= 18")
add("connected_components", lambda s, d: spatial.detect_cells(B.day_grid(s, d), ["day"], "z", "strikes", 5.0))

# A short colour scale.
SCALE = [(5.0, 0, 236, 236), (10.0, 1, 160, 246), (20.0, 0, 255, 0), (30.0, 0, 144, 0), (40.0, 255, 144, 0), (50.0, 255, 0, 0), (60.0, 192, 0, 0), (65.0, 255, 0, 255)]


def _colours(s, d):
    p = B.table(s, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 256).cast("int").alias("r"), (F.col("p_size") * 5 % 256).cast("int").alias("g"), (F.col("p_partkey") * 11 % 256).cast("int").alias("b"))
    return spatial.nearest_colour(p, SCALE, 80.0).select("p_partkey", "dbz")


_VALS = ", ".join(f"({i}, {z}e0, {r}, {g}, {b})" for i, (z, r, g, b) in enumerate(SCALE))
add("lut_nearest", _colours, f"""WITH p AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_size * 5 % 256 AS g, p_partkey * 11 % 256 AS b FROM part), t AS (SELECT * FROM (VALUES {_VALS}) v(i, z, r, g, b)),
n AS (SELECT p.*, t.z, sqrt(CAST((p.r - t.r) * (p.r - t.r) + (p.g - t.g) * (p.g - t.g) + (p.b - t.b) * (p.b - t.b) AS DOUBLE)) AS d, row_number() OVER (PARTITION BY p_partkey ORDER BY (p.r - t.r) * (p.r - t.r) + (p.g - t.g) * (p.g - t.g) + (p.b - t.b) * (p.b - t.b), i) AS n FROM p, t)
SELECT p_partkey, CASE WHEN d <= 80 AND sqrt(CAST((r - 255) * (r - 255) + (g - 255) * (g - 255) + (b - 255) * (b - 255) AS DOUBLE)) > 8 AND sqrt(CAST(r * r + g * g + b * b AS DOUBLE)) > 8 THEN z END AS dbz FROM n WHERE n = 1""")
add("tumbling_5min", lambda s, d: K.accumulate(B.cells(s, d).where("strike")).select((F.unix_micros("start") / 300_000_000).cast("long").alias("frame"), "row", "col", "strikes"), f"WITH {B.CELLS} SELECT frame, row, col, CAST(count(*) AS BIGINT) AS strikes FROM c WHERE strike GROUP BY ALL")


def _stream(s, d):
    """The same by Structured Streaming over the parquet file, run to its end."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    # a pattern: a stream takes a plain path for a folder, and the table is a file or a folder of files
    e = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.select("event_id", "ts", (F.col("user_id") % 64).cast("int").alias("row"), (k % 64).cast("int").alias("col"))
    at = (s.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="stormgrid-")).rstrip("/") + f"/tumbling-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch_{number}")

    # an update has the whole count of each window that changed, so the last one of a window counts
    q = K.accumulate(e).writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start()
    q.awaitTermination()
    out = s.read.schema("start timestamp, row int, col int, strikes long, batch int").option("recursiveFileLookup", "true").parquet(f"{at}/out")
    return out.groupBy("start", "row", "col").agg(F.max_by("strikes", "batch").alias("strikes"))


add("stream_tumbling_5min", _stream)
add("json_props", lambda s, d: B.table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), weather.any_key(F.col("props"), ["k"]).alias("has_k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS has_k FROM events")
def _caps(s, d):
    k = B.strikes(s, d).select("event_id", "source", "stroke_type", F.lit("Severe").alias("severity"), "ts", (F.col("event_id") % 60).alias("r0"), (F.col("event_id") % 60 + 4).alias("r1"), (F.col("event_id") % 50).alias("c0"), (F.col("event_id") % 50 + 8).alias("c1"))
    return K.cap_alert(k, "source", "stroke_type", "severity", "ts", ("r0", "r1", "c0", "c1"), "event_id").select("event_id", "cap")


_CORNERS = [("r0", "c0"), ("r0", "c1"), ("r1", "c1"), ("r1", "c0"), ("r0", "c0")]
_TEXTS = {k: v.replace("{hazard}", "' || stroke_type || '").replace("{AREA}", "' || upper(source) || '").replace("{area}", "' || source || '").replace("{population}", "850,000") for k, v in (("headline", K.HEADLINE), ("description", K.DESCRIPTION), ("instruction", K.INSTRUCTION))}
add("cap_alerts", _caps, f"""WITH {B.STATIONS}, q AS (SELECT *, printf('%.4f', 18 + (event_id % 60) / 64.0e0) AS r0, printf('%.4f', 18 + (event_id % 60 + 4) / 64.0e0) AS r1, printf('%.4f', 73 + (event_id % 50) / 64.0e0) AS c0, printf('%.4f', 73 + (event_id % 50 + 8) / 64.0e0) AS c1 FROM k)
SELECT event_id, '<?xml version="1.0" encoding="UTF-8"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>' || event_id || '</identifier><sender>alerts@stormgrid.example</sender><sent>' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
 || '-00:00</sent><status>Actual</status><msgType>Alert</msgType><scope>Public</scope><info><category>Met</category><event>' || stroke_type || '</event><urgency>Immediate</urgency><severity>Severe</severity><certainty>Observed</certainty><expires>'
 || strftime(ts + INTERVAL 45 MINUTE, '%Y-%m-%dT%H:%M:%S') || '-00:00</expires><headline>{_TEXTS['headline']}</headline><description>{_TEXTS['description']}</description><instruction>{_TEXTS['instruction']}</instruction><area><areaDesc>'
 || source || ' sector perimeter</areaDesc><polygon>' || {" || ' ' || ".join(f"{a} || ',' || {b}" for a, b in _CORNERS)} || '</polygon></area></info></alert>' AS cap FROM q""")
add("sigmoid_logit", lambda s, d: B.cells(s, d).select("event_id", F.round(scalar.sigmoid((F.col("v") - 100.0) / 30.0), 6).alias("p"), F.round(scalar.logit(F.col("prob")), 5).alias("z")), f"WITH {B.CELLS} SELECT event_id, round(1.0e0 / (1.0e0 + exp(-((v - 100.0e0) / 30.0e0))), 6) AS p, round(ln(least(greatest(prob, 1e-6), 1 - 1e-6) / (1.0e0 - least(greatest(prob, 1e-6), 1 - 1e-6))), 5) AS z FROM c")
add("feels_like", lambda s, d: B.cells(s, d).select("event_id", F.round(scalar.feels_like(F.col("v") / 12.0, F.lit(60.0), F.col("row") * 1.0), 6).alias("t"), scalar.compass(F.col("row") * 5.625).alias("wind")),
    f"WITH {B.CELLS}, a AS (SELECT event_id, v / 12.0e0 AS t, row FROM c) SELECT event_id, round(greatest(t - 1.0e0, least(t + 5.5e0, round_even(t + (0.33e0 * (60.0e0 / 100.0e0 * 6.105e0 * exp(17.27e0 * t / (237.7e0 + t))) - 0.7e0 * (row / 3.6e0) - 4.0e0), 1))), 6) AS t, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[CAST(round_even(row * 5.625e0 / 22.5e0, 0) AS INTEGER) % 16 + 1] AS wind FROM a")
