"""Queries of held scans, flash lists by frame edges, polar volumes, motion compensation and the fitted blend."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import geo
from stormgrid.operators import asof, blend, cells, flow, forecast, lagrangian, qc, splits
from stormgrid.plans import base as B
from stormgrid.plans import evaluation as PE
from stormgrid.plans import live
from stormgrid.sources import flashes, polar

QUERIES, ORACLES = {}, {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


# as-of by slices: the same questions as asof_hold and asof_linear, and scans of four sensors onto the five-minute clock


def _sliced(s, d, linear=False):
    t, src = live._targets(s, d)
    return asof.sliced(t, src, ["row"], "ts", "v", 21_600.0, 43_200.0, linear).select("event_id", F.round("v", 6).alias("v"), F.round("age_s", 3).alias("age_s"))


add("asof_sliced", _sliced, live.ORACLES["asof_hold"])
add("asof_sliced_linear", lambda s, d: _sliced(s, d, True), live.ORACLES["asof_linear"])


def imager_hold(s, d):
    """Views of a sensor in a second are a scan; scans are held for at most 20 minutes."""
    c = B.table(s, d, "events").select((F.col("user_id") % 4).alias("sensor"), "ts", "event_type", "value", (F.col("user_id") % 64).cast("int").alias("row"), (F.get_json_object("props", "$.k").cast("long") % 64).cast("int").alias("col"))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = c.groupBy("sensor").agg(F.floor(F.min(t) / B.FRAME_US).alias("a"), F.floor(F.max(t) / B.FRAME_US).alias("b"))
    frames = span.select("sensor", F.explode(F.sequence("a", "b")).alias("frame")).withColumn("at", F.timestamp_micros(F.col("frame") * B.FRAME_US))
    v = c.where("event_type = 'view'").withColumn("at", F.col("ts").cast("timestamp"))
    planes = v.groupBy("sensor", F.col("at").alias("scan_time"), "row", "col").agg(F.max("value").alias("count"))
    held = asof.held_planes(frames, v.select("sensor", "at").distinct(), planes, ["sensor"], "at")
    return held.select("sensor", (F.unix_micros("at") / B.FRAME_US).cast("long").alias("frame"), "row", "col", "count", F.round("age_s", 3).alias("age_s"))


add("imager_hold", imager_hold, """WITH e AS (SELECT user_id % 4 AS sensor, ts, event_type, value, CAST(user_id % 64 AS INTEGER) AS row, CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 64 AS INTEGER) AS col FROM events),
f AS (SELECT sensor, unnest(range(min(epoch_us(ts)) // 300000000, max(epoch_us(ts)) // 300000000 + 1)) AS frame FROM e GROUP BY sensor),
t AS (SELECT sensor, frame, make_timestamp(frame * 300000000) AS ts FROM f),
s AS (SELECT DISTINCT sensor, ts FROM e WHERE event_type = 'view'),
p AS (SELECT sensor, ts, row, col, max(value) AS count FROM e WHERE event_type = 'view' GROUP BY ALL),
a AS (SELECT t.sensor, t.frame, s.ts AS scan, (epoch_us(t.ts) - epoch_us(s.ts)) / 1e6 AS age FROM t ASOF JOIN s ON t.sensor = s.sensor AND t.ts >= s.ts)
SELECT a.sensor, CAST(frame AS BIGINT) AS frame, row, col, count, round(age, 3) AS age_s FROM a JOIN p ON p.sensor = a.sensor AND p.ts = a.scan WHERE age <= 1200""")

# flash lists: an event a day, 49 uneven frames of a quarter of the day; two days of three have pixel columns
EDGES = [-7200.0 + 300 * k + (k * k % 7) * 20 for k in range(49)]


def _flashes(s, d):
    e = B.strikes(s, d).join(B.table(s, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "event_id")
    e = e.withColumn("day", F.to_date("ts"))
    far = F.when(F.day("day") % 3 == 0, 1000.0).otherwise(1.0)
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) % 21_600 - 7200
    return e.select("day", t.cast("double").alias("t"), "lat", "lon", ((F.col("user_id") % 48) * far).alias("x"), ((F.col("k") % 48) * far).alias("y"))


def _events(s, d):
    return B.cells(s, d).select("day").distinct().selectExpr("day", "8.0D AS llat", "68.0D AS llon", "36.0D AS ulat", "96.0D AS ulon")


_FLASH = B.STATIONS + f""", e AS (SELECT CAST(k.ts AS DATE) AS day, CAST((epoch_us(k.ts) // 1000000) % 21600 - 7200 AS DOUBLE) AS t, lat, lon, user_id % 48 AS x, CAST(json_extract(props, '$.k') AS BIGINT) % 48 AS y FROM k JOIN events USING (event_id)),
ed AS (SELECT unnest([{', '.join(f'{x}e0' for x in EDGES)}]) AS edge),
fr AS (SELECT day, (SELECT count(*) FROM ed WHERE edge <= t) - 1 AS frame, CASE WHEN day(day) % 3 = 0 THEN (36.0e0 - lat) / 28.0e0 * 48 ELSE y END AS r, CASE WHEN day(day) % 3 = 0 THEN (lon - 68.0e0) / 28.0e0 * 48 ELSE x END AS q FROM e),
fg AS (SELECT day, CAST(frame AS INTEGER) AS frame, CAST(round_even(r, 0) AS INTEGER) AS row, CAST(round_even(q, 0) AS INTEGER) AS col, count(*) AS flashes FROM fr WHERE frame >= 0 AND round_even(r, 0) BETWEEN 0 AND 47 AND round_even(q, 0) BETWEEN 0 AND 47 GROUP BY ALL)"""
add("flash_edges", lambda s, d: flashes.flash_grid(_flashes(s, d), _events(s, d), "day", EDGES), f"WITH {_FLASH} SELECT * FROM fg")
add("flash_counts", lambda s, d: flashes.flash_counts(_events(s, d), flashes.flash_grid(_flashes(s, d).where(F.day("day") % 5 != 0), _events(s, d), "day", EDGES), "day"),
    f"WITH {_FLASH} SELECT x.day, coalesce(sum(flashes), 0)::BIGINT AS flashes, count(fg.day) AS struck FROM (SELECT DISTINCT day FROM c) x LEFT JOIN fg ON fg.day = x.day AND day(x.day) % 5 <> 0 GROUP BY x.day")

# a volume a return flag: seven sweeps by line number, azimuths and gates by part and supplier


def _volume(s, d):
    e = 0.5 + (F.col("l_linenumber") - 1) * 3.0
    v = B.table(s, d, "lineitem").select(F.col("l_returnflag").alias("volume"), e.alias("elev"), (F.col("l_partkey") % 180 * 2.0 + 0.5).alias("az"), ((F.col("l_suppkey") % 110 + 1) * 0.75).alias("rng"), F.col("l_quantity").alias("dbz"))
    return v.groupBy("volume", "elev", "az", "rng").agg(F.max("dbz").alias("dbz"))


def _levels(method):
    cols = ("dbz_at", "echo_top", "column_max", "lowest")
    return lambda s, d: polar.to_levels(_volume(s, d), method=method).select("volume", "row", "col", *(F.round(c, 6).alias(c) for c in cols), "reason", "lower_bound")


def _levels_sql(method: str) -> str:
    r = geo.EARTH_KM * geo.EARTH_FACTOR
    value = "max(CASE WHEN na = 1 AND near THEN dbz END)" if method == "nearest" else "round(sum(dbz / greatest(sqrt(pow(radians(daz) * greatest(rp, 1e-3), 2) + pow(g.rng - rp, 2)), 1e-3)) FILTER (WHERE na <= 2) / sum(1.0e0 / greatest(sqrt(pow(radians(daz) * greatest(rp, 1e-3), 2) + pow(g.rng - rp, 2)), 1e-3)) FILTER (WHERE na <= 2), 6)"
    return f"""WITH v AS (SELECT l_returnflag AS volume, 0.5e0 + (l_linenumber - 1) * 3.0e0 AS elev, l_partkey % 180 * 2.0e0 + 0.5e0 AS az, (l_suppkey % 110 + 1) * 0.75e0 AS rng, max(l_quantity) AS dbz FROM lineitem GROUP BY ALL),
px AS (SELECT CAST(a.i AS INTEGER) AS row, CAST(b.i AS INTEGER) AS col, sqrt(pow((b.i - 31.5e0) * 2, 2) + pow((31.5e0 - a.i) * 2, 2)) AS rp, (degrees(atan2((b.i - 31.5e0) * 2, (31.5e0 - a.i) * 2)) + 360.0e0) % 360.0e0 AS ap FROM range(64) a(i), range(64) b(i)),
az AS (SELECT volume, elev, row, col, rp, az, daz, row_number() OVER (PARTITION BY volume, elev, row, col ORDER BY daz, az) AS na FROM (SELECT volume, elev, row, col, rp, az, abs((az - ap + 180.0e0 + 360.0e0) % 360.0e0 - 180.0e0) AS daz FROM (SELECT DISTINCT volume, elev, az FROM v), px) QUALIFY na <= 2),
rg AS (SELECT volume, elev, row, col, rp, l, greatest(len(list_filter(l, lambda x: x < rp)), 1) AS i0 FROM (SELECT volume, elev, list(rng ORDER BY rng) AS l FROM (SELECT DISTINCT volume, elev, rng FROM v) GROUP BY ALL), px),
r2 AS (SELECT volume, elev, row, col, l[i0] AS r0, l[least(i0 + 1, len(l))] AS r1, rp >= l[1] - (l[2] - l[1]) AND rp <= l[-1] AS inside FROM rg),
g AS (SELECT az.volume, az.elev, az.row, az.col, rp, na, daz, u.rng, u.rng = CASE WHEN abs(r1 - rp) < abs(r0 - rp) THEN r1 ELSE r0 END AS near FROM az JOIN r2 USING (volume, elev, row, col), LATERAL (SELECT unnest([r0, r1]) AS rng) u WHERE inside),
h AS (SELECT g.volume, g.elev, row, col, {value} AS z FROM g JOIN v ON v.volume = g.volume AND v.elev = g.elev AND v.az = g.az_ AND v.rng = g.rng GROUP BY ALL),
a AS (SELECT r2.volume, r2.elev, r2.row, r2.col, sqrt(px.rp * px.rp + {r}e0 * {r}e0 + 2.0e0 * px.rp * {r}e0 * sin(radians(r2.elev))) - {r}e0 AS h, z FROM r2 JOIN px USING (row, col) LEFT JOIN h USING (volume, elev, row, col)),
b AS (SELECT *, lead(h) OVER w AS h2, lead(z) OVER w AS z2 FROM a WINDOW w AS (PARTITION BY volume, row, col ORDER BY elev)),
o AS (SELECT volume, row, col, max(CASE WHEN h <= 6.5 AND h2 > 6.5 THEN (1.0e0 - (6.5e0 - h) / greatest(h2 - h, 1e-6)) * z + (6.5e0 - h) / greatest(h2 - h, 1e-6) * z2 END) AS dbz_at, count(*) FILTER (WHERE h <= 6.5) AS u, count(*) AS n,
 arg_max(h + CASE WHEN z2 IS NOT NULL AND z > z2 THEN (z - 18.0e0) / greatest(z - z2, 1e-6) * (h2 - h) ELSE 0.0e0 END, elev) FILTER (WHERE z >= 18) AS echo_top, coalesce(arg_max(h2 IS NULL, elev) FILTER (WHERE z >= 18), false) AS lower_bound, max(z) AS column_max, arg_min_null(z, elev) AS lowest FROM b GROUP BY ALL)
SELECT volume, row, col, round(dbz_at, 6) AS dbz_at, round(echo_top, 6) AS echo_top, round(column_max, 6) AS column_max, round(lowest, 6) AS lowest,
 CASE WHEN u = 0 THEN 1 WHEN u = n THEN 2 WHEN dbz_at IS NULL THEN 3 ELSE 0 END AS reason, lower_bound FROM o""".replace("daz, u.rng, u.rng =", "daz, az.az AS az_, u.rng, u.rng =")


for _m in ("nearest", "idw"):
    add(f"polar_{_m}", _levels(_m), _levels_sql(_m))

# motion compensation: afternoon strikes by hour, a motion a day


def _positives(s, d):
    c = B.cells(s, d).where("strike").withColumn("lead", F.hour("ts") - 11).where("lead BETWEEN 1 AND 12")
    return c.select("day", "lead", "row", "col").distinct()


def _motion(s, d):
    return B.cells(s, d).select("day").distinct().select("day", ((F.day("day") % 5 - 2) * 0.75).alias("dy"), ((F.day("day") % 7 - 3) * 0.6).alias("dx"))


def _warp_sql(src: str, sign: str, name: str) -> str:
    """(day, lead, row, col, w) of src (day, lead, row, col), moved by sign times motion times lead."""
    corner = lambda i, j: f"SELECT day, lead, row + fy + {i} AS row, col + fx + {j} AS col, {'ay' if i else '(1 - ay)'} * {'ax' if j else '(1 - ax)'} AS w FROM {name}_f"
    return f"""{name}_m AS (SELECT s.day, lead, row, col, {sign}dy * lead AS my, {sign}dx * lead AS mx FROM {src} s JOIN mo USING (day)),
{name}_f AS (SELECT day, lead, row, col, CAST(floor(my) AS INTEGER) AS fy, CAST(floor(mx) AS INTEGER) AS fx, my - floor(my) AS ay, mx - floor(mx) AS ax FROM {name}_m),
{name} AS (SELECT day, lead, row, col FROM ({' UNION ALL '.join(corner(i, j) for i in (0, 1) for j in (0, 1))}) WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 GROUP BY ALL HAVING round(sum(w), 9) >= 0.5)"""


add("lagrangian_coverage", lambda s, d: lagrangian.coverage(_positives(s, d), _motion(s, d), ["day"]), f"""WITH {B.CELLS}, mo AS (SELECT DISTINCT day, (day(day) % 5 - 2) * 0.75e0 AS dy, (day(day) % 7 - 3) * 0.6e0 AS dx FROM c),
po AS (SELECT DISTINCT day, CAST(hour(ts) - 11 AS INTEGER) AS lead, row, col FROM c WHERE strike AND hour(ts) >= 12),
al AS (SELECT day, CAST(l.i AS INTEGER) AS lead, CAST(r.i AS INTEGER) AS row, CAST(q.i AS INTEGER) AS col FROM mo, range(1, 13) l(i), range(64) r(i), range(64) q(i)),
{_warp_sql('po', '-', 'p1')}, {_warp_sql('p1', '', 'p2')}, {_warp_sql('al', '-', 'a1')}, {_warp_sql('a1', '', 'a2')},
n AS (SELECT lead, count(*) AS n, count(p2.day) AS back FROM po LEFT JOIN p2 USING (day, lead, row, col) GROUP BY lead), g AS (SELECT lead, count(*) AS px FROM a2 GROUP BY lead),
t AS (SELECT CAST(l.i AS INTEGER) AS lead, coalesce(n, 0) AS n, coalesce(back, 0) AS back, coalesce(px, 0) AS px, (SELECT count(*) FROM mo) * 4096 AS al FROM range(1, 13) l(i) LEFT JOIN n ON n.lead = l.i LEFT JOIN g ON g.lead = l.i)
SELECT lead, CAST(sum(n) AS BIGINT) AS n_positive, round(CAST(sum(back) AS DOUBLE) / nullif(sum(n), 0), 6) AS recoverable_frac, round(CAST(sum(px) AS DOUBLE) / sum(al), 6) AS grid_coverage_frac FROM t GROUP BY ROLLUP (lead)""")

# the blend, fitted on the validation days


def _pairs(s, d):
    f = PE.forecasts(s, d).where("model IN ('advection', 'hybrid')").join(splits.split_events(B.cells(s, d), "day", "chronological").where("split = 'val'"), "day")
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("p")))
    return f.groupBy("day", "lead", "row", "col").agg(of("advection").alias("adv"), of("hybrid").alias("net"), F.max("lit").alias("lit"))


_PAIRS = f"""WITH {PE._F}, {PE._SPLIT}, pr AS (SELECT day, lead, row, col, max(p) FILTER (WHERE model = 'advection') AS adv, max(p) FILTER (WHERE model = 'hybrid') AS net, max(CAST(o AS DOUBLE)) AS lit FROM fc JOIN sp USING (day) WHERE split = 'val' GROUP BY ALL),
wg AS (SELECT lead, i / 20.0e0 AS weight, round(avg((adv - net) * (adv - net)) * (i / 20.0e0) * (i / 20.0e0) + 2 * avg((adv - net) * (net - lit)) * (i / 20.0e0) + avg((net - lit) * (net - lit)), 9) AS b FROM pr, range(21) x(i) GROUP BY lead, i),
wr AS (SELECT lead, arg_min(weight, (b, weight)) AS raw FROM wg GROUP BY lead),
wt AS (SELECT lead, raw AS weight_raw, (coalesce(lag(raw) OVER (ORDER BY lead), raw) + raw + coalesce(lead(raw) OVER (ORDER BY lead), raw)) / 3.0e0 AS weight FROM wr)"""


def blend_fit(s, d):
    return blend.weights(_pairs(s, d), "lead", "adv", "net", "lit").select("lead", "weight_raw", F.round("weight", 6).alias("weight"), F.round("slope", 6).alias("slope"))


add("blend_fit", blend_fit, f"{_PAIRS} SELECT lead, weight_raw, round(weight, 6) AS weight, (SELECT round(regr_slope(weight, lead), 6) FROM wt) AS slope FROM wt")


def blend_calibration(s, d):
    p = _pairs(s, d)
    return blend.calibration(p, blend.weights(p, "lead", "adv", "net", "lit"), "lead", "adv", "net", "lit")


add("blend_calibration", blend_calibration, f"""{_PAIRS}, mx AS (SELECT lit, least(greatest(weight * adv + (1.0e0 - weight) * net, 0.0e0), 1.0e0) AS mix FROM pr JOIN wt USING (lead)),
z AS (SELECT lit, mix, ln(least(greatest(mix, 1e-6), 1.0e0 - 1e-6) / (1.0e0 - least(greatest(mix, 1e-6), 1.0e0 - 1e-6))) AS z FROM mx),
ca AS (SELECT unnest([{', '.join(f'{a}e0' for a in blend.SLOPES)}]) AS a), cb AS (SELECT unnest([{', '.join(f'{b}e0' for b in blend.OFFSETS)}]) AS b),
k AS (SELECT a, b, 0 AS i, round(avg(pow(1.0e0 / (1.0e0 + exp(-(a * z + b))) - lit, 2)), 9) AS br FROM z, ca, cb GROUP BY a, b UNION ALL SELECT 1.0e0, 0.0e0, -1, round(avg(pow(mix - lit, 2)), 9) FROM z)
SELECT arg_min(a, (br, i, a, b)) AS cal_a, arg_min(b, (br, i, a, b)) AS cal_b, max(br) FILTER (WHERE i = -1) AS brier_uncalibrated, min(br) AS brier_calibrated FROM k""")

# cells by tiles, and motion of each day's reflectivity from the day before, by quarter of the grid

add("cells_tiled", lambda s, d: cells.detect(B.day_grid(s, d), ["day"], "z", "strikes", 5.0), f"""WITH RECURSIVE {B.GRID},
p AS (SELECT day, row, col, z, strikes, row * 64 + col AS id FROM g WHERE z >= 5.0),
e AS (SELECT a.day, a.id AS a, b.id AS b FROM p a JOIN p b ON a.day = b.day AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
r(day, id, low) AS (SELECT day, id, id FROM p UNION SELECT e.day, e.b, r.low FROM r JOIN e ON e.day = r.day AND e.a = r.id WHERE r.low < e.b),
l AS (SELECT day, id, min(low) AS label FROM r GROUP BY ALL),
c1 AS (SELECT day, label, count(*) AS n, min(row) AS row_min, max(row) + 1 AS row_max, min(col) AS col_min, max(col) + 1 AS col_max, round_even(avg(row), 1) AS centroid_row, round_even(avg(col), 1) AS centroid_col,
 CAST(4 * count(*) AS INTEGER) AS area_km2, round_even(max(z), 1) AS max_dbz, round_even(avg(z), 1) AS mean_dbz, count(*) FILTER (WHERE strikes >= 1) AS strikes, max(z) AS top FROM p JOIN l USING (day, id) GROUP BY ALL)
SELECT day, CAST(row_number() OVER (PARTITION BY day ORDER BY label) AS INTEGER) AS cell, CAST(row_number() OVER (PARTITION BY day ORDER BY max_dbz DESC, label) AS INTEGER) AS rank, row_min, row_max, col_min, col_max,
 centroid_row, centroid_col, area_km2, max_dbz, mean_dbz, strikes, CASE WHEN top >= 45 THEN 'CRITICAL' WHEN top >= 35 THEN 'SEVERE' ELSE 'CONVECTIVE' END AS severity FROM c1 WHERE n >= 4""")


def _days(s, d):
    g = B.day_grid(s, d)
    return g.select((F.unix_date("day") % 2).alias("parity"), F.floor(F.unix_date("day") / 2).cast("int").alias("frame"), "row", "col", "z")


_T = "sum({x}) OVER (PARTITION BY parity, frame, {f} ORDER BY {m} RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) + greatest(0, 7 - {m}) * first_value({x}) OVER ({w}) + greatest(0, {m} - 56) * last_value({x}) OVER ({w})"
_tt = lambda x, f, m: _T.format(x=x, f=f, m=m, w=f"PARTITION BY parity, frame, {f} ORDER BY {m} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
_K = ("tyy", "txx", "txy", "tyt", "txt")
add("flow_regions", lambda s, d: flow.motion(_days(s, d), ["parity"], "frame", "z", region=16).select("parity", "region_row", "region_col", F.round("dy", 5).alias("dy"), F.round("dx", 5).alias("dx")), f"""WITH {B.GRID},
s0 AS (SELECT CAST((day - DATE '1970-01-01') % 2 AS INTEGER) AS parity, CAST((day - DATE '1970-01-01') // 2 AS INTEGER) AS frame, row, col, z AS b FROM g),
s1 AS (SELECT *, lag(b) OVER w AS a, lag(frame) OVER w AS was FROM s0 WINDOW w AS (PARTITION BY parity, row, col ORDER BY frame)),
s2 AS (SELECT parity, frame, row, col, b, (a + b) / 2.0e0 AS m, b - a AS dt FROM s1 WHERE was = frame - 1),
s3 AS (SELECT *, (coalesce(lead(m) OVER v, m) - coalesce(lag(m) OVER v, m)) / 2.0e0 AS y, (coalesce(lead(m) OVER h, m) - coalesce(lag(m) OVER h, m)) / 2.0e0 AS x FROM s2 WINDOW v AS (PARTITION BY parity, frame, col ORDER BY row), h AS (PARTITION BY parity, frame, row ORDER BY col)),
s4 AS (SELECT parity, frame, row, col, b, y * y AS tyy, x * x AS txx, x * y AS txy, y * dt AS tyt, x * dt AS txt FROM s3),
s5 AS (SELECT parity, frame, row, col, b, {', '.join(f'{_tt(k, "row", "col")} AS {k}' for k in _K)} FROM s4),
s6 AS (SELECT parity, frame, row, col, greatest(b - 15.0e0, 0.0e0) AS w, {', '.join(f'round({_tt(k, "col", "row")}, 9) AS {k}' for k in _K)} FROM s5),
s7 AS (SELECT *, tyy * txx - txy * txy AS det FROM s6), s8 AS (SELECT parity, frame, row // 16 AS region_row, col // 16 AS region_col, w, (txy * txt - txx * tyt) / det AS dy, (txy * tyt - tyy * txt) / det AS dx FROM s7 WHERE w > 0 AND det > 1e-3 * (tyy + txx) * (tyy + txx)),
s9 AS (SELECT parity, region_row, region_col, sum(w * dy) / sum(w) AS dy, sum(w * dx) / sum(w) AS dx FROM s8 GROUP BY parity, region_row, region_col, frame)
SELECT parity, CAST(region_row AS INTEGER) AS region_row, CAST(region_col AS INTEGER) AS region_col, round(quantile_cont(dy, 0.5), 5) AS dy, round(quantile_cont(dx, 0.5), 5) AS dx FROM s9 GROUP BY ALL""")

# all baselines by one call: scores of each over the days after the training days

MOVE = (0.6, -0.45)
_MOVE = [f"({x}e0)" for x in MOVE]


def all_baselines(s, d):
    g = B.day_grid(s, d).join(splits.split_events(B.cells(s, d), "day", "chronological"), "day")
    base = forecast.base_rate(g.where("split = 'train'"), F.col("lit")).first()["base_rate"]  # one number
    test = g.where("split = 'test'").select("day", "row", "col", "lit", (F.col("z") * 2.0).alias("m10"))
    p = forecast.run_all(test, ["day"], "lit", "m10", F.lit(MOVE[0]), F.lit(MOVE[1]), base)
    return p.groupBy("model", "lead").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.round(F.max("prob"), 6).alias("max_prob"), F.count_if(F.round("prob", 9) >= 0.15).alias("over"))


add("all_baselines", all_baselines, f"""WITH {B.GRID}, {PE._SPLIT}, te AS (SELECT g.day, row, col, lit, z * 2.0e0 AS m10 FROM g JOIN sp USING (day) WHERE split = 'test'), ba AS (SELECT coalesce(avg(lit), 0.0e0) AS base FROM g JOIN sp USING (day) WHERE split = 'train'),
{B.LEADS},
{B.sql_box_mean('te', 'lit', 1, 'pe', 'q1')}, t0 AS (SELECT *, CASE WHEN m10 >= 40 THEN 1.0e0 ELSE 0.0e0 END AS dd FROM q1), {B.sql_box_max('t0', 'dd', 2, 'wd', 'q2')}, {B.sql_box_mean('q2', 'wd', 1, 'ru', 'q3')},
{B.sql_moved('q3', 'pe', 0.97, 'ad', *_MOVE)}, {B.sql_moved('q3', 'ru', 0.95, 'cr', *_MOVE)},
u AS (SELECT 'persistence' AS model, lead, pe AS prob FROM q3, ld UNION ALL SELECT 'climatology', lead, base FROM q3, ld, ba UNION ALL SELECT 'advection', lead, prob FROM ad UNION ALL SELECT 'charging_rule', lead, prob FROM cr)
SELECT model, lead, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(max(prob), 6) AS max_prob, count(*) FILTER (WHERE round(prob, 9) >= 0.15) AS over FROM u GROUP BY ALL""")

# quality control and features of a cell table: an event a week, a frame an hour


def _cell_table(s, d):
    c = B.cells(s, d)
    days = F.date_diff("day", F.lit("2024-01-01").cast("date"))
    c = c.groupBy(F.floor(days / 7).cast("int").alias("event_id"), (days * 24 + F.hour("ts")).cast("int").alias("frame"), (F.col("row") % 16).alias("row"), (F.col("col") % 16).alias("col")).agg(F.max("v").alias("v"), F.count_if(F.col("strike")).alias("n"))
    v = F.col("v")
    return c.select("event_id", "frame", "row", "col", (v / 5.0 - 5.0).alias("refl_sfc"), F.when(F.col("col") % 5 != 0, v / 8.0).alias("refl_m10"), (v / 25.0).alias("echo_top"), F.when(F.col("row") == 3, F.lit(float("nan"))).otherwise(v / 6.0).alias("vil"), (320.0 - v / 3.0).alias("ir_tb"), F.col("n").cast("double").alias("light_dens"))


_CELL = B.CELLS + """, ct0 AS (SELECT CAST((day - DATE '2024-01-01') // 7 AS INTEGER) AS event_id, CAST((day - DATE '2024-01-01') * 24 + hour(ts) AS INTEGER) AS frame, row % 16 AS row, col % 16 AS col, max(v) AS v, count(*) FILTER (WHERE strike) AS n FROM c GROUP BY ALL),
ct AS (SELECT event_id, frame, row, col, v / 5.0e0 - 5.0e0 AS refl_sfc, CASE WHEN col % 5 <> 0 THEN v / 8.0e0 END AS refl_m10, v / 25.0e0 AS echo_top, CASE WHEN row = 3 THEN 'nan'::DOUBLE ELSE v / 6.0e0 END AS vil, 320.0e0 - v / 3.0e0 AS ir_tb, CAST(n AS DOUBLE) AS light_dens FROM ct0)"""
_OK = {c: f"CASE WHEN NOT isnan({c}) AND {c} BETWEEN {lo}e0 AND {hi}e0 THEN {c} END" for c, (lo, hi) in S.RANGES.items()}
_GEO = geo.radar_geometry(0.5, 20.0)
add("qc_kill_counts", lambda s, d: qc.kill_counts(_cell_table(s, d), (7.5, 7.5), (0.5, 20.0), 12.0), f"""WITH {_CELL},
a AS (SELECT event_id, frame, row, col, {', '.join(f'{c} AS raw_{c}, {x} AS {c}' for c, x in _OK.items())} FROM ct),
b AS (SELECT *, CASE WHEN count(refl_sfc) OVER (PARTITION BY event_id, row, col) >= 3 THEN stddev_pop(refl_sfc) OVER (PARTITION BY event_id, row, col) END AS sd, sqrt(pow((col - 7.5e0) * 2, 2) + pow((7.5e0 - row) * 2, 2)) AS rng FROM a),
k AS (SELECT *, coalesce(refl_sfc >= 35 AND echo_top <= 1.5 AND sd <= 1.5, false) AS cl FROM b),
e AS (SELECT *, NOT cl AND coalesce(refl_sfc BETWEEN 28 AND 47 AND echo_top BETWEEN 4.0 AND 7.5 AND refl_m10 < 30 AND sd <= 3, false) AS bb, rng > 12 AS far, rng <= 12 AND rng < {_GEO['cone_of_silence_km']!r}e0 AS near FROM k),
s AS (SELECT unnest([{', '.join(f"{{'rule': 'non_finite', 'channel': '{c}', 'masked': count(*) FILTER (WHERE isnan(raw_{c}))}}" for c in S.CHANNELS)}, {', '.join(f"{{'rule': 'range', 'channel': '{c}', 'masked': count(*) FILTER (WHERE NOT isnan(raw_{c}) AND {c} IS NULL)}}" for c in S.CHANNELS)},
 {', '.join(f"{{'rule': 'clutter', 'channel': '{c}', 'masked': count(*) FILTER (WHERE cl AND {c} IS NOT NULL)}}" for c in ('refl_sfc', 'refl_m10', 'echo_top', 'vil'))}, {{'rule': 'bright_band', 'channel': 'refl_sfc', 'masked': count(*) FILTER (WHERE bb)}},
 {', '.join(f"{{'rule': '{r}', 'channel': '{c}', 'masked': count(*) FILTER (WHERE {x} AND NOT cl AND {c} IS NOT NULL)}}" for r, x in (('far', 'far'), ('cone_of_silence', 'near')) for c in ('refl_m10', 'echo_top'))}], recursive := true), generate_subscripts([1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21], 1) AS step FROM e)
SELECT CAST(step AS INTEGER) AS step, rule, channel, masked FROM s""")
add("channel_statistics", lambda s, d: qc.channel_statistics(qc.out_of_range(qc.non_finite(_cell_table(s, d)))), f"WITH {_CELL}, a AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _OK.items())} FROM ct) " + " UNION ALL ".join(f"SELECT '{c}' AS channel, count(*) AS n, count({c}) AS valid, round(CAST(count({c}) AS DOUBLE) / count(*), 6) AS share, min({c}) AS least, max({c}) AS largest, round(avg({c}), 6) AS mean FROM a" for c in S.CHANNELS))
