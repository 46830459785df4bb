"""How the operators meet the tables at hand: one projection of `events`, `lineitem` and `supplier` onto storm data, said
once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.operators import grid

FRAME_US = 300_000_000
#: Added before scores are rounded that often lie in the middle between two rounded values, where engines may go to either.
OFF_TIES = 1.234567e-8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, day, frame (5 minutes), row, col, kind, v, strike, prob."""
    e = table(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("ts"), F.col("ts").cast("date").alias("day"), F.floor(F.unix_micros(t) / FRAME_US).cast("long").alias("frame"), (F.col("user_id") % 64).cast("int").alias("row"), (k % 64).cast("int").alias("col"), F.col("event_type").alias("kind"), F.col("value").alias("v"), (F.col("event_type") == "error").alias("strike"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob"))


CELLS = """c AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CAST(epoch_us(ts) // 300000000 AS BIGINT) AS frame, CAST(user_id % 64 AS INTEGER) AS row,
 CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 64 AS INTEGER) AS col, event_type AS kind, value AS v, event_type = 'error' AS strike,
 least(value / 100.0e0, 1.0e0) AS prob FROM events)"""


def day_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `day_grid`, the pixels that have an event."""
    return _graded(_day_cells(spark, sf_dir))


def day_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense 64 x 64 grid a day: z (dBZ-like, largest value over 7.3), strikes, p (least of largest value over 100 and 1)."""
    return _graded(grid.dense(_day_cells(spark, sf_dir), ["day"]))


def _day_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("day", "row", "col").agg((F.max("v") / 7.3).alias("z"), F.count_if(F.col("strike")).alias("strikes"), F.max("prob").alias("p"))


def _graded(d: DataFrame) -> DataFrame:
    return d.select("day", "row", "col", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("strikes", F.lit(0)).alias("strikes"), F.coalesce("p", F.lit(0.0)).alias("p"), (F.coalesce("strikes", F.lit(0)) >= 1).cast("double").alias("lit"))


GRID = CELLS + """, g0 AS (SELECT day, row, col, max(v) / 7.3e0 AS z, CAST(count(*) FILTER (WHERE strike) AS BIGINT) AS strikes, max(prob) AS p FROM c GROUP BY day, row, col),
g AS (SELECT k.day, CAST(r.i AS INTEGER) AS row, CAST(q.i AS INTEGER) AS col, coalesce(z, 0.0e0) AS z, coalesce(strikes, 0) AS strikes, coalesce(p, 0.0e0) AS p,
 CASE WHEN coalesce(strikes, 0) >= 1 THEN 1.0e0 ELSE 0.0e0 END AS lit
 FROM (SELECT DISTINCT day FROM c) k, range(64) r(i), range(64) q(i) LEFT JOIN g0 ON g0.day = k.day AND g0.row = r.i AND g0.col = q.i)"""


def sql_box_max(src: str, value: str, r: int, out: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, max({value}) OVER (PARTITION BY day, row ORDER BY col RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS m_ FROM {src}),
{name} AS (SELECT * EXCLUDE (m_), max(m_) OVER (PARTITION BY day, col ORDER BY row RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {out} FROM {name}0)"""


def sql_box_mean(src: str, value: str, r: int, out: str, name: str) -> str:
    def one(x: str, to: str, fixed: str, moving: str) -> str:
        full = f"OVER (PARTITION BY day, {fixed} ORDER BY {moving} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"(sum({x}) OVER (PARTITION BY day, {fixed} ORDER BY {moving} RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) + greatest(0, {r} - {moving}) * first_value({x}) {full} + greatest(0, {moving} + {r} - 63) * last_value({x}) {full}) / {2 * r + 1} AS {to}"

    return f"""{name}0 AS (SELECT *, {one(value, 'm_', 'row', 'col')} FROM {src}),
{name} AS (SELECT * EXCLUDE (m_), {one('m_', out, 'col', 'row')} FROM {name}0)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (8.0 + (s % 29) * 1.0).alias("lat"), (68.0 + (s * 7 % 28) * 1.0).alias("lon"))


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of `events` as strikes over the stations' area."""
    c = cells(spark, sf_dir).where("strike")
    return c.select("event_id", "ts", (8.0 + F.col("row") * 0.4375 + (F.col("event_id") % 100) * 0.004).alias("lat"), (68.0 + F.col("col") * 0.4375 + (F.col("event_id") % 97) * 0.004).alias("lon"), F.when(F.col("event_id") % 3 == 0, "IC").otherwise("CG").alias("stroke_type"), F.when(F.col("event_id") % 2 == 0, "IITM_LLN").otherwise("WWLLN").alias("source"))


STATIONS = CELLS + """, st AS (SELECT s_suppkey, 8.0e0 + (s_suppkey % 29) * 1.0e0 AS lat, 68.0e0 + (s_suppkey * 7 % 28) * 1.0e0 AS lon FROM supplier),
k AS (SELECT event_id, ts, 8.0e0 + row * 0.4375e0 + (event_id % 100) * 0.004e0 AS lat, 68.0e0 + col * 0.4375e0 + (event_id % 97) * 0.004e0 AS lon,
 CASE WHEN event_id % 3 = 0 THEN 'IC' ELSE 'CG' END AS stroke_type, CASE WHEN event_id % 2 = 0 THEN 'IITM_LLN' ELSE 'WWLLN' END AS source FROM c WHERE strike)"""


def sql_moved(src: str, field: str, decay: float, name: str, dy: str, dx: str) -> str:
    """Of src (day, row, col, field, what dy and dx name), a grid a day: carried on, widened and faded, as table `name` (day,
    lead, row, col, prob). Needs a table ld (lead, rad)."""
    corner = lambda i, j: f"SELECT day, lead, row + fy + {i} AS row, col + fx + {j} AS col, {field} * {'ay' if i else '(1 - ay)'} * {'ax' if j else '(1 - ax)'} AS w FROM {name}0 WHERE {field} <> 0"

    def mean(x: str, f: str, m: str) -> str:
        part = f"PARTITION BY day, lead, {f} ORDER BY {m}"
        whole = f"OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"(sum({x}) OVER ({part} RANGE BETWEEN rad PRECEDING AND rad FOLLOWING) + greatest(0, rad - {m}) * first_value({x}) {whole} + greatest(0, {m} + rad - 63) * last_value({x}) {whole}) / (2 * rad + 1)"

    return f"""{name}0 AS (SELECT s.day, s.row, s.col, s.{field}, ld.lead, ld.rad, CAST(floor({dy} * lead) AS INTEGER) AS fy, CAST(floor({dx} * lead) AS INTEGER) AS fx,
 {dy} * lead - floor({dy} * lead) AS ay, {dx} * lead - floor({dx} * lead) AS ax FROM {src} s, ld),
{name}1 AS (SELECT x.day, x.lead, x.rad, x.row, x.col, coalesce(w, 0.0e0) AS w FROM {name}0 x LEFT JOIN (SELECT day, lead, row, col, sum(w) AS w FROM ({' UNION ALL '.join(corner(i, j) for i in (0, 1) for j in (0, 1))}) GROUP BY ALL) y USING (day, lead, row, col)),
{name}2 AS (SELECT day, lead, rad, row, col, {mean('w', 'row', 'col')} AS w FROM {name}1),
{name} AS (SELECT day, lead, row, col, least(greatest({mean('w', 'col', 'row')} * pow({decay}e0, lead), 0.0e0), 1.0e0) AS prob FROM {name}2)"""


LEADS = "ld AS (SELECT CAST(i AS INTEGER) AS lead, CAST(round_even(sqrt(i), 0) AS INTEGER) AS rad FROM range(1, 13) x(i))"
