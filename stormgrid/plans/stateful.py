"""Queries of keyed streaming state over `events`, run as streams to their end, with SQL over the table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormgrid.plans import base as B
from stormgrid.sources import adapters, health
from stormgrid.streaming import state

QUERIES, ORACLES = {}, {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def folder(s: SparkSession, name: str) -> str:
    """A new folder where driver and executors share one."""
    at = s.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="stormgrid-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stream(s: SparkSession, d: str, **options) -> DataFrame:
    """`events` as a stream: a pattern, as a stream takes a plain path for a folder, and the table is a file or a folder."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    e = s.readStream.schema(schema).options(**options).parquet(f"{d}/events.parque[t]")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("kind"))


def _source() -> Column:
    return F.when(F.col("event_id") % 2 == 0, "IITM_LLN").otherwise("WWLLN")


#: How far the watermark comes over a table: the latest row less the delay, in whole milliseconds.
PASSED = "(SELECT (max(epoch_us(ts)) // 1000 - 1800000) * 1000 AS passed FROM {src})"


def _buffer_sql(keys: str, where: str, newest: int, keep_us: int) -> str:
    return f"""WITH e AS (SELECT event_id AS number, ts, epoch_us(ts) AS entered_us, {keys} FROM events WHERE {where}),
a AS (SELECT *, lead(entered_us, {newest}) OVER (PARTITION BY source ORDER BY entered_us, number) AS pushed, entered_us + {keep_us} AS aged FROM e)
SELECT source, number, entered_us, least(pushed, aged) AS left_us, CASE WHEN pushed < aged THEN 'cap' ELSE 'age' END AS reason
FROM a, {PASSED.format(src='e')} WHERE least(pushed, aged) <= passed"""


def strike_buffer(s: SparkSession, d: str) -> DataFrame:
    """Strikes that left their source's buffer: the 10,000 newest of at most 1,800 s."""
    e = stream(s, d).where("kind = 'error'").withColumn("source", _source())
    return state.drained(state.buffer_log(e, ["source"]), folder(s, "buffer"))


def strike_buffer_capped(s: SparkSession, d: str) -> DataFrame:
    """The same of all events by type, with a buffer of the 20 newest of at most 3 hours, so that both limits are met."""
    e = stream(s, d).withColumn("source", F.col("kind"))
    return state.drained(state.buffer_log(e, ["source"], 20, 10_800.0), folder(s, "buffer"))


add("strike_buffer", strike_buffer, _buffer_sql("CASE WHEN event_id % 2 = 0 THEN 'IITM_LLN' ELSE 'WWLLN' END AS source", "event_type = 'error'", state.NEWEST, 1_800_000_000))
add("strike_buffer_capped", strike_buffer_capped, _buffer_sql("event_type AS source", "true", 20, 10_800_000_000))


def source_freshness(s: SparkSession, d: str) -> DataFrame:
    """Each event refreshes its source; rows where a source's state changes."""
    e = stream(s, d).withColumn("source", F.col("user_id") % 8)
    return state.drained(state.freshness_log(e, ["source"]), folder(s, "fresh"))


add("source_freshness", source_freshness, f"""WITH e AS (SELECT user_id % 8 AS source, epoch_us(ts) AS t, ts, event_id FROM events),
g AS (SELECT source, t, t - lag(t) OVER w AS came, lead(t) OVER w - t AS gap FROM e WINDOW w AS (PARTITION BY source ORDER BY t, event_id)),
p AS {PASSED.format(src='e')},
r AS (SELECT source, t AS changed_us, 'LIVE' AS state FROM g WHERE coalesce(came > 300000000, true)
  UNION ALL SELECT source, t + 300000000, 'STALE' FROM g WHERE coalesce(gap > 300000000, true)
  UNION ALL SELECT source, t + 600000000, 'EXPIRED' FROM g WHERE coalesce(gap > 600000000, true))
SELECT source, changed_us, state FROM r, p WHERE changed_us <= passed""")


def alert_states(s: SparkSession, d: str) -> DataFrame:
    """An error raises its zone's alert, a click acknowledges it; rows where a zone's alert changes."""
    e = stream(s, d).withColumn("zone", F.col("user_id") % 32)
    what = F.when(F.col("kind") == "error", "raise").when(F.col("kind") == "click", "ack").otherwise("")
    return state.drained(state.alert_log(e, ["zone"], what), folder(s, "alerts"))


add("alert_states", alert_states, f"""WITH e AS (SELECT user_id % 32 AS zone, epoch_us(ts) AS t, ts, event_type FROM events WHERE event_type IN ('error', 'click')),
g AS (SELECT zone, t, coalesce(t - lag(t) OVER w > 2700000000, true) AS new FROM e WHERE event_type = 'error' WINDOW w AS (PARTITION BY zone ORDER BY t)),
n AS (SELECT zone, t, sum(CAST(new AS INTEGER)) OVER (PARTITION BY zone ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g),
a AS (SELECT zone, k, min(t) AS first_t, max(t) + 2700000000 AS end_t FROM n GROUP BY zone, k),
c AS (SELECT a.zone, a.k, min(e.t) AS ack_us FROM a JOIN e ON e.zone = a.zone AND e.event_type = 'click' AND e.t BETWEEN first_t AND end_t GROUP BY a.zone, a.k),
r AS (SELECT zone, first_t AS changed_us, 'RAISED' AS state FROM a UNION ALL SELECT zone, ack_us, 'ACKNOWLEDGED' FROM c UNION ALL SELECT zone, end_t, 'EXPIRED' FROM a)
SELECT zone, changed_us, state FROM r, {PASSED.format(src='e')} WHERE changed_us <= passed""")


# adapters: three payloads a source, made of its latest events; one source has none, one an empty file, one broken text
NAMES = ["radar", "insat", "lightning", "aws", "nwp", "mosdac_dwr", "imd_dwr"]


def source_adapters(s: SparkSession, d: str) -> DataFrame:
    at = folder(s, "payloads")
    at = at if ":" in at.split("/")[0] else f"file://{at}"
    e = B.table(s, d, "events")
    k = (F.col("user_id") % 7).cast("int")
    nth = F.row_number().over(Window.partitionBy(k).orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    e = e.select(k.alias("k"), "event_type", F.col("event_id"), nth.alias("n")).where("n <= 3 AND k <> 3")
    needs = F.element_at(F.array(*[F.lit(dict((n, x) for n, _, x in health.SOURCES)[n][0]) for n in NAMES]), F.col("k") + 1)
    key = F.when(F.col("event_type").isin("view", "click"), F.lit("other")).otherwise(needs)
    text = F.when(F.col("k") == 4, F.when(F.col("n") == 1, "").otherwise(F.format_string('{"%s":%d}', needs, "event_id"))).when(F.col("k") == 5, F.format_string("no json %07d", "event_id")).otherwise(F.format_string('{"%s":%d}', key, "event_id"))
    source = F.element_at(F.array(*map(F.lit, NAMES)), F.col("k") + 1)
    for n in (3, 2, 1):  # one file each, the newest last by name
        part = e.where(F.col("n") == n).select(source.alias("source"), text.alias("value"))
        part.coalesce(1).write.partitionBy("source").option("lineSep", "\r").text(f"{at}/run{3 - n}")
    _gather(s, at)
    a = adapters.read(s, f"{at}/all")
    return a.select("source", "state", F.size("channels").cast("long").alias("channels"), F.regexp_extract("payload", r":(\d+)", 1).alias("value"), F.col("error").isNotNull().alias("failed"))


def _gather(s: SparkSession, at: str) -> None:
    """Files of the three runs side by side, named by run: as three fetches would leave them."""
    jvm = s.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(at)
    fs = base.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for run in range(3):
        for folder_ in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{at}/run{run}")):
            name = folder_.getPath().getName()
            if not name.startswith("source="):
                continue
            to = jvm.org.apache.hadoop.fs.Path(f"{at}/all/{name}")
            fs.mkdirs(to)
            for f in fs.listStatus(folder_.getPath()):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{at}/all/{name}/fetch{run}.txt"))


_ADAPTERS = ", ".join(f"({k}, '{n}', {len(dict((a, c) for a, c, _ in health.SOURCES)[n])}, '{dict((a, x) for a, _, x in health.SOURCES)[n][0]}')" for k, n in enumerate(NAMES))
add("source_adapters", source_adapters, f"""WITH a AS (SELECT * FROM (VALUES {_ADAPTERS}) v(k, source, channels, need)),
e AS (SELECT CAST(user_id % 7 AS INTEGER) AS k, event_type, event_id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, event_id DESC) AS n FROM events),
f AS (SELECT a.*, e.n, event_id, CASE WHEN a.k = 4 THEN n > 1 WHEN a.k = 5 THEN true ELSE event_type NOT IN ('view', 'click') END AS ok FROM e JOIN a USING (k) WHERE n <= 3 AND k <> 3),
b AS (SELECT k, source, channels, arg_min(n, n) FILTER (WHERE ok) AS n, arg_min(event_id, n) FILTER (WHERE ok) AS id, bool_and(k = 4 AND n = 1) AS empty FROM f GROUP BY ALL)
SELECT a.source, CASE WHEN b.k IS NULL THEN 'NOT_CONFIGURED' WHEN b.n = 1 THEN 'LIVE' WHEN b.n > 1 THEN 'STALE' ELSE 'DEGRADED' END AS state, CAST(a.channels AS BIGINT) AS channels,
 CASE WHEN a.k = 5 THEN '16' ELSE CAST(id AS VARCHAR) END AS value, b.k IS NULL OR coalesce(b.n, 9) > 1 AS failed FROM a LEFT JOIN b USING (k)""")
