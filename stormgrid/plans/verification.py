"""Verification and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.functions import scalar
from stormgrid.operators import metrics as M
from stormgrid.plans import base as B

QUERIES, ORACLES = {}, {}


def pred():
    return F.col("prob") >= 0.15


COUNTS = "CAST(count(*) FILTER (WHERE {p} AND {o}) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE {p} AND NOT {o}) AS BIGINT) AS false_alarms, CAST(count(*) FILTER (WHERE NOT {p} AND {o}) AS BIGINT) AS misses, CAST(count(*) FILTER (WHERE NOT {p} AND NOT {o}) AS BIGINT) AS correct_negatives"
SCORES = """x.*, round(h / nullif(h + m, 0), 6) AS pod, round(f / nullif(h + f, 0), 6) AS far, round(h / nullif(h + f + m, 0), 6) AS csi, round((h + f) / nullif(h + m, 0), 6) AS bias,
 round(2.0e0 * (h * cn - f * m) / nullif((h + m) * (m + cn) + (h + f) * (f + cn), 0), 6) AS hss,
 round((h - (h + m) * (h + f) / (h + f + m + cn)) / nullif(h + f + m - (h + m) * (h + f) / (h + f + m + cn), 0), 6) AS ets,
 round((h + m) / nullif(h + f + m + cn, 0), 6) AS obs_rate, round((h + f) / nullif(h + f + m + cn, 0), 6) AS pred_rate"""


def scored(inner: str) -> str:
    return f"SELECT {SCORES} FROM (SELECT *, CAST(hits AS DOUBLE) AS h, CAST(false_alarms AS DOUBLE) AS f, CAST(misses AS DOUBLE) AS m, CAST(correct_negatives AS DOUBLE) AS cn FROM ({inner})) y JOIN ({inner}) x USING ({{k}})"


def _scores_sql(cte: str, select: str, keys: str, group: str) -> str:
    s = SCORES.replace("x.*, ", "")
    names = (keys + ", " if keys else "") + "hits, false_alarms, misses, correct_negatives"
    return f"WITH {cte}, n AS (SELECT {select} {group}), y AS (SELECT *, CAST(hits AS DOUBLE) AS h, CAST(false_alarms AS DOUBLE) AS f, CAST(misses AS DOUBLE) AS m, CAST(correct_negatives AS DOUBLE) AS cn FROM n) SELECT {names}, {s} FROM y"


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


C = COUNTS.format(p="prob >= 0.15e0", o="strike")
add("contingency_overall", lambda s, d: M.contingency(B.cells(s, d), [], pred(), F.col("strike")), _scores_sql(B.CELLS, C + " FROM c", "", ""))
add("contingency_by_type", lambda s, d: M.contingency(B.cells(s, d), ["kind"], pred(), F.col("prob") >= 0.3), _scores_sql(B.CELLS, "kind, " + COUNTS.format(p="prob >= 0.15e0", o="prob >= 0.3e0") + " FROM c", "kind", "GROUP BY kind"))
add("contingency_by_day", lambda s, d: M.contingency(B.cells(s, d), ["day"], pred(), F.col("strike")), _scores_sql(B.CELLS, "day, " + C + " FROM c", "day", "GROUP BY day"))
add("contingency_masked", lambda s, d: M.contingency(B.cells(s, d), ["day"], pred(), F.col("strike"), F.col("row") < 32), _scores_sql(B.CELLS, "day, " + COUNTS.format(p="prob >= 0.15e0", o="strike").replace("WHERE ", "WHERE row < 32 AND ") + " FROM c", "day", "GROUP BY day"))

_T = "(VALUES (0.02e0), (0.05e0), (0.10e0), (0.15e0), (0.20e0), (0.30e0), (0.40e0), (0.50e0), (0.70e0)) t(threshold)"
_SWEEP = _scores_sql(B.CELLS, "threshold, " + COUNTS.format(p="prob >= threshold", o="strike") + f" FROM c, {_T}", "threshold", "GROUP BY threshold")
add("threshold_sweep", lambda s, d: M.threshold_sweep(B.cells(s, d), [], "prob", F.col("strike")), _SWEEP)
add("best_csi", lambda s, d: M.best_csi(M.threshold_sweep(B.cells(s, d), [], "prob", F.col("strike")), []), f"SELECT * FROM ({_SWEEP}) WHERE csi IS NOT NULL ORDER BY csi DESC, threshold LIMIT 1")
add("select_threshold", lambda s, d: M.select_threshold(M.threshold_sweep(B.cells(s, d), [], "prob", F.col("strike"))), f"SELECT coalesce((SELECT threshold FROM ({_SWEEP}) WHERE csi IS NOT NULL ORDER BY csi DESC, threshold LIMIT 1), 0.15e0) AS threshold")

_RANK = """, s AS (SELECT {k} {p} AS p, count(*) FILTER (WHERE {o}) AS pos, count(*) AS n FROM {t} GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER ({part} ORDER BY p DESC) AS tp, sum(n) OVER ({part} ORDER BY p DESC) AS seen, coalesce(sum(n) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT {k} CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS n,
 round(CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN sum(pos * CAST(tp AS DOUBLE) / CAST(seen AS DOUBLE)) / sum(pos) END, 6) AS auprc,
 round(CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN (sum(pos * (below + (n + 1) / 2.0e0)) - sum(pos) * (sum(pos) + 1) / 2.0e0) / (sum(pos) * (sum(n) - sum(pos))) END, 6) AS auroc FROM w {g}"""
add("ranking_overall", lambda s, d: M.ranking(B.cells(s, d), [], "prob", F.col("strike")), f"WITH {B.CELLS}" + _RANK.format(k="", p="prob", o="strike", t="c", part="", g=""))
add("ranking_by_day", lambda s, d: M.ranking(B.cells(s, d), ["day"], "prob", F.col("strike")), f"WITH {B.CELLS}" + _RANK.format(k="day,", p="prob", o="strike", t="c", part="PARTITION BY day", g="GROUP BY day"))


def _labelled(s, d):
    docs = B.table(s, d, "documents").select("doc_id", "n_chars")
    return B.table(s, d, "labels").join(docs, "doc_id").withColumn("prob", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)))


add("ranking_labels", lambda s, d: M.ranking(_labelled(s, d), [], "prob", F.col("quality") == 1), "WITH c AS (SELECT least(n_chars / 5000.0e0, 1.0e0) AS prob, quality FROM labels JOIN documents USING (doc_id))" + _RANK.format(k="", p="prob", o="quality = 1", t="c", part="", g=""))

_BIN = "(" + " + ".join(f"CASE WHEN prob >= {i / 10}e0 THEN 1 ELSE 0 END" for i in range(1, 10)) + ")"
_BINS = f"SELECT {{k}} CAST({_BIN} AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, avg(prob) AS mean_p, avg(CASE WHEN strike THEN 1.0e0 ELSE 0.0e0 END) AS mean_o, sum(pow(prob - CASE WHEN strike THEN 1.0e0 ELSE 0.0e0 END, 2)) AS sq FROM c GROUP BY ALL"
add("brier_bins", lambda s, d: M.brier_bins(B.cells(s, d), [], "prob", F.col("strike")).select("bin", "n", *[F.round(x, 6).alias(x) for x in ("mean_p", "mean_o")], F.round("sq", 4).alias("sq")), f"WITH {B.CELLS} SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_o, 6) AS mean_o, round(sq, 4) AS sq FROM ({_BINS.format(k='')})")
add("brier_decomposition", lambda s, d: M.brier(B.cells(s, d), ["day"], "prob", F.col("strike")), f"""WITH {B.CELLS}, b AS ({_BINS.format(k='day,')}),
o AS (SELECT *, sum(n * mean_o) OVER (PARTITION BY day) / sum(n) OVER (PARTITION BY day) AS base FROM b)
SELECT day, round(sum(sq) / sum(n), 6) AS brier, round(sum(n * pow(mean_p - mean_o, 2)) / sum(n), 6) AS reliability, round(sum(n * pow(mean_o - base, 2)) / sum(n), 6) AS resolution,
 round(max(base) * (1.0e0 - max(base)), 6) AS uncertainty, round(1.0e0 - (sum(sq) / sum(n)) / nullif(max(base) * (1.0e0 - max(base)), 0), 6) AS bss FROM o GROUP BY day""")


def _leads(s, d):
    c = B.cells(s, d).withColumn("lead", ((F.col("frame") % 12) + 1) * 5)
    return c.withColumn("band", scalar.lead_band(F.col("lead")))


_BAND = "CASE WHEN lead BETWEEN 5 AND 15 THEN '5-15' WHEN lead BETWEEN 20 AND 30 THEN '20-30' WHEN lead BETWEEN 35 AND 45 THEN '35-45' WHEN lead BETWEEN 50 AND 60 THEN '50-60' END"
_LEADS = B.CELLS + f", l0 AS (SELECT *, (frame % 12 + 1) * 5 AS lead FROM c), l AS (SELECT *, {_BAND} AS band FROM l0)"
add("lead_bands", lambda s, d: M.scores(_leads(s, d).groupingSets([[F.col("lead"), F.col("band")], [F.col("band")], []], "lead", "band").agg(*M.counts(pred(), F.col("strike")))),
    _scores_sql(_LEADS, "lead, band, " + C + " FROM l", "lead, band", "GROUP BY GROUPING SETS ((lead, band), (band), ())"))
add("lead_stats", lambda s, d: _leads(s, d).groupBy("lead").agg(F.max("prob").alias("max_prob"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.count_if(F.col("prob") >= 0.5).alias("over")), f"WITH {_LEADS} SELECT lead, max(prob) AS max_prob, round(avg(prob), 6) AS mean_prob, CAST(count(*) FILTER (WHERE prob >= 0.5e0) AS BIGINT) AS over FROM l GROUP BY lead")

for _r in (1, 2, 4, 8):
    add(f"fss_r{_r}", lambda s, d, r=_r: M.fss(B.day_grid(s, d), ["day"], "p", "lit", r), f"WITH {B.GRID}, {B.sql_box_mean('g', 'p', _r, 'f', 'a')}, {B.sql_box_mean('a', 'lit', _r, 'o', 'b')} SELECT day, round(1.0e0 - avg((f - o) * (f - o)) / nullif(avg(f * f) + avg(o * o), 0), 6) AS fss FROM b GROUP BY day")
add("neighbourhood_contingency", lambda s, d: M.neighbourhood(B.day_grid(s, d), ["day"], F.col("p") >= 0.5, F.col("strikes") >= 1, 2), f"""WITH {B.GRID}, x AS (SELECT *, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS pp, CASE WHEN strikes >= 1 THEN 1 ELSE 0 END AS qq FROM g), {B.sql_box_max('x', 'pp', 2, 'pn', 'a')}, {B.sql_box_max('a', 'qq', 2, 'qn', 'b')},
n AS (SELECT day, CAST(count(*) FILTER (WHERE pp = 1 AND qn = 1) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE pp = 1 AND qn = 0) AS BIGINT) AS false_alarms, CAST(count(*) FILTER (WHERE qq = 1 AND pn = 0) AS BIGINT) AS misses FROM b GROUP BY day)
SELECT *, round(hits / nullif(CAST(hits + misses AS DOUBLE), 0), 6) AS pod, round(false_alarms / nullif(CAST(hits + false_alarms AS DOUBLE), 0), 6) AS far, round(hits / nullif(CAST(hits + false_alarms + misses AS DOUBLE), 0), 6) AS csi FROM n""")
add("roi_analysis", lambda s, d: M.roi(B.day_grid(s, d), ["day"], "p", "strikes", "z", (8, 40, 16, 56), 0.3), f"""WITH {B.GRID}, n AS (SELECT day, {COUNTS.format(p='p >= 0.3e0', o='strikes >= 1')}, round(max(z), 1) AS max_dbz, round(avg(z), 3) AS mean_dbz, round(quantile_cont(z, 0.95), 3) AS p95_dbz FROM g WHERE row BETWEEN 8 AND 39 AND col BETWEEN 16 AND 55 GROUP BY day),
y AS (SELECT *, CAST(hits AS DOUBLE) AS h, CAST(false_alarms AS DOUBLE) AS f, CAST(misses AS DOUBLE) AS m, CAST(correct_negatives AS DOUBLE) AS cn FROM n),
q AS (SELECT *, (h + f) * (h + m) / greatest(1.0e0, h + f + m + cn) AS ch FROM y)
SELECT day, hits, false_alarms, misses, correct_negatives, max_dbz, mean_dbz, p95_dbz, CAST(5120 AS INTEGER) AS area_km2, round(coalesce(h / nullif(h + f + m, 0), 0.0e0), 4) AS csi,
 round(CASE WHEN h + f + m > 0 AND abs((h + f + m + cn) / 2.0e0 - ch) > 1e-6 THEN (h - ch) / ((h + f + m + cn) / 2.0e0 - ch) ELSE 0.0e0 END, 4) AS roi_hss,
 CASE WHEN hits + misses > 10 OR max_dbz >= 45 THEN 'CRITICAL' WHEN hits + misses > 0 OR max_dbz >= 30 THEN 'WARNING' ELSE 'CLEAR' END AS risk FROM q""")
add("daily_summary", lambda s, d: B.table(s, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), "l_returnflag").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("rain"), F.max("l_extendedprice").alias("gust"), F.max("l_tax").alias("proxy"), F.count_if(F.col("l_linestatus") == "F").alias("storm_hours")),
    "SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS rain, max(l_extendedprice) AS gust, max(l_tax) AS proxy, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS storm_hours FROM lineitem GROUP BY ALL")


def _dataset_stats(s, d):
    c = B.cells(s, d).groupBy("day").agg(F.count_if(F.col("strike")).alias("k"), F.countDistinct("frame").alias("frames"), F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("days"), F.sum("k").alias("strikes"), F.round(F.sum("k") / F.sum("n"), 6).alias("base_rate"), F.round(F.sum("k") / F.sum("frames"), 6).alias("per_frame"), F.round(F.count_if(F.col("k") > 0) / F.count(F.lit(1)), 6).alias("lit_days"))


add("dataset_stats", _dataset_stats, f"WITH {B.CELLS}, a AS (SELECT day, count(*) FILTER (WHERE strike) AS k, count(DISTINCT frame) AS frames, count(*) AS n FROM c GROUP BY day) SELECT CAST(count(*) AS BIGINT) AS days, CAST(sum(k) AS BIGINT) AS strikes, round(CAST(sum(k) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS base_rate, round(CAST(sum(k) AS DOUBLE) / CAST(sum(frames) AS DOUBLE), 6) AS per_frame, round(CAST(count(*) FILTER (WHERE k > 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS lit_days FROM a")
