"""Queries of whole evaluations: forecasts for the afternoon of each day from its morning, on a coarse grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.operators import evaluation as E
from stormgrid.operators import splits
from stormgrid.plans import base as B

QUERIES, ORACLES = {}, {}
SIDE, LEADS = 16, 12
THRESHOLD = 0.3


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def forecasts(s, d):
    """model, day, lead, row, col, p, lit, fresh, on. A day's morning is a forecast's input, its n-th hour after noon is the
    n-th lead of five minutes. One aggregation over the events; pixels without any come from a list of the grid's."""
    c = B.cells(s, d).select("day", F.hour("ts").alias("hour"), (F.col("row") % SIDE * SIDE + F.col("col") % SIDE).alias("at"), "v", "strike")
    am = F.col("hour") < 12
    lit = [F.count_if(F.col("strike") & (F.col("hour") == 11 + k)) for k in range(1, LEADS + 1)]
    c = c.groupBy("day", "at").agg(F.struct(F.coalesce(F.max(F.when(am, F.col("v"))), F.lit(0.0)).alias("v"), F.count_if(am & F.col("strike")).alias("struck"), F.array(*lit).alias("lit")).alias("x"))
    c = c.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("by"))
    c = c.select("day", "by", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("at")).select("day", "at", F.try_element_at("by", F.col("at")).alias("x"))
    c = c.select("day", (F.floor(F.col("at") / SIDE)).cast("int").alias("row"), (F.col("at") % SIDE).alias("col"), F.coalesce("x.v", F.lit(0.0)).alias("v"), F.coalesce("x.struck", F.lit(0)).alias("struck"), F.posexplode(F.coalesce("x.lit", F.array_repeat(F.lit(0).cast("long"), LEADS))).alias("k", "n"))
    step = (F.col("k") + 1).cast("double")
    p, hot = F.least(F.col("v") / 100.0, F.lit(1.0)), F.col("v") >= 60.0
    models = {"hybrid": 0.6 * p * F.pow(F.lit(0.98), step) + F.when(hot, 0.2).otherwise(0.0), "advection": p * F.pow(F.lit(0.97), step),
              "charging_rule": F.when(hot, 0.6).otherwise(0.5 * p) * F.pow(F.lit(0.95), step), "persistence": F.when(F.col("struck") >= 1, 1.0).otherwise(0.0)}
    m = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.round(x + B.OFF_TIES, 4).alias("p")) for k, x in models.items()]))
    mid = (SIDE - 1) / 2
    on = (F.col("row") - mid) * (F.col("row") - mid) + (F.col("col") - mid) * (F.col("col") - mid) <= 60.0
    return c.select(m.alias("m"), "day", ((F.col("k") + 1) * S.STEP_MIN).cast("int").alias("lead"), "row", "col", (F.col("n") >= 1).cast("double").alias("lit"), (F.col("struck") == 0).alias("fresh"), on.alias("on")).select("m.*", "day", "lead", "row", "col", "lit", "fresh", "on")


def _evaluated(s, d):
    return E.evaluate(forecasts(s, d), ["model"], ["day"], "p", "lit", THRESHOLD, "lead", "on", "fresh", n=SIDE)


_F = B.CELLS + f""", c0 AS (SELECT day, row % {SIDE} AS row, col % {SIDE} AS col, hour(ts) AS h, v, strike FROM c),
c1 AS (SELECT day, row, col, coalesce(max(v) FILTER (WHERE h < 12), 0.0e0) AS v, count(*) FILTER (WHERE h < 12 AND strike) AS struck FROM c0 GROUP BY ALL),
c2 AS (SELECT day, row, col, h - 11 AS k, count(*) AS n FROM c0 WHERE strike AND h >= 12 GROUP BY ALL),
f0 AS (SELECT y.day, CAST(r.i AS INTEGER) AS row, CAST(q.i AS INTEGER) AS col, CAST(t.i AS INTEGER) AS k, coalesce(v, 0.0e0) AS v, coalesce(struck, 0) AS struck, coalesce(n, 0) AS n
 FROM (SELECT DISTINCT day FROM c) y, range({SIDE}) r(i), range({SIDE}) q(i), range(1, {LEADS + 1}) t(i)
 LEFT JOIN c1 ON c1.day = y.day AND c1.row = r.i AND c1.col = q.i LEFT JOIN c2 ON c2.day = y.day AND c2.row = r.i AND c2.col = q.i AND c2.k = t.i),
f1 AS (SELECT *, least(v / 100.0e0, 1.0e0) AS q FROM f0),
f2 AS (SELECT day, row, col, k, struck, n, unnest([{{'model': 'hybrid', 'p': 0.6e0 * q * pow(0.98e0, k) + CASE WHEN v >= 60 THEN 0.2e0 ELSE 0.0e0 END}},
 {{'model': 'advection', 'p': q * pow(0.97e0, k)}}, {{'model': 'charging_rule', 'p': CASE WHEN v >= 60 THEN 0.6e0 ELSE 0.5e0 * q END * pow(0.95e0, k)}},
 {{'model': 'persistence', 'p': CASE WHEN struck >= 1 THEN 1.0e0 ELSE 0.0e0 END}}], recursive := true) FROM f1),
fc AS (SELECT model, day, CAST(k * 5 AS INTEGER) AS lead, row, col, round(p + {B.OFF_TIES}, 4) AS p, n >= 1 AS o, struck = 0 AS fresh, pow(row - 7.5e0, 2) + pow(col - 7.5e0, 2) <= 60 AS on_ FROM f2)"""


def _boxes_sql(src: str) -> str:
    """Box sums of every field and radius by framed windows, edges repeated."""
    def axis(frm: str, fixed: str, moving: str, names: list[tuple[str, str, int]]) -> str:
        part = f"PARTITION BY model, day, lead, {fixed} ORDER BY {moving}"
        whole = f"OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        one = lambda out, x, r: f"sum({x}) OVER ({part} RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) + greatest(0, {r} - {moving}) * first_value({x}) {whole} + greatest(0, {moving} + {r} - {SIDE - 1}) * last_value({x}) {whole} AS {out}"
        return f"SELECT *, {', '.join(one(*x) for x in names)} FROM {frm}"

    fields, radii = ("fp", "fo", "fq", "fr", "fv"), [r for r in S.FSS_RADII if r]
    return f"""b0 AS (SELECT *, CASE WHEN on_ THEN p ELSE 0.0e0 END AS fp, CAST(on_ AND o AS INTEGER) AS fo, CAST(p >= thr AS INTEGER) AS fq, CAST(o AS INTEGER) AS fr, CAST(on_ AS INTEGER) AS fv FROM {src}),
b1 AS ({axis('b0', 'row', 'col', [(f'x_{f}_{r}', f, r) for f in fields for r in radii])}),
b2 AS (SELECT *, fp AS fp_0, fo AS fo_0, fq AS fq_0, fr AS fr_0, fv AS fv_0 FROM ({axis('b1', 'col', 'row', [(f'{f}_{r}', f'x_{f}_{r}', r) for f in fields for r in radii])}))"""


def _counts_sql(p: str, t: str, on: str) -> str:
    one = lambda c, x: f"CAST(count(*) FILTER (WHERE {on} AND {c}) AS BIGINT) AS {x}"
    return ", ".join(one(c, x) for c, x in ((f"{p} >= {t} AND o", "hits"), (f"{p} >= {t} AND NOT o", "false_alarms"), (f"{p} < {t} AND o", "misses"), (f"{p} < {t} AND NOT o", "correct_negatives")))


def _ap_sql(on: str, name: str) -> str:
    return f"""{name} AS (SELECT {{k}}, CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN round(sum(pos * CAST(tp AS DOUBLE) / seen) / sum(pos), 6) END AS auprc,
 CASE WHEN sum(pos) > 0 AND sum(n) > sum(pos) THEN round((sum(pos * (below + (n + 1) / 2.0e0)) - sum(pos) * (sum(pos) + 1) / 2.0e0) / (sum(pos) * CAST(sum(n) - sum(pos) AS DOUBLE)), 6) END AS auroc
 FROM (SELECT *, sum(pos) OVER (PARTITION BY {{k}} ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY {{k}} ORDER BY p DESC) AS seen, coalesce(sum(n) OVER (PARTITION BY {{k}} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
 FROM (SELECT {{k}}, p, count(*) AS n, count(*) FILTER (WHERE o) AS pos FROM px WHERE {on} GROUP BY {{k}}, p)) GROUP BY {{k}})"""


def _scope_sql(scope: str) -> str:
    """One scope's rows, of boxes b2."""
    k = {"all": "model", "lead": "model, lead", "band": "model, band"}[scope]
    div = lambda a, b: f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6)"
    fss = ", ".join(f"round(1.0e0 - sum(CASE WHEN fv_{r} > 0 THEN pow(fp_{r} / {(2 * r + 1) ** 2}.0e0 - fo_{r} / {(2 * r + 1) ** 2}.0e0, 2) END) / nullif(sum(CASE WHEN fv_{r} > 0 THEN pow(fp_{r} / {(2 * r + 1) ** 2}.0e0, 2) + pow(fo_{r} / {(2 * r + 1) ** 2}.0e0, 2) END), 0), 6) AS fss_r{r}" for r in S.FSS_RADII)
    edges = " + ".join(f"CAST(p >= {i}.0e0 / 10 AS INTEGER)" for i in range(1, 10))
    return f"""(WITH px AS (SELECT *, CASE WHEN lead <= 15 THEN '5-15' WHEN lead <= 30 THEN '20-30' WHEN lead <= 45 THEN '35-45' ELSE '50-60' END AS band FROM b2),
a AS (SELECT {k}, max(thr) AS threshold, {_counts_sql('p', 'thr', 'on_')}, CAST(count(*) FILTER (WHERE on_ AND fresh) AS BIGINT) AS ni_pixels, CAST(count(*) FILTER (WHERE on_ AND fresh AND o) AS BIGINT) AS ni_positives,
 count(*) FILTER (WHERE on_ AND fresh AND o AND p >= thr) AS nh, count(*) FILTER (WHERE on_ AND fresh AND NOT o AND p >= thr) AS nf, avg(pow(p - CAST(o AS INTEGER), 2)) FILTER (WHERE on_) AS sq, {fss} FROM px GROUP BY {k}),
e AS (SELECT *, CAST(hits AS DOUBLE) + misses AS ps, CAST(hits AS DOUBLE) + false_alarms + misses + correct_negatives AS n, CAST(hits + misses AS DOUBLE) * (hits + false_alarms) / nullif(hits + false_alarms + misses + correct_negatives, 0) AS ch FROM a),
bins AS (SELECT {k}, {edges} AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(o AS INTEGER)) AS mo FROM px WHERE on_ GROUP BY ALL),
bs AS (SELECT {k}, sum(n * pow(mp - mo, 2)) / sum(n) AS rel, sum(n * pow(mo - base, 2)) / sum(n) AS res FROM (SELECT *, sum(n * mo) OVER (PARTITION BY {k}) / sum(n) OVER (PARTITION BY {k}) AS base FROM bins) GROUP BY {k}),
{_ap_sql('on_', 'ra').replace('{k}', k)}, {_ap_sql('on_ AND fresh', 'rn').replace('{k}', k)}
SELECT model, '{scope}' AS scope, {'lead' if scope == 'lead' else 'CAST(NULL AS INTEGER) AS lead'}, {"CASE WHEN lead <= 15 THEN '5-15' WHEN lead <= 30 THEN '20-30' WHEN lead <= 45 THEN '35-45' ELSE '50-60' END AS band" if scope == 'lead' else 'band' if scope == 'band' else 'CAST(NULL AS VARCHAR) AS band'},
 threshold, hits, false_alarms, misses, correct_negatives, {div('hits', 'ps')} AS pod, {div('false_alarms', '(hits + false_alarms)')} AS far, {div('hits', '(hits + false_alarms + misses)')} AS csi, {div('hits + false_alarms', 'ps')} AS bias,
 round(2.0e0 * (CAST(hits AS DOUBLE) * correct_negatives - CAST(false_alarms AS DOUBLE) * misses) / nullif(ps * (misses + correct_negatives) + CAST(hits + false_alarms AS DOUBLE) * (false_alarms + correct_negatives), 0), 6) AS hss,
 round((hits - ch) / nullif(hits + false_alarms + misses - ch, 0), 6) AS ets, round(ps / n, 6) AS obs_rate, round((hits + false_alarms) / n, 6) AS pred_rate, CAST(ps AS BIGINT) AS positives,
 ra.auprc, ra.auroc, round(sq, 6) AS brier, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(ps / n * (1.0e0 - ps / n), 6) AS uncertainty, round(1.0e0 - sq / nullif(ps / n * (1.0e0 - ps / n), 0), 6) AS bss,
 fss_r0, fss_r1, fss_r2, fss_r4, fss_r8, ni_pixels, ni_positives, {div('nh', '(nf + ni_positives)')} AS ni_csi, rn.auprc AS ni_auprc
 FROM e JOIN bs USING ({k}) JOIN ra USING ({k}) LEFT JOIN rn USING ({k}))"""


_FULL = f"WITH {_F}, s AS (SELECT *, {THRESHOLD}e0 AS thr FROM fc), {_boxes_sql('s')} " + " UNION ALL ".join(f"SELECT * FROM {_scope_sql(x)}" for x in ("all", "lead", "band"))
add("full_evaluation", lambda s, d: _evaluated(s, d).drop("sweep", "neighbourhood"), _FULL)

_LEADS = f"WITH {_F}, s AS (SELECT *, {THRESHOLD}e0 AS thr FROM fc), {_boxes_sql('s')} " + " UNION ALL ".join(f"SELECT * FROM {_scope_sql(x)}" for x in ("lead", "band"))
add("lead_evaluation", lambda s, d: _evaluated(s, d).where("scope <> 'all'").drop("scope", "sweep", "neighbourhood"), f"SELECT * EXCLUDE (scope) FROM ({_LEADS})")


def _each(s, d, what):
    return _evaluated(s, d).where("scope = 'all'").select("model", F.explode(what).alias("x")).select("model", "x.*")


add("evaluation_sweep", lambda s, d: _each(s, d, "sweep"), f"""WITH {_F}, t AS (SELECT unnest([{', '.join(f'{t}e0' for t in S.THRESHOLDS)}]) AS threshold),
a AS (SELECT model, threshold, {_counts_sql('p', 'threshold', 'on_')} FROM fc, t GROUP BY ALL) SELECT *, round(CAST(hits AS DOUBLE) / nullif(hits + false_alarms + misses, 0), 6) AS csi FROM a""")
add("evaluation_neighbourhood", lambda s, d: _each(s, d, "neighbourhood"), f"""WITH {_F}, s AS (SELECT *, {THRESHOLD}e0 AS thr FROM fc), {_boxes_sql('s')},
a AS (""" + " UNION ALL ".join(f"SELECT model, {r} AS radius, count(*) FILTER (WHERE on_ AND p >= thr AND fr_{r} > 0) AS hits, count(*) FILTER (WHERE on_ AND p >= thr AND fr_{r} = 0) AS false_alarms, count(*) FILTER (WHERE on_ AND o AND fq_{r} = 0) AS misses FROM b2 GROUP BY model" for r in S.FSS_RADII) + """)
SELECT *, round(CAST(hits AS DOUBLE) / nullif(hits + misses, 0), 6) AS pod, round(CAST(false_alarms AS DOUBLE) / nullif(hits + false_alarms, 0), 6) AS far, round(CAST(hits AS DOUBLE) / nullif(hits + false_alarms + misses, 0), 6) AS csi FROM a""")


def _table(s, d):
    """Thresholds from the validation days, scores of the test days."""
    f = forecasts(s, d).join(splits.split_events(B.cells(s, d), "day", "chronological"), "day")
    val = E.choose_thresholds(f.where("split = 'val'").where("on"), ["model"], "p", "lit")
    test = f.where("split = 'test'").join(val.select("model", "thr_val"), "model")
    return E.table(E.evaluate(test, ["model"], ["day"], "p", "lit", "thr_val", "lead", "on", "fresh", n=SIDE), val)


_SPLIT = """n0 AS (SELECT day, row_number() OVER (ORDER BY day) AS i, (SELECT count(DISTINCT day) FROM c) AS n FROM (SELECT DISTINCT day FROM c)),
n1 AS (SELECT *, greatest(1, least(CAST(round_even(0.65e0 * n, 0) AS BIGINT), n - 2)) AS tr FROM n0), n2 AS (SELECT *, greatest(1, least(CAST(round_even(0.15e0 * n, 0) AS BIGINT), n - tr - 1)) AS va FROM n1),
sp AS (SELECT day, CASE WHEN i <= tr THEN 'train' WHEN i <= tr + va THEN 'val' ELSE 'test' END AS split FROM n2)"""
_TABLE = f"""WITH {_F}, {_SPLIT}, v AS (SELECT fc.* FROM fc JOIN sp USING (day) WHERE split = 'val' AND on_),
vt AS (SELECT model, threshold, count(*) FILTER (WHERE o AND p >= threshold) AS h, count(*) FILTER (WHERE o OR p >= threshold) AS u FROM v, (SELECT unnest([{', '.join(f'{t}e0' for t in E.CHOICES)}]) AS threshold) GROUP BY ALL),
vb AS (SELECT model, arg_max(threshold, (round(CAST(h AS DOUBLE) / u, 6), -threshold)) AS t, max(round(CAST(h AS DOUBLE) / u, 6)) AS val_csi FROM vt WHERE u > 0 GROUP BY model),
px AS (SELECT * FROM v), {_ap_sql('on_', 'vr').replace('{k}', 'model')},
va AS (SELECT model, coalesce(t, {E.DEFAULT_THRESHOLD}e0) AS thr_val, val_csi, auprc AS val_auprc FROM vr LEFT JOIN vb USING (model)),
s AS (SELECT fc.*, thr_val AS thr FROM fc JOIN sp USING (day) JOIN va USING (model) WHERE split = 'test'), {_boxes_sql('s')}, te AS (SELECT * FROM {_scope_sql('all')}),
tab AS (SELECT model, CASE WHEN model IN ('persistence', 'climatology', 'advection', 'charging_rule') THEN 'baseline' WHEN model LIKE 'blend%' THEN 'blend' ELSE 'learned' END AS kind,
 thr_val, auprc, csi, pod, far, fss_r2, fss_r4, bss, ni_csi, ni_auprc, val_auprc, val_csi FROM te LEFT JOIN va USING (model))"""
add("comparison_table", _table, f"{_TABLE} SELECT * FROM tab")
_PAIRS = ", ".join(f"{{'metric': '{m}', 'value': {m}}}" for m in E.COMPARED)
add("model_comparison", lambda s, d: E.compared(_table(s, d)), f"""{_TABLE}, l AS (SELECT model, kind, unnest([{_PAIRS}], recursive := true) FROM tab)
SELECT a.metric, a.model AS learned, a.value AS learned_value, b.model AS reference, b.value AS reference_value, a.value IS NOT NULL AND b.value IS NOT NULL AS comparable, coalesce(a.value > b.value, false) AS learned_wins,
 round(a.value - b.value, 6) AS margin, round((a.value - b.value) / nullif(b.value, 0), 6) AS relative FROM l a JOIN l b USING (metric) WHERE a.kind IN ('learned', 'blend') AND b.model IN ('advection', 'charging_rule')""")
add("model_verdict", lambda s, d: E.verdict(_table(s, d), ["val: fewer than 500 positives"]), f"""{_TABLE}, x AS (SELECT (SELECT model FROM tab WHERE kind <> 'baseline' AND auprc IS NOT NULL ORDER BY auprc DESC, model DESC LIMIT 1) AS best_learned,
 (SELECT model FROM tab WHERE auprc IS NOT NULL ORDER BY auprc DESC, model DESC LIMIT 1) AS best_overall, (SELECT model FROM tab WHERE ni_auprc IS NOT NULL ORDER BY ni_auprc DESC, model DESC LIMIT 1) AS best_new_initiation),
y AS (SELECT x.*, coalesce(b.auprc > a.auprc, false) AS beats_advection, coalesce(b.auprc > r.auprc, false) AS beats_charging_rule, coalesce(b.ni_auprc > a.ni_auprc, false) AS ni_beats_advection, coalesce(b.ni_auprc > r.ni_auprc, false) AS ni_beats_charging_rule
 FROM x LEFT JOIN tab b ON b.model = best_learned LEFT JOIN tab a ON a.model = 'advection' LEFT JOIN tab r ON r.model = 'charging_rule')
SELECT *, true AS test_split_usable, CASE WHEN best_learned IS NULL THEN 'nothing to claim' WHEN beats_advection AND beats_charging_rule THEN 'beats both' WHEN beats_advection THEN 'beats advection only' WHEN beats_charging_rule THEN 'beats charging_rule only' ELSE 'beats neither' END AS verdict FROM y""")
