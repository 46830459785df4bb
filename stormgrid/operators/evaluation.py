"""Whole evaluations of forecasts: all scores of each model over leads and bands of leads from one pass over the pixels,
thresholds chosen on other data, their table, and models held against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import scalar
from stormgrid.operators import grid
from stormgrid.operators import metrics as M

# Thresholds tried on validation data beside those of every sweep, the one taken if none can be scored, scores
# by which models are compared, the references, and the columns of the table.
CHOICES = sorted({*S.THRESHOLDS, 0.005, 0.01, 0.60, 0.80, 0.90})
DEFAULT_THRESHOLD = 0.15
COMPARED = ["auprc", "csi", "ni_auprc", "ni_csi"]
REFERENCES = ["advection", "charging_rule"]
BASELINES = ["persistence", "climatology", "advection", "charging_rule"]
TABLE = ["model", "kind", "thr_val", "auprc", "csi", "pod", "far", "fss_r2", "fss_r4", "bss", "ni_csi", "ni_auprc", "val_auprc", "val_csi"]

_COUNTS = ("hits", "false_alarms", "misses", "correct_negatives")
_BINS = 10


def _sums(radii: list[int]) -> list[str]:
    return ["seen", "new", "pos", "npos", *(f"{k}_{r}" for r in radii for k in ("fd", "fs", "nh", "nf", "nm"))]


def _by_score(df: DataFrame, keys: list[str], sample: list[str], prob: str, obs: str, threshold: float | str, lead: str | None, valid: str | None, fresh: str | None, radii: list[int], n: int) -> DataFrame:
    """What the pixels of each score add up to, by scope (all; each lead; each band of leads): the squares that FSS needs and
    the counts of near hits at every radius, and rows and positives, of all pixels (seen, pos) and of new ones (new, npos)."""
    d = df.selectExpr(*keys, *sample, *([f"{lead} AS lead"] if lead else []), "row", "col", f"CAST({prob} AS double) AS p", f"{obs} >= 0.5 AS o", f"{valid or 'true'} AS ok", f"{fresh or 'false'} AND {valid or 'true'} AS fresh",
                      f"CAST({threshold} AS double) AS thr")
    # yes and no of a pixel in 16 bits each, so that one sum counts all four: observed and scored, forecast, observed, scored
    if n * (2 * max(radii) + 1) >= 1 << 15:
        raise ValueError("boxes of so large a grid and radius hold more pixels than are counted together")
    bits = {"fo": 0, "fq": 16, "fr": 32, "fv": 48}
    d = d.selectExpr("*", "if(ok, p, 0.0D) AS fp", "CAST(p >= thr AS int) AS fq", "CAST(ok AND o AS long) + shiftleft(CAST(p >= thr AS long), 16) + shiftleft(CAST(o AS long), 32) + shiftleft(CAST(ok AS long), 48) AS fb")
    d = grid.box_sums(d, [*keys, *sample, *(["lead"] if lead else [])], ["fp", "fb"], [r for r in radii if r], n)
    adds = {"seen": "CAST(ok AS long)", "new": "CAST(fresh AS long)", "pos": "CAST(ok AND o AS long)", "npos": "CAST(fresh AND o AS long)"}
    for r in radii:
        area = float((2 * r + 1) ** 2)
        box = f"fb_r{r}" if r else "fb"
        at = lambda f, r=r, box=box: (f"(shiftrightunsigned({box}, {bits[f]}) & 65535)" if f in bits else f"{f}_r{r}" if r else f)
        f, g, scored = f"{at('fp')} / {area}D", f"{at('fo')} / {area}D", f"{at('fv')} > 0" if valid else "true"
        adds |= {f"fd_{r}": f"if({scored}, ({f} - {g}) * ({f} - {g}), 0.0D)", f"fs_{r}": f"if({scored}, {f} * {f} + {g} * {g}, 0.0D)", f"nh_{r}": f"CAST(ok AND fq = 1 AND {at('fr')} > 0 AS long)",
                 f"nf_{r}": f"CAST(ok AND fq = 1 AND {at('fr')} = 0 AS long)", f"nm_{r}": f"CAST(ok AND o AND {at('fq')} = 0 AS long)"}
    at_lead = ["lead"] if lead else []
    d = d.groupBy(*keys, *at_lead, "p").agg(F.max("thr").alias("thr"), *(F.expr(f"sum({x}) AS {c}") for c, x in adds.items()))
    nothing = "CAST(NULL AS int) AS lead"
    if not lead:
        return d.selectExpr(*keys, "'all' AS scope", nothing, "CAST(NULL AS string) AS band", "p", "thr", *adds)
    d = d.withColumn("band", scalar.lead_band(F.col("lead")))
    scope = lambda name, lead, band: f"named_struct('scope', '{name}', 'lead', CAST({lead} AS int), 'band', CAST({band} AS string))"
    scopes = f"explode(array({scope('all', 'NULL', 'NULL')}, {scope('lead', 'lead', 'band')}, {scope('band', 'NULL', 'band')})) AS at"
    d = d.selectExpr(*keys, scopes, "p", "thr", *adds).where("at.scope <> 'band' OR at.band IS NOT NULL").selectExpr(*keys, "at.*", "p", "thr", *adds)
    return d.groupBy(*keys, "scope", "lead", "band", "p").agg(F.max("thr").alias("thr"), *(F.expr(f"sum({c}) AS {c}") for c in adds))


def _running(d: DataFrame, by: list[str]) -> DataFrame:
    """The positives and rows at or above each score (tp, upto), and those of new pixels (ntp, nupto). Windows see a slice of
    scores, or the slices' sums; the sums come back by a join on what the same exchange holds."""
    names = {"pos": "tp", "seen": "upto", "npos": "ntp", "new": "nupto"}
    d = d.withColumn("slice", M._slice(F.col("p")))
    at = [*by, "slice"]
    s = d.groupBy(*at).agg(*(F.expr(f"sum({c}) AS {c}") for c in names))
    above = f"OVER (PARTITION BY {', '.join(by)} ORDER BY slice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    s = s.selectExpr(*(f"{k} AS _at{i}" for i, k in enumerate(at)), *(f"coalesce(sum({c}) {above}, 0) AS _{o}" for c, o in names.items()))
    inside = f"OVER (PARTITION BY {', '.join(at)} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(at)])
    d = d.selectExpr("*", *(f"sum({c}) {inside} AS {o}" for c, o in names.items())).join(s, same)
    return d.selectExpr(*[c for c in d.columns if c not in names.values() and not c.startswith("_") and c != "slice"], *(f"{o} + _{o} AS {o}" for o in names.values()))


def evaluate(df: DataFrame, keys: list[str], sample: list[str], prob: str, obs: str, threshold: float | str, lead: str | None = None, valid: str | None = None, fresh: str | None = None,
             radii: list[int] = S.FSS_RADII, n: int = S.GRID, thresholds: list[float] = S.THRESHOLDS) -> DataFrame:
    """One row for each of keys and scope: `all`, and with leads (in minutes) each `lead` and each `band` of them.

    df: dense n x n grids, one for each of keys, sample and lead, with a score and what was observed (0 or 1). threshold: a
    number, or a column that is one number for each of keys. valid: pixels that are scored; others count as 0 in the boxes
    of FSS. fresh: pixels of the new-initiation subset. Columns: counts and scores, auprc, auroc, Brier and its parts,
    fss_r{r}; `neighbourhood` and `sweep`, arrays of counts and scores by radius and threshold; ni_ for the subset. What
    can't be scored is NULL. Names of columns are plain words: they go into SQL text."""
    by = [*keys, "scope", "lead", "band"]
    d = _running(_by_score(df, keys, sample, prob, obs, threshold, lead, valid, fresh, radii, n), by)

    def counted(t: str, prefix: str, a: str = "pos", b: str = "seen - pos") -> list[str]:
        return [f"sum(if({c}, {x}, 0)) AS {prefix}{name}" for name, c, x in zip(_COUNTS, (f"p >= {t}", f"p >= {t}", f"p < {t}", f"p < {t}"), (a, b, a, b), strict=True)]

    bin_ = " + ".join(f"CAST(p >= {i / _BINS}D AS int)" for i in range(1, _BINS))
    d = d.selectExpr("*", f"{bin_} AS bin")
    aggs = [*counted("thr", ""), *counted("thr", "ni_", "npos", "new - npos"), *(x for i, t in enumerate(thresholds) for x in counted(f"{float(t)}D", f"_s{i}_"))]
    aggs += ["max(thr) AS threshold", "sum(pos) AS positives", "sum(seen) AS pixels", "sum(npos) AS ni_positives", "sum(new) AS ni_pixels", "sum(if(upto > 0, pos * CAST(tp AS double) / upto, 0.0D)) AS _ap",
             "sum(if(nupto > 0, npos * CAST(ntp AS double) / nupto, 0.0D)) AS _nap", "sum(pos * (upto - (seen + 1) / 2.0D)) AS _rank", "sum(pos * (1.0D - p) * (1.0D - p) + (seen - pos) * p * p) AS _sq"]
    aggs += [f"sum(if(bin = {i}, {x}, 0)) AS _b{i}_{c}" for i in range(_BINS) for c, x in (("n", "seen"), ("p", "seen * p"), ("o", "pos"))]
    aggs += [f"sum({c}_{r}) AS _{c}_{r}" for r in radii for c in ("fd", "fs", "nh", "nf", "nm")]
    d = M.scores(d.groupBy(*by).agg(*map(F.expr, aggs)))
    div = lambda a, b: f"round(try_divide(CAST({a} AS double), {b}), 6)"
    csi = lambda h, f, m: div(h, f"({h} + {f} + {m})")
    part = lambda a, b: f"try_divide({' + '.join(f'coalesce(_b{i}_n * pow({a.format(i=i)} - {b.format(i=i)}, 2), 0.0D)' for i in range(_BINS))}, pixels)"
    mean_p, mean_o, unc = "try_divide(_b{i}_p, _b{i}_n)", "try_divide(CAST(_b{i}_o AS double), _b{i}_n)", "(_base * (1.0D - _base))"
    d = d.selectExpr("*", "try_divide(CAST(positives AS double), pixels) AS _base", "positives > 0 AND pixels > positives AS _both", "ni_positives > 0 AND ni_pixels > ni_positives AS _nboth")
    near = [f"struct({r} AS radius, _nh_{r} AS hits, _nf_{r} AS false_alarms, _nm_{r} AS misses, {div(f'_nh_{r}', f'(_nh_{r} + _nm_{r})')} AS pod, {div(f'_nf_{r}', f'(_nh_{r} + _nf_{r})')} AS far, {csi(f'_nh_{r}', f'_nf_{r}', f'_nm_{r}')} AS csi)" for r in radii]
    sweep = [f"struct({float(t)}D AS threshold, {', '.join(f'_s{i}_{x} AS {x}' for x in _COUNTS)}, {csi(*(f'_s{i}_{x}' for x in _COUNTS[:3]))} AS csi)" for i, t in enumerate(thresholds)]
    return d.selectExpr(
        *by, "threshold", *_COUNTS, "pod", "far", "csi", "bias", "hss", "ets", "obs_rate", "pred_rate", "positives", "round(if(_both, _ap / positives, NULL), 6) AS auprc",
        "round(if(_both, (CAST(pixels AS double) * positives - _rank - positives * (positives + 1) / 2.0D) / (positives * CAST(pixels - positives AS double)), NULL), 6) AS auroc",
        "round(try_divide(_sq, pixels), 6) AS brier", f"round({part(mean_p, mean_o)}, 6) AS reliability", f"round({part(mean_o, '_base')}, 6) AS resolution", f"round({unc}, 6) AS uncertainty", f"round(1.0D - try_divide(try_divide(_sq, pixels), {unc}), 6) AS bss",
        *(f"round(1.0D - try_divide(_fd_{r}, _fs_{r}), 6) AS fss_r{r}" for r in radii), f"array({', '.join(near)}) AS neighbourhood", f"array({', '.join(sweep)}) AS sweep",
        "ni_pixels", "ni_positives", f"{csi('ni_hits', 'ni_false_alarms', 'ni_misses')} AS ni_csi", "round(if(_nboth, _nap / ni_positives, NULL), 6) AS ni_auprc")


def choose_thresholds(df: DataFrame, keys: list[str], prob: str, obs: str, choices: list[float] = CHOICES) -> DataFrame:
    """(keys, thr_val, val_csi, val_auprc) of validation data: the choice of largest CSI, the lowest of equal ones, and the
    default where no choice can be scored."""
    seen = F.col(obs) >= 0.5
    best = M.best_csi(M.threshold_sweep(df, keys, prob, seen, choices), keys).select(*keys, F.col("threshold").alias("_t"), F.col("csi").alias("val_csi"))
    ranked = M.ranking(df, keys, prob, seen, sliced=True).select(*keys, F.col("auprc").alias("val_auprc"))
    return ranked.join(best, keys, "left").select(*keys, F.coalesce("_t", F.lit(DEFAULT_THRESHOLD)).alias("thr_val"), "val_csi", "val_auprc")


def table(test: DataFrame, val: DataFrame) -> DataFrame:
    """The comparison table, a row a model: test scores at the thresholds chosen on validation data, whose scores stand beside
    them. Best AUPRC first, unscored last."""
    kind = F.when(F.col("model").isin(BASELINES), "baseline").when(F.col("model").startswith("blend"), "blend").otherwise("learned")
    d = test.where("scope = 'all'").join(val, "model", "left").withColumn("kind", kind)
    return d.select(*TABLE).orderBy(F.col("auprc").desc_nulls_last(), "model")


def compared(rows: DataFrame, references: list[str] = REFERENCES, metrics: list[str] = COMPARED) -> DataFrame:
    """One row for each learned model, reference and metric: both values, their margin and who is ahead. A missing value is
    not comparable, and nobody wins. rows: a table of models with their kinds."""
    d = rows.select("model", "kind", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("model", "kind", "m.*")
    a = d.where(F.col("kind").isin("learned", "blend")).select("metric", F.col("model").alias("learned"), F.col("value").alias("learned_value"))
    b = d.where(F.col("model").isin(references)).select("metric", F.col("model").alias("reference"), F.col("value").alias("reference_value"))
    margin = F.col("learned_value") - F.col("reference_value")
    return a.join(b, "metric").withColumns({"comparable": margin.isNotNull(), "learned_wins": F.coalesce(margin > 0, F.lit(False)), "margin": F.round(margin, 6), "relative": F.round(F.try_divide(margin, F.col("reference_value")), 6)})


def verdict(rows: DataFrame, problems: list[str] = ()) -> DataFrame:
    """One row: the best learned model by AUPRC, the best of all, the best on new initiation, what the best learned one beats,
    and what follows. It wins by AUPRC; new initiation is told beside it. Problems that begin with `test` withhold the
    verdict, others don't. Of equal models the last by name counts. A table of models is one row each."""
    bad = any(p.strip().startswith("test") for p in problems)
    top = lambda metric, ok: F.max_by("model", F.when(ok & F.col(metric).isNotNull(), F.struct(metric, "model")))
    learned, every = F.col("kind").isin("learned", "blend"), F.lit(True)
    of = lambda metric, who: F.max(F.when(F.col("model") == who, F.col(metric)))
    d = rows.agg(top("auprc", learned).alias("best_learned"), top("auprc", every).alias("best_overall"), top("ni_auprc", every).alias("best_new_initiation"),
                 *(of(m, r).alias(f"_{m}_{r}") for m in ("auprc", "ni_auprc") for r in REFERENCES),
                 *(F.max_by(m, F.when(learned & F.col("auprc").isNotNull(), F.struct("auprc", "model"))).alias(f"_{m}") for m in ("auprc", "ni_auprc")))
    beats = lambda m, r: F.coalesce(F.col(f"_{m}") > F.col(f"_{m}_{r}"), F.lit(False))
    a, b = beats("auprc", REFERENCES[0]), beats("auprc", REFERENCES[1])
    said = F.when(F.col("best_learned").isNull(), "nothing to claim").when(F.lit(bad), "withheld").when(a & b, "beats both").when(a, "beats advection only").when(b, "beats charging_rule only").otherwise("beats neither")
    return d.select("best_learned", "best_overall", "best_new_initiation", a.alias("beats_advection"), b.alias("beats_charging_rule"), beats("ni_auprc", REFERENCES[0]).alias("ni_beats_advection"), beats("ni_auprc", REFERENCES[1]).alias("ni_beats_charging_rule"), F.lit(not bad).alias("test_split_usable"), said.alias("verdict"))
