"""Verification metrics. Every ratio of 0 over 0 is NULL. A metric is one aggregation over its keys; scores are grouped by
value before any ordered window, so that a window sees distinct scores only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.operators import grid


def counts(pred: Column, obs: Column, valid: Column | None = None) -> list[Column]:
    ok = F.lit(True) if valid is None else valid
    return [F.count_if(ok & pred & obs).alias("hits"), F.count_if(ok & pred & ~obs).alias("false_alarms"), F.count_if(ok & ~pred & obs).alias("misses"), F.count_if(ok & ~pred & ~obs).alias("correct_negatives")]


def scores(df: DataFrame, digits: int = 6) -> DataFrame:
    """POD, FAR, CSI, BIAS, HSS, ETS and rates from the four counts."""
    h, f, m, c = (F.col(x).cast("double") for x in ("hits", "false_alarms", "misses", "correct_negatives"))
    n = h + f + m + c
    by_chance = F.try_divide((h + m) * (h + f), n)
    r = lambda x: F.round(x, digits)
    return df.withColumns({
        "pod": r(F.try_divide(h, h + m)), "far": r(F.try_divide(f, h + f)), "csi": r(F.try_divide(h, h + f + m)), "bias": r(F.try_divide(h + f, h + m)),
        "hss": r(F.try_divide(2.0 * (h * c - f * m), (h + m) * (m + c) + (h + f) * (f + c))), "ets": r(F.try_divide(h - by_chance, h + f + m - by_chance)),
        "obs_rate": r(F.try_divide(h + m, n)), "pred_rate": r(F.try_divide(h + f, n)),
    })


def contingency(df: DataFrame, keys: list[str], pred: Column, obs: Column, valid: Column | None = None) -> DataFrame:
    return scores(df.groupBy(*keys).agg(*counts(pred, obs, valid)))


def threshold_sweep(df: DataFrame, keys: list[str], prob: str, obs: Column, thresholds: list[float] = S.THRESHOLDS) -> DataFrame:
    """One scan for all thresholds: counts of each are columns of one aggregation, then unpivoted."""
    aggs = [c.alias(f"{n}_{i}") for i, t in enumerate(thresholds) for n, c in zip(("h", "f", "m", "c"), counts(F.col(prob) >= t, obs), strict=True)]
    wide = df.groupBy(*keys).agg(*aggs)
    part = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(x) for n, x in zip("hfmc", ("hits", "false_alarms", "misses", "correct_negatives"), strict=True)]) for i, t in enumerate(thresholds)])
    return scores(wide.select(*keys, F.explode(part).alias("p")).select(*keys, "p.*"))


def best_csi(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of largest CSI, the lowest on ties; NULL scores don't take part."""
    w = Window.partitionBy(*keys).orderBy(F.col("csi").desc(), "threshold")
    return sweep.where("csi IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def select_threshold(sweep: DataFrame, default: float = 0.15) -> DataFrame:
    return sweep.where("csi IS NOT NULL").agg(F.coalesce(F.min_by("threshold", F.struct(-F.col("csi"), "threshold")), F.lit(default)).alias("threshold"))


def _slice(p: Column) -> Column:
    """A whole number that grows with a score: 1,024 slices a unit, below the first of them 64 slices a halving, so that
    scores of rare events are cut finely too. What is not above 0 is one slice, as is NaN, the largest."""
    fine = F.ceil(64.0 * F.log2(p))
    return F.when(F.isnan(p), F.lit(2**62)).when(p <= 0, F.lit(-1_000_000)).when(p < 1 / 1024, fine).otherwise(F.floor(p * 1024.0)).cast("long")


def _by_score(df: DataFrame, keys: list[str], prob: str, obs: Column, sliced: bool) -> DataFrame:
    """Distinct scores with the positives and all rows at or above, and the rows below. If sliced, ordered windows see one
    slice of scores of a key, or the slices' sums of a key; neither grows with the rows, as all scores of a key would."""
    d = df.groupBy(*keys, F.col(prob).cast("double").alias("p")).agg(F.count_if(obs).alias("pos"), F.count(F.lit(1)).alias("n"))
    if not sliced:
        w = Window.partitionBy(*keys)
        desc, up = w.orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.withColumns({"tp": F.sum("pos").over(desc), "seen": F.sum("n").over(desc), "below": F.sum("n").over(up)})
        return d.withColumn("below", F.col("below") - F.col("seen"))
    d = d.withColumn("slice", _slice(F.col("p")))
    desc = Window.partitionBy(*keys, "slice").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys, "slice").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"tp": F.sum("pos").over(desc), "seen": F.sum("n").over(desc), "below": F.coalesce(F.sum("n").over(up), F.lit(0))})
    sums = d.groupBy(*keys, "slice").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    higher = Window.partitionBy(*keys).orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    at = [*keys, "slice"]
    carried = sums.select(*[F.col(k).alias(f"_at{i}") for i, k in enumerate(at)], *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(o) for c, w, o in (("_pos", higher, "_tp"), ("_n", higher, "_seen"), ("_n", lower, "_below"))])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(at)])
    d = d.join(carried, same)
    return d.select(*keys, "p", "pos", "n", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("tp", "seen", "below")])


def ranking(df: DataFrame, keys: list[str], prob: str, obs: Column, sliced: bool | None = None) -> DataFrame:
    """auprc (stepwise average precision, ties as one step) and auroc (average ranks); NULL without both classes. sliced: for
    keys with more distinct scores than one task should order; if not said, where there are no keys."""
    d = _by_score(df.where(F.col(prob).isNotNull()), keys, prob, obs, not keys if sliced is None else sliced)
    pos, n = F.sum("pos"), F.sum("n")
    ap = F.try_divide(F.sum(F.col("pos") * F.col("tp").cast("double") / F.col("seen")), pos.cast("double"))
    ranks = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0))
    auc = F.try_divide(ranks - pos * (pos + 1) / 2.0, (pos * (n - pos)).cast("double"))
    both = (pos > 0) & (n > pos)
    return d.groupBy(*keys).agg(pos.alias("positives"), n.alias("n"), F.round(F.when(both, ap), 6).alias("auprc"), F.round(F.when(both, auc), 6).alias("auroc"))


def brier_bins(df: DataFrame, keys: list[str], prob: str, obs: Column, bins: int = 10) -> DataFrame:
    """Bins by explicit edges: a value on an edge belongs above it."""
    k = F.lit(0)
    for i in range(1, bins):
        k = k + (F.col(prob) >= i / bins).cast("int")
    d = df.where(F.col(prob).isNotNull()).select(*keys, k.alias("bin"), F.col(prob).alias("p"), obs.cast("double").alias("o"))
    return d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("o").alias("mean_o"), F.sum(F.pow(F.col("p") - F.col("o"), F.lit(2.0))).alias("sq"))


def brier(df: DataFrame, keys: list[str], prob: str, obs: Column, bins: int = 10) -> DataFrame:
    b = brier_bins(df, keys, prob, obs, bins)
    every = Window.partitionBy(*keys)
    b = b.withColumn("base", F.sum(F.col("n") * F.col("mean_o")).over(every) / F.sum("n").over(every))
    n = F.sum("n")
    r = lambda x: F.round(x, 6)
    out = b.groupBy(*keys).agg((F.sum("sq") / n).alias("_b"), (F.sum(F.col("n") * F.pow(F.col("mean_p") - F.col("mean_o"), F.lit(2.0))) / n).alias("_r"), (F.sum(F.col("n") * F.pow(F.col("mean_o") - F.col("base"), F.lit(2.0))) / n).alias("_s"), F.first("base").alias("_o"))
    u = F.col("_o") * (1.0 - F.col("_o"))
    return out.select(*keys, r(F.col("_b")).alias("brier"), r(F.col("_r")).alias("reliability"), r(F.col("_s")).alias("resolution"), r(u).alias("uncertainty"), r(1.0 - F.try_divide(F.col("_b"), u)).alias("bss"))


def fss(df: DataFrame, keys: list[str], prob: str, obs: str, r: int, valid: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Fractions skill score over dense grids. Masked pixels count as 0 in boxes, and only pixels whose box holds an
    unmasked one are scored. keys tell grids apart; scores are pooled over `by`, the keys themselves if not given."""
    if valid:
        on = F.col(valid).cast("double")
        df = df.withColumns({prob: F.col(prob) * on, obs: F.col(obs) * on, "_on": on})
    d = grid.box_mean(grid.box_mean(df, keys, prob, r, "_f"), keys, obs, r, "_o")
    if valid:
        d = grid.box_max(d, keys, "_on", r, "_any").where("_any > 0")
    f, o = F.col("_f"), F.col("_o")
    return d.groupBy(*(keys if by is None else by)).agg(F.round(1.0 - F.try_divide(F.avg((f - o) * (f - o)), F.avg(f * f) + F.avg(o * o)), 6).alias("fss"))


def neighbourhood(df: DataFrame, keys: list[str], pred: Column, obs: Column, r: int) -> DataFrame:
    """Hits and false alarms of forecast pixels by observations within r; misses of observed pixels without a forecast near."""
    d = df.withColumns({"_p": pred.cast("int"), "_q": obs.cast("int")})
    d = grid.box_max(grid.box_max(d, keys, "_p", r, "_pn"), keys, "_q", r, "_qn")
    d = d.groupBy(*keys).agg(F.count_if((F.col("_p") == 1) & (F.col("_qn") == 1)).alias("hits"), F.count_if((F.col("_p") == 1) & (F.col("_qn") == 0)).alias("false_alarms"), F.count_if((F.col("_q") == 1) & (F.col("_pn") == 0)).alias("misses"))
    h, f, m = (F.col(x).cast("double") for x in ("hits", "false_alarms", "misses"))
    return d.withColumns({"pod": F.round(F.try_divide(h, h + m), 6), "far": F.round(F.try_divide(f, h + f), 6), "csi": F.round(F.try_divide(h, h + f + m), 6)})


def roi(df: DataFrame, keys: list[str], prob: str, strikes: str, dbz: str, box: tuple[int, int, int, int], threshold: float) -> DataFrame:
    """A box of pixels: counts, scores, reflectivity and risk. `roi_hss` is the live display's own form, not the standard one."""
    r0, r1, c0, c1 = box
    d = df.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
    obs = F.col(strikes) >= 1
    z = F.coalesce(F.col(dbz), F.lit(0.0))
    out = d.groupBy(*keys).agg(*counts(F.col(prob) >= threshold, obs), F.round(F.max(z), 1).alias("max_dbz"), F.round(F.avg(z), 3).alias("mean_dbz"), F.round(F.percentile(z, F.lit(0.95)), 3).alias("p95_dbz"))
    h, f, m, c = (F.col(x).cast("double") for x in ("hits", "false_alarms", "misses", "correct_negatives"))
    chance = (h + f) * (h + m) / F.greatest(F.lit(1.0), h + f + m + c)
    rest = (h + f + m + c) / 2.0 - chance
    seen = F.col("hits") + F.col("misses")
    return out.withColumns({
        "area_km2": F.lit((r1 - r0) * (c1 - c0) * 4), "csi": F.round(F.coalesce(F.try_divide(h, h + f + m), F.lit(0.0)), 4),
        "roi_hss": F.round(F.when((h + f + m > 0) & (F.abs(rest) > 1e-6), (h - chance) / rest).otherwise(0.0), 4),
        "risk": F.when((seen > 10) | (F.col("max_dbz") >= 45), "CRITICAL").when((seen > 0) | (F.col("max_dbz") >= 30), "WARNING").otherwise("CLEAR"),
    })


def comparison(evaluations: DataFrame, by: str = "auprc") -> DataFrame:
    return evaluations.orderBy(F.col(by).desc_nulls_last(), "model")
