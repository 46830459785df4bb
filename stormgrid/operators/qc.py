"""Quality control of cell tables. A rule masks by NULL and never clamps; rules run in order, and each counts only what it
newly masks, since a masked value no longer meets any test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import geo

PIXEL = ["event_id", "row", "col"]


def out_of_range(df: DataFrame, channels: list[str] = S.CHANNELS) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).between(*S.RANGES[c]), F.col(c)) for c in channels})


def non_finite(df: DataFrame, channels: list[str] = S.CHANNELS) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in channels})


def temporal_std(df: DataFrame, value: str, keys: list[str] = PIXEL, out: str = "std", least: int = 3) -> DataFrame:
    """Population deviation over a pixel's valid frames; NULL with fewer than `least`."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.stddev_pop(value).over(w)))


def clutter(std: Column, sfc: float = 35.0, top: float = 1.5, still: float = 1.5) -> Column:
    """Strong, shallow and unmoving: a ground return."""
    return F.coalesce((F.col("refl_sfc") >= sfc) & (F.col("echo_top") <= top) & (std <= still), F.lit(False))


def bright_band(std: Column, sfc: tuple[float, float] = (28.0, 47.0), margin: float = 2.5, still: float = 3.0) -> Column:
    top = F.col("echo_top").between(S.FREEZING_KM - 1.0, S.FREEZING_KM + margin)
    return F.coalesce(F.col("refl_sfc").between(*sfc) & top & (F.col("refl_m10") < S.CHARGING_DBZ - 10.0) & (std <= still), F.lit(False))


def quality_control(df: DataFrame, centre: tuple[float, float] | None = None, near_km: float = 0.0, far_km: float = 1e9, mask_bright_band: bool = False) -> DataFrame:
    """All rules in order; flags `clutter` and `bright_band` stay as columns. The deviation of refl_sfc is taken once, before clutter goes."""
    d = temporal_std(out_of_range(non_finite(df)), "refl_sfc")
    d = d.withColumn("clutter", clutter(F.col("std")))
    d = d.withColumns({c: F.when(~F.col("clutter"), F.col(c)) for c in ("refl_sfc", "refl_m10", "echo_top", "vil")})
    d = d.withColumn("bright_band", bright_band(F.col("std")))
    if mask_bright_band:
        d = d.withColumn("refl_sfc", F.when(~F.col("bright_band"), F.col("refl_sfc")))
    if centre:
        rng, _ = geo.range_azimuth(F.col("row"), F.col("col"), *centre)
        d = d.withColumns({c: F.when(rng.between(near_km, far_km), F.col(c)) for c in ("refl_m10", "echo_top")})
    return d.drop("std")


def kill_counts(df: DataFrame, centre: tuple[float, float] | None = None, elevations: tuple[float, float] = (0.5, 20.0), far_km: float | None = None, mask_bright_band: bool = False) -> DataFrame:
    """(step, rule, channel, masked): what each rule newly masks of each channel, in the order in which they run; of the bright
    band what is flagged, where it isn't masked. The radar's rules follow from its lowest and highest elevation: beyond the
    overshoot (or far_km), and within the cone of silence. One aggregation, whatever the number of rules."""
    steps: list[tuple[str, str, Column]] = []
    d = temporal_std(out_of_range(non_finite(df.withColumns({f"_raw_{c}": F.col(c) for c in S.CHANNELS}))), "refl_sfc")
    d = d.withColumns({f"_ok_{c}": F.col(c) for c in S.CHANNELS})
    finite = lambda c: ~F.isnan(f"_raw_{c}") & (F.abs(F.col(f"_raw_{c}")) < float("inf"))
    for c in S.CHANNELS:
        steps.append(("non_finite", c, F.col(f"_raw_{c}").isNotNull() & ~finite(c)))
        steps.append(("range", c, F.col(f"_raw_{c}").isNotNull() & finite(c) & F.col(f"_ok_{c}").isNull()))
    steps.sort(key=lambda x: x[0] != "non_finite")
    d = d.withColumns({"_clutter": clutter(F.col("std"))})
    ground = ("refl_sfc", "refl_m10", "echo_top", "vil")
    steps += [("clutter", c, F.col("_clutter") & F.col(f"_ok_{c}").isNotNull()) for c in ground]
    d = d.withColumns({c: F.when(~F.col("_clutter"), F.col(c)) for c in ground})
    d = d.withColumn("_band", bright_band(F.col("std")))
    steps.append(("bright_band", "refl_sfc", F.col("_band")))
    if mask_bright_band:
        d = d.withColumn("refl_sfc", F.when(~F.col("_band"), F.col("refl_sfc")))
    if centre:
        geometry = geo.radar_geometry(*elevations)
        rng, _ = geo.range_azimuth(F.col("row"), F.col("col"), *centre)
        far = rng > (geometry["overshoot_range_km"] if far_km is None else far_km)
        near = ~far & (rng < geometry["cone_of_silence_km"])
        for rule, hit in (("far", far), ("cone_of_silence", near)):
            steps += [(rule, c, hit & F.col(c).isNotNull()) for c in ("refl_m10", "echo_top")]
    d = d.agg(*(F.count_if(F.coalesce(hit, F.lit(False))).alias(f"_{i}") for i, (_, _, hit) in enumerate(steps)))
    rows = F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(rule).alias("rule"), F.lit(c).alias("channel"), F.col(f"_{i}").alias("masked")) for i, (rule, c, _) in enumerate(steps)))
    return d.select(F.explode(rows).alias("r")).select("r.*")


def channel_statistics(df: DataFrame, channels: list[str] = S.CHANNELS) -> DataFrame:
    """(channel, n, valid, share, least, largest, mean) over valid readings: the figures of a contract check."""
    aggs = [F.count(F.lit(1)).alias("_n"), *(x.alias(f"_{k}_{c}") for c in channels for k, x in (("v", F.count(c)), ("lo", F.min(c)), ("hi", F.max(c)), ("m", F.avg(c))))]
    rows = F.array(*(F.struct(F.lit(c).alias("channel"), F.col("_n").alias("n"), F.col(f"_v_{c}").alias("valid"), F.round(F.try_divide(F.col(f"_v_{c}").cast("double"), F.col("_n")), 6).alias("share"), F.col(f"_lo_{c}").cast("double").alias("least"), F.col(f"_hi_{c}").cast("double").alias("largest"), F.round(f"_m_{c}", 6).alias("mean")) for c in channels))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def report(before: DataFrame, after: DataFrame, channels: list[str] = S.CHANNELS) -> DataFrame:
    """(channel, valid_before, valid_after, masked): parts of all values."""
    share = lambda d, tag: d.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in channels]).unpivot(["n"], channels, "channel", tag)
    a, b = share(before, "a"), share(after, "b")
    return a.join(b.select("channel", "b"), "channel").select("channel", F.round(F.try_divide(F.col("a"), F.col("n")), 6).alias("valid_before"), F.round(F.try_divide(F.col("b"), F.col("n")), 6).alias("valid_after"), (F.col("a") - F.col("b")).alias("masked"))


def despeckle(df: DataFrame, value: str, keys: list[str], out: str, n: int = S.GRID, jump: float = 12.0, quiet: float = 15.0) -> DataFrame:
    """Interior spikes over quiet surroundings become the median of their eight neighbours."""
    off = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    near = df.select(*keys, "row", "col", F.col(value).alias("_v"), off.alias("o")).select(*keys, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "_v")
    med = near.groupBy(*keys, "row", "col").agg(F.percentile("_v", F.lit(0.5)).alias("_m"))
    inside = F.col("row").between(1, n - 2) & F.col("col").between(1, n - 2)
    spike = inside & (F.col(value) > 5) & (F.col(value) - F.col("_m") > jump) & (F.col("_m") < quiet)
    return df.join(med, [*keys, "row", "col"], "left").withColumn(out, F.when(F.coalesce(spike, F.lit(False)), F.col("_m")).otherwise(F.col(value))).drop("_m")


def attenuation(df: DataFrame, value: str, ray: list[str], along: str, out: str, alpha: float = 0.001) -> DataFrame:
    """Adds alpha times the running sum of what exceeds 30 dBZ along a ray; within 0 and 75."""
    w = Window.partitionBy(*ray).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    lost = F.sum(F.greatest(F.lit(0.0), F.col(value) - 30.0)).over(w)
    return df.withColumn(out, F.least(F.greatest(F.col(value) + alpha * lost, F.lit(0.0)), F.lit(75.0)))


class ContractError(ValueError):
    """A table breaks the cell contract."""


def validate(df: DataFrame) -> list[str]:
    """Raises on missing columns, pixels off the grid, NaN or negative labels; returns warnings. One aggregation."""
    missing = [c for c in ("event_id", "frame", "row", "col", "y", *S.CHANNELS) if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    aggs = [F.count_if(~F.col("row").between(0, S.GRID - 1) | ~F.col("col").between(0, S.GRID - 1)).alias("off"), F.count_if(F.col("y") < 0).alias("neg"), F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(F.isnan(c)).alias(f"nan_{c}") for c in S.CHANNELS] + [F.count_if(~F.col(c).between(*S.RANGES[c])).alias(f"range_{c}") for c in S.CHANNELS] + [F.count_if(F.col(c) <= S.FILL / 2).alias(f"fill_{c}") for c in S.CHANNELS]
    r = df.agg(*aggs).first().asDict()
    bad = [k for k in ("off", "neg", *(f"nan_{c}" for c in S.CHANNELS)) if r[k]]
    if bad:
        raise ContractError(", ".join(f"{k}: {r[k]}" for k in bad))
    return [f"{k}: {v}" for k, v in r.items() if k.startswith(("range_", "fill_")) and v] + (["no rows"] if not r["n"] else [])
