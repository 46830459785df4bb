"""Causal features: a value at a frame depends on that frame and earlier ones only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import scalar
from stormgrid.operators import grid

PIXEL, FRAME = ["event_id", "row", "col"], ["event_id", "frame"]
NAMES = [*(f"{c}_n" for c in S.CHANNELS), "m10_valid", "charge_excess", "graupel", "deep_conv", "graupel_max_r2", "graupel_max_r4", "graupel_mean_r4", "d_refl_m10", "d_echo_top", "d_ir_tb", "d_graupel", "graupel_cmax", "light_cmean", "light_max_r4"]


def backward_difference(df: DataFrame, value: str, out: str, k: int = 1, keys: list[str] = PIXEL, order: str = "frame") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.coalesce(F.col(value) - F.lag(value, k).over(w), F.lit(0.0)))


def causal(df: DataFrame, value: str, keys: list[str] = PIXEL, order: str = "frame") -> DataFrame:
    """cmax and cmean: largest and mean value up to and with this frame."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"cmax": F.max(value).over(w), "cmean": F.avg(value).over(w)})


def build(df: DataFrame, sentinel_compat: bool = False) -> DataFrame:
    """The twenty features of a dense cell table. With sentinel_compat, differences of a missing reading use the fill value."""
    m10, top, ir = F.col("refl_m10"), F.col("echo_top"), F.col("ir_tb")
    g = scalar.graupel(m10, top)
    d = df.withColumns({**{f"{c}_n": scalar.normalised(c) for c in S.CHANNELS}, "m10_valid": m10.isNotNull().cast("double"), "charge_excess": scalar.charge_excess(m10) / 20.0, "_g": g, "graupel": g / 40.0, "deep_conv": scalar.deep_convection(top, ir), "_l": (F.coalesce(F.col("light_dens"), F.lit(0.0)) >= 1).cast("double")})
    d = grid.box_max(d, FRAME, "_g", 2, "graupel_max_r2")
    d = grid.box_max(d, FRAME, "_g", 4, "graupel_max_r4")
    d = grid.box_mean(d, FRAME, "_g", 4, "graupel_mean_r4")
    d = grid.box_max(d, FRAME, "_l", 4, "light_max_r4")
    w = Window.partitionBy(*PIXEL).orderBy("frame")
    past = w.rangeBetween(Window.unboundedPreceding, 0)
    raw = lambda c: F.coalesce(F.col(c), F.lit(S.FILL)) if sentinel_compat else F.col(c)
    diff = lambda x, scale: F.coalesce((x - F.lag(x, 1).over(w)) / scale, F.lit(0.0))
    d = d.withColumns({"d_refl_m10": diff(raw("refl_m10"), 10.0), "d_echo_top": diff(raw("echo_top"), 2.0), "d_ir_tb": diff(raw("ir_tb"), 10.0), "d_graupel": diff(F.col("_g"), 20.0), "graupel_cmax": F.max("_g").over(past) / 40.0, "light_cmean": F.avg("_l").over(past)})
    d = d.withColumns({c: F.col(c) / 40.0 for c in ("graupel_max_r2", "graupel_max_r4", "graupel_mean_r4")})
    return d.select("event_id", "frame", "row", "col", *[F.coalesce(scalar.finite(F.col(c)), F.lit(0.0)).alias(c) for c in NAMES])


def rank_features(features: DataFrame, labels: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """Average precision of each feature by itself against the labels, best first."""
    from stormgrid.operators import metrics

    long = features.join(labels, ["event_id", "frame", "row", "col"]).unpivot(["event_id", "frame", "row", "col", "label"], names, "feature", "value")
    return metrics.ranking(long, ["feature"], "value", F.col("label"), sliced=True).orderBy(F.col("auprc").desc_nulls_last(), "feature")
