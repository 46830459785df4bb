"""A blend of two forecasts, fitted on validation data: a weight a lead, and a calibration of the mix.

Brier's score is a quadratic in the weight, so three sums over the pixels of a lead give it at every weight; and all
candidates of the calibration are sums of one aggregation. The data are read twice, whatever the number of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.operators import forecast

# Weights tried, and slopes and offsets tried on the logit of the mix.
WEIGHTS, SLOPES, OFFSETS = 21, (0.6, 0.8, 1.0, 1.25, 1.6, 2.0), (-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5)
EPS = 1e-6
DIGITS = 9


def weights(df: DataFrame, lead: str, first: str, second: str, obs: str, smooth: bool = True, monotone: bool = False) -> DataFrame:
    """(lead, weight_raw, weight, slope): the weight of `first` of least Brier score, the lowest of equal ones, as a three-point mean
    over leads, and non-increasing if asked for; slope: of the weights over leads, less than 0 where the first declines. A dozen rows."""
    raw = forecast.blend_weights(df, [lead], first, second, obs, WEIGHTS).select(lead, F.col("weight").alias("weight_raw"), F.col("weight"))
    d = forecast.smoothed_weights(raw, lead) if smooth else raw
    if monotone:
        rows = d.orderBy(lead).collect()  # one row a lead
        d = df.sparkSession.createDataFrame([(r[lead], r["weight_raw"], v) for r, v in zip(rows, forecast.pooled([r["weight"] for r in rows]), strict=True)], d.schema)
    d = d.withColumn("weight", F.least(F.greatest("weight", F.lit(0.0)), F.lit(1.0)))
    return d.withColumn("slope", F.regr_slope("weight", lead).over(Window.partitionBy()))


def _mixed(df: DataFrame, fitted: DataFrame, lead: str, first: str, second: str) -> DataFrame:
    """df with `mix` and its logit; fitted has one row a lead, so it is broadcast."""
    d = df.join(F.broadcast(fitted.select(lead, F.col("weight").alias("_w"))), lead)
    d = d.withColumn("mix", F.least(F.greatest(F.col("_w") * F.col(first) + (1.0 - F.col("_w")) * F.col(second), F.lit(0.0)), F.lit(1.0)))
    return d.withColumn("_q", F.least(F.greatest("mix", F.lit(EPS)), F.lit(1.0 - EPS))).withColumn("_z", F.log(F.col("_q") / (1.0 - F.col("_q")))).drop("_w", "_q")


def calibration(df: DataFrame, fitted: DataFrame, lead: str, first: str, second: str, obs: str) -> DataFrame:
    """One row: cal_a, cal_b (1 and 0 if no candidate is better than none), brier_uncalibrated, brier_calibrated."""
    d = _mixed(df, fitted, lead, first, second)
    at = [(a, b) for a in SLOPES for b in OFFSETS]
    sums = [f"round(avg(pow(1 / (1 + exp(-({a}D * _z + {b}D))) - {obs}, 2)), {DIGITS}) AS _c{i}" for i, (a, b) in enumerate(at)]
    d = d.agg(F.expr(f"round(avg((mix - {obs}) * (mix - {obs})), {DIGITS})").alias("_none"), *map(F.expr, sums))
    order = ["struct(_none AS brier, -1 AS i, 1.0D AS a, 0.0D AS b)", *(f"struct(_c{i} AS brier, {i} AS i, {a}D AS a, {b}D AS b)" for i, (a, b) in enumerate(at))]
    d = d.selectExpr("_none AS brier_uncalibrated", f"array_min(array({', '.join(order)})) AS best")
    return d.select(F.col("best.a").alias("cal_a"), F.col("best.b").alias("cal_b"), "brier_uncalibrated", F.col("best.brier").alias("brier_calibrated"))


def apply(df: DataFrame, fitted: DataFrame, a: float, b: float, lead: str, first: str, second: str, out: str = "prob") -> DataFrame:
    """df with the calibrated mix."""
    d = _mixed(df, fitted, lead, first, second)
    p = F.col("mix") if (a, b) == (1.0, 0.0) else 1.0 / (1.0 + F.exp(-(a * F.col("_z") + b)))
    return d.withColumn(out, p).drop("mix", "_z")
