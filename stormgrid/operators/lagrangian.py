"""Fields in the frame that moves with the storms, and back. Sparse: pixels that are not listed are 0.

A pixel gives its value to at most four others, by bilinear weights; what leaves the grid is lost, nothing wraps. Sums are
rounded to nine digits, so that half a pixel is half a pixel in whatever order its parts are added. Zero motion changes
nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormgrid import schema as S

DIGITS = 9


def warp(df: DataFrame, keys: list[str], value: str, dy: Column, dx: Column, n: int = S.GRID) -> DataFrame:
    """(keys, row, col, value): content moved by (dy, dx) pixels. keys tell grids apart."""
    d = df.select(*keys, "row", "col", F.col(value).cast("double").alias("_v"), dy.cast("double").alias("_dy"), dx.cast("double").alias("_dx")).where("_v <> 0")
    d = d.selectExpr(*keys, "row", "col", "_v", "CAST(floor(_dy) AS int) AS _y", "CAST(floor(_dx) AS int) AS _x", "_dy - floor(_dy) AS _ay", "_dx - floor(_dx) AS _ax")
    part = lambda i, j: f"struct(row + _y + {i} AS row, col + _x + {j} AS col, _v * {'_ay' if i else '(1 - _ay)'} * {'_ax' if j else '(1 - _ax)'} AS w)"
    d = d.selectExpr(*keys, f"explode(array({', '.join(part(i, j) for i in (0, 1) for j in (0, 1))})) AS p").selectExpr(*keys, "p.*")
    d = d.where(f"w <> 0 AND row BETWEEN 0 AND {n - 1} AND col BETWEEN 0 AND {n - 1}")
    return d.groupBy(*keys, "row", "col").agg(F.round(F.sum("w"), DIGITS).alias(value)).where(F.col(value) != 0)


def compensate_inputs(df: DataFrame, keys: list[str], frame: str, last: int, value: str, dy: str, dx: str, n: int = S.GRID) -> DataFrame:
    """Input frames aligned with the last one: a frame `lag` steps older is carried on by lag times the motion."""
    lag = F.lit(last) - F.col(frame)
    return warp(df, [*keys, frame], value, F.col(dy) * lag, F.col(dx) * lag, n)


def compensate_targets(df: DataFrame, keys: list[str], lead: str, observed: Column, dy: str, dx: str, n: int = S.GRID) -> DataFrame:
    """(keys, lead, row, col) of targets that hold in the frame of the last input: made yes or no first, moved back by lead
    times the motion, and yes where half a pixel or more arrives. lead counts steps."""
    d = df.where(observed).withColumn("_one", F.lit(1.0))
    return warp(d, [*keys, lead], "_one", -F.col(dy) * F.col(lead), -F.col(dx) * F.col(lead), n).where("_one >= 0.5").drop("_one")


def decompensate(df: DataFrame, keys: list[str], lead: str, prob: str, dy: str, dx: str, n: int = S.GRID) -> DataFrame:
    """Probabilities of the moving frame at their places on the ground, by the same motion."""
    d = warp(df, [*keys, lead], prob, F.col(dy) * F.col(lead), F.col(dx) * F.col(lead), n)
    return d.withColumn(prob, F.least(F.greatest(prob, F.lit(0.0)), F.lit(1.0)))


def _round_trip(df: DataFrame, motion: DataFrame, keys: list[str], n: int) -> DataFrame:
    there = compensate_targets(df, keys, "lead", F.lit(True), "dy", "dx", n).withColumn("p", F.lit(1.0))
    return decompensate(there.join(motion, keys), keys, "lead", "p", "dy", "dx", n).where("p >= 0.5").select(*keys, "lead", "row", "col")


def coverage(positives: DataFrame, motion: DataFrame, keys: list[str], leads: int = S.N_OUT, n: int = S.GRID) -> DataFrame:
    """What a forecast in the moving frame can reach at best: a row a lead (steps), and one for all where lead is NULL, with
    n_positive, recoverable_frac (positives that come back from there and back) and grid_coverage_frac (pixels that do).
    positives: (keys, lead, row, col) observed, each once; motion: (keys, dy, dx) in pixels a step, one row for each of keys."""
    at = ["lead", "row", "col"]
    back = _round_trip(positives.join(motion, keys), motion, keys, n).withColumn("_back", F.lit(1))
    hit = positives.select(*keys, *at).join(back, [*keys, *at], "left").groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.count("_back").alias("back"))
    side = F.sequence(F.lit(0), F.lit(n - 1))
    whole = motion.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(leads)))).withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    geo = _round_trip(whole, motion, keys, n).groupBy("lead").agg(F.count(F.lit(1)).alias("px"))
    of = motion.agg((F.count(F.lit(1)) * (n * n)).alias("all_px")).withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(leads))))
    d = of.join(hit, "lead", "left").join(geo, "lead", "left")
    d = d.rollup("lead").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "back", "px", "all_px")))
    return d.select("lead", F.col("n").alias("n_positive"), F.round(F.try_divide(F.col("back").cast("double"), F.col("n")), 6).alias("recoverable_frac"), F.round(F.try_divide(F.col("px").cast("double"), F.col("all_px")), 6).alias("grid_coverage_frac"))
