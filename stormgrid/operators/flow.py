"""Motion of each pixel between frames, from structure tensors: the shift that best explains, over a box, how a field
changed given its slopes. Only windows and sums run; boxes are prefix sums, so that their size costs nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.operators import forecast, grid

#: Fixed value: echoes below it don't count for a motion.
CLEAR_DBZ = 15.0


def dense(df: DataFrame, keys: list[str], frame: str, value: str, r: int = 7, n: int = S.GRID) -> DataFrame:
    """(keys, frame, row, col, weight, dy, dx) of each pair of successive frames, named by the later one: pixels a frame. df is
    dense; missing values are 0. dy and dx are NULL where the box has no slope in two directions. weight: the later
    frame's echo above CLEAR_DBZ. Fields should be smooth against the motion: slopes are taken to be straight over it."""
    t = Window.partitionBy(*keys, "row", "col").orderBy(frame)
    d = df.select(*keys, frame, "row", "col", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_b"))
    d = d.withColumns({"_a": F.lag("_b").over(t), "_was": F.lag(frame).over(t)}).where(F.col("_was") == F.col(frame) - 1)
    d = d.withColumns({"_m": (F.col("_a") + F.col("_b")) / 2.0, "_dt": F.col("_b") - F.col("_a")})

    def slope(fixed: str, moving: str) -> Column:
        w = Window.partitionBy(*keys, frame, fixed).orderBy(moving)
        return (F.coalesce(F.lead("_m").over(w), F.col("_m")) - F.coalesce(F.lag("_m").over(w), F.col("_m"))) / 2.0

    d = d.repartition(*keys, frame).withColumn("_y", slope("col", "row")).withColumn("_x", slope("row", "col"))
    d = d.withColumns({"tyy": F.col("_y") * F.col("_y"), "txx": F.col("_x") * F.col("_x"), "txy": F.col("_x") * F.col("_y"), "tyt": F.col("_y") * F.col("_dt"), "txt": F.col("_x") * F.col("_dt")})
    d = grid.box_sums(d, [*keys, frame], ["tyy", "txx", "txy", "tyt", "txt"], [r], n)
    yy, xx, xy, yt, xt = (F.round(F.col(f"{k}_r{r}"), 9) for k in ("tyy", "txx", "txy", "tyt", "txt"))
    det = yy * xx - xy * xy
    # a box whose slopes all run one way tells one direction only
    ok = det > 1e-3 * (yy + xx) * (yy + xx)
    return d.select(*keys, frame, "row", "col", F.greatest(F.col("_b") - CLEAR_DBZ, F.lit(0.0)).alias("weight"), F.when(ok, (xy * xt - xx * yt) / det).alias("dy"), F.when(ok, (xy * yt - yy * xt) / det).alias("dx"))


def motion(df: DataFrame, keys: list[str], frame: str, value: str, r: int = 7, n: int = S.GRID, region: int | None = None) -> DataFrame:
    """(keys, dy, dx), or of squares of `region` pixels (keys, region_row, region_col, dy, dx): each pair of frames gives the mean
    motion by weight, and pairs their median. Pairs without weight give none; keys, or regions, without any are not listed."""
    d = dense(df, keys, frame, value, r, n).where("weight > 0 AND dy IS NOT NULL")
    by = list(keys)
    if region:
        d = d.withColumns({"region_row": F.floor(F.col("row") / region).cast("int"), "region_col": F.floor(F.col("col") / region).cast("int")})
        by += ["region_row", "region_col"]
    d = d.groupBy(*by, frame).agg(*((F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c) for c in ("dy", "dx")))
    return d.groupBy(*by).agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in ("dy", "dx")))


def motion_from_features(df: DataFrame, keys: list[str], frame: str, normalised: str = "refl_sfc_n", most: int = 6) -> DataFrame:
    """Motion by cross-correlation of the first feature, brought back to dBZ: missing pixels are the channel's mean there."""
    mean, scale = S.NORM["refl_sfc"]
    return forecast.motion(df.withColumn("_dbz", F.col(normalised) * scale + mean), keys, frame, "_dbz", most)
