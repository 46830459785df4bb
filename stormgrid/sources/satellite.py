"""Satellite readings already decoded to rows: optical lightning flashes, counts of an imager, fields on linear axes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import geo

#: Seconds from the Unix epoch to 2000-01-01 12:00 UTC, from which the lightning mapper counts.
J2000 = 946_728_000
#: Counts have at most 16 bits, so a temperature table has at most so many rows.
MOST_COUNTS = 1 << 16


def flash_frames(flashes: DataFrame, start: float, frames: int, lat0: float, lon0: float, quality: int = 0, pixel: float = S.PIXEL_KM) -> DataFrame:
    """(frame, row, col, flashes) of flashes (lat, lon, offset_s since J2000, quality) no worse than `quality`. A frame
    begins every STEP_MIN minutes from `start`, in seconds of the Unix epoch; what lies outside frames or grid goes."""
    row, col = geo.to_rowcol(F.col("lat"), F.col("lon"), lat0, lon0, pixel=pixel)
    frame = F.floor((F.col("offset_s") + (J2000 - start)) / (60.0 * S.STEP_MIN))
    d = flashes.where(F.col("quality") <= quality).select(frame.alias("frame"), F.rint(row).cast("int").alias("row"), F.rint(col).cast("int").alias("col"))
    inside = F.col("frame").between(0, frames - 1) & F.col("row").between(0, S.GRID - 1) & F.col("col").between(0, S.GRID - 1)
    return d.where(inside).groupBy("frame", "row", "col").agg(F.count(F.lit(1)).alias("flashes"))


def kelvin(readings: DataFrame, count: Column, table: DataFrame) -> DataFrame:
    """readings with `kelvin`, looked up in table (idx from 0, kelvin); counts beyond the table take its nearest end."""
    rows = table.agg(F.count(F.lit(1)), F.max("idx")).first()
    if not 0 < rows[0] <= MOST_COUNTS or rows[1] != rows[0] - 1:
        raise ValueError(f"a temperature table lists its counts from 0, at most {MOST_COUNTS}")
    idx = F.greatest(F.lit(0), F.least(count, F.lit(rows[1]))).cast("long")
    return readings.withColumn("idx", idx).join(F.broadcast(table.select(F.col("idx").cast("long").alias("idx"), "kelvin")), "idx", "left").drop("idx")


def linear_axes(spark: SparkSession, field: DataFrame, keys: list[str], value: str, shape: tuple[int, int], bounds: tuple[float, float, float, float], lat0: float, lon0: float) -> DataFrame:
    """field (keys, row, col, value), whose rows and columns run evenly from upper to lower latitude and from left to right
    longitude (bounds), on the grid around (lat0, lon0): the nearest reading, NULL outside. The list of target pixels is
    one grid, which is broadcast."""
    upper, lower, left, right = bounds
    h, w = shape
    k = F.col("id")
    t = spark.range(S.GRID * S.GRID).select(F.floor(k / S.GRID).cast("int").alias("to_row"), (k % S.GRID).cast("int").alias("to_col"))
    mid = (S.GRID - 1) / 2
    lat = lat0 + (mid - F.col("to_row")) * (S.PIXEL_KM / geo.KM_GRID)
    lon = lon0 + (F.col("to_col") - mid) * (S.PIXEL_KM / (geo.KM_GRID * math.cos(math.radians(lat0))))
    t = t.select("to_row", "to_col", ((upper - lat) / (upper - lower) * (h - 1)).alias("r"), ((lon - left) / (right - left) * (w - 1)).alias("c"))
    near = lambda x, n: F.greatest(F.lit(0), F.least(F.rint(x).cast("int"), F.lit(n - 1)))
    t = t.select("to_row", "to_col", near(F.col("r"), h).alias("row"), near(F.col("c"), w).alias("col"), (F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1)).alias("inside"))
    d = field.select(*keys, "row", "col", F.col(value).alias("_v")).join(F.broadcast(t), ["row", "col"])
    return d.select(*keys, F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.when(F.col("inside"), F.col("_v")).alias(value))
