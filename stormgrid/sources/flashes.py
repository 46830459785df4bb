"""Flash lists of archive events onto frames that begin at given seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormgrid.operators import grid


def edge_index(value: Column, edges: list[float]) -> Column:
    """How many of the sorted edges are at or below value, less one: the interval that begins with that edge, -1 before the
    first. Binary search as an expression: a value is compared log2(n) times. NULL and NaN have no interval."""
    if list(edges) != sorted(edges) or not edges:
        raise ValueError("edges must be sorted, and there must be one")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(value >= float(edges[mid]), search(mid, hi)).otherwise(search(lo, mid - 1))

    inner = F.when(value < float(edges[0]), -1).otherwise(search(0, len(edges) - 1))
    return F.when(value.isNotNull() & ~F.isnan(value), inner)


def flash_grid(flashes: DataFrame, events: DataFrame, key: str, edges: list[float], pixels: int = 48) -> DataFrame:
    """(key, frame, row, col, flashes). flashes: (key, t, lat, lon, x, y), t in the seconds of edges. x and y are pixels if
    none of an event's reaches twice the grid; otherwise places are binned between the event's corners: events (key, llat,
    llon, ulat, ulon), NULL where unknown, which is an error for an event that needs them. The last frame is open."""
    like = flashes.groupBy(key).agg((F.max(F.abs("x")) < 2 * pixels).alias("_x"), (F.max(F.abs("y")) < 2 * pixels).alias("_y"))
    d = flashes.join(like.select(key, F.coalesce(F.col("_x") & F.col("_y"), F.lit(False)).alias("_px")), key).join(events, key)
    side = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(1e-9))
    unknown = F.raise_error(F.concat(F.lit("x and y of "), F.col(key).cast("string"), F.lit(" are no pixels, and its corners are unknown")))
    known = F.col("ulat").isNotNull() & F.col("llat").isNotNull() & F.col("ulon").isNotNull() & F.col("llon").isNotNull()
    place = lambda x, by: F.when(F.col("_px"), F.col(x)).when(known, by).otherwise(unknown.cast("double"))
    row = place("y", (F.col("ulat") - F.col("lat")) / side("ulat", "llat") * pixels)
    col = place("x", (F.col("lon") - F.col("llon")) / side("ulon", "llon") * pixels)
    d = d.withColumn("frame", edge_index(F.col("t"), edges)).where("frame >= 0")
    return grid.rasterise(d, row, col, [key, "frame"], F.lit(1).cast("long"), pixels, "flashes")


def flash_counts(events: DataFrame, gridded: DataFrame, key: str) -> DataFrame:
    """Every event with its flashes and struck pixels; one that has none in the lists has zeros."""
    per = gridded.groupBy(key).agg(F.sum("flashes").alias("flashes"), F.count(F.lit(1)).alias("struck"))
    return events.select(key).join(per, key, "left").select(key, F.coalesce("flashes", F.lit(0)).alias("flashes"), F.coalesce("struck", F.lit(0)).alias("struck"))
