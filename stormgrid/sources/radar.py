"""Radar volumes as rows (sweep, elev, az, rng, dbz) onto pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import geo


def decode(raw: Column, gain: float, offset: float, nodata: float, undetect: float) -> Column:
    return F.when((raw != nodata) & (raw != undetect), raw * gain + offset)


def pixels(spark, centre: tuple[float, float], n: int = S.GRID) -> DataFrame:
    side = F.sequence(F.lit(0), F.lit(n - 1))
    d = spark.range(1).select(F.explode(side).alias("row")).withColumn("col", F.explode(side))
    rng, az = geo.range_azimuth(F.col("row"), F.col("col"), *centre)
    return d.withColumns({"rng": rng, "az": az})


def to_pixels(volume: DataFrame, centre: tuple[float, float] = (31.5, 31.5), altitude_km: float = S.CHARGING_LOW_KM, echo_dbz: float = 18.0, az_step: float = 1.0, rng_step: float = 0.5) -> DataFrame:
    """For each pixel: dbz at an altitude, interpolated between the beams that bracket it, echo top and column maximum.

    A pixel takes each sweep's nearest bin, by bin numbers, so the join is an equi join. reason: 0 ok, 1 above the lowest
    beam's reach (overshoot), 2 in the cone over the radar, 3 no data."""
    grid = pixels(volume.sparkSession, centre).withColumns({"_a": F.pmod(F.rint(F.col("az") / az_step), F.lit(360.0 / az_step)).cast("int"), "_r": F.rint(F.col("rng") / rng_step).cast("int")})
    v = volume.withColumns({"_a": F.pmod(F.rint(F.col("az") / az_step), F.lit(360.0 / az_step)).cast("int"), "_r": F.rint(F.col("rng") / rng_step).cast("int")}).select("elev", "_a", "_r", "dbz")
    d = grid.join(v, ["_a", "_r"], "left").withColumn("h", geo.beam_height_km(F.col("rng"), F.col("elev")))
    up = Window.partitionBy("row", "col").orderBy("elev")
    d = d.withColumns({"h2": F.lead("h").over(up), "z2": F.lead("dbz").over(up)})
    at = F.when((F.col("h") <= altitude_km) & (F.col("h2") >= altitude_km), F.col("dbz") + (F.col("z2") - F.col("dbz")) * (altitude_km - F.col("h")) / (F.col("h2") - F.col("h")))
    out = d.groupBy("row", "col").agg(F.max(at).alias("dbz_at"), F.max(F.when(F.col("dbz") >= echo_dbz, F.col("h"))).alias("echo_top"), F.max("dbz").alias("column_max"), F.min("h").alias("_lo"), F.max("h").alias("_hi"))
    reason = F.when(F.col("_lo").isNull(), 3).when(F.col("_lo") > altitude_km, 1).when(F.col("_hi") < altitude_km, 2).when(F.col("dbz_at").isNull(), 3).otherwise(0)
    return out.withColumn("reason", reason.cast("tinyint")).drop("_lo", "_hi")
