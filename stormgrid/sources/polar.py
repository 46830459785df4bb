"""Polar volumes (volume, elev, az, rng, dbz) onto pixels: horizontal gather, then levels along each pixel's beams.

Each sweep's azimuths and gates are its own and need not be evenly spaced. They are lists as long as a turn of the antenna
and a beam, so a pixel finds its two azimuths and two gates in them, and only then joins the readings, by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import geo

# Why a pixel has no value at the altitude asked for.
REASONS = {0: "ok", 1: "overshoot", 2: "cone of silence", 3: "no data"}


def gathered(volume: DataFrame, key: str = "volume", method: str = "nearest", centre: tuple[float, float] = (31.5, 31.5), n: int = S.GRID) -> DataFrame:
    """(key, elev, row, col, rng_px, dbz): each sweep at each pixel, NULL where it has nothing. nearest: the nearest azimuth
    and gate; idw: the two nearest azimuths by the two gates about the pixel, weighed by inverse distance, to six
    digits, so that readings of one value average to it."""
    if method not in ("nearest", "idw"):
        raise ValueError("method is nearest or idw")
    axes = volume.groupBy(key, "elev").agg(F.array_sort(F.collect_set("az")).alias("azs"), F.array_sort(F.collect_set("rng")).alias("rngs"))
    side = F.sequence(F.lit(0), F.lit(n - 1))
    d = axes.withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    rng, az = geo.range_azimuth(F.col("row"), F.col("col"), *centre)
    d = d.withColumns({"rng_px": rng, "az_px": az})
    turn = "abs(pmod(a - az_px + 180, 360) - 180)"
    d = d.selectExpr("*", f"array_sort(transform(azs, a -> struct({turn} AS d, a AS az))) AS near", "greatest(size(filter(rngs, r -> r < rng_px)), 1) AS i0")
    d = d.selectExpr("*", "rngs[i0 - 1] AS r0", "rngs[least(i0, size(rngs) - 1)] AS r1", "rng_px >= rngs[0] - if(size(rngs) > 1, rngs[1] - rngs[0], 0) AND rng_px <= rngs[size(rngs) - 1] AS inside")
    pick = "array(struct(near[0].az AS az, near[0].d AS daz, if(abs(r1 - rng_px) < abs(r0 - rng_px), r1, r0) AS rng))" if method == "nearest" else \
        "flatten(transform(slice(near, 1, 2), a -> transform(array(r0, r1), r -> struct(a.az AS az, a.d AS daz, r AS rng))))"
    at = [key, "elev", "row", "col", "rng_px"]
    want = d.selectExpr(*at, f"explode(if(inside, {pick}, array())) AS p").selectExpr(*at, "p.*")
    got = want.join(volume.select(key, "elev", "az", "rng", S.valid("dbz").alias("dbz")), [key, "elev", "az", "rng"]).where("dbz IS NOT NULL")
    w = F.lit(1.0) / F.greatest(F.hypot(F.radians("daz") * F.greatest("rng_px", F.lit(1e-3)), F.abs(F.col("rng") - F.col("rng_px"))), F.lit(1e-3))
    got = got.groupBy(key, "elev", "row", "col").agg((F.round(F.sum(w * F.col("dbz")) / F.sum(w), 6) if method == "idw" else F.max("dbz")).alias("dbz"))
    return d.select(*at).join(got, [key, "elev", "row", "col"], "left")


def to_levels(volume: DataFrame, key: str = "volume", method: str = "nearest", altitude_km: float = S.CHARGING_LOW_KM, echo_dbz: float = 18.0, centre: tuple[float, float] = (31.5, 31.5), n: int = S.GRID) -> DataFrame:
    """(key, row, col, dbz_at, reason, echo_top, lower_bound, column_max, lowest): dbz at an altitude between the two beams about
    it, or why there is none (REASONS); the height of the highest echo, between its beam and the next if that is weaker, a
    lower bound on the last beam; the largest and the lowest beam's reading."""
    d = gathered(volume, key, method, centre, n).withColumn("h", geo.beam_height_km(F.col("rng_px"), F.col("elev")))
    up = Window.partitionBy(key, "row", "col").orderBy("elev")
    d = d.withColumns({"h2": F.lead("h").over(up), "z2": F.lead("dbz").over(up)})
    # beams rise with elevation, so the last one at or below the altitude is the one whose next is above it, or the topmost
    under = F.col("h") <= altitude_km
    about = under & (F.col("h2") > altitude_km)
    w = (altitude_km - F.col("h")) / F.greatest(F.col("h2") - F.col("h"), F.lit(1e-6))
    part = F.when(F.col("h2").isNotNull() & F.col("z2").isNotNull() & (F.col("dbz") > F.col("z2")), (F.col("dbz") - echo_dbz) / F.greatest(F.col("dbz") - F.col("z2"), F.lit(1e-6))).otherwise(0.0)
    top = F.struct(F.col("elev"), (F.col("h") + part * F.coalesce(F.col("h2") - F.col("h"), F.lit(0.0))).alias("h"), F.col("h2").isNull().alias("last"))
    out = d.groupBy(key, "row", "col").agg(F.max(F.when(about, (1.0 - w) * F.col("dbz") + w * F.col("z2"))).alias("dbz_at"), F.count_if(under).alias("_under"), F.count(F.lit(1)).alias("_beams"),
                                          F.max(F.when(F.col("dbz") >= echo_dbz, top)).alias("_top"), F.max("dbz").alias("column_max"), F.min_by("dbz", "elev").alias("lowest"))
    reason = F.when(F.col("_under") == 0, 1).when(F.col("_under") == F.col("_beams"), 2).when(F.col("dbz_at").isNull(), 3).otherwise(0).cast("int")
    return out.select(key, "row", "col", "dbz_at", reason.alias("reason"), F.col("_top.h").alias("echo_top"), F.coalesce("_top.last", F.lit(False)).alias("lower_bound"), "column_max", "lowest")
