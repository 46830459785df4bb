"""Archive events from catalog, rasters and flash lists to the cell table: decode, regrid, surrogates, quality control.

Rasters come as rows (id, img_type, frame, row, col, raw), however their files were read. An event without vertically
integrated liquid (vil) is left out; one without infrared takes a clear sky for the surrogates and has none itself; one
without a flash list has no lightning channel, and no target. Reflectivity, charging-layer reflectivity and echo top
are surrogates made from the other two; they can be kept out, as they hold nothing of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import scalar
from stormgrid.operators import grid, qc
from stormgrid.sources import flashes as fl

CLEAR_SKY_K = 290.0


@dataclass(frozen=True)
class Native:
    """Pixels a side and km a pixel of each image type, and seconds at which frames begin."""

    vil: tuple[int, float] = (384, 1.0)
    ir107: tuple[int, float] = (192, 2.0)
    lght: tuple[int, float] = (48, 8.0)
    edges: tuple[float, ...] = tuple(-7200.0 + 300.0 * k for k in range(49))


def load(catalog: DataFrame, rasters: DataFrame, flash_lists: DataFrame, native: Native = Native(), event_types: list[str] | None = None, surrogates: bool = True, run_qc: bool = True, charging_km: float = S.CHARGING_LOW_KM) -> DataFrame:  # noqa: B008
    """(event_id, frame, row, col, channels, y). catalog: (id, img_type[, event_type, llat, llon, ulat, ulon]); flash_lists:
    (id, t, lat, lon, x, y). Rows are the pixels where some channel has a reading, and for events with flashes all others
    too, since no lightning is a reading."""
    c = catalog.where(F.col("event_type").isin(event_types)) if event_types else catalog
    has = c.groupBy("id").agg(*(F.max(F.col("img_type") == t).alias(f"_{t}") for t in ("vil", "ir107", "lght")), *(F.first(x, True).alias(x) for x in ("llat", "llon", "ulat", "ulon") if x in catalog.columns)).where("_vil")
    for x in ("llat", "llon", "ulat", "ulon"):
        if x not in has.columns:
            has = has.withColumn(x, F.lit(None).cast("double"))
    r = rasters.join(has.select("id"), "id", "left_semi")
    at = ["id", "frame"]

    def plane(kind: str, decoded, shape: tuple[int, float], out: str) -> DataFrame:
        d = r.where(F.col("img_type") == kind).select(*at, "row", "col", decoded(F.col("raw").cast("double")).alias(out))
        return grid.to_config_grid(d, at, out, *shape)

    d = plane("vil", scalar.decode_vil, native.vil, "vil").join(plane("ir107", scalar.decode_ir, native.ir107, "ir_tb"), [*at, "row", "col"], "full")
    side, km = native.lght
    lit = has.where("_lght")
    g = fl.flash_grid(flash_lists, lit.select("id", "llat", "llon", "ulat", "ulon"), "id", list(native.edges), side).withColumn("flashes", F.col("flashes").cast("double"))
    frames = lit.select("id", F.explode(F.sequence(F.lit(0), F.lit(len(native.edges) - 1))).alias("frame"))
    pixels = F.sequence(F.lit(0), F.lit(side - 1))
    g = frames.withColumn("row", F.explode(pixels)).withColumn("col", F.explode(pixels)).join(g, [*at, "row", "col"], "left").select(*at, "row", "col", F.coalesce("flashes", F.lit(0.0)).alias("light_dens"))
    g = grid.to_config_grid(g, at, "light_dens", side, km).withColumn("light_dens", F.greatest(F.col("light_dens") / (km / S.PIXEL_KM) ** 2, F.lit(0.0)))
    d = d.join(g, [*at, "row", "col"], "full").where(F.coalesce("vil", "ir_tb", "light_dens").isNotNull()).join(has.select("id", "_ir107"), "id")
    ir = F.when(F.col("_ir107"), F.col("ir_tb")).otherwise(F.lit(CLEAR_SKY_K))
    ok = F.lit(surrogates) & F.col("vil").isNotNull() & ir.isNotNull()
    top = scalar.top_from_ir(ir, F.col("vil"))
    d = d.select(F.col("id").alias("event_id"), "frame", "row", "col", F.when(ok, scalar.surface_from_vil(F.col("vil"))).alias("refl_sfc"), F.when(ok, scalar.charging_from_vil(F.col("vil"), ir, top, charging_km)).alias("refl_m10"), F.when(ok, top).alias("echo_top"), "vil", "ir_tb", "light_dens",
                 F.coalesce("light_dens", F.lit(0.0)).alias("y"))
    return qc.quality_control(d).drop("clutter", "bright_band") if run_qc else d
