"""Grids as rows: densifying, rasterising, stencils, shifts and resampling.

Stencils are two window passes (rows, then columns), so a grid is sorted twice whatever the radius. Windows are bounded by
a grid's side; keys (event, frame) partition them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S


def dense(df: DataFrame, keys: list[str], n: int = S.GRID) -> DataFrame:
    """df with a row for every pixel of each key's grid; missing pixels have NULLs."""
    side = F.sequence(F.lit(0), F.lit(n - 1))
    every = df.select(*keys).distinct().withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    return every.join(df, [*keys, "row", "col"], "left")


def rasterise(points: DataFrame, row: Column, col: Column, keys: list[str], weight: Column, n: int = S.GRID, out: str = "density") -> DataFrame:
    """Sum of weights of points in each pixel; what falls outside goes."""
    p = points.withColumns({"row": F.rint(row).cast("int"), "col": F.rint(col).cast("int"), "_w": weight})
    return p.where(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)).groupBy(*keys, "row", "col").agg(F.sum("_w").alias(out))


def scattered_max(points: DataFrame, row: Column, col: Column, keys: list[str], value: str, n: int = S.GRID) -> DataFrame:
    """The largest valid value of the points in each pixel; pixels without one are not listed."""
    p = points.select(*keys, F.rint(row).cast("int").alias("row"), F.rint(col).cast("int").alias("col"), S.valid(value).alias(value)).where(F.col(value).isNotNull())
    return p.where(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)).groupBy(*keys, "row", "col").agg(F.max(value).alias(value))


def _along(keys: list[str], fixed: str, moving: str, r: int | None = None):
    w = Window.partitionBy(*keys, fixed).orderBy(moving)
    return w.rangeBetween(-r, r) if r is not None else w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def box_max(df: DataFrame, keys: list[str], value: str, r: int, out: str) -> DataFrame:
    """Largest value within r pixels on either axis; the box is cut at the edge."""
    if r <= 0:
        return df.withColumn(out, F.col(value))
    d = df.withColumn("_m", F.max(value).over(_along(keys, "row", "col", r)))
    return d.withColumn(out, F.max("_m").over(_along(keys, "col", "row", r))).drop("_m")


def box_mean(df: DataFrame, keys: list[str], value: str, r: int, out: str, n: int = S.GRID) -> DataFrame:
    """Mean of a box of side 2r + 1 over a dense grid whose edge pixels go on outside."""
    if r <= 0:
        return df.withColumn(out, F.col(value))

    def one(d: DataFrame, src: str, to: str, fixed: str, moving: str) -> DataFrame:
        full = _along(keys, fixed, moving)
        s = F.sum(src).over(_along(keys, fixed, moving, r))
        low = F.greatest(F.lit(0), r - F.col(moving)) * F.first(src).over(full)
        high = F.greatest(F.lit(0), F.col(moving) + (r - n + 1)) * F.last(src).over(full)
        return d.withColumn(to, (s + low + high) / (2 * r + 1))

    return one(one(df, value, "_m", "row", "col"), "_m", out, "col", "row").drop("_m")


def smooth(df: DataFrame, keys: list[str], value: str, out: str, n: int = S.GRID) -> DataFrame:
    """3 x 3 kernel 1-2-1 by 1-2-1 over 16, edges repeated: two passes of 1-2-1 over 4."""

    def one(d: DataFrame, src: str, to: str, fixed: str, moving: str) -> DataFrame:
        w = Window.partitionBy(*keys, fixed).orderBy(moving)
        v = F.col(src)
        return d.withColumn(to, (F.coalesce(F.lag(src).over(w), v) + 2 * v + F.coalesce(F.lead(src).over(w), v)) / 4)

    return one(one(df, value, "_s", "row", "col"), "_s", out, "col", "row").drop("_s")


def shift(df: DataFrame, keys: list[str], value: str, dy: Column, dx: Column, out: str, n: int = S.GRID) -> DataFrame:
    """Field moved by (dy, dx) pixels, bilinear, zero from outside: each pixel gives its value to at most four others."""
    d = df.where(F.col(value) != 0).withColumns({"_fy": F.floor(dy), "_fx": F.floor(dx), "_ay": dy - F.floor(dy), "_ax": dx - F.floor(dx)})
    part = lambda a, b: F.struct((F.col("row") + F.col("_fy") + a).cast("int").alias("row"), (F.col("col") + F.col("_fx") + b).cast("int").alias("col"), (F.col(value) * (F.col("_ay") if a else 1 - F.col("_ay")) * (F.col("_ax") if b else 1 - F.col("_ax"))).alias("w"))
    d = d.select(*keys, F.explode(F.array(*[part(a, b) for a in (0, 1) for b in (0, 1)])).alias("p")).select(*keys, "p.*")
    moved = d.where((F.col("w") != 0) & F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)).groupBy(*keys, "row", "col").agg(F.sum("w").alias(out))
    return df.join(moved, [*keys, "row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def coarsen_max(df: DataFrame, keys: list[str], value: str, k: int, out: str, n: int = S.GRID) -> DataFrame:
    """Largest value of k x k blocks; rows and columns that fill no block go."""
    m = n // k * k
    d = df.where((F.col("row") < m) & (F.col("col") < m))
    return d.groupBy(*keys, F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(F.max(value).alias(out))


def downsample(df: DataFrame, k: int) -> DataFrame:
    return df.where((F.col("row") % k == 0) & (F.col("col") % k == 0)).withColumns({"row": F.floor(F.col("row") / k).cast("int"), "col": F.floor(F.col("col") / k).cast("int")})


def upsample(df: DataFrame, k: int) -> DataFrame:
    """Every pixel repeated to k x k."""
    part = F.sequence(F.lit(0), F.lit(k - 1))
    d = df.withColumn("_i", F.explode(part)).withColumn("_j", F.explode(part))
    return d.withColumns({"row": (F.col("row") * k + F.col("_i")).cast("int"), "col": (F.col("col") * k + F.col("_j")).cast("int")}).drop("_i", "_j")


def crop_centre(df: DataFrame, n: int, m: int) -> DataFrame:
    """The middle m x m of an n x n grid, renumbered from 0; where m is larger, pixels keep their place in a wider grid."""
    off = (n - m) // 2
    return df.withColumns({"row": F.col("row") - off, "col": F.col("col") - off}).where(F.col("row").between(0, m - 1) & F.col("col").between(0, m - 1))


def resample_area(df: DataFrame, keys: list[str], value: str, n: int, m: int, out: str, least: float = 0.5) -> DataFrame:
    """n x n to m x m by overlap of areas; a pixel is NULL where valid input covers less than `least` of it.

    Each input pixel gives itself to the output pixels it overlaps (an arithmetic sequence on either axis)."""
    scale = m / n

    def spread(d: DataFrame, axis: str) -> DataFrame:
        lo, hi = F.col(axis) * scale, (F.col(axis) + 1) * scale
        d = d.withColumn("_o", F.explode(F.sequence(F.floor(lo).cast("int"), F.least(F.ceil(hi).cast("int") - 1, F.lit(m - 1)))))
        return d.withColumn(f"_w{axis}", F.least(hi, F.col("_o") + 1) - F.greatest(lo, F.col("_o"))).withColumn(axis, F.col("_o")).drop("_o")

    d = spread(spread(df, "row"), "col").withColumn("_w", F.col("_wrow") * F.col("_wcol")).where("_w > 1e-12")
    ok = F.when(F.col(value).isNotNull(), F.col("_w"))
    return d.groupBy(*keys, "row", "col").agg(F.when(F.sum(ok) / F.sum("_w") >= least, F.sum(ok * F.col(value)) / F.sum(ok)).alias(out))


def mean_regrid(points: DataFrame, row: Column, col: Column, keys: list[str], value: str, out: str, n: int = S.GRID) -> DataFrame:
    """Mean of the points that fall in each pixel; pixels without one are missing."""
    p = points.withColumns({"row": F.rint(row).cast("int"), "col": F.rint(col).cast("int")})
    return p.where(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1)).groupBy(*keys, "row", "col").agg(F.avg(value).alias(out))


def spread_radius(step: int) -> int:
    """Pixels by which a forecast widens after so many steps: the root, rounded half to even."""
    return round(math.sqrt(step))


def box_sums(df: DataFrame, keys: list[str], fields: list[str], radii: list[int], n: int = S.GRID) -> DataFrame:
    """{field}_r{r} for every field and radius: the sum over the box of side 2r + 1 of a dense grid whose edge pixels go on
    outside. Prefix sums along rows, then along columns: a box is a difference of two of them, whatever its radius. A
    grid's rows come together once, and both passes sort in place."""

    def along(d: DataFrame, names: dict[str, tuple[str, int]], fixed: str, moving: str) -> DataFrame:
        # SQL text: as many Column objects would take longer to make than the job to run
        w = f"PARTITION BY {', '.join(keys)}, {fixed} ORDER BY {moving}"
        whole = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        sources = sorted({s for s, _ in names.values()})
        d = d.selectExpr("*", *(f"{f} AS _{k}_{s}" for s in sources for k, f in (("sum", f"sum({s}) OVER ({w} ROWS UNBOUNDED PRECEDING)"), ("first", f"first({s}) {whole}"), ("last", f"last({s}) {whole}"), ("all", f"sum({s}) {whole}"))))
        box = lambda s, r: f"coalesce(lead(_sum_{s}, {r}) OVER ({w}), _all_{s}) - coalesce(lag(_sum_{s}, {r + 1}) OVER ({w}), 0) + greatest(0, {r} - {moving}) * _first_{s} + greatest(0, {moving} + {r - n + 1}) * _last_{s}"
        kept = [c for c in d.columns if not c.startswith(("_sum_", "_first_", "_last_", "_all_")) and c not in sources or c in fields]
        return d.selectExpr(*kept, *(f"{box(*at)} AS {name}" for name, at in names.items()))

    half = {f"_x_{f}_r{r}": (f, r) for f in fields for r in radii}
    d = along(df.repartition(*keys), half, "row", "col")
    return along(d, {name.removeprefix("_x_"): (name, r) for name, (_, r) in half.items()}, "col", "row")


def crop_or_pad(df: DataFrame, keys: list[str], value: str, n: int, m: int) -> DataFrame:
    """The middle m x m of an n x n grid, or that grid in the middle of a wider one, whose new pixels are there with NULL.
    Half a pixel too many goes to, or comes from, the upper left when cropping, the lower right when padding."""
    if m <= n:
        return crop_centre(df.select(*keys, "row", "col", value), n, m)
    low = -((n - m) // 2)
    d = df.select(*keys, (F.col("row") + low).alias("row"), (F.col("col") + low).alias("col"), value)
    return dense(d, keys, m).select(*keys, "row", "col", value)


def to_config_grid(df: DataFrame, keys: list[str], value: str, n: int, native_km: float, side: int = S.GRID, pixel: float = S.PIXEL_KM) -> DataFrame:
    """A field of n x n pixels of native_km, cut or padded to the domain about its centre, on the domain's grid by overlap of
    areas. Pixels that are not listed count as missing."""
    need = round(side * pixel / native_km)
    d = crop_or_pad(df, keys, value, n, need)
    # what is missing has to be there: it counts against a pixel's valid share
    d = dense(d, keys, need).select(*keys, "row", "col", value)
    return resample_area(d, keys, value, need, side, value)


def nearest_regrid(points: DataFrame, keys: list[str], value: str, lat0: float, lon0: float, n: int = S.GRID, pixel: float = S.PIXEL_KM) -> DataFrame:
    """A dense grid about (lat0, lon0): the mean of the points in each pixel, NULL where none is. Points far off are left out
    by plain bounds on latitude and longitude, which reach a scan's statistics, before any is projected."""
    from stormgrid.functions import geo

    half_lat = n * pixel / 2.0 / geo.KM_GRID * 1.6
    half_lon = n * pixel / 2.0 / (geo.KM_GRID * max(math.cos(math.radians(lat0)), 0.1)) * 1.6
    near = points.where(F.col("lat").between(lat0 - half_lat, lat0 + half_lat) & F.col("lon").between(lon0 - half_lon, lon0 + half_lon))
    row, col = geo.to_rowcol(F.col("lat"), F.col("lon"), lat0, lon0, n, pixel)
    side = F.sequence(F.lit(0), F.lit(n - 1))
    every = points.select(*keys).distinct().withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    return every.join(mean_regrid(near, row, col, keys, value, value, n), [*keys, "row", "col"], "left")
