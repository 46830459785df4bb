"""Distances from stations to strikes, alert levels, storm cells."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import geo

NEAR_KM, FAR_KM = 15.0, 50.0


def near_strikes(stations: DataFrame, strikes: DataFrame, key: str, near: float = NEAR_KM, far: float = FAR_KM, cell_deg: float = 1.0) -> DataFrame:
    """Strikes within near and far km of each station, and the nearest of them in km.

    Points meet in cells of a lattice of cell_deg, which is wider than `far` reaches on a latitude circle up to 60 degrees:
    a station is listed in the nine cells around it, so this is an equi join, and work goes with strikes near stations."""
    side = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    s = stations.select(key, F.col("lat").alias("_la"), F.col("lon").alias("_lo"), F.floor(F.col("lat") / cell_deg).alias("_a"), F.floor(F.col("lon") / cell_deg).alias("_o"))
    s = s.withColumn("_i", F.explode(side)).withColumn("_j", F.explode(side)).withColumns({"_a": F.col("_a") + F.col("_i"), "_o": F.col("_o") + F.col("_j")})
    p = strikes.select("lat", "lon", F.floor(F.col("lat") / cell_deg).alias("_a"), F.floor(F.col("lon") / cell_deg).alias("_o"))
    d = s.join(p, ["_a", "_o"]).withColumn("km", geo.planar_km(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo"))).where(F.col("km") <= far)
    per = d.groupBy(key).agg(F.count_if(F.col("km") <= near).alias("near"), F.count(F.lit(1)).alias("far"), F.min("km").alias("km"))
    return stations.select(key).join(per, key, "left").select(key, F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("far", F.lit(0)).alias("far"), F.round("km", 3).alias("nearest_km"))


def alert(near: Column, far: Column) -> Column:
    return F.when(near > 0, "RED").when(far > 0, "ORANGE").otherwise("GREEN")


def in_box(lat: float, lon: float, half_deg: float = 0.15) -> Column:
    return (F.abs(F.col("lat") - lat) <= half_deg) & (F.abs(F.col("lon") - lon) <= half_deg)


def lattice_cells(df: DataFrame, keys: list[str], value: str, lat0: float, lon0: float) -> DataFrame:
    """Storm cells on a lattice of 4 pixels, with positions 45 minutes and 3 hours on at a fixed velocity. Suppression
    reaches 2 pixels, less than the lattice, so every lattice pixel over the limit is a cell."""
    d = df.where((F.col("row") % 4 == 0) & (F.col("col") % 4 == 0) & (F.col(value) >= 18))
    lat, lon = geo.from_live_rowcol(F.col("row"), F.col("col"), lat0, lon0)
    d = d.withColumns({"lat": lat, "lon": lon, "severity": F.when(F.col(value) >= 38, "SEVERE").when(F.col(value) >= 25, "MODERATE").otherwise("NORMAL")})
    east, north = 28.5, 12.0  # km/h
    for name, hours in (("45m", 0.75), ("3h", 3.0)):
        d = d.withColumns({f"lat_{name}": F.bround(F.col("lat") + north * hours / geo.KM_LIVE, 5), f"lon_{name}": F.bround(F.col("lon") + east * hours / (geo.KM_LIVE * F.cos(F.radians("lat"))), 5)})
    return d


def detect_cells(df: DataFrame, keys: list[str], value: str, strikes: str, least: float = 25.0, pixels: int = 4) -> DataFrame:
    """Eight-connected areas of at least `pixels` pixels over a limit, numbered in scan order. A frame is one group, of at
    most a grid's pixels; only pixels over the limit are sent."""
    first = {k: df.schema[k].dataType.simpleString() for k in keys}
    schema = ", ".join(f"{k} {t}" for k, t in first.items()) + ", cell int, row_min int, row_max int, col_min int, col_max int, centroid_row double, centroid_col double, area_km2 int, max_dbz double, mean_dbz double, strikes int, severity string"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(r, c): i for i, (r, c) in enumerate(zip(pdf["row"], pdf["col"], strict=True))}
        v, s = pdf[value].to_numpy(), pdf[strikes].to_numpy()
        seen: set = set()
        rows = []
        for start in sorted(at):
            if start in seen:
                continue
            seen.add(start)
            todo, area = deque([start]), []
            while todo:
                r, c = todo.popleft()
                area.append((r, c))
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        p = (r + i, c + j)
                        if p in at and p not in seen:
                            seen.add(p)
                            todo.append(p)
            if len(area) >= pixels:
                ix = [at[p] for p in area]
                rr, cc = [p[0] for p in area], [p[1] for p in area]
                top = float(v[ix].max())
                rows.append((*key, len(rows) + 1, min(rr), max(rr) + 1, min(cc), max(cc) + 1, round(sum(rr) / len(rr), 1), round(sum(cc) / len(cc), 1), 4 * len(area), round(top, 1), round(float(v[ix].mean()), 1), int((s[ix] >= 1).sum()), "CRITICAL" if top >= 45 else "SEVERE" if top >= 35 else "CONVECTIVE"))
        return pd.DataFrame(rows, columns=[*keys, "cell", "row_min", "row_max", "col_min", "col_max", "centroid_row", "centroid_col", "area_km2", "max_dbz", "mean_dbz", "strikes", "severity"])

    return df.where(F.col(value) >= least).groupBy(*keys).applyInPandas(one, schema)


def nearest_colour(pixels: DataFrame, table: list[tuple[float, int, int, int]], most: float = 30.0, ignore: list[tuple[int, int, int]] = ((255, 255, 255), (0, 0, 0)), ignore_within: float = 8.0) -> DataFrame:
    """dbz of the nearest colour of a short table, as one expression; NULL beyond `most` or near a colour to ignore."""
    dist = lambda r, g, b: F.sqrt((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b))
    best = F.array_min(F.array(*[F.struct(dist(r, g, b).alias("d"), F.lit(i).alias("i"), F.lit(float(z)).alias("z")) for i, (z, r, g, b) in enumerate(table)]))
    out = F.least(*[dist(*c) for c in ignore], F.lit(1e9)) <= ignore_within
    return pixels.withColumn("_b", best).withColumn("dbz", F.when(~out & (F.col("_b.d") <= most), F.col("_b.z"))).drop("_b")


def station_alerts(stations: DataFrame, strikes: DataFrame, key: str) -> DataFrame:
    return near_strikes(stations, strikes, key).withColumn("level", alert(F.col("near"), F.col("far")))


GRID_CENTRE = (18.5204, 73.8567)
S_GRID = S.GRID
