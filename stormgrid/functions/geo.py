"""Geolocation, beams and distances as Column functions. Two pixel conventions exist and give different pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormgrid import schema as S

KM_GRID, KM_LIVE = 111.32, 111.0
EARTH_KM, EARTH_FACTOR = 6371.0, 1.21


def to_rowcol(lat: Column, lon: Column, lat0: float, lon0: float, n: int = S.GRID, pixel: float = S.PIXEL_KM) -> tuple[Column, Column]:
    """Fractional pixel of the archive grid: centre between the middle pixels, north up."""
    y = (lat - lat0) * KM_GRID
    x = (lon - lon0) * (KM_GRID * math.cos(math.radians(lat0)))
    return (n - 1) / 2 - y / pixel, (n - 1) / 2 + x / pixel


def to_live_rowcol(lat: Column, lon: Column, lat0: float, lon0: float, n: int = S.GRID, pixel: float = S.PIXEL_KM) -> tuple[Column, Column]:
    """Whole pixel of the live grid: centre at n / 2, rounded half to even."""
    y = (lat - lat0) * KM_LIVE
    x = (lon - lon0) * (KM_LIVE * math.cos(math.radians(lat0)))
    return F.rint(n / 2 - y / pixel).cast("int"), F.rint(n / 2 + x / pixel).cast("int")


def from_live_rowcol(row: Column, col: Column, lat0: float, lon0: float, n: int = S.GRID, pixel: float = S.PIXEL_KM) -> tuple[Column, Column]:
    lat = lat0 + (n / 2 - row) * pixel / KM_LIVE
    lon = lon0 + (col - n / 2) * pixel / (KM_LIVE * math.cos(math.radians(lat0)))
    return F.bround(lat, 5), F.bround(lon, 5)


def planar_km(lat: Column, lon: Column, lat_s: Column, lon_s: Column) -> Column:
    """Distance to a point on a plane tangent at (lat_s, lon_s)."""
    return F.hypot((lat - lat_s) * KM_LIVE, (lon - lon_s) * KM_LIVE * F.cos(F.radians(lat_s)))


def range_azimuth(row: Column, col: Column, row0: float, col0: float, pixel: float = S.PIXEL_KM) -> tuple[Column, Column]:
    east, north = (col - col0) * pixel, (row0 - row) * pixel
    return F.hypot(east, north), F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def beam_height_km(rng: Column, elevation: Column | float, altitude: float = 0.0, factor: float = EARTH_FACTOR) -> Column:
    r = EARTH_KM * factor
    e = F.radians(F.lit(elevation) if isinstance(elevation, (int, float)) else elevation)
    return F.sqrt(rng * rng + r * r + 2.0 * rng * r * F.sin(e)) - r + altitude


def beam_width_km(rng: Column, degrees: float = 1.0) -> Column:
    return rng * math.radians(degrees)


def range_of_altitude_km(altitude: float, elevation: float, factor: float = EARTH_FACTOR, most: float = 500.0) -> float:
    """Ground range at which a beam reaches an altitude, in closed form from the law of cosines; most if it doesn't."""
    r, s = EARTH_KM * factor, math.sin(math.radians(elevation))
    d = -r * s + math.sqrt((r * s) ** 2 + altitude * altitude + 2 * r * altitude)
    return min(max(d, 0.0), most)


def radar_geometry(low_elevation: float = 0.5, high_elevation: float = 20.0, beam_degrees: float = 1.0, low_km: float = S.CHARGING_LOW_KM, high_km: float = S.CHARGING_HIGH_KM, freezing_km: float = S.FREEZING_KM) -> dict[str, float]:
    """Ranges in km that bound what a radar can tell of the charging layer: within the cone no beam reaches it; beyond the
    overshoot the lowest beam is above it; from where the beam is thicker than it, and from where it takes in melting ice."""
    width = math.radians(beam_degrees)
    return {
        "cone_of_silence_km": low_km / math.tan(math.radians(high_elevation)), "overshoot_range_km": range_of_altitude_km(low_km, low_elevation), "overshoot_range_upper_km": range_of_altitude_km(high_km, low_elevation),
        "beam_thicker_than_layer_km": max(high_km - low_km, 1e-6) / width, "bright_band_contamination_km": 2.0 * max(low_km - freezing_km, 1e-6) / width,
    }
