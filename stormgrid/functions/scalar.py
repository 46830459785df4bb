"""Column functions of physics, decoding and rounding. Each returns an expression; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormgrid import schema as S

# Compass points, clockwise from north.
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def normalised(channel: str) -> Column:
    mean, scale = S.NORM[channel]
    return F.coalesce((F.col(channel) - mean) / scale, F.lit(0.0))


def charge_excess(m10: Column) -> Column:
    """Softplus excess of reflectivity at -10 C over 8 dBZ, linear where the exponential would saturate."""
    z = (m10 - 8.0) / 12.0
    return F.coalesce(F.when(z > 20, z).otherwise(F.log1p(F.exp(z))) * 12.0, F.lit(0.0))


def graupel(m10: Column, top: Column) -> Column:
    return F.when(m10.isNotNull() & top.isNotNull(), charge_excess(m10) * F.sqrt(F.greatest(top - S.CHARGING_LOW_KM, F.lit(0.0)))).otherwise(0.0)


def deep_convection(top: Column, ir: Column) -> Column:
    both = clip((top - S.CHARGING_LOW_KM) / 4.0, 0, 1.5) * clip((250.0 - ir) / 30.0, 0, 1.5)
    return F.coalesce(F.when(top.isNotNull() & ir.isNotNull(), both), F.lit(0.0))


def lightning_proxy(cape: Column, rain: Column, code: Column) -> Column:
    flag = thunderstorm(code)
    return F.bround(0.6 * F.least(F.coalesce(cape, F.lit(0.0)), F.lit(3000.0)) / 3000.0 + 0.3 * F.least(F.coalesce(rain, F.lit(0.0)), F.lit(20.0)) / 20.0 + 0.1 * flag, 4)


def thunderstorm(code: Column) -> Column:
    return F.coalesce(code.isin(95, 96, 99).cast("int"), F.lit(0))


def feels_like(temp: Column, humidity: Column, wind_kmh: Column) -> Column:
    vapour = humidity / 100.0 * 6.105 * F.exp(17.27 * temp / (237.7 + temp))
    t = F.bround(temp + (0.33 * vapour - 0.7 * (wind_kmh / 3.6) - 4.0), 1)
    return F.greatest(temp - 1.0, F.least(temp + 5.5, t))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.rint(degrees / 22.5).cast("int") % 16) + 1)


def decode_ir(raw: Column) -> Column:
    return raw * 0.01 + 273.15


def decode_vil(raw: Column) -> Column:
    return F.when(raw <= 5, 0.0).when(raw <= 18, (raw - 2.0) / 90.66).otherwise(F.exp((raw - 83.9) / 38.9))


def surface_from_vil(vil: Column, depth_km: float = 5.0) -> Column:
    z = F.pow(F.greatest(F.greatest(vil, F.lit(0.0)), F.lit(1e-6)) / (3.44e-6 * max(depth_km, 0.1) * 1000.0), F.lit(1.75))
    return clip(10.0 * F.log10(F.greatest(z, F.lit(1e-3))), *S.RANGES["refl_sfc"])


def top_from_ir(ir: Column, vil: Column, surface_k: float = 300.0, lapse: float = 6.5, offset_km: float = 1.5, gate: float = 0.5) -> Column:
    return clip(F.when(vil >= gate, (surface_k - ir) / max(lapse, 0.1) - offset_km).otherwise(0.0), *S.RANGES["echo_top"])


def charging_from_vil(vil: Column, ir: Column, top: Column, charging_km: float = S.CHARGING_LOW_KM) -> Column:
    up, ice = clip((top - charging_km) / 4.0, 0, 1), clip((250.0 - ir) / 40.0, 0, 1)
    z = surface_from_vil(vil) - (25.0 - 20.0 * (0.65 * up + 0.35 * ice))
    return clip(F.when(top <= charging_km, S.RANGES["refl_m10"][0]).otherwise(z), *S.RANGES["refl_m10"])


def dbz_curve(density: Column) -> Column:
    """Reflectivity that stands for a density of strikes: 18 dBZ where there is none."""
    return clip(18.0 + 22.0 * F.log10(1.0 + 3.0 * density), 0, 65)


def proxy_dbz(density: Column) -> Column:
    """The same of a raster, whose pixels without a strike have no echo."""
    return F.when(density > 0, dbz_curve(density)).otherwise(0.0)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1.0 - q))


def weighted_bce(z: Column, y: Column, weight: float) -> Column:
    """Stable logistic loss with a weight on positives."""
    soft = F.log1p(F.exp(-F.abs(z)))
    return F.when(y > 0, weight * (soft + F.greatest(-z, F.lit(0.0)))).otherwise(soft + F.greatest(z, F.lit(0.0)))


def clip_reflectivity(z: Column, lo: float = 0.0, hi: float = 75.0) -> Column:
    return F.when(z.isNull() | F.isnan(z) | (z < lo), 0.0).otherwise(F.least(z, F.lit(hi)))


def lead_band(minutes: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in reversed(S.LEAD_BANDS):
        out = F.when(minutes.between(a, b), f"{a}-{b}").otherwise(out)
    return out


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
