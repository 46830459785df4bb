"""Strikes as a stream: event-time windows with a watermark, duplicates dropped, proxy reflectivity, CAP alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions import geo, scalar
from stormgrid.operators import grid, spatial

KEEP_S = 1800


def accumulate(strikes: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "30 minutes", ids: str | None = "event_id", keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Strikes a window and pixel. On a stream, state older than the watermark goes and repeated ids count once."""
    d = strikes.withColumn("_t", F.col(time).cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark("_t", late)
        d = d.dropDuplicatesWithinWatermark([ids]) if ids else d
    elif ids:
        d = d.dropDuplicates([ids])
    out = d.groupBy(F.window("_t", window), *keys).agg(F.count(F.lit(1)).alias("strikes"))
    return out.select(F.col("window.start").alias("start"), *keys, "strikes")


def query(strikes: DataFrame, now: Column, most_age_s: float = 3600.0, source: str | None = None, time: str = "ts") -> DataFrame:
    """Strikes not older than most_age_s, newest first, of a source (ALL: any)."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(time).cast("timestamp"))) / 1e6
    ok = age.between(0, most_age_s)
    if source and "ALL" not in source.upper():
        ok = ok & F.contains(F.lit(source.upper()), F.upper("source"))
    return strikes.where(ok).orderBy(F.col(time).desc(), "event_id")


def proxy_reflectivity(strikes: DataFrame, keys: list[str], lat0: float, lon0: float) -> DataFrame:
    """(keys, row, col, density, dbz) on a dense grid: strokes to ground weigh 1, others 1.5, smoothed, as reflectivity."""
    row, col = geo.to_live_rowcol(F.col("lat"), F.col("lon"), lat0, lon0)
    d = grid.rasterise(strikes, row.cast("double"), col.cast("double"), keys, F.when(F.col("stroke_type") == "CG", 1.0).otherwise(1.5))
    d = grid.dense(d, keys).withColumn("density", F.coalesce("density", F.lit(0.0)))
    return grid.smooth(d, keys, "density", "density").withColumn("dbz", scalar.proxy_dbz(F.col("density")))


def newest(strikes: DataFrame, keys: list[str], most: int, time: str = "ts") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), "event_id")
    return strikes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def ingested(strikes: DataFrame, time: str = "ts", number: str = "event_id") -> DataFrame:
    """Incoming strikes as they are stored: an id of source and milliseconds, places to 5 digits, currents to 1, and what
    the source is worth (accuracy in metres, confidence). `number` tells strikes of one source and millisecond apart."""
    own = F.col("source") == "IITM_LLN"
    ms = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1000) % 1_000_000
    return strikes.select(
        number, F.concat_ws("-", F.substring("source", 1, 4), ms.cast("string")).alias("id"), "source", F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"),
        (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("timestamp"), "stroke_type", F.bround("peak_current_ka", 1).alias("peak_current_ka"),
        F.when(own, 300.0).otherwise(450.0).alias("location_accuracy_m"), F.when(own, 0.95).otherwise(0.92).alias("confidence"))


def location_risk(strikes: DataFrame, now: Column, lat: float, lon: float, most_age_s: float = 1800.0) -> DataFrame:
    """One row: strikes within 15 and 50 km of a place, the nearest of all ages up to most_age_s, and the alert level."""
    km = geo.planar_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    d = strikes.where(age.between(0, most_age_s)).withColumn("km", km)
    d = d.agg(F.count_if(F.col("km") <= spatial.NEAR_KM).alias("near"), F.count_if(F.col("km") <= spatial.FAR_KM).alias("far"), F.bround(F.min("km"), 1).alias("nearest_km"), F.min_by("event_id", F.struct("km", "event_id")).alias("nearest"))
    return d.select(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), "near", "far", "nearest_km", "nearest", spatial.alert(F.col("near"), F.col("far")).alias("level"))


#: What an alert says where its caller doesn't say it otherwise; {hazard}, {area} and {population} are filled in.
HEADLINE = "URGENT WEATHER DISPATCH: {hazard} IN {AREA}"
DESCRIPTION = "Echo tops in the charging layer with active cloud-to-ground lightning over {area}. Estimated population concerned: {population} civilians."
INSTRUCTION = "Take shelter indoors at once. Disconnect high-voltage transformers and suspend work outdoors."
# The corner of the alert grid, in degrees; a grid is one degree wide.
CAP_LAT, CAP_LON = 18.0, 73.0


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _filled(template: str, **values: Column) -> Column:
    c = F.lit(template)
    for k, v in values.items():
        c = F.replace(c, F.lit("{" + k + "}"), v)
    return _xml(c)


def cap_polygon(r0: Column, r1: Column, c0: Column, c1: Column, n: int = S.GRID) -> Column:
    """Corners of a box of pixels as latitude,longitude pairs, closed."""
    at = lambda base, x: F.format_string("%.4f", F.bround(base + x / float(n), 4))
    a, b, c, d = at(CAP_LAT, r0), at(CAP_LAT, r1), at(CAP_LON, c0), at(CAP_LON, c1)
    return F.concat_ws(" ", *(F.concat_ws(",", p, q) for p, q in ((a, c), (a, d), (b, d), (b, c), (a, c))))


def cap_alert(df: DataFrame, area: str, hazard: str, severity: str, sent: str, bounds: tuple[str, str, str, str] | None = None, identifier: str | None = None, population: int = 850_000, sender: str = "alerts@stormgrid.example", minutes: int = 45,
              headline: str = HEADLINE, description: str = DESCRIPTION, instruction: str = INSTRUCTION) -> DataFrame:
    """df with `cap`, an alert message of the Common Alerting Protocol 1.2 for each row. area, hazard, severity, sent and
    bounds (first and last row, first and last column) name columns; identifier names one, else it is STORM and the second."""
    t = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'-00:00'")
    start = F.col(sent).cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + minutes * 60_000_000)
    number = F.col(identifier).cast("string") if identifier else F.concat(F.lit("STORM-"), F.unix_seconds(start).cast("string"))
    values = {"hazard": F.col(hazard), "area": F.col(area), "AREA": F.upper(area), "population": F.format_number(F.lit(population), 0)}
    box = [F.col(b).cast("double") for b in bounds] if bounds else [F.lit(float(x)) for x in (0, S.GRID, 0, S.GRID)]
    tag = lambda name, c: [F.lit(f"<{name}>"), c, F.lit(f"</{name}>")]
    head = [*tag("identifier", _xml(number)), *tag("sender", F.lit(sender)), *tag("sent", t(start)), F.lit("<status>Actual</status><msgType>Alert</msgType><scope>Public</scope><info><category>Met</category>")]
    info = [*tag("event", _xml(F.col(hazard))), F.lit("<urgency>Immediate</urgency>"), *tag("severity", _xml(F.col(severity))), F.lit("<certainty>Observed</certainty>"), *tag("expires", t(end)), *tag("headline", _filled(headline, **values)),
            *tag("description", _filled(description, **values)), *tag("instruction", _filled(instruction, **values))]
    place = [F.lit("<area>"), *tag("areaDesc", F.concat(_xml(F.col(area)), F.lit(" sector perimeter"))), *tag("polygon", cap_polygon(*box)), F.lit("</area></info></alert>")]
    return df.withColumn("cap", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), *head, *info, *place))
