"""Nested weather and model JSON, hourly tables, catalogs, colour tables: read by schema, normalised by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.functions import scalar

NWP = "hourly struct<time:array<string>, cape:array<double>, convective_inhibition:array<double>, freezing_level_height:array<double>>"
CURRENT = "name string, main struct<temp:double, feels_like:double, humidity:double, pressure:double>, wind struct<speed:double, deg:double>, rain struct<`1h`:double>, weather array<struct<main:string, description:string>>"
FORECAST = "list array<struct<dt:long, main:struct<temp:double>, rain:struct<`3h`:double>, wind:struct<speed:double>>>"
CATALOG = ["id", "img_type", "file_name", "file_index"]


def nwp(df: DataFrame, json: str) -> DataFrame:
    """First hour's values; freezing and charging levels in km, half to even at two digits."""
    h = F.from_json(json, NWP)["hourly"]
    first = lambda c: F.get(h[c], 0)
    km = F.bround(first("freezing_level_height") / 1000.0, 2)
    return df.withColumns({"cape": first("cape"), "inhibition": first("convective_inhibition"), "freezing_km": km, "charging_lower_km": F.bround(km + 1.5, 2)})


def current(df: DataFrame, json: str, forecast: str) -> DataFrame:
    """Typed weather of a place: missing parts get defaults, m/s become km/h, eight forecast entries stay."""
    j = F.from_json(json, CURRENT)
    entries = F.slice(F.coalesce(F.from_json(forecast, FORECAST)["list"], F.array().cast("array<struct<dt:long, main:struct<temp:double>, rain:struct<`3h`:double>, wind:struct<speed:double>>>")), 1, 8)
    return df.withColumns({
        "place": F.coalesce(j["name"], F.lit("Unknown")), "temp": j["main"]["temp"], "humidity": j["main"]["humidity"], "wind_kmh": F.bround(F.coalesce(j["wind"]["speed"], F.lit(0.0)) * 3.6, 1),
        "rain_1h": F.coalesce(j["rain"]["1h"], F.lit(0.0)), "condition": F.coalesce(F.get(j["weather"], 0)["main"], F.lit("Unknown")),
        "forecast": F.transform(entries, lambda e: F.struct(F.timestamp_seconds(e["dt"]).alias("at"), e["main"]["temp"].alias("temp"), F.coalesce(e["rain"]["3h"], F.lit(0.0)).alias("rain_3h"), F.bround(F.coalesce(e["wind"]["speed"], F.lit(0.0)) * 3.6, 1).alias("wind_kmh"))),
    })


def hourly(df: DataFrame, json: str, names: list[str]) -> DataFrame:
    """One row an hour from parallel arrays; times without a zone."""
    kinds = ", ".join(f"{n}:array<double>" for n in names)
    h = F.from_json(json, f"hourly struct<time:array<string>, {kinds}>")["hourly"]
    rows = F.explode(F.arrays_zip(h["time"].alias("time"), *[h[n].alias(n) for n in names]))
    keep = [c for c in df.columns if c != json]
    return df.select(*keep, rows.alias("h")).select(*keep, F.to_timestamp("h.time", "yyyy-MM-dd'T'HH:mm").alias("timestamp"), *[F.col(f"h.{n}") for n in names])


def summary(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(n).alias(f"{n}_{t}") for n in names for t, f in (("mean", F.avg), ("max", F.max), ("min", F.min))], *[F.count_if(F.col(n).isNull()).alias(f"{n}_missing") for n in names])


def daily(df: DataFrame) -> DataFrame:
    """A row a place and day; places with a missing key go, sums of nothing are 0."""
    keys = ["city", "state", "latitude", "longitude", "date"]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    d = df.withColumn("date", F.to_date("timestamp")).na.drop(subset=keys)
    return d.groupBy(*keys).agg(total("rain").alias("rain"), total("precipitation").alias("precipitation"), F.max("wind_speed_10m").alias("max_wind"), F.max("wind_gusts_10m").alias("max_gust"), F.max("cape").alias("max_cape"), F.coalesce(F.sum("is_thunderstorm"), F.lit(0)).alias("thunder_hours"), F.max("lightning_proxy").alias("max_proxy"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    missing = [c for c in CATALOG if c not in df.columns]
    if missing:
        raise ValueError(f"catalog lacks {', '.join(missing)}")
    return df


def catalog_events(df: DataFrame, kinds: list[str], need: str = "vil", most: int | None = None) -> DataFrame:
    """A row an event with each image type's file; events without `need` go; the first `most` by id."""
    wide = df.where(F.col("img_type").isin(kinds)).groupBy("id").pivot("img_type", kinds).agg(F.first(F.struct("file_name", "file_index"))).where(F.col(need).isNotNull())
    return wide.orderBy("id").limit(most) if most else wide


def colour_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("dbz double, r int, g int, b int").csv(path, comment="#", mode="DROPMALFORMED")


def parse_time(c: str | Column) -> Column:
    """Times in any of the archive's spellings."""
    # The spellings.
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd-MMM-yyyy'T'HH:mm:ss", "yyyyMMddHHmmss", "dd-MM-yyyy HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def any_key(json: str | Column, keys: list[str]) -> Column:
    """Whether a payload has one of the keys that a source needs."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(json), F.array(*map(F.lit, keys))), F.lit(False))


# Hourly names as they are fetched, with their names in the table, and the table's columns.
CITY_NAMES = {"weathercode": "weather_code", "windspeed_10m": "wind_speed_10m", "windgusts_10m": "wind_gusts_10m", "relativehumidity_2m": "humidity_2m"}
CITY_COLUMNS = ["timestamp", "city", "state", "latitude", "longitude", "precipitation", "rain", "weather_code", "is_thunderstorm", "wind_speed_10m", "wind_gusts_10m", "temperature_2m", "humidity_2m", "cape", "lifted_index", "convective_inhibition", "lightning_proxy"]
_FETCHED = ["precipitation", "rain", "weathercode", "windspeed_10m", "windgusts_10m", "temperature_2m", "relativehumidity_2m", "cape", "lifted_index", "convective_inhibition"]


def city_hourly(payloads: DataFrame, json: str) -> DataFrame:
    """payloads (city, state, latitude, longitude, json) to the hourly table: one row an hour, in the table's columns. A payload
    without hours, or that is no JSON, has no rows; a missing reading is NULL, and counts as 0 in the proxy."""
    d = hourly(payloads.select("city", "state", "latitude", "longitude", json), json, _FETCHED).withColumnsRenamed(CITY_NAMES)
    d = d.withColumn("weather_code", F.col("weather_code").cast("int"))
    d = d.withColumns({"is_thunderstorm": scalar.thunderstorm(F.col("weather_code")), "lightning_proxy": scalar.lightning_proxy(F.col("cape"), F.col("precipitation"), F.col("weather_code"))})
    return d.select(*CITY_COLUMNS)


def cities(df: DataFrame) -> DataFrame:
    """A list of places without those that lack a coordinate."""
    return df.na.drop(subset=["latitude", "longitude"])


def together(parts: list[DataFrame]) -> DataFrame:
    """Tables of several fetches as one, by names; a column that some lack is NULL there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def background_density(lat: Column, lon: Column, least: float = 0.05) -> Column:
    """Strokes a square km and day of the background climatology: a broad maximum about 20 N 82 E, without noise."""
    base = 0.5 + 2.5 * F.exp(-((lat - 20.0) * (lat - 20.0) + (lon - 82.0) * (lon - 82.0)) / 50.0)
    return F.greatest(F.bround(base, 3), F.lit(least))
