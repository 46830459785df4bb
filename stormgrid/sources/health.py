"""Source registry and health: states, ages, and the six channels put together from what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sources, the channels each gives, and keys of which a payload needs one.
SOURCES = [
    ("radar", ["refl_sfc", "refl_m10", "echo_top", "vil"], ["data", "refl_sfc", "raw_size_bytes"]),
    ("insat", ["ir_tb"], ["ir_tb", "tir1", "raw_size_bytes"]),
    ("lightning", ["light_dens"], ["strikes", "light_dens", "raw_size_bytes"]),
    ("aws", [], ["stations", "observations", "raw_size_bytes"]),
    ("nwp", [], ["hourly", "cape", "raw_size_bytes"]),
    ("mosdac_dwr", ["refl_sfc", "refl_m10"], ["data", "quantities", "refl_sfc", "raw_size_bytes"]),
    ("imd_dwr", ["refl_sfc"], ["data", "variables", "refl_sfc", "raw_size_bytes"]),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, channels array<string>, needs array<string>")


def state(reported: Column, age_s: Column, stale_s: float = 1800.0) -> Column:
    """What was live longer ago than stale_s is stale."""
    return F.when((reported == "LIVE") & (age_s > stale_s), "STALE").otherwise(reported)


def fetched(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """payloads (source, payload, configured, error) judged by each source's needs."""
    d = sources.join(payloads, "source", "left")
    keys = F.json_object_keys("payload")
    # values kept from before serve the numerical forecast too
    kept = (F.col("source") == "nwp") & F.get_json_object("payload", "$.status").isin("LIVE", "STALE") & F.array_contains(keys, "values")
    ok = F.arrays_overlap(keys, F.col("needs")) | F.coalesce(kept, F.lit(False))
    return d.withColumn("state", F.when(~F.coalesce("configured", F.lit(False)), "NOT_CONFIGURED").when(F.col("error").isNotNull() | F.col("payload").isNull(), "UNAVAILABLE").when(F.coalesce(ok, F.lit(False)), "LIVE").otherwise("DEGRADED"))


def assemble(base: DataFrame, planes: dict[str, DataFrame]) -> DataFrame:
    """base (frame, row, col, channels) with each channel's plane (row, col, value), where a source gave one."""
    for c, plane in planes.items():
        base = base.join(plane.select("row", "col", F.col("value").alias(f"_{c}")), ["row", "col"], "left").withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return base
