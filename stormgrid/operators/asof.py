"""As-of join: the latest source reading at or before each target, with its age and a limit on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(targets: DataFrame, sources: DataFrame, keys: list[str], time: str, value: str, limit_s: float | None = None, linear: bool = False) -> DataFrame:
    """targets with `value` and `age_s`. One union and one ordered window a key, no range join. Of equal times the source
    counts as earlier. With linear, values in between are interpolated to the next source reading, where there is one."""
    t = targets.select(*keys, time, F.lit(1).alias("_is"), F.lit(None).cast("double").alias("_v"), F.struct(*targets.columns).alias("_row"))
    s = sources.select(*keys, time, F.lit(0).alias("_is"), F.col(value).cast("double").alias("_v"), F.lit(None).cast(t.schema["_row"].dataType).alias("_row"))
    back = Window.partitionBy(*keys).orderBy(time, "_is").rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("_is") == 0, F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    d = t.unionByName(s).withColumns({"_v0": F.last("_v", True).over(back), "_t0": F.last(at, True).over(back)})
    now = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    v = F.col("_v0")
    if linear:
        # what follows, as what precedes in falling order: a frame that ends with the key is read anew for every row
        ahead = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("_is")).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({"_v1": F.last("_v", True).over(ahead), "_t1": F.last(at, True).over(ahead)})
        v = F.when(F.col("_v1").isNull() | (F.col("_t1") <= F.col("_t0")), v).otherwise(v + (F.col("_v1") - v) * (now - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    d = d.withColumns({"_value": v, "age_s": now - F.col("_t0")}).where("_is = 1")
    if limit_s is not None:
        d = d.withColumn("_value", F.when(F.col("age_s") <= limit_s, F.col("_value")))
    return d.select("_row.*", F.col("_value").alias(value), "age_s")


def sliced(targets: DataFrame, sources: DataFrame, keys: list[str], time: str, value: str, slice_s: float = 3600.0, limit_s: float | None = None, linear: bool = False) -> DataFrame:
    """As `asof`, without one ordered window a key: time is cut into slices, windows see a key's slice, and the last reading
    before it (with linear, the first after it) comes from one row a slice. So a key with most of the readings is as many
    tasks as it has slices. value may be of any type; linear takes numbers."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kind = sources.schema[value].dataType
    t = targets.select(*keys, us(time).alias("_t"), F.lit(1).alias("_is"), F.lit(None).cast(kind).alias("_v"), F.struct(*targets.columns).alias("_row"))
    s = sources.where(F.col(value).isNotNull()).select(*keys, us(time).alias("_t"), F.lit(0).alias("_is"), F.col(value).alias("_v"), F.lit(None).cast(t.schema["_row"].dataType).alias("_row"))
    cut = F.floor(F.col("_t") / int(slice_s * 1e6)).alias("_slice")
    d = t.unionByName(s).select("*", cut)
    read = F.when(F.col("_is") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    w = Window.partitionBy(*keys, "_slice").orderBy("_t", "_is")
    d = d.withColumn("_now", F.last(read, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if linear:
        back = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_t"), F.desc("_is"))
        d = d.withColumn("_next", F.last(read, True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each key's slice, slices of targets alone among them
    per = d.groupBy(*keys, "_slice").agg(F.max_by(read, F.when(F.col("_is") == 0, F.col("_t"))).alias("_last"), F.min_by(read, F.when(F.col("_is") == 0, F.col("_t"))).alias("_first"))
    before, after = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_slice"), F.desc("_slice")))
    per = per.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_at"), F.last("_last", True).over(before).alias("_before"), F.last("_first", True).over(after).alias("_after"))
    on = F.col("_slice") == F.col("_at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = d.where("_is = 1").join(per, on, "left").withColumn("_a", F.coalesce("_now", "_before"))
    d = d.withColumn("age_s", (F.col("_t") - F.col("_a.t")) / 1e6)
    v = F.col("_a.v")
    if linear:
        b = F.coalesce("_next", "_after")
        v = F.when(b.isNull() | (b["t"] <= F.col("_a.t")), v).otherwise(v + (b["v"] - v) * ((F.col("_t") - F.col("_a.t")) / 1e6) / ((b["t"] - F.col("_a.t")) / 1e6))
    if limit_s is not None:
        v = F.when(F.col("age_s") <= limit_s, v)
    return d.select("_row.*", v.alias(value), "age_s")


def held_planes(frames: DataFrame, scans: DataFrame, planes: DataFrame, keys: list[str], time: str, limit_s: float = 1200.0, slice_s: float = 3600.0) -> DataFrame:
    """Whole scans held onto a finer clock: (keys, time, age_s, row, col and what else planes have) for each frame and pixel of
    the latest scan at or before it, while that is no older than limit_s. frames and scans: (keys, time); planes: (keys,
    scan_time, row, col, ...). Scans are matched, not pixels: planes are joined by their scan's time afterwards. A frame
    without a scan in reach has no rows."""
    s = scans.select(*keys, time, F.col(time).alias("scan_time"))
    d = sliced(frames.select(*keys, time), s, keys, time, "scan_time", slice_s, limit_s).where("scan_time IS NOT NULL")
    return d.join(planes, [*keys, "scan_time"])
