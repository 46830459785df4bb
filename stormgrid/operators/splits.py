"""Event-blocked splits, sliding windows over frames, and checks that nothing leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S

SPAN = S.N_IN + S.N_OUT


def split_sizes(n: int, fractions: tuple[float, float, float] = (0.65, 0.15, 0.20)) -> tuple[int, int, int]:
    if n < 3:
        raise ValueError(f"three splits need three events, there are {n}")
    total = sum(fractions)
    train = max(1, min(round(fractions[0] / total * n), n - 2))
    val = max(1, min(round(fractions[1] / total * n), n - train - 1))
    return train, val, n - train - val


def split_events(events: DataFrame, key: str, mode: str = "shuffle", seed: int = 0, fractions: tuple[float, float, float] = (0.65, 0.15, 0.20)) -> DataFrame:
    """(key, split). Events are days, so their numbering is small; chronological, or in order of a seeded hash."""
    ids = events.select(key).distinct()
    train, val, _ = split_sizes(ids.count(), fractions)
    order = [F.col(key)] if mode == "chronological" else [F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.col(key)]
    n = F.row_number().over(Window.orderBy(*order))
    return ids.select(key, F.when(n <= train, "train").when(n <= train + val, "val").otherwise("test").alias("split"))


def windows(frames: DataFrame, key: str, stride: int = 1, guard: int = 0, span: int = SPAN, first: str = "first_frame", last: str = "last_frame") -> DataFrame:
    """(key, t0): starts of windows of `span` frames inside [first, last] less a guard on either side."""
    hi = F.col(last) - guard - span + 1
    lo = F.col(first) + guard
    return frames.where(hi >= lo).select(key, F.explode(F.sequence(lo, hi, F.lit(stride).cast("long"))).alias("t0"))


def sequences(cells: DataFrame, starts: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """Cells of each window: an equi join on frames, which each window lists; `step` counts from 0."""
    s = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(span - 1)))).withColumn("frame", F.col("t0") + F.col("step"))
    return s.join(cells, [key, "frame"])


def cap(starts: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most so many windows, by a seeded hash: the sampling that a split asks for."""
    return starts.orderBy(F.xxhash64(*starts.columns, F.lit(seed))).limit(most)


def split_windows(assigned: DataFrame, frames: DataFrame, key: str, stride: int = 1, eval_stride: int | None = None, guard: int = 0, most: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """(split, key, t0): windows of each split's events, with a stride of their own for val and test, and at most so many
    of a split where `most` names it. An event in more than one split is refused."""
    if overlapping(assigned, key).limit(1).count():
        raise ValueError("an event is in more than one split")
    out = None
    for name in ("train", "val", "test"):
        step = stride if name == "train" or eval_stride is None else eval_stride
        w = windows(frames.join(assigned.where(F.col("split") == name).select(key), key), key, step, guard)
        if most and name in most:
            w = cap(w, most[name], seed)
        w = w.select(F.lit(name).alias("split"), key, "t0")
        out = w if out is None else out.unionByName(w)
    return out


def overlapping(assigned: DataFrame, key: str) -> DataFrame:
    """Events in more than one split: empty, if splits are right."""
    return assigned.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def stats(samples: DataFrame, keys: list[str], event: str, positives: str, pixels: str) -> DataFrame:
    """Of each split: samples, positives, base rate, parts of samples and events with lightning, largest event's share."""
    per = samples.groupBy(*keys, event).agg(F.count(F.lit(1)).alias("n"), F.sum(positives).alias("p"), F.sum(pixels).alias("px"), F.count_if(F.col(positives) > 0).alias("lit"))
    n = F.sum("n")
    return per.groupBy(*keys).agg(n.alias("samples"), F.sum("p").alias("positives"), F.round(F.try_divide(F.sum("p"), F.sum("px")), 6).alias("base_rate"), F.round(F.try_divide(F.sum("lit"), n), 6).alias("lit_samples"), F.count_if(F.col("p") > 0).alias("lit_events"), F.round(F.try_divide(F.max("p"), F.sum("p")), 6).alias("largest_share"))


def problems(stats_: DataFrame, least: int = 500) -> DataFrame:
    said = F.array_compact(F.array(F.when(F.col("positives") == 0, "no positives"), F.when(F.col("positives").between(1, least - 1), f"fewer than {least} positives"), F.when(F.col("largest_share") >= 1, "all from one event")))
    return stats_.withColumn("problems", said)


def leakage(train: DataFrame, test: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """Part of test windows with a training window of the same event nearer than a span. Windows, not pairs, are counted:
    the nearest training start on either side comes from one ordered window over both."""
    d = train.select(key, "t0", F.lit(0).alias("_t")).unionByName(test.select(key, "t0", F.lit(1).alias("_t")))
    w = Window.partitionBy(key).orderBy("t0", "_t")
    at = F.when(F.col("_t") == 0, F.col("t0"))
    d = d.withColumns({"_a": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("_t = 1")
    near = F.least(F.col("t0") - F.col("_a"), F.col("_b") - F.col("t0"))
    return d.agg(F.count(F.lit(1)).alias("windows"), F.count_if(near < span).alias("leaking")).withColumn("part", F.round(F.try_divide(F.col("leaking"), F.col("windows")), 6))
