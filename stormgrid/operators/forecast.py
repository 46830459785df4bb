"""Forecasts as long tables (keys, lead, row, col, prob)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.operators import grid

LEADS = range(1, S.N_OUT + 1)


def persistence(df: DataFrame, keys: list[str], lit: str, leads: range = LEADS, r: int = 1) -> DataFrame:
    """The last frame's lightning, smoothed, for every lead."""
    d = grid.box_mean(df.withColumn("_l", F.col(lit).cast("double")), keys, "_l", r, "prob")
    return d.select(*keys, F.explode(F.array(*map(F.lit, leads))).alias("lead"), "row", "col", "prob")


def climatology(df: DataFrame, keys: list[str], base_rate: float, leads: range = LEADS) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*map(F.lit, leads))).alias("lead"), "row", "col", F.lit(base_rate).alias("prob"))


def _mean(a: np.ndarray, r: int) -> np.ndarray:
    """Mean of a box of side 2r + 1; edge pixels go on outside."""
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = sum(np.take(p, range(i, i + a.shape[axis]), axis) for i in range(2 * r + 1)) / (2 * r + 1)
    return a


def _most(a: np.ndarray, r: int) -> np.ndarray:
    """Largest value of a box of side 2r + 1, cut at the edge. Values are 0 at least."""
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)])
        a = np.maximum.reduce([np.take(p, range(i, i + a.shape[axis]), axis) for i in range(2 * r + 1)])
    return a


def _rasters(df: DataFrame, keys: list[str], columns: dict[str, Column], kind: str, run: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """Each key's pixels, row and col with `columns`, in one task: what `run` makes of them as arrays, keys before it."""
    inside = F.col("row").between(0, S.GRID - 1) & F.col("col").between(0, S.GRID - 1)
    d = df.select(*keys, F.when(inside, F.col("row").cast("int")).alias("row"), F.when(inside, F.col("col").cast("int")).alias("col"), *(c.cast("double").alias(k) for k, c in columns.items()))
    names = ["row", "col", *columns]

    def one(pixels: pa.Table) -> pa.Table:
        here = pixels.filter(pc.and_(pc.is_valid(pixels["row"]), pc.is_valid(pixels["col"])))
        got = run({c: here[c].to_numpy() for c in names})
        out = pixels.select(keys).take(pa.array(np.zeros(len(got["row"]), np.int64)))
        for name, x in got.items():
            out = out.append_column(name, pa.array(x))
        return out

    return d.groupBy(*keys).applyInArrow(one, "".join(f"`{k}` {d.schema[k].dataType.simpleString()}, " for k in keys) + kind)


def _carried(df: DataFrame, keys: list[str], value: Column, start: Callable[[np.ndarray], np.ndarray], dy: Column, dx: Column, decay: float, leads: range) -> DataFrame:
    """What `start` makes of a grid of `value` (0 where no pixel is), carried on by (dy, dx) a step, widened by the root of
    the steps, fading by `decay` a step. A grid's leads are made in its task, so a pixel is shuffled once for all of them."""
    n = S.GRID

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at = c["row"].astype(np.int64) * n + c["col"]
        v = start(np.bincount(at, c["_v"], n * n).reshape(n, n)).ravel()
        ys, xs = np.full(n * n, np.nan), np.full(n * n, np.nan)
        if len(at):  # a pixel that is not listed moves as its grid's first
            ys[:], xs[:] = c["_dy"][0], c["_dx"][0]
        ys[at], xs[at] = c["_dy"], c["_dx"]
        moves = np.flatnonzero((v != 0) & np.isfinite(ys) & np.isfinite(xs))
        v, ys, xs, row, col = v[moves], ys[moves], xs[moves], moves // n, moves % n
        probs = []
        for step in leads:
            my, mx = ys * step, xs * step
            fy, fx = np.floor(my), np.floor(mx)
            f = np.zeros(n * n)
            for i, wy in ((0, 1 - (my - fy)), (1, my - fy)):
                for j, wx in ((0, 1 - (mx - fx)), (1, mx - fx)):
                    p, q = row + fy + i, col + fx + j
                    on = (p >= 0) & (p < n) & (q >= 0) & (q < n)
                    f += np.bincount((p[on] * n + q[on]).astype(np.int64), (v * wy * wx)[on], n * n)
            probs.append(np.clip(_mean(f.reshape(n, n), grid.spread_radius(step)) * decay**step, 0.0, 1.0).ravel())
        every = np.arange(n * n, dtype=np.int32)
        return {"lead": np.repeat(np.array(leads, np.int32), n * n), "row": np.tile(every // n, len(leads)), "col": np.tile(every % n, len(leads)), "prob": np.concatenate(probs)}

    columns = {"_v": F.coalesce(value.cast("double"), F.lit(0.0)), "_dy": dy, "_dx": dx}
    return _rasters(df, keys, columns, "lead int, row int, col int, prob double", run)


def moved(df: DataFrame, keys: list[str], field: str, dy: Column, dx: Column, decay: float, leads: range = LEADS) -> DataFrame:
    """A field carried on as it is; pixels that are not listed are 0."""
    return _carried(df, keys, F.col(field), lambda a: a, dy, dx, decay, leads)


def advection(df: DataFrame, keys: list[str], lit: str, dy: Column, dx: Column, leads: range = LEADS) -> DataFrame:
    return _carried(df, keys, F.col(lit), lambda a: _mean(a, 1), dy, dx, 0.97, leads)


def charging_rule(df: DataFrame, keys: list[str], m10: str, dy: Column, dx: Column, leads: range = LEADS, dbz: float = S.CHARGING_DBZ, dilate: int = 2) -> DataFrame:
    return _carried(df, keys, F.col(m10) >= dbz, lambda a: _mean(_most(a, dilate), 1), dy, dx, 0.95, leads)


def _shifts(names: list[str], most: int) -> Callable[[pa.Table], pa.Table]:
    """(names, dy, dx, s) of one frame's pixels and those of the frame before it: sums of products at each shift that has one."""
    dy, dx = (x.ravel() for x in np.mgrid[-most : most + 1, -most : most + 1].astype(np.int32))

    def run(pixels: pa.Table) -> pa.Table:
        old = pixels["_old"].to_numpy()
        row, col, v = (pixels[c].to_numpy() for c in ("row", "col", "_v"))
        row, col = (x.astype(np.int64) - x.min() + most for x in (row, col))
        now, there = np.zeros((row.max() + most + 1, col.max() + most + 1)), np.zeros((row.max() + most + 1, col.max() + most + 1), bool)
        np.add.at(now, (row[~old], col[~old]), v[~old])
        there[row[~old], col[~old]] = True
        at = row[old, None] + dy, col[old, None] + dx
        met = there[at]
        s = np.where(met, v[old, None] * now[at], 0.0).sum(0)
        some = np.flatnonzero(met.any(0))
        out = pixels.select(names).take(pa.array(np.zeros(len(some), np.int64)))
        for name, x in (("dy", dy), ("dx", dx), ("s", s)):
            out = out.append_column(name, pa.array(x[some]))
        return out

    return run


def motion(df: DataFrame, keys: list[str], frame: str, value: str, most: int = 6) -> DataFrame:
    """(keys, dy, dx): the median over successive frames of the whole-pixel shift of largest cross-correlation, of equal
    ones the first in scan order. Pairs of frames without any product give no vector; a key without one rests.

    Only pixels with an echo take part. A frame's pixels meet those of the frame before in one task, each its
    (2 most + 1)^2 neighbours, so the work is linear in pixels and a pixel is shuffled twice, however far it may shift."""
    d = df.where((F.coalesce(F.col(value), F.lit(0.0)) > 0) & F.col(frame).isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull())
    d = d.select(*keys, F.col(frame).cast("long").alias(frame), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("_v"), F.explode(F.array(F.lit(True), F.lit(False))).alias("_old"))
    d = d.withColumn(frame, F.col(frame) + F.col("_old").cast("int"))
    kinds = "".join(f"`{k}` {d.schema[k].dataType.simpleString()}, " for k in [*keys, frame])
    s = d.groupBy(*keys, frame).applyInArrow(_shifts([*keys, frame], most), f"{kinds}dy int, dx int, s double").withColumn("s", F.round("s", 6))
    best = s.groupBy(*keys, frame).agg(F.min_by(F.struct("dy", "dx"), F.struct(-F.col("s"), F.col("dy"), F.col("dx"))).alias("m"))
    per = best.groupBy(*keys).agg(F.percentile("m.dy", F.lit(0.5)).alias("dy"), F.percentile("m.dx", F.lit(0.5)).alias("dx"))
    return df.select(*keys).distinct().join(per, keys, "left").select(*keys, F.coalesce("dy", F.lit(0.0)).alias("dy"), F.coalesce("dx", F.lit(0.0)).alias("dx"))


def base_rate(train: DataFrame, lit: Column) -> DataFrame:
    """One row: the share of struck pixels of training data."""
    return train.agg(F.coalesce(F.avg(lit.cast("double")), F.lit(0.0)).alias("base_rate"))


def run_all(df: DataFrame, keys: list[str], lit: str, m10: str, dy: Column, dx: Column, base: float, leads: range = LEADS) -> DataFrame:
    """(model, keys, lead, row, col, prob) of every baseline. base: the training data's base rate."""
    named = {"persistence": persistence(df, keys, lit, leads), "climatology": climatology(df, keys, base, leads), "advection": advection(df, keys, lit, dy, dx, leads), "charging_rule": charging_rule(df, keys, m10, dy, dx, leads)}
    return reduce(DataFrame.unionByName, [d.select(F.lit(m).alias("model"), *keys, "lead", "row", "col", "prob") for m, d in named.items()])


def capped(dy: Column, dx: Column, most: float = 4.0) -> tuple[Column, Column]:
    size = F.hypot(dy, dx)
    scale = F.when(size > most, most / size).otherwise(1.0)
    return dy * scale, dx * scale


def initiation_mask(df: DataFrame, keys: list[str], lit: str, r: int = 4) -> DataFrame:
    """Pixels with no lightning within r at any input frame: `eligible`. df has a row for each frame."""
    had = df.groupBy(*keys, "row", "col").agg(F.max(F.col(lit).cast("int")).alias("_h"))
    return grid.box_max(had, keys, "_h", r, "_n").select(*keys, "row", "col", (F.col("_n") == 0).alias("eligible"))


def swept_mask(df: DataFrame, keys: list[str], lit: str, dy: float | Column, dx: float | Column, leads: range = LEADS, r: int = 4) -> DataFrame:
    """Pixels that advected lightning reaches, with the first lead at which it does: those leads and later are excluded.

    At each step a struck pixel sweeps the box it has moved and widened to; a box over an edge is cut, never wrapped. Only
    struck pixels are shuffled, once for all steps: a grid's steps are made in its task."""
    n = S.GRID

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        first = np.zeros((n, n), np.int32)
        for step in sorted({0, *leads}):
            p, q = c["row"] + np.rint(c["_dy"] * step), c["col"] + np.rint(c["_dx"] * step)
            on = (p >= 0) & (p < n) & (q >= 0) & (q < n)
            hit = np.zeros((n, n), bool)
            hit[p[on].astype(np.int64), q[on].astype(np.int64)] = True
            first[_most(hit, r + (grid.spread_radius(step) if step else 0)) & (first == 0)] = max(step, 1)
        row, col = np.nonzero(first)
        return {"row": row.astype(np.int32), "col": col.astype(np.int32), "first_lead": first[row, col]}

    dy, dx = (x if isinstance(x, Column) else F.lit(float(x)) for x in (dy, dx))
    struck = df.where((F.col(lit).cast("int") >= 1) & dy.isNotNull() & dx.isNotNull())
    struck = struck.select(*keys, "row", "col", dy.alias("_dy"), dx.alias("_dx")).distinct()
    return _rasters(struck, keys, {"_dy": F.col("_dy"), "_dx": F.col("_dx")}, "row int, col int, first_lead int", run)


def ensemble(df: DataFrame, advect: str, rule: str, persist: str, clim: str) -> DataFrame:
    """Weighted mean of four members and population variance of three."""
    a, b, c, d = (F.col(x) for x in (advect, rule, persist, clim))
    m = (a + b + c) / 3.0
    return df.withColumns({"ens_mean": 0.50 * a + 0.25 * b + 0.15 * c + 0.10 * d, "ens_var": ((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3.0})


def blend_weights(df: DataFrame, keys: list[str], learned: str, base: str, obs: str, points: int = 21) -> DataFrame:
    """Of each key (lead), the weight of least Brier score on a grid from 0 to 1, the lowest on ties.

    The score is a quadratic in the weight, so three sums over the data give it at every weight."""
    p, q, y = F.col(learned), F.col(base), F.col(obs)
    s = df.groupBy(*keys).agg(F.avg((p - q) * (p - q)).alias("_a"), F.avg((p - q) * (q - y)).alias("_b"), F.avg((q - y) * (q - y)).alias("_c"))
    s = s.withColumn("weight", F.explode(F.array(*[F.lit(i / (points - 1)) for i in range(points)])))
    s = s.withColumn("brier", F.round(F.col("_a") * F.col("weight") * F.col("weight") + 2 * F.col("_b") * F.col("weight") + F.col("_c"), 9))
    return s.groupBy(*keys).agg(F.min_by(F.struct("weight", "brier"), F.struct("brier", "weight")).alias("m")).select(*keys, "m.*")


def smoothed_weights(df: DataFrame, lead: str = "lead", weight: str = "weight") -> DataFrame:
    """Three-point mean over leads, ends repeated; a dozen rows."""
    w = Window.orderBy(lead)
    v = F.col(weight)
    return df.withColumn(weight, (F.coalesce(F.lag(weight).over(w), v) + v + F.coalesce(F.lead(weight).over(w), v)) / 3.0)


def pooled(values: list[float]) -> list[float]:
    """The non-increasing sequence nearest to values in squares: pool adjacent violators. Each block of the result is the
    mean of the values it stands for, so the total stays; pairwise averages, which weigh a block's last value most, would
    differ where more than two values meet."""
    blocks: list[tuple[float, int]] = []  # sum and number of values
    for v in values:
        total, n = float(v), 1
        while blocks and blocks[-1][0] * n < total * blocks[-1][1]:
            before, k = blocks.pop()
            total, n = total + before, n + k
        blocks.append((total, n))
    return [total / n for total, n in blocks for _ in range(n)]
