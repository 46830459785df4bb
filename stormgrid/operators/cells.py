"""Storm cells as connected areas, by tiles: labels inside tiles of a frame first, then labels that meet at tiles' edges are
made one. No task holds more than a tile's pixels, or the pairs of labels that meet in one frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pixel's number is row times this plus column, so that numbers are in scan order.
WIDTH = 1 << 24
TILE = 16


def _smallest(label: np.ndarray) -> np.ndarray:
    """Labels of a dense tile (-1: none) spread to their eight neighbours until nothing changes. Labels are indices into the
    flattened tile, so each round also follows the label's own label, and rounds are few."""
    h, w = label.shape
    big = h * w
    a = np.where(label < 0, big, label)
    while True:
        p = np.pad(a, 1, constant_values=big)
        m = np.min([p[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        m = np.where(label < 0, big, m)
        m = np.append(m.ravel(), big)[m]
        if np.array_equal(m, a):
            return np.where(label < 0, -1, a)
        a = m


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels that occur in pairs, and the smallest label that each hangs together with."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        for k in (x, y, root[x], root[y]):
            np.minimum.at(new, k, low)
        new = new[new]
        if np.array_equal(new, root):
            return names, names[root]
        root = new


def labels(df: DataFrame, keys: list[str], over: Column, tile: int = TILE) -> DataFrame:
    """(keys, row, col, label) of the pixels where `over` holds; label: the number of the first pixel, in scan order, of the
    eight-connected area that the pixel belongs to. keys tell frames apart and aren't null."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    on = df.where(over).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    on = on.withColumns({"_tr": F.floor(F.col("row") / tile).cast("int"), "_tc": F.floor(F.col("col") / tile).cast("int")})

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[-2] * tile, key[-1] * tile
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        grid = np.full((tile, tile), -1)
        grid[r, c] = r * tile + c
        low = _smallest(grid)[r, c]
        out = pdf[[*keys, "row", "col"]].copy()
        out["label"] = (low // tile + r0).astype(np.int64) * WIDTH + (low % tile + c0)
        return out

    inside = on.groupBy(*keys, "_tr", "_tc").applyInPandas(one, f"{kinds}, row int, col int, label long")
    # pairs across an edge: a pixel on one looks right and down; up and left are the other's
    edge = ((F.col("row") + 1) % tile <= 1) | ((F.col("col") + 1) % tile <= 1)
    rim = inside.where(edge)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    looks = rim.withColumn("s", F.explode(steps)).select(*keys, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), F.col("label").alias("_a"))
    pairs = looks.join(rim.withColumnRenamed("label", "_b"), [*keys, "row", "col"]).where("_a <> _b").select(*keys, "_a", "_b").distinct()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, root = _merged(pdf["_a"].to_numpy(), pdf["_b"].to_numpy())
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "label": names, "_root": root})

    roots = pairs.groupBy(*keys).applyInPandas(merge, f"{kinds}, label long, _root long")
    return inside.join(roots, [*keys, "label"], "left").select(*keys, "row", "col", F.coalesce("_root", "label").alias("label"))


def detect(df: DataFrame, keys: list[str], value: str, strikes: str, least: float = 25.0, pixels: int = 4, tile: int = TILE) -> DataFrame:
    """A row for each area of at least `pixels` pixels of `value` at or above `least`: cell (numbered in scan order), box (ends
    excluded), centroid, area, largest and mean value, struck pixels, severity, and rank (largest value first)."""
    d = labels(df, keys, F.col(value) >= least, tile).join(df.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).alias("_v"), F.col(strikes).alias("_s")), [*keys, "row", "col"])
    r1 = lambda c: F.bround(c, 1)
    d = d.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("_n"), F.min("row").alias("row_min"), (F.max("row") + 1).alias("row_max"), F.min("col").alias("col_min"), (F.max("col") + 1).alias("col_max"), r1(F.avg("row")).alias("centroid_row"), r1(F.avg("col")).alias("centroid_col"),
        r1(F.max("_v")).alias("max_dbz"), r1(F.avg("_v")).alias("mean_dbz"), F.count_if(F.col("_s") >= 1).alias("strikes"), F.max("_v").alias("_top")).where(F.col("_n") >= pixels)
    top = F.col("_top")
    d = d.withColumns({"cell": F.row_number().over(Window.partitionBy(*keys).orderBy("label")), "rank": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("max_dbz").desc(), "label")), "area_km2": (4 * F.col("_n")).cast("int"),
                       "severity": F.when(top >= 45, "CRITICAL").when(top >= 35, "SEVERE").otherwise("CONVECTIVE")})
    return d.select(*keys, "cell", "rank", "row_min", "row_max", "col_min", "col_max", "centroid_row", "centroid_col", "area_km2", "max_dbz", "mean_dbz", "strikes", "severity")
