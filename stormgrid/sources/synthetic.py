"""Synthetic storm events: one task group an event, seeded by the event, so events are made in parallel and again alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stormgrid import schema as S

KINDS = ["electrified", "warm_rain", "stratiform", "clutter"]


def generate(spark: SparkSession, events: int = 24, frames: int = 36, seed: int = 20260905, mimics: float = 0.6, detection: float = 0.85, noise_db: float = 2.0) -> DataFrame:
    """Cell tables with moving cells of four kinds; only electrified ones strike, some frames after they reach the charging layer."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        event = int(key[0])
        rng = np.random.Generator(np.random.PCG64([seed, event]))
        yy, xx = np.mgrid[: S.GRID, : S.GRID]
        wind = rng.normal(0, 1.2, 2)
        cells = []
        for _ in range(rng.integers(2, 8)):
            kind = "electrified" if rng.random() > mimics else KINDS[rng.integers(1, 4)]
            cells.append((kind, rng.uniform(8, 56, 2), rng.integers(0, max(1, frames // 2)), rng.integers(10, 24), rng.uniform(2.5, 6)))
        parts = []
        for t in range(frames):
            sfc, m10, top = np.full((S.GRID, S.GRID), -20.0), np.full((S.GRID, S.GRID), -20.0), np.zeros((S.GRID, S.GRID))
            rate = np.zeros((S.GRID, S.GRID))
            for kind, at, born, life, size in cells:
                age = (t - born) / life
                if not 0 <= age <= 1:
                    continue
                grow = np.sin(np.pi * age)
                y, x = at + (wind * (t - born) if kind != "clutter" else 0)
                shape = np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * size**2))
                peak, deep, high = {"electrified": (58, 48, 14), "warm_rain": (50, 18, 5.5), "stratiform": (34, 22, 7), "clutter": (48, 0, 0.4)}[kind]
                sfc, m10, top = np.maximum(sfc, (peak + 20) * shape * grow - 20), np.maximum(m10, (deep + 20) * shape * grow - 20), np.maximum(top, high * shape * grow)
                if kind == "electrified" and age > 0.25:
                    rate += 2.5 * shape**2 * grow
            strikes = rng.binomial(rng.poisson(rate), detection).astype(float)
            sfc, m10 = sfc + rng.normal(0, noise_db, sfc.shape), m10 + rng.normal(0, noise_db, m10.shape)
            parts.append(pd.DataFrame({"event_id": event, "frame": t, "row": yy.ravel(), "col": xx.ravel(), "refl_sfc": sfc.ravel(), "refl_m10": m10.ravel(), "echo_top": top.ravel(), "vil": np.clip(sfc.ravel() - 10, 0, 70) / 2, "ir_tb": np.clip(295 - 6.5 * top.ravel() + rng.normal(0, 1.5, top.size), 180, 320), "light_dens": strikes.ravel(), "y": strikes.ravel()}))
        return pd.concat(parts, ignore_index=True)

    ids = spark.range(events).selectExpr("cast(id as int) as event_id")
    return ids.groupBy("event_id").applyInPandas(one, S.CELL)
