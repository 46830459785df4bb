"""The feature stack, archive loader, padding and city tables against numpy or by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.operators import features, grid
from stormgrid.sources import archive, weather


def _box(a, r, how):
    """a: (frames, rows, columns); edges repeated, which for a largest value is the same as cut."""
    p = np.pad(a, ((0, 0), (r, r), (r, r)), mode="edge")
    parts = [p[:, i : i + a.shape[1], j : j + a.shape[2]] for i in range(2 * r + 1) for j in range(2 * r + 1)]
    return np.max(parts, axis=0) if how == "max" else np.sum(parts, axis=0) / (2 * r + 1) ** 2


def test_feature_stack_by_numpy(spark):
    rng = np.random.default_rng(8)
    t, n = 4, S.GRID
    x = {"refl_sfc": rng.uniform(0, 60, (t, n, n)), "refl_m10": rng.uniform(-5, 55, (t, n, n)), "echo_top": rng.uniform(0, 15, (t, n, n)), "vil": rng.uniform(0, 40, (t, n, n)), "ir_tb": rng.uniform(200, 300, (t, n, n)), "light_dens": rng.choice([0.0, 0.5, 1.0, 3.0], (t, n, n), p=[0.9, 0.04, 0.03, 0.03])}
    for c in ("refl_m10", "echo_top", "ir_tb"):
        x[c][rng.random((t, n, n)) < 0.1] = np.nan
    val = lambda v: None if np.isnan(v) else float(v)
    rows = [(1, f, r, c, *(val(x[k][f, r, c]) for k in S.CHANNELS)) for f in range(t) for r in range(n) for c in range(n)]
    df = spark.createDataFrame(rows, "event_id int, frame int, row int, col int, " + ", ".join(f"{c} double" for c in S.CHANNELS))
    got = {k: np.zeros((t, n, n)) for k in features.NAMES}
    for r in features.build(df).toPandas().itertuples(index=False):
        for k in features.NAMES:
            got[k][r.frame, r.row, r.col] = getattr(r, k)
    z = lambda a: np.nan_to_num(a, nan=0.0)
    m10, top, ir = x["refl_m10"], x["echo_top"], x["ir_tb"]
    with np.errstate(invalid="ignore"):
        u = (m10 - 8.0) / 12.0
        excess = z(np.where(u > 20, u, np.log1p(np.exp(np.minimum(u, 20)))) * 12.0)
        g = np.where(np.isnan(m10) | np.isnan(top), 0.0, excess * np.sqrt(np.maximum(0, z(top) - 6.5)))
        deep = z(np.clip((top - 6.5) / 4, 0, 1.5) * np.clip((250 - ir) / 30, 0, 1.5))
    lit = (x["light_dens"] >= 1).astype(float)
    want = {f"{c}_n": z((x[c] - S.NORM[c][0]) / S.NORM[c][1]) for c in S.CHANNELS}
    want |= {"m10_valid": (~np.isnan(m10)).astype(float), "charge_excess": excess / 20, "graupel": g / 40, "deep_conv": deep, "graupel_max_r2": _box(g, 2, "max") / 40, "graupel_max_r4": _box(g, 4, "max") / 40, "graupel_mean_r4": _box(g, 4, "mean") / 40, "light_max_r4": _box(lit, 4, "max")}
    for k, a, s in (("d_refl_m10", m10, 10), ("d_echo_top", top, 2), ("d_ir_tb", ir, 10), ("d_graupel", g, 20)):
        want[k] = z(np.concatenate([np.zeros((1, n, n)), np.diff(a, axis=0)]) / s)
    want["graupel_cmax"] = np.maximum.accumulate(g, axis=0) / 40
    want["light_cmean"] = np.cumsum(lit, axis=0) / np.arange(1, t + 1)[:, None, None]
    assert set(want) == set(features.NAMES)
    for k, w in want.items():
        assert np.allclose(got[k], w, atol=1e-9), k
    labels = df.select("event_id", "frame", "row", "col", (F.col("light_dens") >= 1).alias("label"))
    best = features.rank_features(features.build(df), labels, ["light_dens_n", "vil_n"]).collect()
    assert [r["feature"] for r in best] == ["light_dens_n", "vil_n"] and best[0]["auprc"] == 1.0


def test_crop_and_pad_are_numpys(spark):
    rng = np.random.default_rng(9)
    for n, m in ((7, 4), (8, 3), (4, 7), (3, 8), (5, 5)):
        a = rng.random((n, n))
        df = spark.createDataFrame([(1, r, c, float(a[r, c])) for r in range(n) for c in range(n)], "k int, row int, col int, v double")
        got = np.full((m, m), np.nan)
        rows = grid.crop_or_pad(df, ["k"], "v", n, m).collect()
        assert len(rows) == m * m
        for r in rows:
            got[r["row"], r["col"]] = np.nan if r["v"] is None else r["v"]
        o = (n - m) // 2
        want = a[o : o + m, o : o + m] if m <= n else np.pad(a, [(-o, m - n + o)] * 2, constant_values=np.nan)
        assert np.array_equal(got, want, equal_nan=True), (n, m)


def test_archive_events(spark):
    """An event with all types, one without infrared, one without flashes, one without vil, which goes."""
    native = archive.Native((32, 4.0), (32, 4.0), (16, 8.0), (0.0, 300.0))
    kinds = {"all": ["vil", "ir107", "lght"], "no_ir": ["vil", "lght"], "no_flash": ["vil", "ir107"], "no_vil": ["ir107", "lght"]}
    catalog = spark.createDataFrame([(i, k, "Storm") for i, ks in kinds.items() for k in ks] + [("other", "vil", "Quiet")], "id string, img_type string, event_type string")
    raw = [(i, k, 0, 5, 6, 100.0 if k == "vil" else -5000.0) for i, ks in kinds.items() for k in ks if k != "lght"] + [("all", "vil", 1, 0, 0, 250.0)]
    rasters = spark.createDataFrame(raw, "id string, img_type string, frame int, row int, col int, raw double")
    flashes = spark.createDataFrame([(i, 10.0, 0.0, 0.0, 3.0, 2.0) for i in ("all", "all", "no_ir", "no_vil")], "id string, t double, lat double, lon double, x double, y double")
    rows = archive.load(catalog, rasters, flashes, native, ["Storm"]).collect()
    at = {(r["event_id"], r["frame"], r["row"], r["col"]): r for r in rows}
    assert {r["event_id"] for r in rows} == {"all", "no_ir", "no_flash"}
    vil = np.exp((100 - 83.9) / 38.9)
    r = at["all", 0, 11, 13]
    assert r["vil"] == pytest.approx(vil) and r["ir_tb"] == pytest.approx(223.15) and at["all", 0, 0, 0]["light_dens"] == 0.0
    assert r["echo_top"] == pytest.approx((300 - 223.15) / 6.5 - 1.5) and r["refl_m10"] < r["refl_sfc"]
    assert at["all", 0, 8, 12]["light_dens"] == at["all", 0, 11, 15]["y"] == 2 / 16 and at["all", 1, 8, 12]["light_dens"] == 0.0
    assert at["all", 1, 0, 0]["vil"] is None and at["all", 1, 0, 0]["refl_sfc"] is None  # out of range, and no infrared there
    r = at["no_ir", 0, 10, 12]
    assert r["ir_tb"] is None and r["echo_top"] == pytest.approx((300 - 290) / 6.5 - 1.5)
    r = at["no_flash", 0, 10, 12]
    assert r["light_dens"] is None and r["y"] == 0.0 and sum(k[0] == "no_flash" for k in at) == 4
    bare = archive.load(catalog, rasters, flashes, native, ["Storm"], surrogates=False)
    assert bare.where("refl_sfc IS NOT NULL OR refl_m10 IS NOT NULL OR echo_top IS NOT NULL").count() == 0


def test_city_tables(spark):
    hours = {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], **{n: [1.0, None] for n in weather._FETCHED}}
    hours["weathercode"], hours["cape"] = [95, None], [1500.0, None]
    p = spark.createDataFrame([("A", "s", 1.0, 2.0, json.dumps({"hourly": hours})), ("B", "s", 1.0, None, json.dumps({"hourly": hours})), ("C", "s", 1.0, 2.0, "no json"), ("D", "s", 1.0, 2.0, "{}")], "city string, state string, latitude double, longitude double, json string")
    got = weather.city_hourly(weather.cities(p), "json")
    assert got.columns == weather.CITY_COLUMNS and len(weather.CITY_COLUMNS) == 17
    rows = sorted(got.collect(), key=lambda r: r["timestamp"])
    assert [(r["city"], r["is_thunderstorm"], r["lightning_proxy"], r["cape"]) for r in rows] == [("A", 1, 0.415, 1500.0), ("A", 0, 0.0, None)]
    day = weather.daily(weather.together([got, got.drop("rain")])).first()
    assert day["city"] == "A" and day["precipitation"] == 2.0 and day["rain"] == 1.0
