"""Cells by tiles against flood fill, planted motion, alert messages, kill counts and channel figures by hand."""

import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormgrid.functions import geo
from stormgrid.operators import cells, flow, qc, spatial
from stormgrid.streaming import strikes

GRID = "day int, row int, col int, z double, strikes int"


@pytest.mark.parametrize("tile", [4, 16, 64])
def test_cells_by_tiles_equal_flood_fill(spark, tile):
    """Random frames, a snake through all tiles, a frame without echoes, rings and diagonals across edges."""
    rng = np.random.default_rng(6)
    n, frames = 32, {}
    for k, p in enumerate((0.2, 0.35, 0.5)):
        frames[k] = np.where(rng.random((n, n)) < p, rng.uniform(26, 60, (n, n)).round(2), 0.0)
    snake = np.zeros((n, n))
    for r in range(0, n, 2):
        snake[r] = 30.0
        if r + 1 < n:
            snake[r + 1, -1 if r % 4 == 0 else 0] = 31.0
    frames[3], frames[4], frames[5] = snake, np.zeros((n, n)), np.fliplr(np.eye(n)) * 40 + np.eye(n) * 20
    rows = [(k, r, c, float(a[r, c]), int(a[r, c] > 50)) for k, a in frames.items() for r in range(n) for c in range(n)]
    df = spark.createDataFrame(rows, GRID)
    want = {(r["day"], r["cell"]): r.asDict() for r in spatial.detect_cells(df, ["day"], "z", "strikes").collect()}
    got = {(r["day"], r["cell"]): r.asDict() for r in cells.detect(df, ["day"], "z", "strikes", tile=tile).collect()}
    assert set(got) == set(want) and len(want) > 20
    for k, w in want.items():
        g = got[k]
        assert all(g[x] == w[x] for x in ("row_min", "row_max", "col_min", "col_max", "area_km2", "strikes", "severity"))
        assert all(g[x] == pytest.approx(w[x], abs=0.1001) for x in ("centroid_row", "centroid_col", "max_dbz", "mean_dbz"))
    for d in range(6):
        by_rank = [g["max_dbz"] for g in sorted((g for (k, _), g in got.items() if k == d), key=lambda g: g["rank"])]
        assert by_rank == sorted(by_rank, reverse=True)
    assert sum(k == 3 for k, _ in got) == 1 and not any(k == 4 for k, _ in got)


def test_planted_motion_by_region(spark):
    """Two storms that move apart, one of them not by whole pixels, and a key at rest."""
    n = 64
    y, x = np.mgrid[0:n, 0:n]
    blob = lambda r, c: 50 * np.exp(-((y - r) ** 2 + (x - c) ** 2) / (2 * 6.0**2))
    rows = []
    for t in range(4):
        a = blob(16 + 0.8 * t, 16 - 0.5 * t) + blob(48 - 0.6 * t, 48 + 0.9 * t)
        b = blob(32, 32)
        rows += [(k, t, r, c, float(v[r, c])) for k, v in (("moving", a), ("still", b)) for r in range(n) for c in range(n)]
    rows += [("clear", t, r, c, None) for t in range(2) for r in range(n) for c in range(n)]
    df = spark.createDataFrame(rows, "k string, frame int, row int, col int, z double")
    got = {(r["k"], r["region_row"], r["region_col"]): (r["dy"], r["dx"]) for r in flow.motion(df, ["k"], "frame", "z", region=32).collect()}
    assert got["moving", 0, 0] == pytest.approx((0.8, -0.5), abs=0.08) and got["moving", 1, 1] == pytest.approx((-0.6, 0.9), abs=0.08)
    whole = {r["k"]: (r["dy"], r["dx"]) for r in flow.motion(df, ["k"], "frame", "z").collect()}
    assert whole["still"] == pytest.approx((0.0, 0.0), abs=1e-9) and "clear" not in whole and "clear" not in {k for k, *_ in got}


def test_motion_from_features(spark):
    a = np.full((64, 64), -1.0)
    a[20:24, 30:34] = 1.0
    rows = [(1, t, r, c, float(np.roll(a, (2 * t, -t), (0, 1))[r, c])) for t in range(3) for r in range(64) for c in range(64)]
    m = flow.motion_from_features(spark.createDataFrame(rows, "k int, frame int, row int, col int, refl_sfc_n double"), ["k"], "frame").first()
    assert (m["dy"], m["dx"]) == (2.0, -1.0)


def test_alert_message(spark):
    df = spark.createDataFrame([("A & B <north>", "Hail", "Severe", "2024-03-01 12:30:15", 0, 64, 16, 32)], "area string, hazard string, severity string, at string, r0 int, r1 int, c0 int, c1 int")
    x = ET.fromstring(strikes.cap_alert(df, "area", "hazard", "severity", "at", ("r0", "r1", "c0", "c1")).first()["cap"].split("?>", 1)[1])
    get = lambda p: x.findtext("/".join("{urn:oasis:names:tc:emergency:cap:1.2}" + t for t in p.split("/")))
    assert get("identifier") == "STORM-1709296215" and get("sent") == "2024-03-01T12:30:15-00:00" and get("info/expires") == "2024-03-01T13:15:15-00:00"
    assert (get("info/urgency"), get("info/severity"), get("info/certainty"), get("info/event")) == ("Immediate", "Severe", "Observed", "Hail")
    assert get("info/headline").endswith("Hail IN A & B <NORTH>") and "850,000" in get("info/description") and get("info/instruction")
    assert get("info/area/polygon") == "18.0000,73.2500 18.0000,73.5000 19.0000,73.5000 19.0000,73.2500 18.0000,73.2500"


def test_kill_counts_by_hand(spark):
    """Rules in order; what one has masked, the next doesn't count again."""
    base = dict(refl_sfc=20.0, refl_m10=10.0, echo_top=8.0, vil=5.0, ir_tb=250.0, light_dens=0.0)
    rows = []
    for t in range(4):
        for r, c, change in ((10, 10, {}), (5, 5, dict(refl_sfc=48.0, echo_top=0.4)), (8, 8, dict(refl_sfc=38.0, echo_top=5.8, refl_m10=6.0)), (0, 0, {}), (31, 31, {})):
            v = {**base, **change}
            if (t, r) == (3, 10):
                v |= dict(vil=9999.0, ir_tb=float("nan"))
            rows.append((0, t, r, c, *v.values()))
    df = spark.createDataFrame(rows, "event_id int, frame int, row int, col int, " + ", ".join(f"{k} double" for k in base))
    got = {(r["rule"], r["channel"]): r["masked"] for r in qc.kill_counts(df, (31.0, 31.0), far_km=85.0).collect() if r["masked"]}
    far = sum(np.hypot((r - 31) * 2, (c - 31) * 2) > 85 for _, _, r, c, *_ in rows)
    assert far == 4 and geo.radar_geometry()["cone_of_silence_km"] == pytest.approx(17.86, abs=0.01)
    assert got == {("non_finite", "ir_tb"): 1, ("range", "vil"): 1, **{("clutter", c): 4 for c in ("refl_sfc", "refl_m10", "echo_top", "vil")}, ("bright_band", "refl_sfc"): 4,
                   ("far", "refl_m10"): 4, ("far", "echo_top"): 4, ("cone_of_silence", "refl_m10"): 4, ("cone_of_silence", "echo_top"): 4}
    s = {r["channel"]: r for r in qc.channel_statistics(qc.out_of_range(qc.non_finite(df))).collect()}
    assert (s["vil"]["valid"], s["vil"]["n"], s["vil"]["largest"]) == (19, 20, 5.0) and s["refl_sfc"]["mean"] == pytest.approx((12 * 20 + 4 * 48 + 4 * 38) / 20)
