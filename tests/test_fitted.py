"""Sliced as-of, flash lists, polar volumes, motion compensation, the fitted blend and adapters against numpy or by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormgrid.operators import asof, blend, forecast, lagrangian
from stormgrid.sources import adapters, flashes, polar

T0 = 1_700_000_000


def test_asof_in_slices(spark):
    """A key with most readings, one with none before some targets, a null key, equal times, gaps of many slices."""
    rng = random.Random(1)
    read = [(rng.choice(["hot"] * 9 + ["b", None]), T0 + rng.randrange(40_000), float(rng.randrange(100))) for _ in range(500)]
    read = list({(k, t): (k, t, v) for k, t, v in read}.values())
    ask = [(i, rng.choice(["hot", "b", None, "none"]), T0 - 500 + rng.randrange(90_000)) for i in range(300)] + [(1000, read[0][0], read[0][1])]
    s = spark.createDataFrame(read, "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    t = spark.createDataFrame(ask, "i long, k string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for linear in (False, True):
        got = {r["i"]: (r["v"], r["age_s"]) for r in asof.sliced(t, s, ["k"], "ts", "v", 600.0, 9000.0, linear).collect()}
        for i, k, at in ask:
            past = max(((a, v) for kk, a, v in read if kk == k and a <= at), default=None)
            nxt = min(((a, v) for kk, a, v in read if kk == k and a > at), default=None)
            if past is None:
                assert got[i] == (None, None)
                continue
            v = past[1] + (nxt[1] - past[1]) * (at - past[0]) / (nxt[0] - past[0]) if linear and nxt else past[1]
            assert got[i][1] == at - past[0] and (got[i][0] is None if at - past[0] > 9000 else got[i][0] == pytest.approx(v))
    assert asof.sliced(t.limit(0), s, ["k"], "ts", "v").count() == 0
    assert asof.sliced(t, s.limit(0), ["k"], "ts", "v").where("v IS NOT NULL").count() == 0


def test_held_planes(spark):
    scans = spark.createDataFrame([(1, T0), (1, T0 + 1800)], "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    planes = spark.createDataFrame([(1, T0, 0, 0, 5.0), (1, T0, 0, 1, 6.0), (1, T0 + 1800, 3, 3, 7.0)], "k int, s long, row int, col int, bt double").withColumn("scan_time", F.timestamp_seconds("s")).drop("s")
    frames = spark.createDataFrame([(1, T0 - 1), (1, T0), (1, T0 + 1200), (1, T0 + 1201), (1, T0 + 1900)], "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = sorted((int(r["ts"].timestamp()) - T0, r["row"], r["bt"], r["age_s"]) for r in asof.held_planes(frames, scans, planes, ["k"], "ts").collect())
    assert got == [(0, 0, 5.0, 0.0), (0, 0, 6.0, 0.0), (1200, 0, 5.0, 1200.0), (1200, 0, 6.0, 1200.0), (1900, 3, 7.0, 100.0)]


def test_edges_are_numpys_digitize(spark):
    rng = random.Random(2)
    edges = sorted(rng.uniform(-50, 50) for _ in range(49))
    t = [rng.uniform(-60, 60) for _ in range(300)] + edges + [float("nan"), None]
    got = [r[1] for r in spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t double").select("i", flashes.edge_index(F.col("t"), edges)).orderBy("i").collect()]
    assert got[:-2] == [int(k) - 1 for k in np.digitize(t[:-2], edges)] and got[-2:] == [None, None]
    with pytest.raises(ValueError):
        flashes.edge_index(F.col("t"), [2.0, 1.0])


def test_flash_columns_that_are_no_pixels(spark):
    rows = [("p", 1.0, 0.0, 0.0, 3.0, 2.0), ("p", 11.0, 0.0, 0.0, 3.0, 95.0), ("m", 5.0, 1.0, 2.0, 9e5, 1.0), ("m", -1.0, 1.0, 2.0, 9e5, 1.0)]
    f = spark.createDataFrame(rows, "id string, t double, lat double, lon double, x double, y double")
    e = spark.createDataFrame([("p", None, None, None, None), ("m", 0.0, 0.0, 4.0, 4.0), ("quiet", 0.0, 0.0, 4.0, 4.0)], "id string, llat double, llon double, ulat double, ulon double")
    g = flashes.flash_grid(f, e, "id", [0.0, 10.0])
    assert sorted(map(tuple, g.collect())) == [("m", 0, 36, 24, 1), ("p", 0, 2, 3, 1)]
    assert sorted(map(tuple, flashes.flash_counts(e, g, "id").collect())) == [("m", 1, 1), ("p", 1, 1), ("quiet", 0, 0)]
    with pytest.raises(Exception, match="no pixels"):
        flashes.flash_grid(f, e.withColumn("llat", F.lit(None).cast("double")), "id", [0.0, 10.0]).collect()


def _polar(volume, method, altitude, n=64):
    """Plain loops over the definition, for one volume: pixel to (dbz_at, reason, echo_top, lower_bound, column_max, lowest)."""
    sweeps = {}
    for e, a, r, z in volume:
        sweeps.setdefault(e, {})[a, r] = z
    out = {}
    radius = 6371.0 * 1.21
    for row in range(0, n, 7):
        for col in range(n):
            x, y = (col - 31.5) * 2, (31.5 - row) * 2
            rng, az = math.hypot(x, y), math.degrees(math.atan2(x, y)) % 360
            v, h = [], []
            for e in sorted(sweeps):
                azs, rgs = sorted({a for a, _ in sweeps[e]}), sorted({r for _, r in sweeps[e]})
                turn = lambda a, az=az: abs((a - az + 180) % 360 - 180)
                near = sorted(azs, key=lambda a: (turn(a), a))[:2]
                i0 = max(sum(r < rng for r in rgs) - 1, 0)
                i1 = min(i0 + 1, len(rgs) - 1)
                if rng < rgs[0] - (rgs[1] - rgs[0]) or rng > rgs[-1]:
                    z = None
                elif method == "nearest":
                    z = sweeps[e].get((near[0], rgs[i1] if abs(rgs[i1] - rng) < abs(rgs[i0] - rng) else rgs[i0]))
                else:
                    top = down = 0.0
                    for a in near:
                        for r in (rgs[i0], rgs[i1]):
                            w = 1 / max(math.hypot(math.radians(turn(a)) * max(rng, 1e-3), r - rng), 1e-3)
                            if (z := sweeps[e].get((a, r))) is not None:
                                top, down = top + w * z, down + w
                    z = top / down if down else None
                v.append(z)
                h.append(math.sqrt(rng * rng + radius * radius + 2 * rng * radius * math.sin(math.radians(e))) - radius)
            k = sum(x <= altitude for x in h) - 1
            reason, at = (1, None) if k < 0 else (2, None) if k == len(h) - 1 else (3, None)
            if reason == 3 and v[k] is not None and v[k + 1] is not None:
                w = (altitude - h[k]) / max(h[k + 1] - h[k], 1e-6)
                reason, at = 0, (1 - w) * v[k] + w * v[k + 1]
            high = max((i for i, z in enumerate(v) if z is not None and z >= 18), default=None)
            top = None
            if high is not None:
                top = h[high]
                if high + 1 < len(v) and v[high + 1] is not None and v[high] > v[high + 1]:
                    top += (v[high] - 18) / max(v[high] - v[high + 1], 1e-6) * (h[high + 1] - h[high])
            out[row, col] = (at, reason, top, high == len(v) - 1, max((z for z in v if z is not None), default=None), v[0])
    return out


@pytest.mark.parametrize("method", ["nearest", "idw"])
def test_polar_is_the_definition(spark, method):
    """Sweeps with gates and azimuths of their own, uneven, with holes."""
    rng = random.Random(3)
    vol = []
    for e in (0.5, 2.0, 4.5, 9.0, 16.0):
        azs = sorted({round(rng.uniform(0, 360), 1) for _ in range(60)})
        rgs = sorted({round(rng.uniform(1, 95), 1) for _ in range(50)})
        vol += [(e, a, r, round(rng.uniform(-5, 60), 1)) for a in azs for r in rgs if rng.random() < 0.8]
    df = spark.createDataFrame([("v", *x) for x in vol], "volume string, elev double, az double, rng double, dbz double")
    reasons = set()
    for altitude in (6.5, 0.4):
        got = {(r["row"], r["col"]): tuple(r)[3:] for r in polar.to_levels(df, method=method, altitude_km=altitude).where("row % 7 = 0").collect()}
        want = _polar(vol, method, altitude)
        assert set(got) == set(want)
        for k, w in want.items():
            assert got[k] == pytest.approx(w, abs=1e-4), k
        reasons |= {w[1] for w in want.values()}
    assert reasons == {0, 1, 2, 3}


def _shift(a, dy, dx):
    h, w = a.shape
    out = np.zeros_like(a)
    for r in range(h):
        for c in range(w):
            y, x = r - dy, c - dx
            y0, x0 = math.floor(y), math.floor(x)
            for i in (0, 1):
                for j in (0, 1):
                    if 0 <= y0 + i < h and 0 <= x0 + j < w:
                        out[r, c] += a[y0 + i, x0 + j] * ((y - y0) if i else 1 - (y - y0)) * ((x - x0) if j else 1 - (x - x0))
    return np.round(out, 9)


def test_lagrangian_frames(spark):
    rng = np.random.default_rng(4)
    n, leads = 12, 3
    fields = {(k, t): (rng.random((n, n)) < 0.25).astype(float) for k in "ab" for t in range(1, leads + 1)}
    move = {"a": (0.0, 0.0), "b": (1.5, -0.6)}
    rows = [(k, t, r, c, float(v[r, c])) for (k, t), v in fields.items() for r in range(n) for c in range(n)]
    m = spark.createDataFrame([(k, *v) for k, v in move.items()], "k string, dy double, dx double")
    df = spark.createDataFrame(rows, "k string, lead int, row int, col int, v double").join(m, "k")
    as_array = lambda d, v: {x: np.array([[dict(((r["row"], r["col"]), r[v] if v else 1.0) for r in d if (r["k"], r["lead"]) == x).get((i, j), 0.0) for j in range(n)] for i in range(n)]) for x in fields}
    older = as_array(lagrangian.compensate_inputs(df, ["k"], "lead", leads, "v", "dy", "dx", n).collect(), "v")
    there = as_array(lagrangian.compensate_targets(df, ["k"], "lead", F.col("v") >= 1, "dy", "dx", n).collect(), None)
    back = as_array(lagrangian.decompensate(df, ["k"], "lead", "v", "dy", "dx", n).collect(), "v")
    hits = {t: [0, 0, 0] for t in range(1, leads + 1)}
    for (k, t), a in fields.items():
        dy, dx = move[k]
        assert np.allclose(older[k, t], _shift(a, dy * (leads - t), dx * (leads - t)))
        want = (_shift(a, -dy * t, -dx * t) >= 0.5).astype(float)
        assert np.array_equal(there[k, t], want) and np.allclose(back[k, t], _shift(a, dy * t, dx * t))
        ones = _shift((_shift(np.ones((n, n)), -dy * t, -dx * t) >= 0.5).astype(float), dy * t, dx * t) >= 0.5
        come = (_shift(want, dy * t, dx * t) >= 0.5) & (a > 0)
        hits[t] = [x + y for x, y in zip(hits[t], (int(a.sum()), int(come.sum()), int(ones.sum())), strict=True)]
    pos = df.where("v >= 1").select("k", "lead", "row", "col")
    got = {r["lead"]: tuple(r)[1:] for r in lagrangian.coverage(pos, m, ["k"], leads, n).collect()}
    for t, (p, b, o) in hits.items():
        assert got[t] == (p, pytest.approx(b / p, abs=1e-6), pytest.approx(o / (2 * n * n), abs=1e-6))
    assert got[None][0] == sum(p for p, *_ in hits.values())
    still = lagrangian.coverage(pos.where("k = 'a'"), m.where("k = 'a'"), ["k"], leads, n).collect()
    assert all(r["recoverable_frac"] == r["grid_coverage_frac"] == 1.0 for r in still)


def test_blend_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, by = [], {}
    for lead in range(1, 7):
        y = (rng.random(80) < 0.3).astype(float)
        a, b = np.clip(y * (0.9 - lead / 8) + rng.random(80) * 0.3, 0, 1), np.clip(y * lead / 8 + rng.random(80) * 0.3, 0, 1)
        by[lead] = (a, b, y)
        rows += [(lead, *map(float, x)) for x in zip(a, b, y, strict=True)]
    df = spark.createDataFrame(rows, "lead int, adv double, net double, y double")
    raw = [min(range(21), key=lambda i, t=t: (round(float(np.mean((i / 20 * t[0] + (1 - i / 20) * t[1] - t[2]) ** 2)), 9), i)) / 20 for t in by.values()]
    pad = [raw[0], *raw, raw[-1]]
    want = [sum(pad[i : i + 3]) / 3 for i in range(6)]
    got = blend.weights(df, "lead", "adv", "net", "y").orderBy("lead")
    assert [r["weight"] for r in got.collect()] == pytest.approx(want) and [r["weight_raw"] for r in got.collect()] == pytest.approx(raw)
    assert got.first()["slope"] == pytest.approx(np.polyfit(range(6), want, 1)[0])
    mono = [r["weight"] for r in blend.weights(df, "lead", "adv", "net", "y", monotone=True).orderBy("lead").collect()]
    assert mono == pytest.approx(forecast.pooled(want))
    mix = np.concatenate([w * a + (1 - w) * b for w, (a, b, _) in zip(want, by.values(), strict=True)])
    y = np.concatenate([t[2] for t in by.values()])
    q = np.clip(mix, 1e-6, 1 - 1e-6)
    z = np.log(q / (1 - q))
    best = (float(np.mean((mix - y) ** 2)), 1.0, 0.0)
    for a in blend.SLOPES:
        for b in blend.OFFSETS:
            if (s := float(np.mean((1 / (1 + np.exp(-(a * z + b))) - y) ** 2))) < best[0] - 1e-9:
                best = (s, a, b)
    c = blend.calibration(df, got, "lead", "adv", "net", "y").first()
    assert (c["cal_a"], c["cal_b"]) == best[1:] and c["brier_calibrated"] == pytest.approx(best[0], abs=1e-8) and best[1:] != (1.0, 0.0)
    p = [r["prob"] for r in blend.apply(df, got, c["cal_a"], c["cal_b"], "lead", "adv", "net").collect()]
    assert float(np.mean((np.array(sorted(p)) - np.sort(1 / (1 + np.exp(-(best[1] * z + best[2]))))) ** 2)) < 1e-12


def test_adapters_states(spark, tmp_path):
    def put(source, **files):
        (tmp_path / f"source={source}").mkdir()
        for name, text in files.items():
            (tmp_path / f"source={source}" / f"{name}.json").write_text(text)

    put("radar", a1='{"data": 1}', a2='{"data": 2}')
    put("insat", a1='{"ir_tb": 1}', a2='{"nothing": 2}')
    put("lightning", a1="", a2=" \n")
    put("aws", a1='{"nothing": 1}')
    put("nwp", a1='{"status": "STALE", "values": {}}')
    put("mosdac_dwr", a1="\x00\x01binary")
    at = f"file://{tmp_path}"
    got = {r["source"]: r for r in adapters.read(spark, at).collect()}
    assert {s: r["state"] for s, r in got.items()} == {"radar": "LIVE", "insat": "STALE", "lightning": "UNAVAILABLE", "aws": "DEGRADED", "nwp": "LIVE", "mosdac_dwr": "LIVE", "imd_dwr": "NOT_CONFIGURED"}
    assert got["radar"]["payload"] == '{"data":2}' and got["mosdac_dwr"]["payload"] == '{"raw_size_bytes":8}'
    assert got["insat"]["payload"] == '{"ir_tb":1}' and "lacks" in got["insat"]["error"] and got["insat"]["stale"]
    strict = {r["source"]: r["state"] for r in adapters.read(spark, at, ["insat", "radar"], fallback=False).collect()}
    assert strict == {"insat": "DEGRADED", "radar": "LIVE"}
    gone = adapters.read(spark, "nowhere://x/y", ["radar"]).first()
    assert gone["state"] == "UNAVAILABLE" and gone["error"]
    assert adapters.read(spark, at).rdd.getNumPartitions() == 7
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = adapters.read(spark, at).where("source = 'aws'")
        assert one.rdd.getNumPartitions() == 1 and one.first()["state"] == "DEGRADED"
        assert {r["source"] for r in adapters.read(spark, at).where("source IN ('aws', 'nwp') AND state = 'LIVE'").collect()} == {"nwp"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="unknown sources"):
        adapters.read(spark, at, ["radr"]).collect()
