"""Stencils against plain numpy, causality by changing the future, masks, motion, cells and quality control."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.operators import asof, features, forecast, grid, qc, spatial, splits
from stormgrid.sources import radar, store, synthetic

N = 64


@pytest.fixture(scope="module")
def noise(spark):
    a = np.random.Generator(np.random.PCG64(1)).random((N, N))
    df = spark.createDataFrame([(0, r, c, float(a[r, c])) for r in range(N) for c in range(N)], "day int, row int, col int, z double").cache()
    return a, df


def back(df, name):
    out = np.zeros((N, N))
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


@pytest.mark.parametrize("r", [1, 4])
def test_boxes(noise, r):
    a, df = noise
    rep, cut = np.pad(a, r, mode="edge"), np.pad(a, r, constant_values=-1)
    mean = sum(rep[i : i + N, j : j + N] for i in range(2 * r + 1) for j in range(2 * r + 1)) / (2 * r + 1) ** 2
    most = np.max([cut[i : i + N, j : j + N] for i in range(2 * r + 1) for j in range(2 * r + 1)], axis=0)
    assert np.allclose(back(grid.box_mean(df, ["day"], "z", r, "m"), "m"), mean)
    assert np.array_equal(back(grid.box_max(df, ["day"], "z", r, "m"), "m"), most)


def test_shift(noise):
    a, df = noise
    got = back(grid.shift(df, ["day"], "z", F.lit(2.0), F.lit(-3.0), "f"), "f")
    want = np.zeros_like(a)
    want[2:, : N - 3] = a[: N - 2, 3:]
    assert np.allclose(got, want)


def test_resample_keeps_means(noise):
    a, df = noise
    got = grid.resample_area(df, ["day"], "z", 64, 32, "m").collect()
    assert np.allclose(sorted(r["m"] for r in got), sorted(a.reshape(32, 2, 32, 2).mean((1, 3)).ravel()))


def test_motion_of_a_moved_block(spark):
    rows = [(0, t, 20 + 2 * t + i, 30 - t + j, 50.0) for t in range(4) for i in range(3) for j in range(4)]
    df = spark.createDataFrame(rows, "day int, frame int, row int, col int, z double")
    r = forecast.motion(df, ["day"], "frame", "z").first()
    assert (r["dy"], r["dx"]) == (2.0, -1.0)
    assert forecast.motion(df.withColumn("z", F.lit(0.0)), ["day"], "frame", "z").first()["dy"] == 0.0


def test_initiation_mask_does_not_wrap(spark):
    df = grid.dense(spark.createDataFrame([(0, 6, 0, 1)], "day int, row int, col int, lit int"), ["day"]).withColumn("lit", F.coalesce("lit", F.lit(0)))
    assert forecast.initiation_mask(df, ["day"], "lit", 4).where("not eligible").count() == 45


def test_pooled():
    assert forecast.pooled([1.0, 3.0, 2.0]) == sorted(forecast.pooled([1.0, 3.0, 2.0]), reverse=True)
    assert forecast.pooled([3.0, 2.0, 1.0]) == [3.0, 2.0, 1.0] and forecast.pooled([]) == []
    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(50):
        v = rng.random(rng.integers(1, 13))
        got = np.array(forecast.pooled(v.tolist()))
        # from its definition: at each place the largest mean to the right of the smallest such choice to the left
        want = [min(max(v[a:b].mean() for b in range(i + 1, len(v) + 1)) for a in range(i + 1)) for i in range(len(v))]
        assert np.allclose(got, want) and np.isclose(got.sum(), v.sum()) and (np.diff(got) <= 1e-12).all()


def test_features_do_not_see_the_future(spark):
    cells = synthetic.generate(spark, 1, 6).where("row < 64").cache()
    late = cells.withColumn("refl_m10", F.when(F.col("frame") == 4, F.col("refl_m10") + 5).otherwise(F.col("refl_m10")))
    a, b = (features.build(x).where("frame < 4").agg(*[F.sum(c) for c in features.NAMES]).first() for x in (cells, late))
    assert tuple(a) == tuple(b)
    assert tuple(features.build(cells).where("frame = 4").agg(F.sum("graupel_cmax")).first()) != tuple(features.build(late).where("frame = 4").agg(F.sum("graupel_cmax")).first())


def test_synthetic_repeats_and_validates(spark):
    a = synthetic.generate(spark, 2, 3)
    assert a.count() == 2 * 3 * N * N and a.exceptAll(synthetic.generate(spark, 2, 3)).count() == 0
    qc.validate(qc.out_of_range(a))
    with pytest.raises(qc.ContractError):
        qc.validate(a.drop("vil"))
    with pytest.raises(qc.ContractError):
        qc.validate(a.withColumn("y", F.lit(-1.0)))


def test_store_round_trip(spark, tmp_path):
    a = qc.out_of_range(synthetic.generate(spark, 2, 2))
    store.save_events(a, str(tmp_path / "s"))
    b = store.load_events(spark, str(tmp_path / "s"))
    assert b.where("event_id = 1").count() == 2 * N * N and set(b.columns) == set(a.columns)


def test_clutter_spike(spark):
    df = spark.createDataFrame([(0, r, c, 60.0 if (r, c) == (5, 5) else 5.0) for r in range(10) for c in range(10)], "day int, row int, col int, z double")
    out = qc.despeckle(df, "z", ["day"], "m", 10)
    assert out.where("m <> 5").count() == 0


def test_qc_masks_in_order(spark):
    rows = [(0, t, 6, 6, 48.0, 0.0, 0.4, 9.0, 290.0, 0.0, 0.0) for t in range(4)] + [(0, t, 10, 10, 20.0, 10.0, 6.0, 9999.0, 250.0, 0.0, 0.0) for t in range(4)]
    out = qc.quality_control(spark.createDataFrame(rows, S.CELL)).collect()
    assert all(r["refl_sfc"] is None and r["vil"] is None and r["ir_tb"] == 290.0 for r in out if r["row"] == 6)
    assert all(r["vil"] is None and r["refl_sfc"] == 20.0 for r in out if r["row"] == 10)


def test_cells(spark):
    rows = [(0, r, c, 40.0, 1) for r in (1, 2) for c in (1, 2)] + [(0, 3, 3, 50.0, 0), (0, 30, 30, 60.0, 0)]
    out = spatial.detect_cells(spark.createDataFrame(rows, "day int, row int, col int, z double, strikes int"), ["day"], "z", "strikes").collect()
    assert len(out) == 1 and out[0]["area_km2"] == 20 and out[0]["row_max"] == 4 and out[0]["severity"] == "CRITICAL" and out[0]["strikes"] == 4


def test_asof_limit_and_ties(spark):
    t = spark.sql("select 1 k, timestamp'2024-01-01 00:10:00' ts union all select 1, timestamp'2024-01-01 02:00:00'")
    s = spark.sql("select 1 k, timestamp'2024-01-01 00:10:00' ts, 5.0D v")
    out = asof.asof(t, s, ["k"], "ts", "v", 1200.0).orderBy("ts").collect()
    assert [r["v"] for r in out] == [5.0, None] and out[0]["age_s"] == 0.0


@pytest.mark.parametrize("n", [3, 6, 9, 12, 20, 37, 60])
def test_split_sizes(spark, n):
    assert min(splits.split_sizes(n)) >= 1 and sum(splits.split_sizes(n)) == n
    s = splits.split_events(spark.range(n), "id", seed=42)
    assert s.count() == n and splits.overlapping(s, "id").count() == 0
    with pytest.raises(ValueError):
        splits.split_sizes(2)


def test_leakage_of_neighbours(spark):
    w = spark.range(200).selectExpr("1 as e", "id as t0")
    assert splits.leakage(w.where("t0 % 5 > 0"), w.where("t0 % 5 = 0"), "e").first()["part"] > 0.9


def test_radar_layers(spark):
    v = spark.range(360).selectExpr("cast(id as double) az").crossJoin(spark.range(1, 240).selectExpr("id / 2.0D rng")).crossJoin(spark.createDataFrame([(0.5,), (5.0,), (10.0,), (20.0,)], "elev double")).selectExpr("elev", "az", "rng", "40.0D dbz")
    out = radar.to_pixels(v)
    r = out.where("row = 31 and col = 51").first()
    assert r["reason"] == 0 and abs(r["dbz_at"] - 40) < 1e-9 and r["column_max"] == 40


def test_sentinels(spark):
    df = S.from_sentinels(spark.createDataFrame([(-999.0,), (float("nan"),), (12.0,)], "vil double"))
    assert [r[0] for r in df.collect()] == [None, None, 12.0]


def _box(a, r, mean):
    p = np.pad(a, r, mode="edge") if mean else np.pad(a, r, constant_values=0)
    x = [p[i : i + N, j : j + N] for i in range(2 * r + 1) for j in range(2 * r + 1)]
    return sum(x) / len(x) if mean else np.max(x, axis=0)


def _moved(a, y, x):
    out = np.zeros_like(a)
    for r, c in np.argwhere(a != 0):
        for i in (0, 1):
            for j in (0, 1):
                p, q = int(np.floor(y)) + r + i, int(np.floor(x)) + c + j
                if 0 <= p < N and 0 <= q < N:
                    fy, fx = y - np.floor(y), x - np.floor(x)
                    out[p, q] += a[r, c] * (fy if i else 1 - fy) * (fx if j else 1 - fx)
    return out


def test_whole_forecasts_against_numpy(spark, tmp_path):
    """A storm that moves by (-3, 5) pixels an hour, with noise, over a day: 6 pixels of shift, 12 leads, its own motion."""
    from datetime import datetime, timezone

    from stormgrid.plans import registry

    rng, rows = np.random.Generator(np.random.PCG64(4)), []
    for hour in range(5):
        at = datetime(2024, 1, 15, hour, tzinfo=timezone.utc)
        for i, j, v in [(0, 0, 400.0), (0, 2, 320.0), (3, 1, 500.0)]:
            rows.append((40 - 3 * hour + i, 8 + 5 * hour + j, at, v, "error"))
        rows += [(int(r), int(c), at, 9.0, "view") for r, c in rng.integers(0, N, (8, 2))]
    df = spark.createDataFrame([(i, ts, r, kind, v, '{"k": %d}' % c) for i, (r, c, ts, v, kind) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "events.parquet"))
    q = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()

    frames, lit, top = np.zeros((5, N, N)), np.zeros((N, N)), np.zeros((N, N))
    for r, c, ts, v, kind in rows:
        frames[ts.hour, r, c], top[r, c] = max(frames[ts.hour, r, c], v / 8.0), max(top[r, c], v / 7.3)
        lit[r, c] = max(lit[r, c], kind == "error")
    best = []
    for a, b in zip(frames, frames[1:], strict=False):
        score = {(dy, dx): sum(a[r, c] * b[r + dy, c + dx] for r, c in np.argwhere(a > 0) if 0 <= r + dy < N and 0 <= c + dx < N) for dy in range(-6, 7) for dx in range(-6, 7)}
        best.append(max(score, key=score.get))
    dy, dx = np.median(best, axis=0)
    (m,) = q("motion_xcorr_whole")
    assert (m["dy"], m["dx"]) == (dy, dx) == (-3.0, 5.0)
    size = np.hypot(dy, dx)
    dy, dx = dy * 4 / size, dx * 4 / size

    for name, start, decay in (("advection_whole", _box(lit, 1, True), 0.97), ("charging_rule_whole", _box(_box((top >= 40) * 1.0, 2, False), 1, True), 0.95)):
        got = np.zeros((13, N, N))
        for r in q(name):
            got[r["lead"], r["row"], r["col"]] = r["prob"]
        for step in range(1, 13):
            want = np.clip(_box(_moved(start, dy * step, dx * step), round(np.sqrt(step)), True) * decay**step, 0, 1)
            assert np.allclose(got[step], want, atol=2e-6), (name, step)

    want = np.full((N, N), 99)
    for step in range(12, -1, -1):
        hit = np.zeros((N, N))
        for r, c in np.argwhere(lit):
            p, k = r + round(dy * step), c + round(dx * step)
            if 0 <= p < N and 0 <= k < N:
                hit[p, k] = 1
        want[_box(hit, 4 + (round(np.sqrt(step)) if step else 0), False) > 0] = max(step, 1)
    got = np.full((N, N), 99)
    for r in q("swept_corridor_whole"):
        got[r["row"], r["col"]] = r["first_lead"]
    assert np.array_equal(got, want) and got[got < 99].max() > 3


def test_asof_reads_no_frame_anew_for_each_row(spark):
    """Interpolated readings by hand, equal times and nulls among them, from frames that grow with the rows only."""
    t = spark.createDataFrame([(k, k % 2, s) for k, s in enumerate([5, 10, 10, 15, 40, 5])], "id long, row int, s long").select("id", "row", F.timestamp_seconds("s").alias("ts"))
    v = spark.createDataFrame([(0, 4, 1.0), (0, 10, 7.0), (0, 20, None), (0, 30, 27.0), (1, 8, 3.0)], "row int, s long, v double").select("row", F.timestamp_seconds("s").alias("ts"), "v")
    want = {0: (2.0, 1.0), 1: (3.0, 2.0), 2: (7.0, 0.0), 3: (3.0, 7.0), 4: (27.0, 10.0), 5: (None, None)}
    for join in (asof.asof, asof.sliced):
        d = join(t, v, ["row"], "ts", "v", linear=True)
        assert {r["id"]: (r["v"], r["age_s"]) for r in d.collect()} == want
        frames = d._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedpreceding" in frames and "unboundedfollowing" not in frames


def test_motion_shuffles_a_pixel_twice_whatever_the_shift(spark):
    """A planted shift, with nulls, a pixel of no echo and a frame missing, from a plan that repeats pixels once and not for each shift."""
    rows = [(1, f, 20 + 2 * f + i, 30 - 3 * f + 2 * i, 5.0 + i) for f in range(3) for i in range(3)] + [(1, 1, 0, 0, None), (1, 1, 1, 1, 0.0), (1, None, 5, 5, 9.0), (2, 0, 4, 4, 1.0), (2, 2, 4, 5, 1.0)]
    d = forecast.motion(spark.createDataFrame(rows, "day int, hour int, row int, col int, z double"), ["day"], "hour", "z")
    assert sorted(tuple(r) for r in d.collect()) == [(1, 2.0, -3.0), (2, 0.0, 0.0)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "explode([true,false])" in plan.replace(" ", "")


def _sparse(spark):
    """Grids of a few pixels: one with nulls and a pixel outside, one that moves by fractions, one whose pixels have no row."""
    rows = [(1, 0, 0, 1.0), (1, 63, 63, 1.0), (1, 5, 6, None), (1, 64, 3, 1.0), (1, None, 2, 1.0), (2, 30, 31, 1.0), (2, 32, 31, 0.0), (3, None, None, 0.0)]
    return spark.createDataFrame(rows, "day int, row int, col int, lit double")


def _exchanges(d):
    return d._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_sweep_shuffles_struck_pixels_and_not_each_step(spark):
    d = forecast.swept_mask(_sparse(spark), ["day"], "lit", F.lit(1.25), F.lit(-0.5), range(1, 13))
    assert _exchanges(d) <= 2
    got, want = {(r["day"], r["row"], r["col"]): r["first_lead"] for r in d.collect()}, {}
    for day, r, c in ((1, 0, 0), (1, 63, 63), (2, 30, 31)):
        for step in range(12, -1, -1):
            p, q, rr = r + round(1.25 * step), c + round(-0.5 * step), 4 + round(step**0.5)
            if 0 <= p < N and 0 <= q < N:
                for at in ((day, i, j) for i in range(max(p - rr, 0), min(p + rr, N - 1) + 1) for j in range(max(q - rr, 0), min(q + rr, N - 1) + 1)):
                    want[at] = min(want.get(at, 99), max(step, 1))
    assert got == want


def _carried_by_hand(starts, decay):
    return {(day, step): np.clip(_box(_moved(a, 1.25 * step, -0.5 * step), round(np.sqrt(step)), True) * decay**step, 0, 1) for day, a in starts.items() for step in range(1, 13)}


def _grids(d):
    got, n = {}, 0
    for r in d.collect():
        got.setdefault((r["day"], r["lead"]), np.zeros((N, N)))[r["row"], r["col"]] = r["prob"]
        n += 1
    assert n == len(got) * N * N
    return got


def _lit():
    lit = {1: np.zeros((N, N)), 2: np.zeros((N, N)), 3: np.zeros((N, N))}
    lit[1][0, 0] = lit[1][63, 63] = lit[2][30, 31] = 1
    return lit


def test_charging_rule_shuffles_a_pixel_once_for_all_leads(spark):
    d = forecast.charging_rule(_sparse(spark).withColumn("z", F.col("lit") * 40.0), ["day"], "z", F.lit(1.25), F.lit(-0.5))
    assert _exchanges(d) == 1
    got, want = _grids(d), _carried_by_hand({k: _box(_box(a, 2, False), 1, True) for k, a in _lit().items()}, 0.95)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_advection_shuffles_a_pixel_once_for_all_leads(spark):
    d = forecast.advection(_sparse(spark), ["day"], "lit", F.lit(1.25), F.lit(-0.5))
    assert _exchanges(d) == 1
    got, want = _grids(d), _carried_by_hand({k: _box(a, 1, True) for k, a in _lit().items()}, 0.97)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
