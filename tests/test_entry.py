import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", ["lead_bands", "threshold_sweep", "ranking_by_day", "asof_hold", "naive_leakage", "station_risk", "motion_xcorr", "tumbling_5min", "ranking_overall", "full_evaluation", "model_comparison", "model_verdict", "lead_evaluation", "flash_frames", "scattered_max", "imager_kelvin", "linear_axis_regrid", "strike_ingest", "location_risk", "split_windows", "weather_daily", "source_health", "evaluation_sweep", "evaluation_neighbourhood", "comparison_table", "strike_buffer", "strike_buffer_capped", "source_freshness", "alert_states", "asof_sliced", "asof_sliced_linear", "imager_hold", "flash_edges", "flash_counts", "polar_nearest", "polar_idw", "lagrangian_coverage", "blend_fit", "blend_calibration", "source_adapters", "cells_tiled", "flow_regions", "qc_kill_counts", "channel_statistics", "all_baselines", "cap_alerts", "archive_cells", "config_grid", "nearest_regrid", "city_hours", "background_density"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got = entry.queries()[name](spark, DIR)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    q = entry.queries()
    n = lambda name: q[name](spark, DIR).agg({"strikes": "sum"}).first()[0]
    assert n("stream_tumbling_5min") == n("tumbling_5min")


@pytest.mark.parametrize("files", [1, 3])
def test_stream_leaves_its_rows_in_files(spark, tmp_path, files):
    """Equal to the batch query row by row, of a table in a folder too, and not held in the driver's memory sink."""
    spark.read.parquet(f"{DIR}/events.parquet").repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    q = entry.queries()
    got = q["stream_tumbling_5min"](spark, str(tmp_path))
    assert got.inputFiles()
    rows = lambda df, first: sorted(tuple(r) for r in df.selectExpr(first, "row", "col", "strikes").collect())
    assert rows(got, "unix_micros(start) div 300000000") == rows(q["tumbling_5min"](spark, str(tmp_path)), "frame")


def test_surrogates_without_density_equal_sql(spark, tmp_path):
    """A value of 0: the SQL has the curve's 18 dBZ there, and a raster's pixel without a strike has no echo."""
    from stormgrid.functions import scalar

    rows = [(i, f"2024-01-01 00:0{i}:00", i, "view", v, '{"k": 3}') for i, v in enumerate([0.0, 0.01, 4.0, 250.0])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("* except (ts)", "cast(ts as timestamp_ntz) ts").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["surrogates"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in entry.queries()["surrogates"](spark, str(tmp_path)).collect()) == sorted(want.fetchall())
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,)], "d double").select(scalar.proxy_dbz(scalar.F.col("d"))).collect()] == [0.0, pytest.approx(31.245, abs=1e-3)]
