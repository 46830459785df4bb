"""Keyed streaming state against its batch form and plain Python, over several batches and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from stormgrid.streaming import state

START = 1_700_000_000


@pytest.fixture(scope="module")
def rows():
    """(event_id, s, kind, zone), with equal times and gaps longer than every limit."""
    rng, t, out = random.Random(4), START, []
    for i in range(700):
        t += rng.choice([0, 1, 20, 60, 200, 301, 900, 4000])
        out.append((i, t, rng.choice(["error", "click", "view"]), rng.randrange(3)))
    return out


@pytest.fixture(scope="module")
def files(spark, rows, tmp_path_factory):
    """The rows as three files, one of them out of order inside; the last is left out at first."""
    at = tmp_path_factory.mktemp("events")
    cut = [rows[:250], rows[250:500][::-1], rows[500:]]
    for k, part in enumerate(cut):
        df = spark.createDataFrame(part, "event_id long, s long, kind string, zone int").withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.parquet(f"{at}/{'late' if k == 2 else 'new'}/part={k}")
    return at


def run(spark, files, tmp_path, log):
    """Once over two files, one a batch, and again over all three in the same folder."""
    live = tmp_path / "live"
    schema = spark.read.parquet(f"{files}/new").drop("part").schema
    for k in range(2):
        (live / f"part={k}").parent.mkdir(exist_ok=True)
        spark.read.parquet(f"{files}/new/part={k}").write.parquet(f"{live}/f{k}")

    def once():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(live))
        return state.drained(log(stream), f"file://{tmp_path}/at")

    first = {tuple(r) for r in once().collect()}
    spark.read.parquet(f"{files}/late/part=2").write.parquet(f"{live}/f2")
    both = once().collect()
    assert first and first < {tuple(r) for r in both}
    return sorted(tuple(r) for r in both)


def passed(rows):
    return (max(s for _, s, *_ in rows) - 1800) * 1_000_000


@pytest.mark.parametrize("newest", [1, 4, 10_000])
def test_buffer_equals_batch_after_restart(spark, files, rows, tmp_path, newest):
    got = run(spark, files, tmp_path, lambda s: state.buffer_log(s, ["zone"], newest))
    table = spark.createDataFrame(rows, "event_id long, s long, kind string, zone int").withColumn("ts", F.timestamp_seconds("s"))
    want = state.buffer_log_batch(table, ["zone"], newest, upto_us=F.lit(passed(rows)))
    assert got == sorted(tuple(r) for r in want.collect())
    reasons = {r[-1] for r in got}
    assert reasons == ({"age"} if newest == 10_000 else {"age", "cap"})
    # what is in the buffer: by hand, a zone's newest rows of the last 1,800 s
    log = spark.createDataFrame(got, want.schema)
    held = {r["event_id"] for r in state.buffered(table, log).collect()}
    assert held == {i for i, *_ in rows} - {r[1] for r in got}


def test_freshness_equals_plain_python(spark, files, rows, tmp_path):
    got = run(spark, files, tmp_path, lambda s: state.freshness_log(s, ["zone"]))
    want = []
    for zone in range(3):
        t = [s for _, s, _, z in rows if z == zone]
        for k, s in enumerate(t):
            if k == 0 or s - t[k - 1] > 300:
                want.append((zone, s * 1_000_000, "LIVE"))
            gap = t[k + 1] - s if k + 1 < len(t) else 10**9
            want += [(zone, (s + n) * 1_000_000, w) for n, w in ((300, "STALE"), (600, "EXPIRED")) if gap > n]
    assert got == sorted(x for x in want if x[1] <= passed(rows))


def test_alerts_equal_plain_python(spark, files, rows, tmp_path):
    what = lambda: F.when(F.col("kind") == "error", "raise").when(F.col("kind") == "click", "ack")
    got = run(spark, files, tmp_path, lambda s: state.alert_log(s, ["zone"], what()))
    want = []
    for zone in range(3):
        raises = [s for _, s, k, z in rows if z == zone and k == "error"]
        acks = [s for _, s, k, z in rows if z == zone and k == "click"]
        while raises:
            n = next((k for k in range(1, len(raises)) if raises[k] - raises[k - 1] > 2700), len(raises))
            first, end = raises[0], raises[n - 1] + 2700
            raises = raises[n:]
            ack = min((a for a in acks if first <= a <= end), default=None)
            want += [(zone, s * 1_000_000, w) for s, w in ((first, "RAISED"), (ack, "ACKNOWLEDGED"), (end, "EXPIRED")) if s is not None]
    assert got == sorted(x for x in want if x[1] <= passed([r for r in rows if r[2] != "view"]))
    assert {r[2] for r in got} == {"RAISED", "ACKNOWLEDGED", "EXPIRED"}


class _Map(dict):
    """State as a dictionary, which notes the most rows that were given out and not yet stepped over."""

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class _Value:
    now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, v):
        self.now = v

    def clear(self):
        self.now = None


class _Handle:
    def __init__(self):
        self.timers, self.map = [], _Map()

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return _Value()

    def registerTimer(self, ms):
        self.timers.append(ms)


@pytest.mark.parametrize("kind", ["buffer", "fresh", "alerts"])
def test_a_key_is_settled_with_a_few_pieces_in_memory(monkeypatch, kind):
    """Far more rows than pieces, out of order, with equal times: the same log as in one piece, from steps of some pieces."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 6000
    d = pd.DataFrame({"t": rng.integers(0, 900_000, n) * 1_000_000, "number": np.arange(n), "what": rng.choice(["raise", "ack"], n)})
    make = {"buffer": lambda: state._Buffer(["zone"], 5, 900_000_000), "fresh": lambda: state._Fresh(["zone"], 300_000_000, 600_000_000), "alerts": lambda: state._Alerts(["zone"], 700_000_000)}[kind]
    timer = lambda us: type("T", (), {"getCurrentWatermarkInMs": lambda self: us // 1000})()

    def log(piece, run, marks):
        monkeypatch.setattr(state, "PIECE", piece)
        monkeypatch.setattr(state, "RUN", run)
        p, most, out = make(), [0], []
        p.init(_Handle())
        list(p.handleInputRows(("z",), (d[i : i + 100] for i in range(0, n, 100)), None))
        step = p.step
        p.step = lambda rows, passed: (most.append(len(rows)), step(rows, passed))[1]
        for mark in marks:
            out += list(p.handleExpiredTimer(("z",), timer(mark), None))
        assert all(ms * 1000 > marks[-1] for ms in p.handle.timers[-1:])
        key = lambda r: tuple(map(str, r))
        return sorted((tuple(r) for x in out for r in x.itertuples(index=False)), key=key), max(most)

    end = 800_000_000_000
    whole, at_once = log(10_000, 1 << 20, [end])
    parts, in_pieces = log(50, 1000, [200_000_000_000, 200_000_000_000, end])
    assert parts == whole and len(whole) > 100
    assert at_once > 5000 and in_pieces <= 6 * 50
