"""Keyed state with event-time timers: the strike buffer, how fresh a source is, and alerts with their acknowledgement.

What leaves these operators depends on event times alone, not on how a stream is cut into batches: rows are settled in
order of time once the watermark has passed them, and deadlines fall due by event-time timers. So a stream's log equals
the batch form beside it, up to the watermark, and goes on where it was after a restart from its checkpoint.

A key's state is what the watermark has not passed yet and, for the buffer, at most its newest rows; a key's rows are
taken as arrays, some pieces at a time, never one by one. Names of the state's columns are the operators' own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Strikes kept and for how long; a source's age in seconds when it is stale and when it is forgotten; how
#: long an alert holds after the last that raised it.
NEWEST, KEEP_S, STALE_S, FORGET_S, ALERT_S = 10_000, 1800, 300, 600, 2700
LATE = "30 minutes"
_NEVER = np.iinfo(np.int64).max
_ROW = np.dtype([("t", "<i8"), ("number", "<i8"), ("what", "i1")])
_RAISE, _ACK = 1, 2
#: Rows of a piece of what a key holds, and rows that are sorted together before they are cut into pieces.
PIECE, RUN = 10_000, 1 << 20


class _Settling(StatefulProcessor):
    """Holds a key's rows until the watermark passes them, in sorted pieces that are named by their first time. They are
    settled in order of time, with as many pieces in memory as overlap, however many rows a key has."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "first long, piece long", "rows binary")
        self.made = handle.getValueState("made", "pieces long")
        self.carried = handle.getValueState("carried", self.CARRIED)

    def hold(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["number"], rows["t"]))]
        made = self.made.get()[0] if self.made.exists() else 0
        for at in range(0, len(rows), PIECE):
            made += 1
            self.held.updateValue((int(rows["t"][at]), made), (rows[at : at + PIECE].tobytes(),))
        self.made.update((made,))

    def due(self, at_us: int) -> None:
        """Whole milliseconds, rounded up: the watermark has passed at_us when the timer comes."""
        if at_us != _NEVER:
            self.handle.registerTimer(-(-int(at_us) // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part, n, first = [], 0, _NEVER
        for d in rows:
            a = np.empty(len(d), _ROW)
            a["t"], a["number"] = d["t"].astype("int64"), d["number"].astype("int64")
            a["what"] = np.select([d["what"] == "raise", d["what"] == "ack"], [_RAISE, _ACK], 0)
            part.append(a)
            n, first = n + len(a), min(first, int(a["t"].min()))
            if n >= RUN:
                self.hold(np.concatenate(part))
                part, n = [], 0
        if part:
            self.hold(np.concatenate(part))
        self.due(first)  # nothing that these rows bring about falls due before the first of them
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for out in self.settled(timerValues.getCurrentWatermarkInMs() * 1000):
            if len(out):
                yield pd.DataFrame({**dict(zip(self.names, key, strict=True)), **out})[[*self.names, *out.columns]]

    def settled(self, passed: int) -> Iterator[pd.DataFrame]:
        order = sorted((int(first), int(piece)) for first, piece in self.held.keys())
        now = [k for k in order if k[0] <= passed]
        after = order[len(now)][0] if len(now) < len(order) else _NEVER
        self.load(self.carried.get() if self.carried.exists() else None)
        rows = np.empty(0, _ROW)
        for k, nxt in zip(now, [first for first, _ in now[1:]] + [_NEVER], strict=False):
            rows = np.concatenate((rows, np.frombuffer(self.held.getValue(k)[0], _ROW)))
            rows = rows[np.lexsort((rows["number"], rows["t"]))]
            self.held.removeKey(k)
            upto = min(passed, nxt - 1)
            n = int(np.searchsorted(rows["t"], upto, "right"))
            if n:
                yield self.step(rows[:n], upto)
                rows = rows[n:]
        yield self.step(rows[:0], passed)
        self.hold(rows)
        kept = self.kept()
        if kept is None:
            self.carried.clear()
        else:
            self.carried.update(kept)
        self.due(min(after, int(rows["t"][0]) if len(rows) else _NEVER, self.deadline(passed)))

    def load(self, carried: tuple | None) -> None:
        self.carry = carried

    def kept(self) -> tuple | None:
        return self.carry

    def step(self, rows: np.ndarray, passed: int) -> pd.DataFrame:
        """What the rows after those of the last step, up to a moment, bring about up to it."""
        raise NotImplementedError

    def deadline(self, passed: int) -> int:
        """When something falls due even without further rows."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Buffer(_Settling):
    """Rows leave by age, or when `newest` later ones have come. Both times grow with a row's own, so they leave in order.
    What is carried are the rows in the buffer, `newest` at most."""

    CARRIED = "rows binary"

    def __init__(self, names: list[str], newest: int, keep_us: int) -> None:
        super().__init__(names)
        self.newest, self.keep_us = newest, keep_us

    def load(self, carried: tuple | None) -> None:
        self.inside = np.frombuffer(carried[0], _ROW) if carried else np.empty(0, _ROW)

    def kept(self) -> tuple | None:
        return (self.inside.tobytes(),) if len(self.inside) else None

    def step(self, rows: np.ndarray, passed: int) -> pd.DataFrame:
        d = np.concatenate((self.inside, rows))
        t = d["t"]
        aged, pushed = t + self.keep_us, np.full(len(t), _NEVER)
        if len(t) > self.newest:
            pushed[: len(t) - self.newest] = t[self.newest :]
        out = np.minimum(aged, pushed)
        n = int(np.searchsorted(out, passed, "right"))
        self.inside = d[n:]
        return pd.DataFrame({"number": d["number"][:n], "entered_us": t[:n], "left_us": out[:n], "reason": np.where(pushed[:n] < aged[:n], "cap", "age")})

    def deadline(self, passed: int) -> int:
        return int(self.inside["t"][0]) + self.keep_us if len(self.inside) else _NEVER


class _Fresh(_Settling):
    """Refreshes in order: LIVE from each that finds the source otherwise, STALE and EXPIRED as long after the last. What is
    carried is the last refresh, and up to when it was judged."""

    CARRIED = "first long, last long, mark long"

    def __init__(self, names: list[str], stale_us: int, forget_us: int) -> None:
        super().__init__(names)
        self.limits = {"STALE": stale_us, "EXPIRED": forget_us}

    def step(self, rows: np.ndarray, passed: int) -> pd.DataFrame:
        t, known = rows["t"], self.carry is not None
        _, last, told = self.carry if known else (0, 0, -1)
        t = np.concatenate(([last], t)) if known else t
        if not len(t):
            return _changes({})
        gap = np.append(np.diff(t), _NEVER)
        out = {"LIVE": t[np.concatenate(([not known], gap[:-1] > self.limits["STALE"]))]}
        for state, limit in self.limits.items():
            at = t + limit
            out[state] = at[(gap > limit) & (at <= passed) & (at > told)]
        self.carry = (int(t[0]), int(t[-1]), int(passed))
        return _changes(out)

    def deadline(self, passed: int) -> int:
        return min((self.carry[1] + limit for limit in self.limits.values() if self.carry[1] + limit > passed), default=_NEVER) if self.carry else _NEVER


class _Alerts(_Settling):
    """An alert is raised, acknowledged once, and expires hold_us after what raised it last. Of equal times raises come first.
    What is carried is an open alert's first and last raise, and when it was acknowledged."""

    CARRIED = "first long, last long, mark long"

    def __init__(self, names: list[str], hold_us: int) -> None:
        super().__init__(names)
        self.hold_us = hold_us

    def step(self, rows: np.ndarray, passed: int) -> pd.DataFrame:
        raises, acks = (rows["t"][rows["what"] == w] for w in (_RAISE, _ACK))
        known = self.carry is not None
        begun, last, marked = self.carry if known else (None, None, None)
        t = np.concatenate(([last], raises)) if known else raises
        self.carry = None
        if not len(t):
            return _changes({})
        starts = np.flatnonzero(np.append(True, np.diff(t) > self.hold_us))
        first, end = t[starts], t[np.append(starts[1:], len(t)) - 1] + self.hold_us
        # the first acknowledgement while an alert holds; those that are settled now came after what is carried
        ack = np.append(acks, _NEVER)[np.searchsorted(acks, first, "left")]
        ack[ack > end] = _NEVER
        told, raised = ack != _NEVER, np.full(len(first), True)
        if known:
            raised[0] = False
            first[0] = begun
            if marked is not None:
                ack[0], told[0] = marked, False
        out = {"RAISED": first[raised], "ACKNOWLEDGED": ack[told], "EXPIRED": end[end <= passed]}
        if end[-1] > passed:
            self.carry = (int(first[-1]), int(end[-1] - self.hold_us), None if ack[-1] == _NEVER else int(ack[-1]))
        return _changes(out)

    def deadline(self, passed: int) -> int:
        return self.carry[1] + self.hold_us if self.carry else _NEVER


def _changes(by_state: dict[str, np.ndarray]) -> pd.DataFrame:
    d = pd.concat([pd.DataFrame({"changed_us": t, "state": s}) for s, t in by_state.items()]) if by_state else pd.DataFrame({"changed_us": [], "state": []})
    return d.sort_values("changed_us", kind="stable", ignore_index=True)


def _run(events: DataFrame, keys: list[str], time: str, number: str, what: Column, late: str, processor: StatefulProcessor, out: str) -> DataFrame:
    t = F.col(time).cast("timestamp")
    d = events.select(*keys, t.alias("_t"), F.unix_micros(t).alias("t"), F.col(number).cast("long").alias("number"), what.alias("what")).withWatermark("_t", late)
    kinds = StructType([d.schema[k] for k in keys]).simpleString()[len("struct<") : -1].replace(":", " ")
    return d.groupBy(*keys).transformWithStateInPandas(processor, f"{kinds.replace(',', ', ')}, {out}", "Append", "EventTime")


def buffer_log(strikes: DataFrame, keys: list[str], newest: int = NEWEST, keep_s: float = KEEP_S, time: str = "ts", number: str = "event_id", late: str = LATE) -> DataFrame:
    """Of a stream: (keys, number, entered_us, left_us, reason) of each strike that has left its key's buffer, by `age` or
    because of the `cap`. What the log doesn't list is in the buffer. number orders strikes of one moment."""
    return _run(strikes, keys, time, number, F.lit(""), late, _Buffer(keys, newest, int(keep_s * 1e6)), "number long, entered_us long, left_us long, reason string")


def buffer_log_batch(strikes: DataFrame, keys: list[str], newest: int = NEWEST, keep_s: float = KEEP_S, time: str = "ts", number: str = "event_id", upto_us: Column | None = None) -> DataFrame:
    """The same of a table, of what left up to a moment."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("entered_us", "number")
    d = strikes.select(*keys, F.col(number).cast("long").alias("number"), t.alias("entered_us"))
    d = d.withColumns({"_pushed": F.lead("entered_us", newest).over(w), "_aged": F.col("entered_us") + int(keep_s * 1e6)})
    d = d.withColumns({"left_us": F.least("_pushed", "_aged"), "reason": F.when(F.col("_pushed") < F.col("_aged"), "cap").otherwise("age")}).drop("_pushed", "_aged")
    return d if upto_us is None else d.where(F.col("left_us") <= upto_us)


def buffered(strikes: DataFrame, log: DataFrame, number: str = "event_id") -> DataFrame:
    """What is in the buffers: strikes that the log does not list."""
    return strikes.join(log.select(F.col("number").alias("_number")), F.col(number) == F.col("_number"), "left_anti")


def freshness_log(refreshes: DataFrame, keys: list[str], stale_s: float = STALE_S, forget_s: float = FORGET_S, time: str = "ts", number: str = "event_id", late: str = LATE) -> DataFrame:
    """Of a stream of refreshes: (keys, changed_us, state), a row for each change of a source's state."""
    return _run(refreshes, keys, time, number, F.lit(""), late, _Fresh(keys, int(stale_s * 1e6), int(forget_s * 1e6)), "changed_us long, state string")


def alert_log(events: DataFrame, keys: list[str], what: Column, hold_s: float = ALERT_S, time: str = "ts", number: str = "event_id", late: str = LATE) -> DataFrame:
    """Of a stream in which `what` is raise, ack or else: (keys, changed_us, state), a row for each change of a key's alert."""
    d = events.withColumn("_what", what).where(F.col("_what").isin("raise", "ack"))
    return _run(d, keys, time, number, F.col("_what"), late, _Alerts(keys, int(hold_s * 1e6)), "changed_us long, state string")


def drained(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its rows. at: a folder in a store that driver and executors share; a later
    call with the same folder goes on from its checkpoint and reads the rows of all runs. A batch that is run again
    overwrites its own folder."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)
