"""Packed exchange: many small numeric entries travel as one row of arrays per task and bucket.

An entry costs its bytes and no row; a reducer sees a bucket's arrays as numpy columns. Operators choose the number of
buckets by the size of what is sent, so that a bucket keeps its size when the input grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.llm.shared import materialise

#: Entries that a task gathers before it writes them out.
FLUSH = 1_500_000


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the upper 32 bits of a hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


class Packer:
    def __init__(self, names: list[str]):
        self.names, self.held, self.size = names, [], 0

    def add(self, where: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((where, *cols))
        self.size += len(where)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        where, *cols = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(where, kind="stable")
        where = where[order]
        cols = [c[order] for c in cols]
        cut = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        ends = np.append(cut[1:], len(where))
        data = [pa.array([c[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary()) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(where[cut], pa.int32()), *data], names=["bucket", *self.names])


def column(t: pa.Table | pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of equal values in a sorted array."""
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return cut, np.append(cut[1:], len(x)).astype(np.int64)


class Forest:
    """Union-find over dense numbers; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


#: Edges that a task contracts together.
CONTRACT = 400_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, fewer: each task puts stars of smallest members in place of what it holds."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        names, number = np.unique(np.concatenate((a, b)), return_inverse=True)
        forest = Forest(len(names))
        for x, y in zip(number[: len(a)].tolist(), number[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        roots = np.fromiter(map(forest.find, range(len(names))), np.int64, len(names))
        off = np.flatnonzero(roots != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[off]), pa.array(names[roots[off]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= CONTRACT:
                yield stars(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))

    return edges.mapInArrow(run, "a long, b long")


def _stars_only(e: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has that one alone, and it has none itself."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    both = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR ups = 1 AND least = 0")
    return not both.limit(1).count()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root): root is the smallest node reachable by edges; nodes without an edge are not listed.

    Tasks first contract the edges that they hold. Alternating large and small stars then join neighbours to their
    smallest member, and contract again, until nothing but stars is left; rounds grow with the logarithm of a component's
    size. A star's centre may have very many edges: its smallest member is written first, so that the join with it is a
    plain one, which Spark splits where a key is hot. Nothing but a yes or no reaches the driver.
    """
    e = edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b")).where("a <> b")
    e = materialise(contracted(materialise(contracted(e), "cc-first")).distinct(), "cc")
    while not _stars_only(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")), "cc-least")
        large = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "cc-large")
        small = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "cc-small")
        out = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(contracted(out.unionByName(small.select("a", F.col("m").alias("b")))).distinct(), "cc")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
