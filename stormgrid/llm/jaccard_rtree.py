"""Operator 5: joining documents whose sets of word n-grams are alike (Jaccard), exactly, with count-vector R-trees.

1. Each document's n-grams are hashed; a document's point is its number of n-grams in each of GROUPS hash groups. Equal
   sets become one node, so copies, however many, are no load.
2. Two sets alike enough differ in few n-grams. So their n-grams are dealt over more parts than that by hash: of the
   parts of one set, whichever they are, some are the same n-grams in the other. The number of parts hangs on a class of
   sizes; sets near the end of a class are dealt for the next one too. Nodes with a part in common are put into one
   cluster. This loses no link; a cluster may hold more than one component. Only as many parts are sent as are needed,
   those first that hold most n-grams not frequent (by a sketch of fixed size, summed over all documents). Such a part
   holds several n-grams, so that unrelated documents, however many and however long, and those that share a passage with
   many others, hardly ever have one in common.
3. Within a cluster, nodes are leaves of an R-tree over their points. The overlap of two sets is at most the sum of the
   coordinates' minima, in the tree's groups and then in FINE ones; what these bounds leave is verified on the sets. Nodes already in one component are not compared
   again. Clusters of more than LEAF nodes are cut into leaves that are joined each for itself; the components' smallest
   members are then joined in the same way, and every node outside its cluster's largest component visits the leaves
   whose bounding box it can overlap enough.

Edge cases: null text, empty text or no word: an empty set, linked with nothing. Fewer words than n: the whole sequence
is the set. Equal sets link whatever their texts. Repeated rows have a row each; null doc_ids link with nothing. Empty
table: empty result. Whole texts are read. Other columns are not looked at. Sets are compared by 48 bits of each n-gram's
hash and told apart by 64 bits of all of them, so a chance collision in 2**48 may add a shared n-gram.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.llm import exchange as ex
from stormgrid.llm import textkit as tk
from stormgrid.llm.shared import materialise, project

NGRAM, PERCENT, GROUPS, LEAF = 4, 85, 64, 2048
#: Groups of the second bound: sets of thousands of n-grams fill the tree's few groups alike, whatever is in them.
FINE = 4096
#: Counters of the sketch of n-gram counts; one byte each is broadcast. Tasks' sketches are added in SLICES, first over
#: one in SALTS of the tasks.
SKETCH_BITS, SLICES, SALTS = 22, 32, 32
SKETCH = 1 << SKETCH_BITS
#: An n-gram is frequent if its counter is above both this and so many times the median one.
FREQUENT, TIMES = 64, 4
#: Bytes of parts' hashes that meet in one bucket, and those of a part.
BUCKET_BYTES, PART_BYTES = 16 << 20, 13
#: Ways to deal a set that have too few filled parts before all such sets of a class are held together.
WAYS = 6


_POINT = pa.list_(pa.int32())
#: Ids up to which a list of documents is broadcast to filter texts before they are shuffled.
BROADCAST_IDS = 1_000_000


def _lists(points: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(points) if points else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * GROUPS, pa.int32()), pa.array(flat.astype(np.int32)))


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> tk.U(64 - SKETCH_BITS)).astype(np.int64)


def sets_of(c: tk.Chunk, n: int = NGRAM, frequent: np.ndarray | None = None, sketch: np.ndarray | None = None) -> Iterator:
    """Of each document, the sorted hashes of its distinct word n-grams; with the frequent counters, these and for each
    n-gram whether it is rare. N-grams are counted into the sketch, if there is one."""
    ws, we, first = c.words(tk.SPACED)
    h = tk.span_hash(tk.prefix_hash(c.buf), ws, we)
    g, at = tk.grams(h, first, n)
    if sketch is not None:
        np.add.at(sketch, _counter(g), 1)
    each = np.searchsorted(at, first)
    for i in range(len(first) - 1):
        if first[i + 1] - first[i] >= n:
            s = np.unique(g[each[i] : each[i + 1]])
        else:
            short = h[first[i] : first[i + 1]]
            s = tk.mix(tk.grams(short, np.array([0, len(short)]), len(short))[0] + tk.U(len(short))) if len(short) else np.empty(0, np.uint64)
        yield s if frequent is None else (s, ~frequent[_counter(s)])


def key_of(s: np.ndarray) -> int:
    """A fingerprint of a set; nodes are told apart by it and the set's size."""
    return int(tk.mix(np.array([s.sum(dtype=np.uint64) ^ tk.U(len(s))], np.uint64)).view(np.int64)[0])


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> tk.U(58)).astype(np.int64), minlength=GROUPS)


def need(a, b, percent: int):
    """Overlap that sets of sizes a and b must have at least to be alike: percent of their union, rounded up."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


@cache
def _classes(percent: int) -> list[int]:
    """Largest sizes of the classes. The sizes of two alike sets are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 34:
        out.append(max(out[-1] + 1, out[-1] * 10_000 // percent**2))
    return out


def parts(s: np.ndarray, rare: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of parts of s (sorted, not empty); two sets that are alike, but not equal, have one in common.

    Sets of a class differ in `d` n-grams at most, and this one from any other in `most`, of which each spoils one part. In
    an order that hangs on what a part holds, the first part that both sets have stands behind spoiled ones only, so each
    lists `most` and one. Those with most rare n-grams come first, so that single and frequent ones are left out. A set
    that has no more filled parts than `most` lists all, and is dealt in another way too; so is any other of its kind."""
    if percent >= 100:
        return np.empty(0, np.uint64)
    upto, out = _classes(percent), []
    far = 100 * len(s) // percent
    own = bisect_left(upto, len(s))
    mixed, rare = tk.mix(s), None if rare.all() else rare
    for k in (own, own + 1):
        if k > own and far <= upto[own]:
            break
        d = 2 * upto[k] * (100 - percent) // (100 + percent)
        most = (len(s) + min(far, upto[k])) * (100 - percent) // (100 + percent)
        if not d:
            continue
        for way in range(WAYS):
            h = s if not way else np.sort(tk.mix(s + tk.U(way)))
            part = ex.bucket(h, d + 2 + d // 6).astype(np.uint64)  # sorted, as h is
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            g = tk.mix(np.add.reduceat(tk.mix(h) if way else mixed, cut) ^ tk.mix(part[cut] + tk.U((k * WAYS + way) << 40)))
            if len(cut) > most:
                held = np.diff(np.append(cut, len(h))) if way or rare is None else np.add.reduceat(rare.astype(np.int64), cut)
                rank = (15 - np.minimum(held, 15)).astype(np.uint64) << tk.U(60) | g >> tk.U(4)
                out.append(g[np.argpartition(rank, most)[: most + 1]])
                break
            out.append(g)
        else:
            out.append(tk.mix(np.array([k], np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class CountTree:
    """R-tree over points, packed in order of size and leading coordinates. An inner box keeps the largest coordinates
    and the smallest and largest size below it; that is all the bound asks for."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        boxes, lo, hi = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(boxes, lo, hi)]
        while len(boxes) > self.FAN:
            at = np.arange(0, len(boxes), self.FAN)
            boxes, lo, hi = np.maximum.reduceat(boxes, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((boxes, lo, hi))

    def search(self, p: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose sets can be alike to one of this point and size."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            boxes, lo, hi = self.levels[k]
            ok = (100 * hi[at] >= percent * size) & (percent * lo[at] <= 100 * size)
            at = at[ok]
            at = at[np.minimum(boxes[at], p).sum(1) >= need(size, lo[at], percent)]
            if k:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


def overlaps(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of s with each other set (all sorted, none empty)."""
    flat = np.concatenate(others)
    at = np.searchsorted(s, flat)
    hit = s[np.minimum(at, len(s) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def fine(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of the sets' 48-bit n-grams in FINE groups."""
    return np.array([np.bincount((s >> tk.U(36)).astype(np.int64), minlength=FINE).astype(np.uint16) for s in sets])


def linked(sets: list[np.ndarray], points: np.ndarray, percent: int) -> ex.Forest:
    """Components of a group of sets: breadth first, each node against what no component holds yet."""
    n = len(sets)
    forest = ex.Forest(n)
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(points, sizes) if n > 64 else None
    counts = fine(sets)
    left = np.ones(n, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo and left.any():
            p = todo.pop()
            if tree is not None:
                cand = tree.search(points[p], int(sizes[p]), percent)
                cand = cand[left[cand]]
            else:
                cand = np.flatnonzero(left)
                cand = cand[np.minimum(points[cand], points[p]).sum(1) >= need(sizes[p], sizes[cand], percent)]
            for at in range(0, len(cand), 256):
                part = cand[at : at + 256]
                part = part[np.minimum(counts[part], counts[p]).sum(1, dtype=np.int64) >= need(sizes[p], sizes[part], percent)]
                if not len(part):
                    continue
                o = overlaps(sets[p], [sets[i] for i in part])
                for i in part[(100 + percent) * o >= percent * (sizes[p] + sizes[part])].tolist():
                    left[i] = False
                    forest.join(start, i)
                    todo.append(i)
    return forest


def _nodes(docs: DataFrame, ngram: int) -> DataFrame:
    """Rows of documents (doc_id, n, key, point) and, with a null doc_id, slices of the tasks' sketches (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)
        for b in batches:
            n, key, pts = [], [], []
            for c in tk.chunks(b.column(1), lower=True):
                for s in sets_of(c, ngram, sketch=sketch):
                    n.append(len(s)), key.append(key_of(s)), pts.append(point(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), _lists(pts), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "key", "point", "part", "counts"])
        z = zstandard.ZstdCompressor(1)
        parts = [z.compress(x.astype("<u8").tobytes()) for x in sketch.reshape(SLICES, -1)]
        k = SLICES if sketch.any() else 0
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, _POINT), pa.array(range(k), pa.int32()), pa.array(parts[:k], pa.binary())], names=["doc_id", "n", "key", "point", "part", "counts"])

    return docs.mapInArrow(tk.released(run), "doc_id long, n long, key long, point array<int>, part int, counts binary")


def _frequent(nodes: DataFrame) -> np.ndarray:
    """Of each counter, whether its n-grams count as frequent: one byte a counter, whatever the corpus."""

    def added(tables: Iterator[pa.RecordBatch]) -> np.ndarray:
        z = zstandard.ZstdDecompressor()
        total = np.zeros(SKETCH // SLICES, np.uint64)
        for t in tables:
            for x in t.column("counts").to_pylist():
                total += np.frombuffer(z.decompress(x), "<u8")
        return total

    def some(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressor(1).compress(added(tables).astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["part", "counts"])

    def every(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = added(tables)
        above = np.packbits(total > max(FREQUENT, TIMES * np.median(total))).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([above], pa.binary())], names=["part", "above"])

    parts = nodes.where("part IS NOT NULL").select("part", "counts", (F.spark_partition_id() % SALTS).alias("salt"))
    rows = parts.groupBy("part", "salt").applyInArrow(some, "part int, counts binary").groupBy("part").applyInArrow(every, "part int, above binary").collect()
    out = np.zeros((SLICES, SKETCH // SLICES), bool)
    for r in rows:
        out[r["part"]] = np.unpackbits(np.frombuffer(r["above"], np.uint8)).astype(bool)
    return out.ravel()


def _candidates(docs: DataFrame, frequent: np.ndarray, nb: int, ngram: int, percent: int) -> DataFrame:
    """(a, b): edges by which nodes that have a part in common hang together, one forest a bucket."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = ex.Packer(["low", "high", "key"])
        seen: set[int] = set()
        for b in batches:
            for c in tk.chunks(b.column(0), lower=True):
                for s, rare in sets_of(c, ngram, known.value):
                    if len(s) and (key := key_of(s)) not in seen:
                        seen.add(key)
                        g = parts(s, rare, percent)
                        # of the bits that choose the bucket, the last eight are free
                        yield from pack.add(ex.bucket(g, nb), g.astype(np.uint32), (g >> tk.U(32)).astype(np.uint8), np.full(len(g), key, np.int64))
        yield from pack.flush()

    def join(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        g = ex.column(t, "low", "<u4") | ex.column(t, "high", "u1").astype(np.uint64) << tk.U(32)
        node = ex.column(t, "key", "<i8")
        order = np.argsort(g)
        g = g[order]
        keep = np.zeros(len(g), bool)
        keep[1:] = g[1:] == g[:-1]
        keep[:-1] |= keep[1:]
        g, node = g[keep], node[order[keep]]
        names, number = np.unique(node, return_inverse=True)
        order = np.lexsort((number, g))
        g, number = g[order], number[order]
        forest = ex.Forest(len(names))
        near = np.flatnonzero((g[1:] == g[:-1]) & (number[1:] != number[:-1]))
        pairs = np.unique(np.stack((number[near], number[near + 1]), 1), axis=0) if len(near) else np.empty((0, 2), int)
        for x, y in pairs.tolist():
            forest.join(x, y)
        roots = np.array([forest.find(i) for i in range(len(names))], np.int64)
        off = np.flatnonzero(roots != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[off]), pa.array(names[roots[off]])], names=["a", "b"])

    packed = docs.select("text").mapInArrow(tk.released(emit), "bucket int, low binary, high binary, key binary")
    return packed.groupBy("bucket").applyInArrow(tk.released(join), "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """wanted (doc_id, key, ...) with the sets of their documents, 6 bytes an n-gram. A row of the same id but another
    text does not have the key and is passed over."""
    cols = [c for c in wanted.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column("text"), lower=True):
                sets = list(sets_of(c, ngram))
                part = b.slice(c.rows.start, len(c.rows))
                right = [key_of(s) == k for s, k in zip(sets, part.column("key").to_pylist(), strict=True)]
                packed = [(s >> tk.U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in cols), pa.array(packed, pa.binary())], names=[*cols, "grams"]).filter(pa.array(right))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name != "doc_id")
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(wanted, "doc_id").select("text", *cols).mapInArrow(tk.released(run), f"{kinds}, grams binary")


def _unpack(x: bytes) -> np.ndarray:
    a = np.zeros((len(x) // 6, 8), np.uint8)
    a[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return a.view("<u8").ravel()


def _points(t: pa.Table) -> np.ndarray:
    return t.column("point").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, GROUPS).astype(np.int64)


def _local(group: Column, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root): components within each group and cluster; every node is listed."""

    def run(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        if not t.num_rows:
            return
        cluster, node = t.column("cluster").to_numpy(), t.column("key").to_numpy()
        points = _points(t)
        grams = t.column("grams").to_pylist()
        order = np.lexsort((node, cluster))
        # a node is its set: rows repeating an id may bring it twice
        order = order[np.concatenate(([True], (node[order][1:] != node[order][:-1])))]
        nodes, roots = [], []
        for a, b in zip(*ex.runs(cluster[order]), strict=True):
            at = order[a:b]
            f = linked([_unpack(grams[i]) for i in at], points[at], percent)
            nodes.append(node[at])
            roots.append(node[at][[f.find(i) for i in range(len(at))]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], names=["node", "root"])

    return sets.withColumn("g", group).groupBy("g").applyInArrow(run, "node long, root long")


def _meetings(homes: DataFrame, guests: DataFrame, percent: int) -> DataFrame:
    """(leaf, key, guest): nodes of each leaf, and its guests, that some bound leaves to be compared. Only points travel."""

    def run(home: pa.Table, guest: pa.Table) -> pa.Table:
        here, there = set(), set()
        leaf = (home if home.num_rows else guest).column("leaf")[0].as_py()
        if home.num_rows and guest.num_rows:
            root, key = home.column("root").to_numpy(), home.column("key").to_numpy()
            tree = CountTree(_points(home), home.column("n").to_numpy())
            for k, n, p, r in zip(guest.column("key").to_pylist(), guest.column("n").to_pylist(), _points(guest), guest.column("root").to_pylist(), strict=True):
                cand = tree.search(p, n, percent)
                cand = cand[root[cand] != r]
                if len(cand):
                    there.add(k)
                    here.update(key[cand].tolist())
        return pa.table({"leaf": pa.array([leaf] * (len(here) + len(there)), pa.int64()), "key": pa.array([*here, *there], pa.int64()), "guest": pa.array([False] * len(here) + [True] * len(there), pa.bool_())})

    return homes.groupBy("leaf").cogroup(guests.groupBy("leaf")).applyInArrow(run, "leaf long, key long, guest boolean")


def _visits(homes: DataFrame, guests: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that a guest links with a node of another component, in the leaves it visits."""

    def run(home: pa.Table, guest: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        if home.num_rows and guest.num_rows:
            sets = [_unpack(x) for x in home.column("grams").to_pylist()]
            points = _points(home)
            sizes, root = np.array([len(s) for s in sets]), home.column("root").to_numpy()
            tree, counts = CountTree(points, sizes), fine(sets)
            for g, p, r in zip(guest.column("grams").to_pylist(), _points(guest), guest.column("root").to_pylist(), strict=True):
                s = _unpack(g)
                cand = tree.search(p, len(s), percent)
                cand = cand[root[cand] != r]
                own = fine([s])[0]
                for at in range(0, len(cand), 256):
                    part = cand[at : at + 256]
                    part = part[np.minimum(counts[part], own).sum(1, dtype=np.int64) >= need(len(s), sizes[part], percent)]
                    part = part[np.array([(r, int(x)) not in out for x in root[part]], bool)]
                    if len(part):
                        o = overlaps(s, [sets[i] for i in part])
                        out.update((r, int(x)) for x in root[part[(100 + percent) * o >= percent * (len(s) + sizes[part])]])
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return homes.groupBy("leaf").cogroup(guests.groupBy("leaf")).applyInArrow(run, "a long, b long")


def _labelled(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """doc_id, key (of its set), n_shingles, component_id."""
    docs = project(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = materialise(_nodes(docs, ngram), "jaccard-nodes")
    frequent = _frequent(nodes)
    rows = nodes.where("part IS NULL").select("doc_id", "n", "key", "point")
    grams = rows.agg(F.sum("n")).first()[0] or 0
    nb = max(8, math.ceil(PART_BYTES * grams * 4 * (101 - percent) / (100 + percent) / BUCKET_BYTES))
    # written first: contracted in the tasks that find them, they would take a second Python worker for each
    edges = materialise(_candidates(docs, frequent, nb, ngram, percent), "jaccard-edges")
    clusters = ex.components(edges, "a", "b").select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    one = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key", "n").agg(F.min("doc_id").alias("doc_id"), F.first("point").alias("point"))
    members = materialise(one.join(clusters, "key"), "jaccard-members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    large = materialise(sizes.where(F.col("size") > leaf), "jaccard-large")
    some_large = large.limit(1).count() > 0
    packs = max(1, members.count() // leaf * 2)
    # sizes within a factor of 1.03 share a tile; small tiles in a row share a leaf, a tile of many nodes is cut by digest
    tile = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.03)))
    if some_large:
        tiles = members.join(large, "cluster").withColumn("tile", tile).groupBy("cluster", "tile").agg(F.count(F.lit(1)).alias("in"))
        upto = Window.partitionBy("cluster").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)  # of a cluster's few hundred tiles
        tiles = tiles.select("cluster", "tile", F.ceil(F.col("in") / leaf).alias("cuts"), F.floor(F.coalesce(F.sum("in").over(upto), F.lit(0)) / leaf).alias("run"))
        in_large = materialise(members.join(large.select("cluster"), "cluster").withColumn("tile", tile).join(tiles, ["cluster", "tile"])
                               .withColumn("leaf", F.xxhash64("cluster", F.when(F.col("cuts") > 1, F.concat_ws(":", "tile", F.pmod(F.xxhash64("key"), "cuts"))).otherwise(F.col("run").cast("string")))).select("doc_id", "key", "n", "point", "cluster", "leaf"), "jaccard-leaves")
        members = members.join(large.select("cluster"), "cluster", "left_anti").select("doc_id", "key", "n", "point", "cluster", F.pmod("cluster", F.lit(packs)).alias("leaf")).unionByName(in_large)
    else:
        members = members.select("doc_id", "key", "n", "point", "cluster", F.pmod("cluster", F.lit(packs)).alias("leaf"))
    local = materialise(_local(F.col("leaf"), _sets(docs, members.select("doc_id", "key", "point", "cluster", "leaf"), ngram), percent), "jaccard-local")
    links = local.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if some_large:
        # smallest members of the leaves' components, joined across leaves
        tops = in_large.join(local.where("node = root").select(F.col("node").alias("key")), "key")
        cuts = tops.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("cuts"))
        tops = tops.join(cuts, "cluster").withColumn("leaf", F.xxhash64("cluster", F.pmod(F.xxhash64("key", F.lit(1)), "cuts"))).select("doc_id", "key", "point", "cluster", "leaf")
        across = materialise(_local(F.col("leaf"), _sets(docs, tops, ngram), percent), "jaccard-across").select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = links.unionByName(across)
        now = in_large.join(ex.components(links.join(in_large.select(F.col("key").alias("a")), "a", "left_semi"), "a", "b").withColumnsRenamed({"node": "key", "root": "far"}), "key", "left").select(*in_large.columns, F.coalesce("far", "key").alias("root"))
        now = materialise(now, "jaccard-now")
        per = now.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("size"))
        main = per.groupBy("cluster").agg(F.max_by("root", "size").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        split = now.join(main, "cluster")
        guests = split.where("root <> main")
        if guests.limit(1).count():
            low = F.array(*[F.max(F.col("point")[i]) for i in range(GROUPS)])
            boxes = split.groupBy("cluster", F.col("leaf").alias("to")).agg(low.alias("box"), F.min("n").alias("lo"), F.max("n").alias("hi"))
            most = F.aggregate(F.zip_with("point", "box", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, x: a + x)
            may = (100 * F.col("hi") >= percent * F.col("n")) & (percent * F.col("lo") <= 100 * F.col("n")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("lo")))
            visiting = guests.join(boxes, "cluster").where(may).select("doc_id", "key", "n", "point", "root", F.col("to").alias("leaf"))
            visiting = visiting.select(*[F.col(x).alias(x) for x in visiting.columns])  # apart from homes, of the same table
            homes = split.select("doc_id", "key", "n", "point", "root", "leaf")
            meet = materialise(_meetings(homes.drop("doc_id"), visiting.drop("doc_id"), percent), "jaccard-meet")
            few = lambda d, g: d.join(meet.where(F.col("guest") == g).select("leaf", "key"), ["leaf", "key"]).select("doc_id", "key", "point", "root", "leaf")
            links = links.unionByName(materialise(_visits(_sets(docs, few(homes, False), ngram), _sets(docs, few(visiting, True), ngram), percent), "jaccard-visits"))
    roots = ex.components(links, "a", "b").withColumnsRenamed({"node": "key"})
    labelled = rows.join(roots, "key", "left").withColumn("class", F.coalesce("root", "key"))
    labelled = materialise(labelled.select("doc_id", "n", "key", "class"), "jaccard-classes")
    # written, so that the join is a plain one, which Spark splits where a class is hot
    least = materialise(labelled.where("n > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")), "jaccard-least")
    out = labelled.join(least, "class", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    return _labelled(docs, ngram, percent, leaf).drop("key")


def _keyed(docs: DataFrame, ngram: int) -> DataFrame:
    """docs, all columns, and _jaccard_key: that of a row's set."""
    at = docs.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(at), lower=True):
                yield b.slice(c.rows.start, len(c.rows)).append_column("_jaccard_key", pa.array([key_of(s) for s in sets_of(c, ngram)], pa.int64()))

    return docs.mapInArrow(tk.released(run), f"{kinds}, _jaccard_key long")


def representatives(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """docs, all columns, with the document of smallest id of each component; of rows equal in id and text, one. Rows
    without an id stay. Where an id has several texts, each is judged for itself."""
    found = materialise(_labelled(docs, ngram, percent, leaf), "jaccard-found")
    again = materialise(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"), "jaccard-again")
    out = materialise(found.where("component_id <> doc_id").select("doc_id", F.col("key").alias("_jaccard_key")).distinct(), "jaccard-out")
    small = lambda d: F.broadcast(d) if d.count() <= BROADCAST_IDS else d
    if not again.limit(1).count():
        return docs.join(small(out.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(small(out.select("doc_id").unionByName(again).distinct()), "doc_id", "left_anti").select(*docs.columns)
    several = _keyed(docs.join(small(again), "doc_id", "left_semi").select(*docs.columns), ngram).join(out, ["doc_id", "_jaccard_key"], "left_anti")
    return once.unionByName(several.select(*docs.columns).dropDuplicates(["doc_id", "text"]))
