"""Operator 1: nearest neighbours in windows along shifted space-filling curves.

1. Unit vectors are projected onto random orthonormal directions, shifted, and put in the order of a Hilbert curve through
   those AXES directions; ORDERS such orderings are made. Each is cut into buckets of keys at quantiles, which are fitted
   on a sample of about SAMPLE_ROWS rows; every row is indexed.
2. How many orderings to use, and how many buckets on either side of a query's own, is measured: SAMPLE_QUERIES queries
   of each length of vectors get their true neighbours by comparison with all rows, and the cheapest choice of two
   orderings or more is taken whose windows hold RECALL of those. All buckets of one ordering, an exact search, is taken
   only where such windows would compare more than MOST_COMPARED of all pairs: vectors without directions have no better
   choice, and work then grows with queries times rows.
3. Rows go to their bucket of each ordering used, queries to the buckets of their window. A bucket ranks by single
   precision, keeps all that rounding could have put behind the best, and reranks those by the exact cosine. What windows
   of all orderings found is merged by query.

Queries of a bucket are dealt into groups of QUERIES, for which the bucket's rows are repeated; beyond MOST_BUCKETS, a
bucket's rows are dealt into parts, all of which its queries visit. So no task's share grows with the input.

Copies: equal vectors are one point that carries its smallest ids (as many as a result can show), so a group of copies,
however large, is no load; a limit of that kind is applied before the shuffle by Spark's group limit. Points have numbers
of their own, since an id may stand at several vectors. Keys that tie are spread by a digest of the vector.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or
candidate; so do rows without vec_id. Components may be of any size: vectors are scaled by powers of two. A score is
computed in extended precision and rounded once, so that vectors of one direction tie at 1. A row is never its own
neighbour; rows repeating an id and vector are one. Rows of one id with different vectors are rows of their own: each
asks for itself, query_point tells their results apart, and each may be a neighbour, of the other too. Vectors of different lengths never meet. Ties go to smaller
ids. Fewer candidates than k: all found. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.llm.shared import materialise, project
from stormgrid.llm.textkit import mix as tk_mix

ORDERS, AXES, BITS, WINDOW, BUCKET, QUERIES = 8, 8, 7, 2048, 256, 32_768
#: Buckets of an order at most; their bounds go to every task.
MOST_BUCKETS = 10_000
#: Rows that quantiles are fitted on; queries whose true neighbours are looked up to choose windows; their part that
#: windows must hold.
SAMPLE_ROWS, SAMPLE_QUERIES, RECALL = 200_000, 200, 0.95
#: Costs of a row in a bucket and of a comparison, by which choices are compared; part of all pairs beyond which an exact
#: search is as good, and rows in its buckets, which are wider, since each query visits all of them.
_ROW, _COMPARE, MOST_COMPARED, EXACT_BUCKET = 5e-6, 2e-8, 1.0, 8192
#: Buckets are joined so far that windows reach about so many on either side.
_REACH = 3
SEED = 3


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, axes) with so many bits an axis."""
    x = x.astype(np.uint64).T.copy()
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:  # undo the curve's turns, from the largest cells to the smallest
        below = q - one
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key


def keys_of(v: np.ndarray, order: int, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors in one order: the curve's position, then 7 bits of digest for ties."""
    dim = v.shape[1]
    rng = np.random.Generator(np.random.PCG64([SEED, order, dim]))
    axes = np.linalg.qr(rng.standard_normal((dim, min(AXES, dim))))[0]
    shift = rng.uniform(-0.06, 0.06, axes.shape[1])
    y = np.clip(v @ axes * (math.sqrt(dim) / 8) + 0.5 + shift, 0, 1 - 1e-9)
    k = hilbert((y * (1 << bits)).astype(np.uint64), bits).astype(np.int64)
    digest = (np.abs(v * 1e6).sum(1) * 7919).astype(np.int64) & 127
    return (k << 7) | digest


def usable(vec: str, id_: str) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    return F.col(id_).isNotNull() & F.col(vec).isNotNull() & F.coalesce(ok & some, F.lit(False))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes; cosines stay the same to the last bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one length of vectors at a time, and those vectors."""
    for b in batches:
        dims = np.array(b.column("dim").to_pylist(), np.int64)
        for dim in np.unique(dims).tolist():
            s = b.filter(pa.array(dims == dim))
            for at in range(0, s.num_rows, 2000):
                t = s.slice(at, 2000)
                yield dim, t, t.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bucket_of(cuts: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, key, "right").astype(np.int64)


def _sample_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, t, flat in _parts(batches):
        unit = _unit(flat)
        for order in range(ORDERS):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), order, np.int32)), t.column("dim"), pa.array(keys_of(unit, order))], names=["ord", "dim", "key"])


def _true_neighbours(batches: Iterator[pa.RecordBatch], some: dict, k: int) -> Iterator[pa.RecordBatch]:
    """(dim, query, point, score, keys): a task's k nearest rows of each sampled query; some: by dim, their points and unit vectors."""
    best: dict[int, list] = {}
    for dim, t, flat in _parts(batches):
        if dim not in some:
            continue
        asking, asks = some[dim]
        point, unit = np.array(t.column("point").to_pylist(), np.int64), _unit(flat)
        s = asks @ unit.T
        s[asking[:, None] == point[None]] = -9
        most = min(k, len(point))
        near = np.argpartition(-s, most - 1, axis=1)[:, :most]
        keys = np.stack([keys_of(unit[near.ravel()], o) for o in range(ORDERS)], 1).reshape(*near.shape, ORDERS)
        one = (np.take_along_axis(s, near, 1), point[near], keys)
        if dim in best:
            one = tuple(np.concatenate((x, y), 1) for x, y in zip(best[dim], one, strict=True))
            top = np.argsort(-one[0], axis=1)[:, :k]
            one = (np.take_along_axis(one[0], top, 1), np.take_along_axis(one[1], top, 1), np.take_along_axis(one[2], top[..., None], 1))
        best[dim] = one
    for dim, (s, point, keys) in best.items():
        n = s.size
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.repeat(some[dim][0], s.shape[1])), pa.array(point.ravel()), pa.array(s.ravel()), pa.array(keys.reshape(n, ORDERS).tolist(), pa.list_(pa.int64()))], names=["dim", "query", "point", "score", "keys"])


class Plan:
    """Of one length of vectors: cuts between the buckets of each ordering used, buckets on either side of a query's own,
    parts of a bucket's rows, groups of its queries."""

    def __init__(self, cuts: list[np.ndarray], reach: int, parts: int, groups: int):
        self.cuts, self.reach, self.parts, self.groups = cuts, reach, parts, groups


def choose(cuts: list[np.ndarray], near: list[tuple[np.ndarray, np.ndarray]], rows: int, asks: int, dim: int) -> tuple[int, int]:
    """Orderings and reach that cost least and hold RECALL of the sampled neighbours; near: keys of query and neighbour in
    each ordering. Without a sample, or where all would
    compare too much: one ordering, all of it."""
    buckets = len(cuts[0]) + 1
    per = _COMPARE * dim / 64 * asks * rows
    best = (math.inf, 1, buckets)
    if near:
        apart = np.array([np.abs(_bucket_of(c, q) - _bucket_of(c, x)) for c, (q, x) in zip(cuts, near, strict=True)])
        for m in range(2, len(cuts) + 1):
            reach = int(np.quantile(apart[:m].min(0), RECALL, method="higher"))
            compared = m * min(1.0, (2 * reach + 1) / buckets)
            if compared <= MOST_COMPARED:
                best = min(best, (m * _ROW * rows + per * compared, m, reach))
    return best[1], best[2]


def _placed(batches: Iterator[pa.RecordBatch], plans: dict[int, Plan]) -> Iterator[pa.RecordBatch]:
    for dim, t, flat in _parts(batches):
        plan, unit = plans[dim], _unit(flat)
        vec = pa.array([x.tobytes() for x in flat.astype("<f8")], pa.binary())
        query = np.flatnonzero(np.array(t.column("asks").to_pylist(), bool))
        point = np.array(t.column("point").to_pylist(), np.int64)
        spread = tk_mix(point.astype(np.uint64))
        part, group = (spread % np.uint64(plan.parts)).astype(np.int64), ((spread >> np.uint64(32)) % np.uint64(plan.groups)).astype(np.int64)
        for order, cuts in enumerate(plan.cuts):
            key = keys_of(unit, order)
            own = _bucket_of(cuts, key)
            lo, hi = np.maximum(own[query] - plan.reach, 0), np.minimum(own[query] + plan.reach, len(cuts))
            n = (hi - lo + 1) * plan.parts
            far = np.repeat(lo * plan.parts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))  # bucket and part
            row = np.concatenate((np.repeat(np.arange(len(point)), plan.groups), np.repeat(query, n)))
            to = np.concatenate((np.repeat(own * plan.parts + part, plan.groups) * plan.groups + np.tile(np.arange(plan.groups), len(point)), far * plan.groups + np.repeat(group[query], n)))
            home = np.arange(len(row)) < len(point) * plan.groups
            for at in range(0, len(row), 4000):
                i = pa.array(row[at : at + 4000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), order, np.int32)), t.column("dim").take(i), pa.array(to[at : at + 4000]), pa.array(key).take(i), t.column("point").take(i), t.column("ids").take(i), vec.take(i), pa.array(home[at : at + 4000])], names=["ord", "dim", "bucket", "key", "point", "ids", "vec", "home"])


def _search(table: pa.Table, k: int) -> pa.Table:
    """Of one bucket: for each query, the k + 1 nearest points."""
    home = np.array(table.column("home").to_pylist(), bool)
    key, point = table.column("key").to_numpy(), table.column("point").to_numpy()
    ids = table.column("ids").combine_chunks()
    first = pc.list_element(ids, 0).to_numpy()  # smallest id, by which ties are broken
    raw = _scaled(np.frombuffer(b"".join(table.column("vec").to_pylist()), "<f8").reshape(-1, table.column("dim")[0].as_py()))
    norm = np.sqrt((raw * raw).sum(1))
    unit = (raw / norm[:, None]).astype(np.float32)
    base = np.flatnonzero(home)
    base = base[np.lexsort((point[base], key[base]))]
    ask = np.flatnonzero(~home)
    ask = ask[np.argsort(key[ask], kind="stable")]
    close = np.float32(1e-6 * (8 + raw.shape[1] ** 0.5))  # what single precision may be wrong by, and more
    out_q, out_c, out_s = [], [], []

    def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        x, y = raw[q].astype(np.longdouble), raw[c].astype(np.longdouble)  # so that parallel vectors tie at 1
        return ((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))).astype(float)

    for at in range(0, len(ask), 64):
        q = ask[at : at + 64]
        near: list[list[np.ndarray]] = [[] for _ in q]
        for lo in range(0, len(base), 2 * WINDOW):
            c = base[lo : lo + 2 * WINDOW]
            s = unit[q] @ unit[c].T
            s[point[q][:, None] == point[c][None]] = -9
            least = -np.partition(-s, min(k, len(c) - 1), axis=1)[:, min(k, len(c) - 1)]
            for i, j in zip(*np.nonzero(s >= least[:, None] - close), strict=True):
                near[i].append(c[j])
        for row, found in zip(q, near, strict=True):
            cand = np.array(found, np.int64)
            cand = cand[point[cand] != point[row]]
            score = exact(np.full(len(cand), row), cand)
            top = np.lexsort((first[cand], -score))[: k + 1]
            out_q.append(np.full(len(top), row)), out_c.append(cand[top]), out_s.append(score[top])
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    q, c, s = cat(out_q, np.int64), cat(out_c, np.int64), cat(out_s, float)
    return pa.table({"query_point": pa.array(point[q], pa.int64()), "point": pa.array(point[c], pa.int64()), "ids": ids.take(pa.array(c, pa.int64())), "score": pa.array(s, pa.float64())})


def _plans(points: DataFrame, k: int) -> dict[int, Plan]:
    """By length of vectors; what reaches the driver are counts, quantiles and the sampled queries' neighbours."""
    out: dict[int, Plan] = {}
    counts = {r["dim"]: (r["n"], r["asks"]) for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks")).collect()}
    buckets = {d: max(1, min(MOST_BUCKETS, math.ceil(n / BUCKET))) for d, (n, _) in counts.items()}
    cuts: dict = {}
    most = max(buckets.values(), default=1)
    if most > 1:
        every = max(1, math.ceil(sum(n for n, _ in counts.values()) / SAMPLE_ROWS))
        keyed = points.where(F.pmod(F.xxhash64("point"), F.lit(every)) == 0).mapInArrow(_sample_keys, "ord int, dim int, key long")
        at = F.array(*[F.lit(i / most) for i in range(1, most)])
        for r in keyed.groupBy("ord", "dim").agg(F.percentile_approx("key", at, F.lit(max(10_000, 20 * most))).alias("cuts")).collect():
            x = np.array(r["cuts"], np.int64)
            cuts[r["ord"], r["dim"]] = np.unique(x[np.linspace(0, len(x) - 1, buckets[r["dim"]] - 1).astype(int)] if buckets[r["dim"]] > 1 else x[:0])
    near: dict = {}
    if most > 1:
        first = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("point"), "point"))
        asks = points.where("asks").select("dim", "point", "embedding", first.alias("n")).where(F.col("n") <= SAMPLE_QUERIES)
        some: dict = {}
        for r in asks.collect():
            some.setdefault(r["dim"], []).append((r["point"], r["embedding"]))
        some = {d: (np.array([i for i, _ in x], np.int64), _unit(np.array([v for _, v in x], float))) for d, x in some.items() if buckets[d] > 1}
        shared = points.sparkSession.sparkContext.broadcast(some)
        true = points.mapInArrow(lambda b: _true_neighbours(b, shared.value, k), "dim int, query long, point long, score double, keys array<long>")
        best = F.row_number().over(Window.partitionBy("dim", "query").orderBy(F.col("score").desc(), "point"))
        for r in true.withColumn("n", best).where(F.col("n") <= k).collect():
            near.setdefault(r["dim"], []).append((r["query"], r["keys"]))
        for d, pairs in near.items():
            asking, unit = some[d]
            at_ = np.searchsorted(np.sort(asking), [q for q, _ in pairs])
            row = np.argsort(asking)[at_]
            there = np.array([x for _, x in pairs], np.int64)
            near[d] = [(keys_of(unit, o)[row], there[:, o]) for o in range(ORDERS)]
    for d, (n, asks) in counts.items():
        own = [cuts.get((o, d), np.empty(0, np.int64)) for o in range(ORDERS)]
        m, reach = choose(own, near.get(d, []), n, asks, d)
        exact = reach > len(own[0])
        step = max(1, EXACT_BUCKET // max(1, n // (len(own[0]) + 1)) if exact else reach // _REACH)
        own = [c[step - 1 :: step] for c in own]
        reach = len(own[0]) + 1 if exact else math.ceil(reach / step)
        per = max(1, n // (len(own[0]) + 1))
        here = math.ceil(asks * min(1.0, (2 * reach + 1) / (len(own[0]) + 1)))
        out[d] = Plan(own[:m], reach, max(1, round(per / (2 * EXACT_BUCKET))), max(1, math.ceil(here / QUERIES)))
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, query_point: of each row for which `queries` (over vec_id) holds, its k nearest other
    rows. query_point numbers the queries' vectors."""
    rows = project(vectors, "vec_id", "embedding").where(usable("embedding", "vec_id")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", queries.alias("asks"))
    asks = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    few = rows.select("vec_id", "embedding").distinct().withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    points = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # a point asks if any of its rows does
    points = points.join(asks.groupBy("embedding").agg(F.lit(True).alias("asks")), "embedding", "left")
    points = points.select(F.monotonically_increasing_id().alias("point"), "ids", "embedding", F.size("embedding").alias("dim"), F.coalesce("asks", F.lit(False)).alias("asks"))
    points = materialise(points, "ann-points")
    shared = points.sparkSession.sparkContext.broadcast(_plans(points, k))
    placed = points.mapInArrow(lambda b: _placed(b, shared.value), "ord int, dim int, bucket long, key long, point long, ids array<long>, vec binary, home boolean")
    found = placed.groupBy("ord", "dim", "bucket").applyInArrow(lambda t: _search(t, k), "query_point long, point long, ids array<long>, score double")
    own = points.where("asks").select(F.col("point").alias("query_point"), "point", "ids", F.lit(2.0).alias("score"))  # copies of a query
    merged = found.unionByName(own).groupBy("query_point", "point").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = merged.withColumn("n", F.row_number().over(Window.partitionBy("query_point").orderBy(F.col("score").desc(), F.col("ids")[0]))).where(F.col("n") <= k + 2)
    of = asks.join(points.where("asks").select("embedding", F.col("point").alias("query_point")), "embedding").select("query_id", "query_point")
    each = of.join(best, "query_point").select("query_id", "query_point", (F.col("point") == F.col("query_point")).alias("copy"), F.least("score", F.lit(1.0)).alias("score"), F.explode("ids").alias("vec_id"))
    each = each.where("vec_id <> query_id OR NOT copy")
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_point").orderBy(F.col("score").desc(), "vec_id")))
    return each.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_point")


def op1(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 50 == 0)
