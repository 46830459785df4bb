"""Operator 10: mixing sources to target weights by weighted fair queueing. Only DataFrame functions run.

Every document joins its source's queue once a lap, in an order shuffled by a seeded digest of its id. Its virtual
finish time is what its source's queue holds up to it divided by the source's target; documents of all sources are then
ordered by that time and taken until the total budget is spent.

Running sums are two-level: sums of (source, slice of the digest) first, then within a slice, so that no source, however
large, meets in one task. The same holds for the global order, whose slices are slices of virtual time.

Edge cases: null text or no words: size 0, never adds words. Null source: a source of its own, after all others.
Repeated ids are rows of their own. Empty table: empty result. Only doc_id, source and text are read from the input;
names that begin with _wfq_ are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.llm.shared import materialise, project

WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which the table of sources may be broadcast.
BROADCAST_ROWS = 10_000


def digests(docs: DataFrame) -> list[Column]:
    """128 bits that rows share only if they are equal in doc_id, source and text."""
    fields = [x for c in ("doc_id", "source", "text") for x in (docs[c].isNull(), docs[c])]
    return [F.xxhash64(F.lit(i), *fields).alias(f"_wfq_k{i}") for i in (0, 1)]


def sizes(docs: DataFrame, digest: bool = False) -> DataFrame:
    docs = project(docs, "doc_id", "source", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return docs.select("doc_id", "source", size, *(digests(docs) if digest else [F.lit(0).cast("long").alias("_wfq_k0"), F.lit(0).cast("long").alias("_wfq_k1")]))


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target): share of all words by weight, no source above most times its size.

    Filling by weight with caps: sources sorted by cap over weight saturate one after another; the first one that does
    not tells the level of all that follow. One row a source, so a window over all sources is small.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w.cast("double"))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("at", F.row_number().over(order))
    level = F.coalesce(F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("at"))).over(Window.partitionBy()), F.lit(0.0))
    return s.select("source", "source_size", "weight", F.least("cap", level * F.col("weight")).alias("target"),
                    F.ceil(F.lit(float(share)) * total).cast("long").alias("budget"))


def running(df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """out: running sum of value by keys in the order given, which must sort by the slice first."""
    d = df.withColumn("_slice", slice_of)
    per = d.groupBy(*keys, "_slice").agg(F.sum(value).alias("_in"))
    up_to = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"),
                      F.coalesce(F.sum("_in").over(up_to), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.sum(value).over(inside))
    on = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_by{i}"))
    return d.join(base, on).withColumn(out, F.col("_base") + F.col("_own")).drop("_slice", "_own", "_base", "_s", *[f"_by{i}" for i in range(len(keys))])


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, slice_rows: int = 50_000, seed: str = "wfq", digest: bool = False) -> DataFrame:
    """One row for each document and lap that the mix takes or leaves (a document of size 0 has one): doc_id, source, size,
    _wfq_k0 and _wfq_k1 (digests, if asked for), source_size, target, lap, finish (virtual time), upto (words of the mix up to it;
    null where the budget is spent before its slice begins), taken_now (whether it is in)."""
    sized = materialise(sizes(docs, digest), "wfq-sizes")
    goal = targets(sized, weights, share, most)
    goal = materialise(goal.coalesce(1), "wfq-targets")
    small = F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal
    g = small.withColumnRenamed("source", "_source")
    laps = int(-(-most // 1))
    slices = min(65_536, max(256, sized.count() // slice_rows))  # a footer count of the written table
    rows = sized.join(g, sized["source"].eqNullSafe(g["_source"])).drop("_source")
    rows = rows.withColumn("lap", F.explode(F.array(*[F.lit(i) for i in range(laps)])))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("lap").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
    digest = F.conv(F.substring("key", 1, 4), 16, 10).cast("int")
    tie = [F.col("key"), F.col("doc_id"), F.col("size"), F.col("_wfq_k0"), F.col("_wfq_k1")]
    nothing = rows.where("size = 0 AND lap = 0").withColumns({"finish": F.lit(0.0), "upto": F.lit(0).cast("long"), "taken_now": F.lit(True)})
    rows = rows.where("size > 0")
    rows = running(rows, ["source", "lap"], F.floor(digest * slices / 65536).cast("int"), tie, "size", "cum")
    rows = rows.withColumn("cum", F.col("cum") + F.col("lap") * F.col("source_size"))
    rows = rows.withColumn("finish", F.col("cum") / F.col("target"))
    by_time = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("lap"), *tie]
    rows = rows.drop("cum").withColumn("_slice", F.least(F.floor(F.col("finish") * slices), F.lit(16 * slices)).cast("int"))
    per = rows.groupBy("_slice").agg(F.sum("size").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(per.select(F.col("_slice").alias("_s"), before.alias("_base")), F.col("_slice") == F.col("_s")).drop("_s")
    # slices that begin beyond the budget, with all rows of late times, aren't sorted
    inside = Window.partitionBy("_slice").orderBy(*by_time).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.where("_base < budget").withColumn("upto", F.col("_base") + F.sum("size").over(inside))
    far = rows.where("_base >= budget").withColumn("upto", F.lit(None).cast("long"))
    rows = near.unionByName(far).withColumn("taken_now", F.coalesce(F.col("upto") <= F.col("budget"), F.lit(False)))
    return rows.drop("_slice", "_base").unionByName(nothing).drop("budget")


def drawn(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it: not at all, once, or once a lap. All columns of docs stay. Rows
    equal in doc_id, source and text share their draws evenly. Texts are shuffled once, by their digest."""
    m = mix(docs, digest=True, **how).groupBy("_wfq_k0", "_wfq_k1").agg(F.count_if("taken_now").alias("_wfq_copies"), F.count_if(F.col("lap") == 0).alias("_wfq_n"))
    j = docs.select("*", *digests(docs)).join(m.where("_wfq_copies > 0"), ["_wfq_k0", "_wfq_k1"])
    nth = F.row_number().over(Window.partitionBy("_wfq_k0", "_wfq_k1").orderBy("_wfq_k0")) - 1
    times = F.floor((F.col("_wfq_copies") + F.col("_wfq_n") - 1 - nth) / F.col("_wfq_n")).cast("int")
    return j.withColumn("_wfq_t", times).withColumn("_wfq_t", F.explode(F.array_repeat(F.lit(0), F.col("_wfq_t")))).select(*docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    """Contract rows; repeated (doc_id, source, size) rows stay apart."""
    m = mix(docs)
    who = ["doc_id", "source", "size", "source_size", "target"]
    nth = F.row_number().over(Window.partitionBy(*who, "lap").orderBy(F.col("upto").asc_nulls_last()))
    m = m.withColumn("nth", nth)
    return m.groupBy(*who, "nth").agg(F.sum(F.when(F.col("taken_now"), F.col("size")).otherwise(0)).alias("taken")).select(
        "doc_id", "size", "source_size", "target", "taken")


#: budget is ceil(1.5 * total); the rest follows op10 step by step.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, 2.0e0 * source_size AS cap, 2.0e0 * source_size / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (SELECT *, (1.5e0 * total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY ratio, source NULLS LAST) AS rn FROM s2),
l AS (SELECT coalesce(arg_min(level, rn) FILTER (WHERE level <= ratio), 0.0e0) AS level FROM s3),
g AS (SELECT source, source_size, least(cap, l.level * weight) AS target, CAST(ceil(1.5e0 * total) AS BIGINT) AS budget FROM s3, l),
r AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.budget, lap,
  md5('wfq:' || CAST(lap AS VARCHAR) || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '-')) AS key
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, (SELECT unnest([0, 1]) AS lap)),
c AS (SELECT *, sum(size) OVER (PARTITION BY source, lap ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) + lap * source_size AS cum FROM r),
f AS (SELECT *, CASE WHEN size > 0 THEN CAST(cum AS DOUBLE) / target ELSE 0.0e0 END AS finish FROM c),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, lap, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM u GROUP BY doc_id, source, size, source_size, target
"""
