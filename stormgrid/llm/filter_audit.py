"""Operator 13: what a sequence of filters removes, for every order of the filters.

Each document fails some of the filters; that is its mask. Counts of (part, mask, label) tell all that any order of the
filters does, so documents are counted once and the orders are worked out from 2**n numbers a part.

The filter for copies needs every text of the table. Texts are routed by their xxhash to the partitions of an RDD, where
a fingerprint's chain holds each different text in full (compressed) with the smallest id seen. A row with a larger id
goes out at once as a copy; one with a smaller id takes the entry over and the one before goes out. The same is done in
each input partition first: it sends one row for each text, however many copies it has, and of a text that a third of all
rows hold, a partition gets one row from each task. Chains are let go when a task holds HELD bytes of them; the rows
sent are then more, the result is the same.

Edge cases: a null text is an empty one, and empty texts are copies of each other. A missing id is not compared: such a
row is no copy, makes none and has no label. Rows of one id and text are not copies of each other. A null part is the empty one.
Labels: a document is good, or toxic, if any of its label rows says so. An empty table has an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import count, permutations

import numpy as np
import zstandard
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormgrid.llm.shared import project

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of compressed texts in the chains of an input task before they are sent on; bytes of text for one partition.
HELD, ROUTED = 64 << 20, 64 << 20
#: The letter whose filter is "a copy of a text with a smaller id".
COPY = "E"


def _short(text: Column, words: Column) -> Column:
    return F.size(words) < 200


def _repetitive(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)


def _shouting(text: Column, words: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text)


def _symbols(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Letter to condition of failing, of (text, its words). COPY stands beside them, as the last.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": _short, "B": _repetitive, "C": _shouting, "D": _symbols}


def base_masks(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, mask, fp, text): the bits of all filters but the one for copies."""
    d = project(docs, "doc_id", "source", "text").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(FILTERS.values())]
    return d.select("doc_id", "part", sum(bits[1:], bits[0]).cast("int").alias("mask"), fingerprint(F.col("text")).alias("fp"), "text")


class Chains:
    """Fingerprint to entries [text, smallest id, {(part, mask): rows of that id}]; what is found to be a copy goes out."""

    def __init__(self) -> None:
        self.by: dict[int, list[list]] = {}
        self.size = 0

    def put(self, fp: int, packed: bytes, doc_id: int, rows: dict[tuple[str, int], int]) -> Iterator[tuple[int, str, int, int]]:
        chain = self.by.setdefault(fp, [])
        for e in chain:
            if e[0] == packed or _unpack(e[0]) == _unpack(packed):
                break
        else:
            chain.append([packed, doc_id, rows])
            self.size += len(packed) + 200
            return
        if doc_id == e[1]:
            for k, n in rows.items():
                e[2][k] = e[2].get(k, 0) + n
            return
        out = (doc_id, rows) if doc_id > e[1] else (e[1], e[2])
        if doc_id < e[1]:
            e[1:] = [doc_id, rows]
        yield from _copies(*out)

    def drained(self) -> Iterator[tuple[int, bytes, int, dict]]:
        for fp, chain in self.by.items():
            for packed, doc_id, rows in chain:
                yield fp, packed, doc_id, rows
        self.by, self.size = {}, 0


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _copies(doc_id: int, rows: dict) -> Iterator[tuple[int, str, int, int]]:
    for (part, mask), n in rows.items():
        yield doc_id, part, mask | 1 << len(FILTERS), n


def _sent(rows: Iterable, held: int = HELD) -> Iterator[tuple[int, tuple]]:
    """In an input partition: (fingerprint, entry of a chain), and what is decided already under a key that spreads it."""
    chains, z, nameless = Chains(), zstandard.ZstdCompressor(1), count()
    spread = lambda r: (r[0] * 0x9E3779B97F4A7C15 >> 17 & 0x7FFFFFFF, r)
    for doc_id, part, mask, fp, text in rows:
        if doc_id is None:
            yield next(nameless), (None, part, mask, 1)
            continue
        yield from map(spread, chains.put(fp, z.compress(text.encode("utf-8", "surrogatepass")), doc_id, {(part, mask): 1}))
        if chains.size > held:
            for key, *entry in chains.drained():
                yield key, (key, *entry)
    for key, *entry in chains.drained():
        yield key, (key, *entry)


def _routed(rows: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int, str, int, int]]:
    """In a partition of fingerprints: every row's whole mask."""
    chains = Chains()
    for _, r in rows:
        if isinstance(r[1], bytes):
            yield from chains.put(*r)
        else:
            yield r
    for _, _, doc_id, rows_ in chains.drained():
        for (part, mask), n in rows_.items():
            yield doc_id, part, mask, n


def masks(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64, held: int = HELD, routed: int = ROUTED) -> DataFrame:
    """(doc_id, part, mask, n): n rows of an id fail the filters of mask; bit len(FILTERS) says that they are copies."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    base = base_masks(docs, fingerprint)
    n = max(8, math.ceil(size / routed), docs.sparkSession.sparkContext.defaultParallelism)
    rows = base.rdd.mapPartitions(lambda it: _sent(it, held)).partitionBy(n, lambda fp: fp % n).mapPartitions(_routed)
    return docs.sparkSession.createDataFrame(rows, "doc_id long, part string, mask int, n long", verifySchema=False)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of every row whose text a smaller id has."""
    bit = 1 << len(FILTERS)
    return masks(docs).where(F.col("mask").bitwiseAND(bit) > 0).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth")).select("doc_id")


def mask_counts(found: DataFrame, labels: DataFrame) -> RDD:
    """part to a table of counts: masks by (rows, good rows, toxic rows)."""
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    each = found.join(said, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False)))
    shape = (2 << len(FILTERS), 3)

    def add(v: np.ndarray, x: tuple) -> np.ndarray:
        mask, n, good, toxic = x
        v[mask] += (n, n * good, n * toxic)
        return v

    return each.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(lambda x: add(np.zeros(shape, np.int64), x), add, np.add)


def _orders(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """The rows of one part: orders times steps."""
    every = range(len(counts))
    bit = {f: 1 << i for i, f in enumerate(letters)}
    ways = math.factorial(len(letters))
    shapley = {f: sum(int(counts[m][0]) * ways // m.bit_count() for m in every if m & b) for f, b in bit.items()}
    for order in permutations(letters):
        before = 0
        for step, f in enumerate(order, 1):
            b = bit[f]
            removed = sum(counts[m] for m in every if m & b and not m & before)
            redundant = sum(int(counts[m][0]) for m in every if m & b and m & before)
            before |= b
            kept = sum(int(counts[m][0]) for m in every if not m & before)
            yield (part, "".join(order), step, kept, int(removed[0]), redundant, int(counts[b][0]), int(removed[1]), int(removed[2]), shapley[f])


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row for each part, order of the filters and step. docs: doc_id, source, text; labels: doc_id, quality, toxic."""
    letters = "".join(FILTERS) + COPY
    rows = mask_counts(masks(docs, **how), labels).flatMap(lambda kv: _orders(kv[0], kv[1], letters))
    return docs.sparkSession.createDataFrame(rows, RESULT, verifySchema=False)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least_id FROM t),
m AS (SELECT doc_id, part,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > least_id THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT chr(CAST(65 + i AS INTEGER)) AS f, 1 << i AS b FROM range(5) x(i)),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits FROM f f1, f f2, f f3, f f4, f f5
  WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS b, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, b,
  sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & b > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM r
"""
