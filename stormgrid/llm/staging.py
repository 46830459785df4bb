"""Documents packed into batches of about a MB, kept as a table in the shared folder.

Operators that go over the texts more than once, with answers for each batch in between, join those answers by batch
number. The table is bucketed by it, so that texts are not shuffled; only answers travel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.llm import textkit as tk
from stormgrid.llm.shared import bucketed, project

BATCH = 1 << 20
#: Bytes of text in a bucket of the table, which is what a task goes over and an executor lost repeats.
TASK = 24 << 20
#: Stands for a missing doc_id; after every other.
NO_ID = 2**63 - 1


def stage(docs: DataFrame, size: int = BATCH, whole: bool = False) -> DataFrame:
    """(batch, size, ids, lens, blob[, rest]): documents of a batch in order of doc_id; a null text is empty, a null id is
    NO_ID. size: bytes of its texts. rest, if whole: all columns of those rows, and whether text is null (_null), as an Arrow stream."""
    d = docs if whole else project(docs, "doc_id", "text")
    at_id, at_text = d.columns.index("doc_id"), d.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(5)
        held: list[pa.RecordBatch] = []
        total = 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = [NO_ID if i is None else int(i) for i in t.column(at_id).to_pylist()]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            t = t.take(pa.array(order))
            texts = tk.as_bytes(t.column(at_text))
            lens = [len(x) for x in texts]
            cols = [pa.array([sum(lens)], pa.int64()), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([z.compress(b"\n".join(texts))], pa.binary())]
            if whole:
                sink = pa.BufferOutputStream()
                slim = t.append_column("_null", t.column(at_text).is_null()).set_column(at_text, "text", pa.nulls(t.num_rows, pa.string()))
                with pa.ipc.new_stream(sink, slim.schema) as w:
                    w.write_table(slim)
                cols.append(pa.array([z.compress(sink.getvalue().to_pybytes())], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=["size", "ids", "lens", "blob", "rest"][: len(cols)])

        for b in batches:
            lens = np.array([len(x) for x in tk.as_bytes(b.column(at_text))], np.int64) + 1
            at = 0
            while at < b.num_rows:
                fit = max(int(np.searchsorted(np.cumsum(lens[at:]), size - total, "right")), 0 if held else 1)
                if not fit:
                    yield out()
                    held, total = [], 0
                    continue
                held.append(b.slice(at, fit))
                total += int(lens[at : at + fit].sum())
                at += fit
        if held:
            yield out()

    packed = d.mapInArrow(tk.released(run), "size long, ids array<long>, lens array<long>, blob binary" + ", rest binary" * whole)
    text = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bucketed(packed.withColumn("batch", F.monotonically_increasing_id()), "staged", "batch", max(8, math.ceil(text / TASK)))


def buckets(staged: DataFrame, size: int) -> int:
    """So many buckets that each has `size` bytes of text to answer for, however many documents there are."""
    return max(8, math.ceil((staged.agg(F.sum("size")).first()[0] or 0) / size))


def opened(ids: list[int], lens: list[int], blob: bytes) -> tuple[np.ndarray, tk.Chunk]:
    total = int(sum(lens)) + max(len(lens) - 1, 0)
    buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(total, 1)), np.uint8)
    n = np.array(lens, np.int64)
    ends = np.cumsum(n + 1) - 1
    return np.array(ids, np.int64), tk.Chunk(range(len(lens)), buf, ends - n, ends)


def over(staged: DataFrame, answers: list[DataFrame], f: Callable, schema: str) -> DataFrame:
    """f(batch, ids, chunk, *answers[, rest]) over the batches; it yields record batches. answers: (batch, bucket, data), each
    given to f as the batch's data in order of bucket."""
    joined, n = staged, len(answers)
    for i, a in enumerate(answers):
        each = a.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias("x")).select("batch", F.col("x.data").alias(f"answer{i}"))
        joined = joined.join(each.hint("shuffle_hash"), "batch", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                ids, chunk = opened(row["ids"], row["lens"], row["blob"])
                more = [row["rest"]] if "rest" in row else []
                yield from f(row["batch"], ids, chunk, *[row[f"answer{k}"] or [] for k in range(n)], *more)

    return joined.mapInArrow(tk.released(run), schema)
