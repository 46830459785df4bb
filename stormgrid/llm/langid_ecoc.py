"""Operator 8: language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier a bit, a log-odds model of hashed byte trigrams, tells on
which side of that bit a text lies. Decoding adds up, for each codeword, the loss of its bits, weighted by how well each
classifier told its sides apart in training, and takes the nearest codeword. Two codewords about equally near make a text
ambiguous.

Training reads all labelled documents that are not held out: each task adds up a table of fixed size per language
(BUCKETS counts), tables are added per language, and one model of languages x BUCKETS is broadcast; its size depends on
the number of languages alone, which is checked.

Edge cases: null text or no letter: `und`, score 0. A null language or empty text teaches nothing. No labelled text at
all: everything is `und`. Null doc_id: not held out. Language, source and id never enter a prediction. An empty table has
an empty result; repeated rows have a result each and teach each time; texts of any length are read whole; other columns
are not looked at. Of languages equally near, the first by name is taken, and the text is ambiguous.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.llm import textkit as tk
from stormgrid.llm.shared import project

BUCKETS = 1 << 14
#: Languages up to which the model may be broadcast (64 kB of it each).
MOST_LANGUAGES = 1000
#: Tables of one language are added first over one in SALTS of the tasks, so that a frequent language is no hot key.
SALTS = 64
#: Trigrams beyond which more text doesn't make a classifier surer, and the margin below which a text is ambiguous.
SURE_AFTER, AMBIGUOUS = 60, 0.2
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_SOME_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


def _buckets(c: tk.Chunk) -> np.ndarray:
    """The bucket of the three bytes that begin at each byte, -1 where they are white or pass a document's end."""
    b = _PLAIN[c.buf].astype(np.uint32)
    out = np.full(len(b), -1, np.int32)
    if len(b) >= 3:
        x = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
        good = (b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))
        out[:-2] = np.where(good, (x >> np.uint32(18)).astype(np.int32), -1)
        out[c.end - 1] = -1
        out[np.maximum(c.end - 2, 0)] = -1
        out[c.end[:-1]] = -1
    else:
        out[:] = -1
    return out


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 a language. Few languages have all different splits; more have seeded random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1 if (k >> i) & 1 else -1 for k in range(1, 2 ** (n - 1))] for i in range(n - 1)] + [[-1] * (2 ** (n - 1) - 1)], float)
    bits = int(np.ceil(12 * np.log2(n)))
    rng = np.random.Generator(np.random.PCG64(11))
    best, far = None, -1
    for _ in range(20):
        code = np.array([rng.permutation(np.arange(n) % 2) * 2.0 - 1 for _ in range(bits)]).T
        same = code @ code.T
        np.fill_diagonal(same, -bits)
        apart = int(bits - same.max()) // 2  # the least distance of two codewords
        if apart > far:
            best, far = code, apart
    return best


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = len(self.languages)
        self.code = codewords(n)
        if not n:
            return
        table = np.array([counts[x] for x in self.languages], float)
        p = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * BUCKETS)
        sides = [(self.code[:, b] > 0, self.code[:, b] < 0) for b in range(self.code.shape[1])]
        self.weight = np.array([np.log(p[u].mean(0)) - np.log(p[v].mean(0)) if u.any() and v.any() else np.zeros(BUCKETS) for u, v in sides], np.float32).T.copy()
        # how far apart the sides are on average, by which a classifier's vote counts
        gap = np.array([(p[u].mean(0) - p[v].mean(0)) @ self.weight[:, b] if u.any() and v.any() else 0 for b, (u, v) in enumerate(sides)])
        self.vote = gap / max(gap.sum(), 1e-9)
        self.scale = np.maximum(gap, 1e-6) / 2

    def predict(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score, ambiguous."""
        idx = _buckets(c)
        ok = np.flatnonzero(idx >= 0)
        lo, hi = np.searchsorted(ok, c.start), np.searchsorted(ok, c.end)
        n = hi - lo
        sums = np.zeros((len(n), self.weight.shape[1]), np.float64)
        some = np.flatnonzero(n)
        if len(some):
            sums[some] = np.add.reduceat(self.weight[idx[ok]], lo[some], axis=0, dtype=np.float32)
        sure = np.sqrt(np.minimum(n, SURE_AFTER) / SURE_AFTER)
        margin = sums / np.maximum(n, 1)[:, None] / self.scale * sure[:, None]
        loss = (np.log1p(np.exp(-2 * self.code[None] * np.clip(margin, -4, 4)[:, None])) * self.vote).sum(2)
        best = loss.argmin(1)
        e = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        score = 1 / e.sum(1)
        far = np.sort(loss, axis=1)
        close = far[:, 1] - far[:, 0] < AMBIGUOUS * self.vote.max() if loss.shape[1] > 1 else np.zeros(len(best), bool)
        return best, score, close


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for c in tk.chunks(b.column(0), lower=True):
                idx = _buckets(c)
                ok = np.flatnonzero(idx >= 0)
                each = np.searchsorted(ok, np.append(c.start, len(c.buf)))
                names, number = np.unique(langs[c.rows.start : c.rows.stop].astype(str), return_inverse=True)
                per = np.bincount(np.repeat(number, np.diff(each)) * BUCKETS + idx[ok], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + per[k]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, "<i8")
        for t in tables:
            for x in t.column("counts").to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])

    d = project(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang")
    kind = "lang string, counts binary"
    some = d.mapInArrow(count, kind).withColumn("salt", F.spark_partition_id() % SALTS).groupBy("lang", "salt").applyInArrow(add, kind)
    tables = some.groupBy("lang").applyInArrow(add, kind)
    got = tables.limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Model({r["lang"]: np.frombuffer(r["counts"], "<i8") for r in got})


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = b.column(0).to_pylist()
            lang, score, close = [], [], []
            for c in tk.chunks(b.column(1), lower=True):
                if m.languages:
                    best, s, a = m.predict(c)
                for i, row in enumerate(c.rows):
                    t = texts[row]
                    if not t or not m.languages or not (_SOME_LETTER.search(t) or any(map(str.isalpha, t))):
                        lang.append("und"), score.append(0.0), close.append(True)
                    else:
                        lang.append(m.languages[best[i]]), score.append(float(s[i])), close.append(bool(a[i]))
            out = [x is not None and zlib.crc32(str(x).encode()) % 3 == 1 for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    docs = project(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")
