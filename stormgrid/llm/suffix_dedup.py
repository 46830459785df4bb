"""Operator 4: exact substring dedup with a common-prefix interval tree over suffixes.

Every byte that lies in a LEAST-byte string which also starts in a document with a smaller id goes.

1. Anchors: of every LEAST-byte window, the KMER-byte string in it with the smallest hash; equal windows have their anchor
   at the same place, so a repeat of LEAST bytes has an anchor that its other occurrences have too. Batches of documents
   send the hashes of their distinct anchors to buckets and learn which ones another document has.
2. Suffixes: at each shared anchor a batch sends its suffix (LEAST bytes) and what can stand left of it inside a window,
   once for each distinct context, with the smallest document that has it. A hot passage costs one entry a batch.
3. Intervals: suffixes of a bucket are sorted with their common prefixes; a stack scan gives the tree of common-prefix
   intervals. The occurrences below an interval are one group of a repeat unless they differ on the left; where they do,
   the left sides are split the same way. The groups with the windows they stand for are maximal repeats with all their
   occurrences, and an occurrence whose group has a smaller document learns which windows go.
4. Batches mark those windows and cut them out.

Edge cases: null text is empty: 0 bytes, digest of nothing. Documents with equal ids do not cut each other. A null id
counts as larger than all others. A text shorter than LEAST keeps everything. Strings are judged on the input, not on what
is left. Whole texts are read; a document is held by one task. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.llm import exchange as ex
from stormgrid.llm import staging
from stormgrid.llm import textkit as tk
from stormgrid.llm.shared import materialise

LEAST, KMER = 50, 24
REACH = LEAST - KMER  # bytes of a window that can stand left of its anchor
_WIDTH = REACH + LEAST
#: Bytes of text whose anchors one bucket answers for: at most a few hundred MB in its task, however large the input is.
BUCKET_BYTES = 12 << 20


def anchors(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of anchors."""
    n = len(c.buf)
    long = c.end - c.start >= LEAST
    if not long.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = tk.prefix_hash(c.buf)
    at = np.arange(n - KMER + 1)
    g = tk.span_hash(sums, at, at + KMER)
    w = LEAST - KMER + 1
    least = tk.sliding(g, w)
    inside = np.zeros(n - LEAST + 2, np.int64)
    np.add.at(inside, c.start[long], 1)
    np.add.at(inside, c.end[long] - LEAST + 1, -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    none = np.zeros(w - 1, np.uint64)
    most = tk.sliding(np.concatenate((none, least, none)), w, np.maximum)
    p = np.flatnonzero((most == g) & (g > 0))
    return p, tk.mix(g[p])  # least hashes are small; buckets go by evenly spread ones


def _distinct(c: tk.Chunk, ids: np.ndarray):
    """Anchors' places, documents, index into their distinct hashes; the hashes; whether two ids have one."""
    p, g = anchors(c)
    doc = np.searchsorted(c.start, p, "right") - 1
    hashes, first, which = np.unique(g, return_index=True, return_inverse=True)
    twice = np.zeros(len(hashes), bool)
    if len(p):
        twice[which[ids[doc] != ids[doc[first[which]]]]] = True
    return p, doc, which, hashes, twice


def _bits(masks: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Answers of buckets, in order, as one mask."""
    return np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=int(n)).astype(bool) for m, n in zip(masks, sizes, strict=True)]) if masks else np.empty(0, bool)


def _slices(hashes: np.ndarray, nb: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, start and end of each bucket's part of sorted hashes."""
    where = ex.bucket(hashes, nb)
    a, b = ex.runs(where)
    return where[a], a, b


def _shared(staged: DataFrame, nb: int) -> DataFrame:
    """(batch, bucket, data): a bit for each of the batch's distinct anchors, in order of hash: whether it is shared."""

    def emit(batch, ids, c):
        _, _, _, hashes, twice = _distinct(c, ids)
        where, a, b = _slices(hashes, nb)
        low = (hashes & tk.U(0xFFFFFFFF)).astype("<u4")
        more = ((hashes >> tk.U(32)) & tk.U(0xFF)).astype(np.uint8)
        cut = list(zip(a.tolist(), b.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([batch] * len(cut), pa.int64()), pa.array(where, pa.int32()), pa.array([low[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([more[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([np.packbits(twice[x:y]).tobytes() for x, y in cut], pa.binary())], names=["batch", "bucket", "low", "more", "twice"])

    def judge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        low, more = ex.column(t, "low", "<u4"), ex.column(t, "more", np.uint8)
        sizes = np.array([len(x) for x in t.column("more").to_pylist()])
        shared = _bits(t.column("twice").to_pylist(), sizes)
        h = low.astype(np.uint64) | (more.astype(np.uint64) << tk.U(32))
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([t.column("batch").combine_chunks(), t.column("bucket").combine_chunks(), pa.array([np.packbits(shared[e - n : e]).tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["batch", "bucket", "data"])

    sent = staging.over(staged, [], emit, "batch long, bucket int, low binary, more binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(judge, "batch long, bucket int, data binary")


def _contexts(c: tk.Chunk, ids: np.ndarray, masks: list[bytes], nb: int):
    """The shared anchors' places, documents and contexts' numbers, and of each distinct context (ordered by its anchor's
    hash): that hash, its first document, place, and how far it reaches left and right."""
    p, doc, which, hashes, _ = _distinct(c, ids)
    _, a, b = _slices(hashes, nb)
    ok = _bits(masks, b - a)[which] if len(p) else np.empty(0, bool)
    p, doc, g = p[ok], doc[ok], hashes[which[ok]]
    left = np.minimum(REACH, p - c.start[doc])
    right = np.minimum(LEAST, c.end[doc] - p)
    sums = tk.prefix_hash(c.buf)
    own = tk.mix(tk.span_hash(sums, p - left, p + right) + left.astype(np.uint64))
    order = np.lexsort((p, own, g))  # documents of a batch stand in order of id, so the first place has the smallest
    fresh = np.ones(len(p), bool)
    fresh[1:] = (own[order][1:] != own[order][:-1]) | (g[order][1:] != g[order][:-1])
    number = np.empty(len(p), np.int64)
    number[order] = np.cumsum(fresh) - 1
    head = order[fresh]
    return p, doc, number, left, right, (g[head], doc[head], p[head], left[head], right[head])


def _tree(depth: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """(first, last, depth, parent's depth) of every common-prefix interval; depth[i] is the common prefix of i - 1 and i."""
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i in range(1, len(depth) + 1):
        d = depth[i] if i < len(depth) else 0
        left = i - 1
        while stack and stack[-1][0] > d:
            top, left = stack.pop()
            parent = max(d, stack[-1][0] if stack else 0)
            if top >= least:
                out.append((left, i - 1, top, max(parent, least - 1)))
        if d and (not stack or stack[-1][0] < d):
            stack.append((d, left))
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _windows(rights: list[bytes], lefts: list[bytes], docs: list[int]) -> list[int]:
    """Of each context of one anchor, sorted by suffix: a bit for each left length o whose window (o bytes before the
    anchor, LEAST - o from it on) a smaller document has too. lefts are reversed."""
    n = len(rights)
    out = [0] * n
    depth = [0, *(_common(rights[i - 1], rights[i]) for i in range(1, n))]
    for first, last, d, parent in _tree(depth, KMER):
        lo, hi = max(0, LEAST - d), min(REACH, LEAST - 1 - parent)
        if lo > hi:
            continue
        members = [i for i in range(first, last + 1) if len(lefts[i]) >= lo]
        if len(members) < 2:
            continue
        members.sort(key=lefts.__getitem__)
        split = [_common(lefts[x], lefts[y]) for x, y in zip(members, members[1:], strict=False)]
        if min(split) >= hi:  # alike on the left as far as windows reach: one group
            least = min(docs[i] for i in members)
            bits = (1 << (hi + 1)) - (1 << lo)
            for i in members:
                if docs[i] > least:
                    out[i] |= bits
            continue
        for o in range(lo, hi + 1):
            at = 0
            while at < len(members):
                to = at + 1
                while to < len(members) and split[to - 1] >= o:
                    to += 1
                if to - at > 1:
                    least = min(docs[i] for i in members[at:to])
                    for i in members[at:to]:
                        if docs[i] > least:
                            out[i] |= 1 << o
                at = to
    return out


_PARTS = 8


def _masks(h: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of each context, the windows that a smaller document has too. Suffixes are sorted by anchor, then by their bytes,
    then by what stands left of them, reversed; equal contexts come to stand together."""
    n = len(h)
    rows = np.zeros((n, 88), np.uint8)
    rows[:, :LEAST] = text[:, REACH:]
    rows[:, 56 : 56 + REACH] = text[:, :REACH][:, ::-1]
    rows[:, 82], rows[:, 83] = right, left
    cols = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((*cols.T[::-1], h))
    cols, hs, ds = cols[order], h[order], doc[order]
    new_group = np.concatenate(([True], hs[1:] != hs[:-1]))
    new_context = new_group | np.concatenate(([True], (cols[1:] != cols[:-1]).any(1)))
    context = np.cumsum(new_context) - 1
    head = np.flatnonzero(new_context)
    smallest = np.minimum.reduceat(ds, head)
    lo, hi = np.maximum(0, LEAST - right[order]), np.minimum(REACH, left[order])
    every = np.where(hi >= lo, (np.int64(1) << (hi + 1)) - (np.int64(1) << lo), 0)
    per = np.add.reduceat(new_context.astype(np.int64), np.flatnonzero(new_group))
    start = np.cumsum(per) - per
    found = np.zeros(len(head), np.int64)
    for a, m in zip(start[per > 1].tolist(), per[per > 1].tolist(), strict=True):
        part = rows[order[head[a : a + m]]]
        found[a : a + m] = _windows([r[: r[82]].tobytes() for r in part], [r[56 : 56 + r[83]].tobytes() for r in part], smallest[a : a + m].tolist())
    # a context's smallest document learns what the tree found; larger ones lose all windows anyway
    out = np.empty(n, np.int64)
    out[order] = np.where(ds > smallest[context], every, found[context])
    return out


def _judged(staged: DataFrame, shared: DataFrame, nb: int) -> DataFrame:
    """(batch, bucket, data): for each of the batch's contexts, in order, the windows that go in its first document."""

    def emit(batch, ids, c, masks):
        *_, (g, doc, p, left, right) = _contexts(c, ids, masks, nb)
        if not len(g):
            return
        where, a, b = _slices(g, nb)
        padded = np.concatenate((np.zeros(REACH, np.uint8), c.buf, np.zeros(LEAST, np.uint8)))
        text = np.lib.stride_tricks.sliding_window_view(padded, _WIDTH)[p]
        short = np.flatnonzero((left < REACH) | (right < LEAST))
        span = np.arange(-REACH, LEAST)
        part = text[short]
        part[(span < -left[short, None]) | (span >= right[short, None])] = 0
        text[short] = part
        z = zstandard.ZstdCompressor(3)
        cut = list(zip(a.tolist(), b.tolist(), strict=True))
        raw = lambda x: pa.array([x[i:j].tobytes() for i, j in cut], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([batch] * len(cut), pa.int64()), pa.array(where, pa.int32()), raw(g.astype("<u8")), raw(ids[doc].astype("<i8")), raw(left.astype(np.uint8)), raw(right.astype(np.uint8)), pa.array([z.compress(text[i:j].tobytes()) for i, j in cut], pa.binary())], names=["batch", "bucket", "hash", "doc", "left", "right", "text"])

    def judge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        z = zstandard.ZstdDecompressor()
        h, doc = ex.column(t, "hash", "<u8"), ex.column(t, "doc", "<i8")
        left, right = ex.column(t, "left", np.uint8).astype(np.int64), ex.column(t, "right", np.uint8).astype(np.int64)
        sizes = np.array([len(x) for x in t.column("left").to_pylist()])
        ends = np.cumsum(sizes)
        zipped = t.column("text")
        text = np.empty((len(h), _WIDTH), np.uint8)
        for i, (k, e) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
            text[e - k : e] = np.frombuffer(z.decompress(zipped[i].as_py(), max_output_size=k * _WIDTH), np.uint8).reshape(-1, _WIDTH)
        out = np.empty(len(h), "<u4")
        for part in range(_PARTS):  # anchors of a part at a time, for memory
            at = np.flatnonzero(h % tk.U(_PARTS) == tk.U(part))
            if len(at):
                out[at] = _masks(h[at], doc[at], left[at], right[at], text[at])
        yield pa.RecordBatch.from_arrays([t.column("batch").combine_chunks(), t.column("bucket").combine_chunks(), pa.array([out[e - k : e].tobytes() for k, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["batch", "bucket", "data"])

    sent = staging.over(staged, [shared], emit, "batch long, bucket int, hash binary, doc binary, left binary, right binary, text binary")
    return sent.groupBy("bucket").applyInArrow(judge, "batch long, bucket int, data binary")


def deduplicated(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run, in bytes) and, if asked
    for, kept (the remaining bytes)."""
    staged = staging.stage(docs)
    nb = staging.buckets(staged, BUCKET_BYTES)
    shared = materialise(_shared(staged, nb), "anchors")
    judged = _judged(staged, shared, nb)

    def cut(batch, ids, c, masks, windows):
        p, doc, number, left, right, (_, first, *_) = _contexts(c, ids, masks, nb)
        mark = np.zeros(len(c.buf) + 1, np.int32)
        if len(p):
            own = np.frombuffer(b"".join(windows), "<u4").astype(np.int64)[number]
            lo, hi = np.maximum(0, LEAST - right), np.minimum(REACH, left)
            every = np.where(hi >= lo, (np.int64(1) << (hi + 1)) - (np.int64(1) << lo), 0)
            bits = np.where(ids[doc] > ids[first[number]], every, own)
            for o in range(REACH + 1):
                at = p[(bits >> o) & 1 == 1] - o
                np.add.at(mark, at, 1)
                np.add.at(mark, at + LEAST, -1)
        gone = np.cumsum(mark[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        where = np.searchsorted(edge[0::2], np.append(c.start, len(c.buf) + 1)).tolist()
        n, removed, spans, sha, kept = [], [], [], [], []
        pairs = edge.reshape(-1, 2)
        for i, (a, b) in enumerate(zip(c.start.tolist(), c.end.tolist(), strict=True)):
            mine = pairs[where[i] : where[i + 1]] - a
            rest = c.buf[a:b] if not len(mine) else c.buf[a:b][~gone[a:b]]
            data = rest.tobytes()
            n.append(b - a), removed.append(b - a - len(data)), sha.append(hashlib.sha256(data).hexdigest())
            spans.append([{"start": x, "end": y} for x, y in mine.tolist()])
            if text:
                kept.append(data)
        cols = [pa.array([None if x == staging.NO_ID else x for x in ids.tolist()], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        if text:
            cols.append(pa.array(kept, pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return staging.over(staged, [shared, judged], cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * text)
