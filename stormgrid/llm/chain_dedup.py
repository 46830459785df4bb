"""Operator 9: fuzzy substring dedup by collinear chaining.

1. Seeds: all word 5-grams. Batches send the hashes of their seeds to buckets and learn which ones stand in one document
   only, in few (FEW at most) or in many. The rest takes part no more.
2. References: a seed of few documents refers to all of them that have smaller ids. A seed of many refers to the first
   one, and to the first one among those that also agree on what stands around: the next words, up to each of LEVELS
   words in all, or the least shared seed in each of STROBES ranges of words further on, whatever lies between. So a
   passage finds its like though thousands of documents hold its pieces, at a cost that is linear in its words.
3. Chains: a document's seeds that refer to one earlier document are matches (place here, place there). Runs on one
   diagonal become segments; a Fenwick tree over places there gives each segment the best chain that ends before it in
   both, less a gap cost, which is linear in the words skipped on either side.
4. Alignment: the earlier document's words around a chain are fetched in blocks of BLOCK words, distinct ones only, and
   the chain is aligned: words on segments compared, gaps by edit distance, ends extended while they pay. What is long
   and alike enough is a passage; the later document loses it.
5. What is left open: a stretch of LEAST_WORDS words with LEAST_SHARED of them in shared seeds but in no passage, the
   first and last of those less than a seed from its ends (a seed counts where it first stands in its document). All holders of the rarest of those seeds are asked for, so many seeds
   that an earlier document with LEAST_SHARED of the words must hold LEAST_ASKED words of the asked ones; holders of so
   many are aligned as above.

Nothing here depends on how rows are dealt over batches: references go by id.

Edge cases: null or empty text, fewer than 5 words: no passage. Documents with equal ids do not refer to each other; a
null id refers to others and is never referred to. Repeated rows have equal ids, so neither loses a passage to the other,
and both lose what a smaller id has. Repeats within one document stay. Of equal chains the one with smaller places wins.
Whole texts are read; a document is held by one task. Upper case A-Z counts as lower case. Empty table: empty result.
Other columns pass through `cleaned`; a text that is null there stays null.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.llm import exchange as ex
from stormgrid.llm import staging
from stormgrid.llm import textkit as tk
from stormgrid.llm.shared import materialise, settled

SEED_WORDS = 5
#: A passage has so many words at least, and so large a part of them alike.
LEAST_WORDS, ALIKE = 45, 0.8
#: Words from the first to the last seed of a chain that is aligned, at least; ends are extended from there.
LEAST_CHAIN = 16
#: Score of a seed, cost of a word skipped, and words that a chain may skip at once.
WORTH, COST, SKIP = 4.0, 0.1, 40
#: Seeds on one diagonal, so near each other, are one segment.
NEAR = 16
BLOCK = 128
_LONGER = 4  # words by which a passage that was too short may become longer than it must
_MORE = 64  # words fetched beyond a chain's ends
_BEYOND = 2 * _MORE + BLOCK  # words kept of the document itself beyond its chains' ends
#: Documents up to which a seed refers to all of them; what tells the holders of other seeds apart.
FEW, LEVELS, STROBES = 8, (9, 17, 33, 45), ((6, 26), (16, 56))
#: Words in shared seeds, of LEAST_WORDS in a row, from which a stretch without a passage is looked at again; of them, in
#: the seeds that are asked for then.
LEAST_SHARED, LEAST_ASKED = 30, 10
#: Words from a seed's first place in a document to a repeat of it that is taken to be repeated in the other document too.
_FAR = 256
#: Bytes of text whose seeds one bucket answers for.
BUCKET_BYTES = 24 << 20
_ALONE, _FEW, _MANY = 0, 1, 2
_RARE = int(np.log2(FEW) * 8)  # rarity up to which references are all there are


def _dump(x) -> bytes:
    return zstandard.ZstdCompressor(1).compress(pickle.dumps(x, 5))


def _load(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _pack(*arrays: np.ndarray) -> bytes:
    """Flat arrays, byte by byte of their values: small numbers have runs of zeros then."""
    kinds = [(x.dtype.str, len(x)) for x in arrays]
    flat = [np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(1).compress(pickle.dumps((kinds, b"".join(flat)), 5))


def _unpack(x: bytes) -> list[np.ndarray]:
    (kinds, flat), out, at = _load(x), [], 0
    for kind, n in kinds:
        kind = np.dtype(kind)
        part = np.frombuffer(flat, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def _words(c: tk.Chunk):
    """Word starts, ends, documents' first words, and 64-bit hashes, ASCII case aside."""
    low = tk.Chunk(c.rows, tk.LOWER[c.buf], c.start, c.end)
    ws, we, first = low.words(tk.SPACED)
    return ws, we, first, tk.span_hash(tk.prefix_hash(low.buf), ws, we)


def _seeds(c: tk.Chunk):
    """Words as above; seeds' places (word numbers), documents, index into distinct pairs of hash and document; those
    pairs' hashes, in order, and each one's first seed."""
    ws, we, first, h = _words(c)
    g, at = tk.grams(h, first, SEED_WORDS)
    doc = np.searchsorted(first, at, "right") - 1
    order = tk.order(g)  # places ascend within a hash, and so do documents
    gs, ds = g[order], doc[order]
    new = np.ones(len(gs), bool)
    new[1:] = (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1])
    which = np.empty(len(gs), np.int64)
    which[order] = np.cumsum(new) - 1
    return (ws, we, first, h), (at, doc, which), gs[new], order[new]


def _slices(hashes: np.ndarray, nb: int):
    where = ex.bucket(hashes, nb)
    a, b = ex.runs(where)
    return where[a], list(zip(a.tolist(), b.tolist(), strict=True))


def _within(hashes: np.ndarray, nb: int) -> np.ndarray:
    """32 bits that tell a bucket's hashes apart, in their order."""
    part = ((hashes >> tk.U(32)) * tk.U(nb)) & tk.U(0xFFFFFFFF)  # the place in the bucket
    return np.minimum(part + ((hashes & tk.U(0xFFFFFFFF)) * tk.U(nb) >> tk.U(32)), tk.U(0xFFFFFFFF)).astype("<u4")


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, n of them, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _planes(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers, as differences, byte by byte."""
    d = np.diff(x, prepend=x[:0].dtype.type(0)).astype("<u4")
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplaned(x: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(b.T).view("<u4").ravel(), dtype=np.uint32)


def _packed(batch: int, where: np.ndarray, **cols: list[bytes]) -> pa.RecordBatch:
    k = len(where)
    return pa.RecordBatch.from_arrays([pa.array([batch] * k, pa.int64()), pa.array(where, pa.int32()), *(pa.array(x, pa.binary()) for x in cols.values())], names=["batch", "bucket", *cols])


def _marked(staged: DataFrame, nb: int) -> DataFrame:
    """(batch, bucket, data): of each of the batch's distinct seeds, in order of hash, whether one, few or many hold it."""

    def emit(batch, ids, c):
        _, _, hashes, _ = _seeds(c)
        if not len(hashes):
            return
        a, b = ex.runs(hashes)
        h, n = hashes[a], np.minimum(b - a, FEW + 1).astype(np.uint8)
        where, cut = _slices(h, nb)
        z = zstandard.ZstdCompressor(1)
        low = _within(h, nb)
        yield _packed(batch, where, low=[_planes(low[i:j]) for i, j in cut], n=[z.compress(n[i:j].tobytes()) for i, j in cut])

    def judge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        z, unz = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        lows = [_unplaned(x) for x in t.column("low").to_pylist()]
        low = np.concatenate(lows)
        n = np.frombuffer(b"".join(map(unz.decompress, t.column("n").to_pylist())), np.uint8)
        order = tk.order(low.astype(np.uint64) << tk.U(32))
        a, b = ex.runs(low[order])
        total = np.add.reduceat(n[order].astype(np.int64), a)
        mark = np.empty(len(low), np.uint8)
        mark[order] = np.repeat(np.where(total > FEW, _MANY, np.where(total > 1, _FEW, _ALONE)).astype(np.uint8), b - a)
        sizes = [len(x) for x in lows]
        ends = np.cumsum(sizes).tolist()
        data = [z.compress(mark[e - k : e].tobytes()) for k, e in zip(sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([t.column("batch").combine_chunks(), t.column("bucket").combine_chunks(), pa.array(data, pa.binary())], names=["batch", "bucket", "data"])

    sent = staging.over(staged, [], emit, "batch long, bucket int, low binary, n binary")
    return sent.groupBy("bucket").applyInArrow(tk.released(judge), "batch long, bucket int, data binary")


def _shared(c: tk.Chunk, marks: list[bytes]):
    """As _seeds, of shared seeds' pairs only (-1: alone), with each pair's mark."""
    words, (at, doc, which), hashes, head = _seeds(c)
    if not len(hashes):
        return words, (at, doc, which), hashes, head, np.empty(0, np.uint8)
    unz = zstandard.ZstdDecompressor()
    mark = np.frombuffer(b"".join(map(unz.decompress, marks)), np.uint8)
    a, b = ex.runs(hashes)
    mark = np.repeat(mark, b - a)
    keep = mark > _ALONE
    number = np.where(keep, np.cumsum(keep) - 1, -1)
    return words, (at, doc, number[which]), hashes[keep], head[keep], mark[keep]


def _contexts(words, seeds, hashes: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each pair, and each level and strobe, 32 bits of what stands around its first seed; 0 where a document ends, or
    where the next words hold a seed of this document alone, so that no other has them."""
    _, _, first, h = words
    at, doc, which = seeds
    p = at[head]
    end = first[1:][doc[head]]
    out = np.zeros((len(LEVELS) + len(STROBES), len(p)), "<u4")
    up, _ = tk._power(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    alone = np.zeros(len(h) + 1, np.int64)
    alone[at[which < 0] + 1] = 1
    np.cumsum(alone, out=alone)
    for k, n in enumerate(LEVELS):
        ok = p + n <= end
        ok[ok] = alone[p[ok] + n - SEED_WORDS + 1] == alone[p[ok]]
        out[k, ok] = (tk.span_hash(sums, p[ok], p[ok] + n) >> tk.U(32)) | tk.U(1)
    most = np.uint64(2**64 - 1)
    least = np.full(len(h), most)
    some = which >= 0
    least[at[some]] = hashes[which[some]]
    for k, (lo, hi) in enumerate(STROBES, len(LEVELS)):
        if len(h) < hi:
            continue
        m = tk.sliding(least, hi - lo)
        ok = p + hi <= end
        x = np.full(len(p), most)
        x[ok] = m[p[ok] + lo]
        ok &= x != most
        out[k, ok] = (tk.mix(x[ok]) >> tk.U(32)) | tk.U(1)
    return out


_ENTRY = np.dtype([("h", "<u8"), ("id", "<i8"), ("batch", "<i8"), ("doc", "<u4"), ("at", "<u4")])
NO_BATCH = -1
_COLUMNS = len(LEVELS) + len(STROBES)


def _sparse(x: np.ndarray) -> bytes:
    """Numbers that look random, and zeros, of which only the places are kept."""
    return zstandard.ZstdCompressor(1).compress(np.packbits(x > 0).tobytes() + x[x > 0].tobytes())


def _unsparse(x: bytes, shape: tuple[int, int]) -> np.ndarray:
    x, n = zstandard.ZstdDecompressor().decompress(x), shape[0] * shape[1]
    out = np.zeros(n, "<u4")
    out[np.unpackbits(np.frombuffer(x, np.uint8, -(-n // 8)), count=n) > 0] = np.frombuffer(x, "<u4", offset=-(-n // 8))
    return out.reshape(shape)


def _sent(staged: DataFrame, marks: DataFrame, nb: int) -> DataFrame:
    """(batch, bucket, low, more, around, data): the batch's pairs of a shared seed and a document."""

    def emit(batch, ids, c, marks):
        words, seeds, hashes, head, mark = _shared(c, marks)
        if not len(hashes):
            return
        at, doc, _ = seeds
        where, cut = _slices(hashes, nb)
        d = doc[head]
        low, more = (hashes & tk.U(0xFFFFFFFF)).astype("<u4"), ((hashes >> tk.U(32)) & tk.U(0xFF)).astype(np.uint8)
        place = (at[head] - words[2][d]).astype("<u4")
        many = mark == _MANY
        around = _contexts(words, seeds, hashes, head)
        data = []
        for i, j in cut:
            held, code = np.unique(d[i:j], return_inverse=True)
            data.append(_pack(held.astype("<u4"), np.diff(ids[held], prepend=0), code.astype("<u4"), place[i:j], np.packbits(many[i:j])))
        yield _packed(batch, where, low=[low[i:j].tobytes() for i, j in cut], more=[more[i:j].tobytes() for i, j in cut], around=[_sparse(around[:, i:j][:, many[i:j]]) for i, j in cut], data=data)

    return staging.over(staged, [marks], emit, "batch long, bucket int, low binary, more binary, around binary, data binary")


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A bucket's pairs as _ENTRY, the rank of each one's document by id, batch and place in it, what stands around each,
    and how many pairs each row has."""
    low, more = ex.column(t, "low", "<u4"), ex.column(t, "more", np.uint8)
    sizes = [len(x) for x in t.column("more").to_pylist()]
    out = np.empty(len(low), _ENTRY)
    out["h"] = low.astype(np.uint64) | (more.astype(np.uint64) << tk.U(32))
    out["batch"] = np.repeat(t.column("batch").to_numpy(), sizes)
    around = np.zeros((_COLUMNS, len(low)), "<u4")
    at, docs, known, rank = 0, [], 0, np.empty(len(low), np.int64)
    for n, b, x, y in zip(sizes, t.column("batch").to_pylist(), t.column("data").to_pylist(), t.column("around").to_pylist(), strict=True):
        held, ids, code, place, many = _unpack(x)
        ids = np.cumsum(ids)
        part = out[at : at + n]
        part["id"], part["doc"], part["at"] = ids[code], held[code], place
        rank[at : at + n] = known + code.astype(np.int64)
        some = at + np.flatnonzero(np.unpackbits(many, count=n))
        around[:, some] = _unsparse(y, (_COLUMNS, len(some)))
        docs.append((held, np.full(len(ids), b), ids))
        known += len(ids)
        at += n
    by = np.empty(known, np.int64)
    by[np.lexsort([np.concatenate(x) for x in zip(*docs, strict=True)])] = np.arange(known)
    return out, by[rank], around, sizes


def _ranked(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in order of x and id: where the entries of equal x start, how many of them have smaller ids, their end."""
    a, b = ex.runs(x)
    start, end = np.repeat(a, b - a), np.repeat(b, b - a)
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (ids[1:] != ids[:-1])
    same = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return start, same - start, end


def references(e: np.ndarray, rank: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (entry, entry it refers to), in order of the first, and of each entry how many documents hold its seed."""
    order = tk.order((e["h"] << tk.U(24)) | rank.astype(np.uint64)) if rank.max(initial=0) < 1 << 24 else np.lexsort((rank, e["h"]))
    s = e[order]
    start, before, end = _ranked(s["h"], s["id"])
    held = np.empty(len(e), np.int64)
    held[order] = end - start
    few = end - start <= FEW
    n = np.where(few, before, np.minimum(before, 1))
    of, to = [np.repeat(order, n)], [order[_ragged(start, n)]]
    many = np.flatnonzero(~few)
    for level in around:
        x = many[level[order[many]] > 0]
        if not len(x):
            continue
        key = tk.mix(s["h"][x] + (level[order[x]].astype(np.uint64) << tk.U(40) | level[order[x]].astype(np.uint64) >> tk.U(24)))
        by = tk.order(key)
        o = x[by]  # ids ascend within a key
        start, n, _ = _ranked(key[by], s["id"][o])
        got = n > 0
        of.append(order[o[got]]), to.append(order[o[start[got]]])
    both = np.sort(np.concatenate(of) * len(e) + np.concatenate(to))
    both = both[ex.runs(both)[0]]
    return both // max(len(e), 1), both % max(len(e), 1), held


def _referred(sent: DataFrame) -> DataFrame:
    """(batch, bucket, data): of each of the batch's pairs, in order, its references. Rows of batch NO_BATCH hold all pairs
    of a bucket's seeds of many documents."""

    def judge(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(tables)
        e, rank, around, sizes = _entries(t)
        of, to, held = references(e, rank, around)
        ref = e[["batch", "doc", "at"]]
        rare = np.minimum(np.ceil(np.log2(held) * 8), 255).astype(np.uint8)
        data, at = [], 0
        for n in sizes:
            lo, hi = np.searchsorted(of, (at, at + n))
            got = ref[to[lo:hi]]
            count = np.bincount(of[lo:hi] - at, minlength=n).astype(np.uint8)
            data.append(_pack(count, rare[at : at + n], got["batch"], got["doc"], got["at"]))
            at += n
        batches, buckets = t.column("batch").to_pylist(), t.column("bucket").to_pylist()
        many = np.flatnonzero(held > FEW)
        if len(many):
            many = e[many[np.lexsort((rank[many], e["h"][many]))]]
            batches.append(NO_BATCH), buckets.append(key[0].as_py()), data.append(_pack(*(many[f] for f in _ENTRY.names)))
        yield pa.RecordBatch.from_arrays([pa.array(batches, pa.int64()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["batch", "bucket", "data"])

    return sent.groupBy("bucket").applyInArrow(tk.released(judge), "batch long, bucket int, data binary")


def best_chains(segments: list[tuple[int, int, int, float]]) -> list[list[int]]:
    """Disjoint chains of segments (place here, place there, words, score), best first: both places ascend along a chain,
    and segments overlap by less than a seed. A gap costs COST a word on either side; chains part where one is over SKIP.

    A sweep over places here asks at each segment's start and enters it behind its end. A Fenwick tree over ends there
    holds, for a prefix of them, the best score raised by its end's place, so that the gap cost is a difference of sums.
    """
    n, slack = len(segments), SEED_WORDS - 1
    places = sorted({y + k - slack for _, y, k, _ in segments})
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(places) + 1)
    score, before = [0.0] * n, [-1] * n
    sweep = sorted([(x + k - slack, 0, i) for i, (x, _, k, _) in enumerate(segments)] + [(x, 1, i) for i, (x, *_) in enumerate(segments)])
    for _, asks, i in sweep:
        x, y, k, worth = segments[i]
        if asks:
            best = (-1e18, -1)
            p = bisect_right(places, y)
            while p:
                best = max(best, tree[p])
                p -= p & -p
            gain = best[0] - COST * (x + y)
            score[i] = worth + max(gain, 0.0)
            before[i] = best[1] if gain > 0 else -1
        else:
            value = (score[i] + COST * (x + y + 2 * k), i)
            p = bisect_right(places, y + k - slack)
            while p <= len(places):
                tree[p] = max(tree[p], value)
                p += p & -p
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            if chain:
                x, y, *_ = segments[chain[-1]]
                a, b, k, _ = segments[j]
                if x - a - k > SKIP or y - b - k > SKIP:
                    out.append(chain[::-1])
                    chain = []
            chain.append(j)
            j = before[j]
        if chain:
            out.append(chain[::-1])
    return out


def _edit(x: np.ndarray, y: np.ndarray) -> int:
    """Words alike in the best alignment of two short gaps."""
    if not len(x) or not len(y):
        return 0
    row = [0] * (len(y) + 1)
    ys = y.tolist()
    for a in x.tolist():
        last = 0
        for j, b in enumerate(ys):
            up = row[j + 1]
            row[j + 1] = last + 1 if a == b else max(up, row[j])
            last = up
    return row[-1]


def _extend(eq: np.ndarray) -> int:
    """How far an end is worth extending over words that are alike or not: the best sum of +1 and -2, without a drop of 9."""
    if not len(eq):
        return 0
    s = np.cumsum(np.where(eq, 1, -2))
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(s, 0)) - s > 9)
    s = s[: low[0]] if len(low) else s
    return int(s.argmax()) + 1 if len(s) and s.max() > 0 else 0


def _ends(before: np.ndarray, after: np.ndarray, core: int, alike: int) -> tuple[int, int]:
    """Words to extend by on either side of `core` words, so many of them alike. What is too short then for a passage is
    made LEAST_WORDS long or a few more, where that many words with enough of them alike stand there and end alike on
    either side, and goes on from there."""
    back, on = _extend(before), _extend(after)
    missing = LEAST_WORDS - core
    if back + on >= missing:
        return back, on
    most = missing + _LONGER
    sides = []
    for eq in (before[:most], after[:most]):
        ends = np.concatenate(([True], eq))
        ends[3:] &= eq[1:-1] | eq[:-2]  # two of three alike, so that a common word alone doesn't end a passage
        sides.append((np.flatnonzero(ends), np.concatenate(([0], np.cumsum(eq)))[ends]))
    (i, x), (j, y) = sides
    length, same = core + i[:, None] + j[None], alike + x[:, None] + y[None]
    part = np.where((length >= LEAST_WORDS) & (length <= LEAST_WORDS + _LONGER), same / length, 0)
    k, m = np.unravel_index(int(part.argmax()), part.shape)
    if part[k, m] < ALIKE:
        return back, on
    back, on = int(i[k]), int(j[m])
    return back + _extend(before[back:]), on + _extend(after[on:])


def align(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int, int]], lo: int, hi: int) -> tuple[int, int, int, int, float]:
    """Start and end here and there, and the part alike, of a chain of (place here, place there, words). x: all words
    here; y: words there, of which places from lo to hi are known."""
    start, other, _ = chain[0]
    alike, xe, ye = 0, start, other
    for a, b, n in chain:
        if a > xe or b > ye:
            alike += _edit(x[xe:a], y[ye:b]) if a > xe and b > ye else 0
        skip = max(xe - a, ye - b, 0)
        a, b, n = a + skip, b + skip, n - skip
        if n > 0:
            same = int((x[a : a + n] == y[b : b + n]).sum())
            # a diagonal may leave and come back between two seeds
            alike += _edit(x[a : a + n], y[b : b + n]) if same < 0.85 * n and n <= 4 * NEAR else same
            xe, ye = a + n, b + n
    room, more = min(start, other - lo), min(len(x) - xe, hi - ye)
    before, after = (x[start - room : start] == y[other - room : other])[::-1], x[xe : xe + more] == y[ye : ye + more]
    back, on = _ends(before, after, max(xe - start, ye - other), alike)
    alike += int(before[:back].sum()) + int(after[:on].sum())
    start, xe, other, ye = start - back, xe + on, other - back, ye + on
    return start, xe, other, ye, alike / max(xe - start, ye - other, 1)


Chain = tuple[int, int, int, list[tuple[int, int, int]]]  # document here, batch and document there, (here, there, words)


def chained(d, x, rb, rd, y, seeds: int = 2, reach: int = LEAST_CHAIN) -> list[Chain]:
    """Chains of matches (document and place here, batch, document and place there) that have so many seeds, and so many
    words from the first to the last."""
    out: list[Chain] = []
    order = np.lexsort((x, y - x, rd, rb, d))
    d, x, rb, rd, y = d[order], x[order], rb[order], rd[order], y[order]
    if not len(d):
        return out
    new = np.ones(len(d), bool)
    pair = new.copy()
    pair[1:] = (d[1:] != d[:-1]) | (rb[1:] != rb[:-1]) | (rd[1:] != rd[:-1])
    new[1:] = pair[1:] | ((y - x)[1:] != (y - x)[:-1]) | (x[1:] - x[:-1] > NEAR)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(d)) - 1
    length = x[tail] + SEED_WORDS - x[head]
    worth = (tail - head + 1) * WORTH
    starts = np.flatnonzero(pair[head])
    ends = np.append(starts[1:], len(head))
    far = np.maximum.reduceat((x[head] + length), starts) - np.minimum.reduceat(x[head], starts)
    may = (np.add.reduceat(tail - head + 1, starts) >= seeds) & (far >= reach)  # no chain of the others is long enough
    for s, e in zip(starts[may].tolist(), ends[may].tolist(), strict=True):
        segments = list(zip(x[head[s:e]].tolist(), y[head[s:e]].tolist(), length[s:e].tolist(), worth[s:e].tolist(), strict=True))
        i = head[s]
        for chain in best_chains(segments) if len(segments) > 1 else [[0]]:
            got = [segments[k][:3] for k in chain]
            if sum(segments[k][3] for k in chain) >= seeds * WORTH and got[-1][0] + got[-1][2] - got[0][0] >= reach:
                out.append((int(d[i]), int(rb[i]), int(rd[i]), got))
    return out


def _blocks_of(chain: list[tuple[int, int, int]]) -> range:
    lo, hi = max(0, chain[0][1] - _MORE), chain[-1][1] + chain[-1][2] + _MORE
    return range(lo // BLOCK, (hi - 1) // BLOCK + 1)


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Of n words, which are in a seed that starts at one of x."""
    d = np.bincount(x, minlength=n + 1) - np.bincount(np.minimum(x + SEED_WORDS, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def _rich(words: np.ndarray) -> np.ndarray:
    """Starts of stretches of LEAST_WORDS words that hold LEAST_SHARED of these, one of them less than a seed from either end."""
    if len(words) < LEAST_WORDS:
        return np.empty(0, np.int64)
    c = np.concatenate(([0], np.cumsum(words)))
    near = c[SEED_WORDS:] > c[:-SEED_WORDS]  # whether one of SEED_WORDS words from here on is
    n = len(words) - LEAST_WORDS + 1
    return np.flatnonzero((c[LEAST_WORDS:] - c[:-LEAST_WORDS] >= LEAST_SHARED) & near[:n] & near[LEAST_WORDS - SEED_WORDS :])


def _chains(staged: DataFrame, marks: DataFrame, refs: DataFrame) -> DataFrame:
    """(batch, want, data, open): chains to align, with their documents' words around them and the blocks that they want;
    documents with rich stretches: (id, number of words, first word kept, words kept, places, hashes, rarity and known holders
    of shared seeds there)."""

    def run(batch, ids, c, marks, refs):
        words, (at, doc, which), hashes, head, _ = _shared(c, marks)
        if not len(hashes):
            return
        first, h = words[2], words[3].astype("<u4")
        got = [np.concatenate(x) for x in zip(*map(_unpack, refs), strict=True)]
        count, rare, (rb, rd, ry) = got[0].astype(np.int64), got[1], (x.astype(np.int64) for x in got[2:])
        some = np.flatnonzero(which >= 0)
        some = some[count[which[some]] > 0]
        n = count[which[some]]
        if not len(some):
            return
        src = _ragged((np.cumsum(count) - count)[which[some]], n)
        place = at - first[doc]
        d, x, b_, d_, y = np.repeat(doc[some], n), np.repeat(place[some], n), rb[src], rd[src], ry[src]
        # a seed that a document repeats may be repeated there at the same distances
        far = x - np.repeat(place[head[which[some]]], n)
        again = np.flatnonzero((far > 0) & (far <= _FAR))
        chains = chained(*(np.concatenate(v) for v in ((d, d[again]), (x, x[again]), (b_, b_[again]), (d_, d_[again]), (y, (y + far)[again]))))
        span: dict[int, tuple[int, int]] = {}
        for d, _, _, chain in chains:
            lo, hi = span.get(d, (1 << 60, 0))
            span[d] = min(lo, chain[0][0]), max(hi, chain[-1][0] + chain[-1][2])
        here = {}
        for d, (lo, hi) in span.items():
            lo, hi = max(0, lo - _BEYOND), min(int(first[d + 1] - first[d]), hi + _BEYOND)
            here[d] = lo, h[first[d] + lo : first[d] + hi]
        some = some[at[some] == at[head[which[some]]]]
        whole = _spread(at[some], len(h))
        rich = _rich(whole)
        of = np.searchsorted(first, rich, "right") - 1
        left = {}
        cut = np.searchsorted(doc[some], np.arange(len(ids) + 1))
        fits = rich + LEAST_WORDS <= first[of + 1]
        rich, of = rich[fits], of[fits]
        ends, before = np.searchsorted(of, np.arange(len(ids) + 1)), np.cumsum(count) - count
        for d in np.unique(of).tolist():
            s = some[cut[d] : cut[d + 1]]
            mine = rich[ends[d] : ends[d + 1]]
            # seeds with a word in one of these stretches, and the words that their chains are aligned with
            s = s[np.searchsorted(mine, at[s] + SEED_WORDS) > np.searchsorted(mine, at[s] - LEAST_WORDS, "right")]
            q = which[s]
            n = np.where(rare[q] <= _RARE, count[q], 0)
            src = _ragged(before[q], n)
            lo, hi = max(0, int(place[s[0]]) - _BEYOND), min(int(first[d + 1] - first[d]), int(place[s[-1]]) + SEED_WORDS + _BEYOND)
            hash_ = np.where(rare[q] <= _RARE, tk.U(0), hashes[q])  # seeds of few documents are not asked for by it
            left[d] = int(ids[d]), int(first[d + 1] - first[d]), lo, _pack(h[first[d] + lo : first[d] + hi], place[s], hash_, rare[q], n, rb[src], rd[src], ry[src])
        want = sorted({(rb, rd, k) for _, rb, rd, chain in chains for k in _blocks_of(chain)})
        if want or left:
            yield _wanting(batch, want, (chains, here, ids), left)

    return staging.over(staged, [marks, refs], run, _WANTING)


_WANTING = "batch long, want array<struct<ref:long,doc:long,block:long>>, data binary, open binary"


def _wanting(batch: int, want: list, data, left) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("ref", pa.int64()), ("doc", pa.int64()), ("block", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([[dict(zip(("ref", "doc", "block"), w, strict=True)) for w in want]], kind), pa.array([_dump(data)], pa.binary()), pa.array([_dump(left) if left else None], pa.binary())], names=["batch", "want", "data", "open"])


def _passages(chains: list[Chain], here: dict, blocks: dict) -> dict[int, list[tuple]]:
    """Of each document, its passages (start, end, other id, start and end there, part alike), none within another."""
    out: dict[int, list[tuple]] = {}
    for d, rb, rd, chain in chains:
        need = _blocks_of(chain)
        have = [p for p in (blocks.get((rb, rd, k)) for k in need) if p is not None]
        if not have or (rb, rd, need.start) not in blocks:
            continue
        lo, ri = need.start * BLOCK, have[0][0]
        y = np.concatenate((np.zeros(lo, "<u4"), *(p[1] for p in have)))
        start, x = here[d]
        # what a repeat was taken for may lie beyond the other document's end
        todo = [[(a - start, b, min(n, len(y) - b)) for a, b, n in chain if b < len(y)]]
        todo = [part for part in todo if part]
        while todo:
            part = todo.pop()
            a, b, oa, ob, alike = align(x, y, part, lo, len(y))
            if b - a >= LEAST_WORDS and alike >= ALIKE:
                out.setdefault(d, []).append((a + start, b + start, ri, oa, ob, alike))
            elif b - a >= LEAST_WORDS and len(part) > 1:  # its parts on either side of the widest gap may be alike
                gap = [max(q[0] - p[0] - p[2], q[1] - p[1] - p[2]) for p, q in zip(part, part[1:], strict=False)]
                at = gap.index(max(gap)) + 1
                todo += [part[:at], part[at:]]
    for d, found in out.items():
        found.sort(key=lambda p: (p[0], -p[1], p[2]))
        far, keep = -1, []
        for p in found:
            if p[1] > far:
                keep.append(p)
                far = p[1]
        out[d] = keep
    return out


_FOUND = "batch long, doc long, doc_id long, first long, end long, other_id long, other_first long, other_end long, similarity double"


def _aligned(staged: DataFrame, wanting: DataFrame) -> DataFrame:
    """Passages (_FOUND) of chains (_WANTING)."""

    def tell(batch, ids, c, wanted):
        keys, data = [], []
        of: dict[int, list[int]] = {}
        for w in wanted:
            of.setdefault(w["doc"], []).append(w["block"])
        docs = sorted(of)
        start, end = c.start[docs], c.end[docs]
        ends = np.cumsum(end - start + 1) - 1
        buf = np.frombuffer(b"\n".join(c.buf[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint8)
        _, _, first, h = _words(tk.Chunk(range(len(docs)), buf, ends - (end - start), ends))
        h = h.astype("<u4")
        for i, d in enumerate(docs):
            for k in sorted(of[d]):
                part = h[first[i] + k * BLOCK : min(first[i] + (k + 1) * BLOCK, first[i + 1])]
                if len(part):
                    keys.append((batch, d, k, int(ids[d]))), data.append(part.tobytes())
        if keys:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*keys, strict=True)), pa.array(data, pa.binary())], names=["ref", "doc", "block", "id", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                chains, here, ids = _load(r["data"])
                blocks = {(x["ref"], x["doc"], x["block"]): (x["id"], np.frombuffer(x["words"], "<u4")) for x in r["back"]}
                rows = [(r["batch"], d, int(ids[d]), *p) for d, ps in _passages(chains, here, blocks).items() for p in ps]
                if rows:
                    kinds = [pa.int64()] * 8 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    each = wanting.select(F.col("batch").alias("asker"), F.explode("want").alias("w")).select("asker", "w.*")
    asked = each.select("ref", "doc", "block").distinct().select(F.col("ref").alias("batch"), F.lit(0).alias("bucket"), F.struct("doc", "block").alias("data"))
    told = staging.over(staged, [asked], tell, "ref long, doc long, block long, id long, words binary")
    back = each.join(told, ["ref", "doc", "block"]).groupBy("asker").agg(F.collect_list(F.struct("ref", "doc", "block", "id", "words")).alias("back"))
    return wanting.where(F.size("want") > 0).select("batch", "data").join(back, F.col("batch") == F.col("asker")).select("batch", "data", "back").mapInArrow(tk.released(run), _FOUND)


def _still_open(n: int, x: np.ndarray, rare: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Seeds (numbers in x) of n words to ask for: in each rich stretch the rarest, until a document with LEAST_SHARED of the stretch's
    words must hold LEAST_ASKED of the asked ones."""
    keep = np.flatnonzero(~np.logical_or.reduce([gone[np.minimum(x + k, n - 1)] for k in range(SEED_WORDS)])) if len(x) else np.empty(0, np.int64)
    keep = keep[np.argsort(x[keep], kind="stable")]
    xs = x[keep]
    shared = _spread(xs, n)
    asked, out = np.zeros(n, bool), set()
    for s in _rich(shared).tolist():
        most = int(shared[s : s + LEAST_WORDS].sum()) - LEAST_SHARED + LEAST_ASKED
        if int(asked[s : s + LEAST_WORDS].sum()) >= most:
            continue
        lo, hi = np.searchsorted(xs, (max(0, s - SEED_WORDS + 1), s + LEAST_WORDS))
        for i in (lo + np.argsort(rare[keep[lo:hi]], kind="stable")).tolist():
            if int(asked[s : s + LEAST_WORDS].sum()) >= most:
                break
            asked[xs[i] : xs[i] + SEED_WORDS] = True
            out.add(int(keep[i]))
    return np.array(sorted(out), np.int64)


def _asks(wanting: DataFrame, found: DataFrame, nb: int) -> DataFrame:
    """(batch, bucket, data): seeds of stretches that are still open; in bucket -1, the known holders of rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                spans: dict[int, list] = {}
                for s in r["spans"] or []:
                    spans.setdefault(s["doc"], []).append((s["first"], s["end"]))
                rows, known = [], []
                for d, (id_, length, _, packed) in _load(r["open"]).items():
                    _, x, h, rare, n, rb, rd, ry = _unpack(packed)
                    gone = np.zeros(length, bool)
                    for p, q in spans.get(d, []):
                        gone[p:q] = True
                    k = _still_open(length, x, rare, gone)
                    some = k[n[k] > 0]
                    if len(some):
                        src = _ragged((np.cumsum(n) - n)[some], n[some])
                        known.append((np.full(len(src), d), np.repeat(x[some], n[some]), rb[src], rd[src], ry[src]))
                    k = k[rare[k] > _RARE]
                    if len(k):
                        rows.append((np.full(len(k), d), np.full(len(k), id_), x[k], h[k]))
                if known:
                    yield _packed(r["batch"], np.array([-1]), data=[_dump([np.concatenate(v) for v in zip(*known, strict=True)])])
                if rows:
                    d, id_, x, h = (np.concatenate(v) for v in zip(*rows, strict=True))
                    o = np.argsort(h, kind="stable")
                    where, cut = _slices(h[o], nb)
                    yield _packed(r["batch"], where, data=[_dump((d[o[i:j]], id_[o[i:j]], x[o[i:j]], h[o[i:j]] & tk.U(0xFFFFFFFFFF))) for i, j in cut])

    spans = found.groupBy("batch").agg(F.collect_list(F.struct("doc", "first", "end")).alias("spans")).withColumnRenamed("batch", "of")
    return wanting.where("open IS NOT NULL").select("batch", "open").join(spans, F.col("batch") == F.col("of"), "left").select("batch", "open", "spans").mapInArrow(tk.released(run), "batch long, bucket int, data binary")


def _holders(asks: DataFrame, index: DataFrame, open_: DataFrame) -> DataFrame:
    """Chains (_WANTING) of holders with smaller ids that hold LEAST_ASKED words of a document's asked seeds."""
    TURN = 1 << 20

    def judge(asked: pa.Table, index: pa.Table) -> pa.Table:
        batch, data = [], []
        if asked.num_rows and index.num_rows:
            cols = _unpack(index.column("data")[0].as_py())
            e = np.empty(len(cols[0]), _ENTRY)
            for f, x in zip(_ENTRY.names, cols, strict=True):
                e[f] = x
            for b, x in zip(asked.column("batch").to_pylist(), asked.column("data").to_pylist(), strict=True):
                d, id_, place, h = _load(x)
                lo = np.searchsorted(e["h"], h)
                size = np.searchsorted(e["h"], h, "right") - lo
                less, step = np.zeros(len(h), np.int64), 1 << int(size.max(initial=0)).bit_length()
                while step:  # holders of smaller ids, by bisection
                    to = less + step
                    ok = to <= size
                    ok[ok] = e["id"][lo[ok] + to[ok] - 1] < id_[ok]
                    less = np.where(ok, to, less)
                    step >>= 1
                at = 0
                while at < len(h):  # a row has about TURN holders
                    end = max(at + 1, int(np.searchsorted(np.cumsum(less), (np.cumsum(less)[at] - less[at]) + TURN, "right")))
                    n = less[at:end]
                    got = e[_ragged(lo[at:end], n)]
                    if len(got):
                        batch.append(b)
                        data.append(_dump((np.repeat(d[at:end], n), np.repeat(place[at:end], n), got["batch"].copy(), got["doc"].astype(np.int64), got["at"].astype(np.int64))))
                    at = end
        return pa.table({"batch": pa.array(batch, pa.int64()), "data": pa.array(data, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d, x, rb, rd, y = (np.concatenate(v) for v in zip(*map(_load, r["got"]), strict=True))
                o = np.lexsort((x, rd, rb, d))
                d, x, rb, rd, y = d[o], x[o], rb[o], rd[o], y[o]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (rb[1:] != rb[:-1]) | (rd[1:] != rd[:-1])
                fresh = np.where(new, SEED_WORDS, np.minimum(np.diff(x, prepend=0), SEED_WORDS))
                enough = np.repeat(np.add.reduceat(fresh, np.flatnonzero(new)) >= LEAST_ASKED, np.diff(np.append(np.flatnonzero(new), len(d))))
                chains = chained(*(v[enough] for v in (d, x, rb, rd, y)), seeds=1, reach=SEED_WORDS)
                left = _load(r["open"])
                here = {d: (left[d][2], _unpack(left[d][3])[0]) for d in {d for d, *_ in chains}}
                ids = {d: left[d][0] for d in here}
                want = sorted({(rb, rd, k) for _, rb, rd, chain in chains for k in _blocks_of(chain)})
                yield _wanting(r["batch"], want, (chains, here, ids), None)

    some = index.join(asks.select("bucket").distinct(), "bucket", "left_semi")
    got = asks.where("bucket >= 0").groupBy("bucket").cogroup(some.groupBy("bucket")).applyInArrow(judge, "batch long, data binary")
    got = got.unionByName(asks.where("bucket < 0").select("batch", "data")).groupBy("batch").agg(F.collect_list("data").alias("got")).withColumnRenamed("batch", "of")
    return open_.join(got, F.col("batch") == F.col("of")).select("batch", "open", "got").mapInArrow(tk.released(run), _WANTING)


def _found(docs: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The staged batches, and all passages of their documents."""
    staged = staging.stage(docs, whole=whole)
    slim = staged.drop("rest")
    nb = staging.buckets(staged, BUCKET_BYTES)
    spark = docs.sparkSession
    marks = materialise(_marked(slim, nb), "marks")
    settled(spark)
    refs = materialise(_referred(_sent(slim, marks, nb)), "references")
    settled(spark)
    wanting = materialise(_chains(slim, marks, refs.where(F.col("batch") != NO_BATCH)), "chains")
    settled(spark, marks)
    found = materialise(_aligned(slim, wanting), "passages")
    settled(spark)
    asks = materialise(_asks(wanting, found, nb), "asks")
    if not asks.isEmpty():
        more = materialise(_holders(asks, refs.where(F.col("batch") == NO_BATCH), wanting.where("open IS NOT NULL").select("batch", "open")), "holders")
        settled(spark, asks)
        found = found.unionByName(materialise(_aligned(slim, more), "more-passages"))
    return staged, found


def passages(docs: DataFrame) -> DataFrame:
    """A row for each passage that an earlier document has: doc_id, first_word, last_word (words from 0), other_id,
    other_first, other_last, similarity. Documents without one have no row."""
    _, found = _found(docs)
    id_ = F.when(F.col("doc_id") != staging.NO_ID, F.col("doc_id"))
    return found.select(id_.alias("doc_id"), F.col("first").alias("first_word"), (F.col("end") - 1).alias("last_word"), "other_id", F.col("other_first"), (F.col("other_end") - 1).alias("other_last"), "similarity")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs, all columns, with passages that an earlier document has cut out of text (n_chars follows, where there is
    one); a document of which no word is left goes. Texts without a passage, null ones too, stay as they are."""
    names, kind = docs.columns, docs.schema
    staged, found = _found(docs, whole=True)

    def cut(batch, ids, c, spans, rest):
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)) as r:
            t = r.read_all()
        mine: dict[int, list] = {}
        for s in spans:
            mine.setdefault(s["doc"], []).append((s["first"], s["end"]))
        null = t.column(t.num_columns - 1).to_pylist()  # stands last; its name may be one of the columns too
        texts, keep = [], []
        for d in range(len(ids)):
            a, b = int(c.start[d]), int(c.end[d])
            if d not in mine:
                texts.append(None if null[d] else c.buf[a:b].tobytes().decode()), keep.append(True)
                continue
            ws, we, _ = tk.Chunk(range(1), c.buf[a:b], np.zeros(1, np.int64), np.array([b - a])).words(tk.SPACED)
            gone = np.zeros(len(ws), bool)
            for x, y in mine[d]:
                gone[x:y] = True
            parts, at = [], a
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
            for x, y in edge.tolist():
                parts.append(c.buf[at : a + ws[x]].tobytes())
                at = a + int(ws[y]) if y < len(ws) else b
            parts.append(c.buf[at:b].tobytes())
            texts.append(b"".join(parts).decode()), keep.append(not gone.all())
        t = t.remove_column(t.num_columns - 1)
        t = t.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in names:
            t = t.set_column(names.index("n_chars"), "n_chars", pa.array([len(x or "") for x in texts], pa.int64()).cast(t.schema.field("n_chars").type))
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    spans = found.select("batch", F.lit(0).alias("bucket"), F.struct("doc", "first", "end").alias("data"))
    return staging.over(staged, [spans], cut, kind)
