"""Operator 7: quality rules with repetition taken from a suffix array.

The words of many documents together are sorted by suffix (prefix doubling over word ranks, groups that are already
single left alone, documents kept apart). Common prefixes of neighbours follow from the ranks of each doubling. A
suffix's longest common prefix with a neighbour is the depth of the deepest common-prefix interval that holds it, so
the union of those spans is the union of all occurrences of all maximal repeats.

Verdict of the method: a document goes if repeats of MIN_REPEAT words or more cover more than MAX_COVERED of its words,
or if its longest repeat is longer than MAX_LONGEST of its words and than LONG_REPEAT words. Both see what the base rule
cannot: MIN_REPEAT is shorter than its window (repeats of a whole window cover n_repeat_words exactly, of which it lets
pass at most 30 %), and a longest repeat of MAX_LONGEST can stand twice within those 30 %.

Edge cases: null or empty text: no words, base_failed. Windows, lines and repeats never cross documents. Repeated rows
are judged each for itself. Whole texts are read, however long. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stormgrid.llm import textkit as tk
from stormgrid.llm.shared import project

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
MIN_REPEAT, MAX_COVERED, LONG_REPEAT, MAX_LONGEST = 4, 0.5, 60, 0.1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def suffix_array(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of words h (documents begin at first), and of each place in it the common prefix with the one before."""
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][doc] - np.arange(n)  # words to the document's end
    key = h + tk.mix(doc.astype(np.uint64))
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    fresh = np.concatenate(([True], k[1:] != k[:-1])) if n else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    ranks, step = [rank.copy()], 1
    slots = np.flatnonzero(~fresh | np.append(~fresh[1:], False)) if n else np.empty(0, np.int64)
    while len(slots):
        a = sa[slots]
        there = np.minimum(a + step, n - 1)
        nxt = np.where(left[a] > step, rank[there] + 1, 0)
        both = rank[a] * (n + 1) + nxt
        order = np.argsort(both, kind="stable")
        a, both = a[order], both[order]
        sa[slots] = a
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        rank[a] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))]
        ranks.append(rank.copy())
        slots = slots[~fresh | np.append(~fresh[1:], False)]
        step *= 2
    lcp = np.zeros(n, np.int64)
    r0 = ranks[0][sa]
    j = np.flatnonzero(r0[1:] == r0[:-1]) + 1
    p, q, l = sa[j - 1], sa[j], np.zeros(len(j), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        ok = (left[p] - l > 0) & (left[q] - l > 0)
        same = ok & (r[np.minimum(p + l, n - 1)] == r[np.minimum(q + l, n - 1)])
        # equal ranks of a level mean 2**level equal words, or suffixes equal to their ends, which cannot be twice in a document
        l += np.where(same, 1 << level, 0)
    lcp[j] = l
    return sa, lcp


def depths(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each word, the depth of the deepest common-prefix interval that holds its suffix."""
    out = np.zeros(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + length, -1)
    return np.cumsum(d[:-1]) > 0


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, h: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """(length, starts) of every maximal repeat of at least `least` words: intervals of a stack scan whose suffixes
    have different words before them."""
    out, stack = [], []  # (depth, left edge)
    for j in range(1, len(sa) + 1):
        depth, left = (int(lcp[j]) if j < len(sa) else 0), j - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            starts = sa[left:j]
            if d >= least and (starts.min() == 0 or len(np.unique(h[starts - 1])) > 1):
                out.append((d, sorted(starts.tolist())))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return out


def _sums(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return c[end] - c[start]


def measure(c: tk.Chunk) -> dict[str, np.ndarray]:
    ws, we, first = c.words(tk.SPACED)
    lo, hi = first[:-1], first[1:]
    n_words = hi - lo
    sums = tk.prefix_hash(c.buf)
    h = tk.span_hash(sums, ws, we)
    inside = tk.SPACED[c.buf]
    chars = _sums(inside & ((c.buf & 0xC0) != 0x80), c.start, c.end)
    symbols = _sums(_SYMBOL[c.buf], c.start, c.end)
    sa, lcp = suffix_array(h, first)
    depth = depths(sa, lcp)
    at = np.flatnonzero(depth >= WINDOW)
    repeat = _sums(covered(at, np.full(len(at), WINDOW), len(h)), lo, hi)
    at = np.flatnonzero(depth >= MIN_REPEAT)
    cover = _sums(covered(at, depth[at], len(h)), lo, hi)
    longest = np.zeros(len(lo), np.int64)
    full = np.flatnonzero(n_words)
    if len(full):
        longest[full] = np.maximum.reduceat(depth, lo[full])
    # lines: the joining newline ends a document's last one
    cut = np.flatnonzero(c.buf == 10)
    ls = np.concatenate(([0], cut + 1))
    le = np.append(cut, len(c.buf))
    has = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    ls, le = ls[has], le[has]
    doc = np.searchsorted(c.start, ls, "right") - 1
    key = tk.span_hash(sums, ls, le) + tk.mix(doc.astype(np.uint64))
    one = np.unique(key, return_index=True)[1]
    lines = np.bincount(doc, minlength=len(lo)) - np.bincount(doc[one], minlength=len(lo))
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    bad = (cover > MAX_COVERED * n_words) | ((longest > LONG_REPEAT) & (longest > MAX_LONGEST * n_words))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat,
            "base_failed": failed, "kept": ~failed & ~bad, "covered_words": cover, "longest_repeat": longest}


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def judged(docs: DataFrame) -> DataFrame:
    """doc_id and FIELDS, one row a document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(1)):
                m = measure(c)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.rows.start, len(c.rows)), *map(pa.array, m.values())], names=["doc_id", *m])

    docs = project(docs, "doc_id", "text")
    return docs.mapInArrow(tk.released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; whole batches pass through the same measure."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(at)):
                yield b.slice(c.rows.start, len(c.rows)).filter(pa.array(measure(c)["kept"]))

    return docs.mapInArrow(tk.released(run), docs.schema)
