"""Operator 6: byte-level BPE encoding and decoding with the ranks of a tokenizer file.

Encoding goes from left to right by longest entries first. The longest one at a byte is found by slices from there on,
until one begins no entry; each entry knows the next shorter one that it begins with. An entry may follow another only if the pair is
what the merges make of the two entries' bytes together; that test is memoised. A sequence whose neighbours all pass is
exactly the merges' result, and a position that failed once is never entered again, so the time is linear in the piece.

Edge cases: null or empty text has no tokens (digests of nothing). Whole texts are encoded, however long. The vocabulary
must hold all 256 single bytes. An empty table has an empty result, repeated rows a result each; other columns are not
looked at. A piece that is an entry itself is that entry, whether or not merges reach it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stormgrid.llm import textkit as tk
from stormgrid.llm.shared import project

#: White space as the merges' pattern takes it (Unicode White_Space), spelt out since libraries differ over it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Texts of these characters only are split by the standard library, which is faster; its letters and numbers follow.
PLAIN = re.compile(r"[\t-\r -~\xa0-ɏ‐-‧]*")
LETTER, NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Pieces, and pairs of entries, remembered by one Python worker; characters encoded before a batch of rows goes on.
REMEMBERED, PAIRS, TURN = 200_000, 600_000, 1 << 20


def _split(letter: str, number: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


_PLAIN_SPLIT = re.compile(_split(LETTER, NUMBER))
_ANY_SPLIT = regex.compile(_split(r"\p{L}", r"\p{N}"))


def plain_pieces(text: str) -> Iterator[str]:
    """Of a text that PLAIN matches, one after another."""
    return (m.group() for m in _PLAIN_SPLIT.finditer(text))


def pieces(text: str) -> list[str]:
    return (_PLAIN_SPLIT if PLAIN.fullmatch(text) else _ANY_SPLIT).findall(text)


class Bpe(dict):
    """As a dict: a piece's ids as decimal text, found when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.entry = {v: k for k, v in ranks.items()}
        self.length = array("i", bytes(4 * (max(ranks.values()) + 1)))
        for k, v in ranks.items():
            self.length[v] = len(k)
        self.by_text = {str(v): k for k, v in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.reached: dict[int, bool] = {}
        #: Of each entry's prefixes, the longest entry that it begins with; of each entry, the next shorter one (-1: none).
        self.prefixes: dict[bytes, int] = {}
        self.shorter = array("i", [-1]) * len(self.length)
        for k in sorted(ranks, key=len):
            before = -1
            for n in range(1, len(k)):
                before = self.prefixes.setdefault(k[:n], before)
            self.shorter[ranks[k]] = before
            self.prefixes[k] = ranks[k]

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank first; only for the pairs and entries that are tested."""
        parts, get, none = [data[i : i + 1] for i in range(len(data))], self.ranks.get, 1 << 40
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (rank := min(ranks)) != none:
            i = ranks.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave entries a and b, side by side, as they are."""
        if (ok := self.pairs.get(a << 32 | b)) is None:
            ok = self.pairs[a << 32 | b] = self._apart(self.entry[a], self.entry[b])
        return ok

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether no merge of a + b goes over their border. Both are reachable, so the rest then makes a and b of them."""
        data, get, none = a + b, self.ranks.get, 1 << 40
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        border = len(a) - 1  # the rank of the pair that the border parts
        while (rank := min(ranks)) != none:
            i = ranks.index(rank)
            if i == border:
                return False
            border -= i < border
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return True

    def reachable(self, a: int) -> bool:
        if (ok := self.reached.get(a)) is None:
            ok = self.reached[a] = self.merged(self.entry[a]) == [a]
        return ok

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        size, prefixes, length, shorter, reached, pairs = len(data), self.prefixes, self.length, self.shorter, self.reached, self.pairs
        closed = bytearray(size + 1)
        out: list[int] = []
        at, last, t = 0, -1, -1
        while at < size:
            if t < 0:  # come to anew: the longest entry here
                t, to = prefixes[data[at : at + 1]], at + 2
                while to <= size and (x := prefixes.get(data[at:to])) is not None:
                    t = x
                    to += 1
            while t >= 0:
                to = at + length[t]
                if not closed[to] and ((ok := reached.get(t)) or ok is None and self.reachable(t)):
                    if last < 0 or (ok := pairs.get(last << 32 | t)) or ok is None and self.follows(last, t):
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at, last, t = to, t, -1
            else:  # no way on from here
                closed[at] = 1
                at -= length[last]
                t = shorter[out.pop()]
                last = out[-1] if out else -1
                while t < 0:  # nor from the byte before
                    closed[at] = 1
                    at -= length[last]
                    t = shorter[out.pop()]
                    last = out[-1] if out else -1
        return out

    def __missing__(self, piece: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        got = ",".join(map(str, self.encode_piece(piece.encode())))
        if len(piece) <= 64:
            self[piece] = got
        return got

    def encode_text(self, text: str) -> str:
        """Ids as decimal text joined by commas."""
        return ",".join(map(self.__getitem__, pieces(text)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text).split(",")] if text else []

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(","))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """Once in a Python process; path is a rank file that every machine has with the tokenizer library."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Bpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoded(docs: DataFrame, path: str | None = None, ids: bool = False, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids as array<int>. No shuffle. keep: whether a
    Python worker holds its tables after a task, for the next one; where other work follows, they are in its way."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                start, left = at, TURN
                n, e, d, all_ids = [], [], [], []
                while at < len(texts) and left > 0:
                    text = texts[at] or ""
                    s = bpe.encode_text(text)
                    n.append(s.count(",") + 1 if s else 0)
                    e.append(hashlib.sha256(s.encode()).hexdigest())
                    d.append(hashlib.sha256(bpe.decode_text(s)).hexdigest())
                    if ids:
                        all_ids.append(np.fromstring(s, np.int32, sep=",") if s else np.empty(0, np.int32))
                    at, left = at + 1, left - len(text) - 1
                cols = [b.column(0).slice(start, at - start), pa.array(n, pa.int64()), pa.array(e, pa.string()), pa.array(d, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(all_ids))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    def forgotten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _loaded.pop(path, None)

    docs = project(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tk.released(run if keep else forgotten), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
