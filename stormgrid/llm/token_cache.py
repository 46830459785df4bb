"""Operator 12: token counts from a cache of digests.

A text's digest and the tokenizer's version digest are the key of its stored count. Documents are looked up by it, each
distinct text that the cache lacks is encoded once, its count is appended, and all documents take their counts by join.
Only digests are kept of a document; texts are shuffled only where some of them are missing, after copies within a task
have been joined up, and not at all where the missing digests are few enough to be broadcast.

The cache is a folder `version=<digest>/run=<id>/*.parquet` of (digest, n_tokens). Each call appends a folder of its own,
so that calls don't disturb one another; a digest that two of them stored is one when read. The version holds the
tokenizer's file, the library and its version, so a change of any of them finds nothing stored.

Edge cases: a null text is an empty one, of 0 tokens. Texts count whole, however long; special strings inside are what the
library takes them for. An empty table has an empty result and stores nothing. Repeated rows have a result each, ids may
be missing, and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version as installed
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm import bpe
from stormgrid.llm.shared import materialise, project

#: Characters handed to a tokenizer at a time; pieces taken from a long text at a time; pieces remembered by one worker.
TURN, PIECES, REMEMBERED = 1 << 20, 200_000, 400_000
#: Missing digests (32 bytes each) up to which they are broadcast.
FEW = 100_000
STORED = "digest binary, n_tokens long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def version(path: str) -> str:
    """Digest of all that a count depends on beside the text."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {installed(library)} ".encode() + f.read()).hexdigest()


class _Pieces(dict):
    """Counts by pieces, for a byte-level tokenizer without a normaliser that splits as bpe.pieces does: on plain texts
    that hold none of its added strings. Their pieces are few beside their words. Other texts go to the library whole."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def one(self, text: str) -> int:
        if not bpe.PLAIN.fullmatch(text) or any(a in text for a in self.added):
            return self.whole([text])[0]
        total, left = 0, bpe.plain_pieces(text)
        while part := list(islice(left, PIECES)):
            if len(self) > REMEMBERED:
                self.clear()
            missing = [p for p in set(part) if p not in self]
            self.update(zip(missing, self.whole(missing), strict=True))
            total += sum(map(self.__getitem__, part))
        return total

    def counts(self, texts: list[str]) -> list[int]:
        return [self.one(t) for t in texts]


_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Texts to numbers of tokens; loaded once in a Python process, from a file that every machine has with its library."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            import json

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            with open(path, encoding="utf-8") as f:
                form = json.load(f)
            split = form.get("pre_tokenizer") or {}
            plain = form.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
            strict = not any(a[k] for a in form.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
            by_piece = _Pieces(t)
            _loaded[path] = by_piece.counts if plain and strict else by_piece.whole
    return _loaded[path]


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            at, got = 0, []
            column = b.column(1)
            while at < b.num_rows:
                some, size = [], 0
                while at < b.num_rows and (not some or size < TURN):
                    some.append(column[at].as_py())
                    size += len(some[-1])
                    at += 1
                got += count(some)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, STORED)


def stored(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """(digest, n_tokens) that the cache has for a version, each digest once."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={of}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(at.toString()).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append(counts: DataFrame, cache: str, of: str) -> None:
    counts.write.option("compression", "zstd").parquet(f"{cache}/version={of}/run={uuid.uuid4().hex}")


def counted(docs: DataFrame, cache: str, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of every row. cache: a folder that driver and
    executors share; what it lacks is encoded and appended before this returns."""
    spark, path = docs.sparkSession, path or default_path()
    of = version(path)
    text = F.coalesce("text", F.lit(""))
    keyed = project(docs, "doc_id", "text").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    slim = materialise(keyed.drop("text"), "token-digests")
    asked = slim.select("digest").distinct()
    looked = materialise(asked.join(stored(spark, cache, of), "digest", "left"), "token-lookup")
    counts, misses = looked.where("n_tokens IS NOT NULL"), looked.where("n_tokens IS NULL").select("digest")
    if missing := misses.count():
        texts = keyed.select("digest", "text")
        if missing <= FEW:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:  # inner, as a semi join would be moved below the removal of copies, and copies would travel
            texts = texts.dropDuplicates(["digest"]).join(misses, "digest")
        fresh = materialise(_encoded(texts, path), "token-counts")
        append(fresh, cache, of)
        counts = counts.unionByName(fresh)
    counts = materialise(counts, "token-known")
    return slim.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
