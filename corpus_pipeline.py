"""A corpus from documents to tokens: quality rules, near copies, repeated passages, source weights, encoding.

Every stage takes whole documents, null and empty texts, repeated rows, empty tables and further columns; a null text has
no words. A stage's result must be written before the next stage is called: that deletes what the stage left half-way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stormgrid.llm import bpe, chain_dedup, jaccard_rtree, mix_wfq, quality_sa
from stormgrid.llm.shared import materialise, owned


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those without words among them. Repeated rows are judged each for itself."""
    with owned(docs, "pipeline"):
        return quality_sa.filtered(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (word 5-grams, Jaccard 0.8), of rows equal in id and text one.
    Texts without words, and rows without an id, stay."""
    with owned(docs, "pipeline"):
        return jaccard_rtree.representatives(docs, ngram=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out of the text; a document of which no word is left goes.
    Null and empty texts stay as they are."""
    with owned(docs, "pipeline"):
        return chain_dedup.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated, or left out, as its source's weight asks for. A null source is one of its own; a document
    without words stays once."""
    with owned(docs, "pipeline"):
        return mix_wfq.drawn(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, digests, number of tokens and the tokens of each document; a null text has none. Repeated rows have a
    result each."""
    with owned(docs, "pipeline"):
        return bpe.encoded(docs, ids=True, keep=False)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
#: No SQL for suffix arrays, chaining or merges: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{i}")
    return docs
