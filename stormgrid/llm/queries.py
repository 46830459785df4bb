"""The numbered queries of this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stormgrid.llm import (
    ann_hilbert,
    bpe,
    chain_dedup,
    conversation_repair,
    filter_audit,
    html_crf,
    jaccard_rtree,
    langid_ecoc,
    license_sam,
    mix_wfq,
    quality_sa,
    suffix_dedup,
    token_cache,
)
from stormgrid.llm.shared import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_hilbert.op1(_table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(_table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_sam.scanned(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_table(spark, sf_dir, "documents")).drop("spans")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.components(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_sa.judged(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid_ecoc.predicted(docs, langid_ecoc.train(docs))


def op9_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.passages(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_wfq.op10(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.op11(_table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first, so that what it costs is what encoding costs."""
    return token_cache.counted(_table(spark, sf_dir, "documents"), scratch(spark, "token-cache"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours,
        op2_html_extraction,
        op3_license_scan,
        op4_suffix_dedup,
        op5_jaccard_join,
        op6_byte_bpe,
        op7_quality_rules,
        op8_language_id,
        op9_fuzzy_passages,
        op10_mix_sources,
        op11_conversation_repair,
        op12_token_counts,
        op13_filter_audit,
    )
}
ORACLES: dict[str, str] = {
    "op10_mix_sources": mix_wfq.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
