"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import class_lm, decontaminate, filter_audit, html_text, jaccard_join, language_id, mixing, oracles, quality_cnn, token_rollup, url_filter, vector_graph, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicate_vectors(_table(spark, sf_dir, "embeddings")).drop("audited_links")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.rollup_documents(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_cnn.score_quality(docs, quality_cnn.train(docs, _table(spark, sf_dir, "labels")))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(_table(spark, sf_dir, "embeddings")).drop("deviation_exact")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_ngram_jaccard_join,
        op3_benchmark_decontamination,
        op4_html_extraction,
        op5_url_filters,
        op6_warc,
        op7_language_id,
        op8_mixing_sources,
        op9_token_counts,
        op10_quality_classifier,
        op11_filter_interaction_audit,
        op12_embedding_whitening,
        op13_lm_scoring,
    )
}
ORACLES = {
    "op1_embedding_near_dedup": oracles.VECTORS,
    "op2_ngram_jaccard_join": oracles.JACCARD,
    "op3_benchmark_decontamination": oracles.CONTAMINATION,
    "op6_warc": warc.ORACLE,
    "op8_mixing_sources": mixing.ORACLE,
    "op11_filter_interaction_audit": filter_audit.ORACLE,
}
