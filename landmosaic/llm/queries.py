"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from landmosaic.llm import decontamination, hash_forest, html_extract, mixing, near_dedup, piece_lattice, pivot_search, quality, quotations, suffix_dedup, term_stages, token_counts, whitening

#: Limit of the token-count query.
MAX_TOKENS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(quotations.quoting_messages(table(spark, sf_dir, "conversations")), "conv_id", "turn", "body")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), MAX_TOKENS)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_lattice.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.neighbours(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op12_term_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_stages.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_html_extraction, op3_pivot_search, op4_quality_classifier, op5_quotation_linking, op6_token_counts, op7_source_mixing, op8_near_dedup, op9_piece_lattice, op10_hash_forest, op11_whitening, op12_term_stages, op13_decontamination, pipeline)}
ORACLES: dict[str, str] = {"op5_quotation_linking": quotations.ORACLE, "op3_pivot_search": pivot_search.ORACLE, "op7_source_mixing": mixing.ORACLE, "op8_near_dedup": near_dedup.ORACLE, "op12_term_stages": term_stages.ORACLE, "op13_decontamination": decontamination.ORACLE}
