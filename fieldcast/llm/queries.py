"""Thin registered queries over the operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldcast.llm import binary_tokens, decontam, jaccard_join, langid, packing, periodic_runs, quality_rules, secret_ledger, suffix_array, suffix_tree, token_alignment, toxicity, warc
from fieldcast.llm.common import ship
from fieldcast.llm.common import table as read

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return read(spark, sf_dir, name)


def op1_language_bloom_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_warc_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("text_key")


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_tokens.read_files(binary_tokens.write_files(table(spark, sf_dir, "documents")))


def op8_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op9_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "text_key")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secret_ledger.Ledger.new(spark)
    secret_ledger.scan(docs, ledger)
    return secret_ledger.digest(secret_ledger.report(docs, ledger))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_repeats(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_language_bloom_filters,
    op2_warc_sequential,
    op3_line_frequency_rules,
    op4_toxicity_chain,
    op5_cutting_stock_packing,
    op6_suffix_array_dedup,
    op7_seekable_token_files,
    op8_index_decontamination,
    op9_suffix_tree_dedup,
    op10_ngram_jaccard_join,
    op11_secret_ledger,
    op12_token_alignment,
    op13_periodic_runs,
)}
