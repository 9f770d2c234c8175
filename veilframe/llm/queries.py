"""Registered queries of this folder: each applies one operator, with its production settings, to whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import language_id, oracle, quality_classifier
from veilframe.llm.decontaminate import find_contamination
from veilframe.llm.jaccard_join import jaccard_classes
from veilframe.llm.license_scan import license_matches
from veilframe.llm.packing import pack
from veilframe.llm.quality_rules import quality_cascade
from veilframe.llm.secret_scan import find_secrets, listed
from veilframe.llm.suffix_dedup import remove_repeats
from veilframe.llm.textio import id_crc32, read_table
from veilframe.llm.tokens import token_counts


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read_table(spark, sf_dir, "documents"), id_crc32() % 4 == 2
    found = language_id.identify(docs, language_id.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    base = ["assign", "access", "hex"]
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed([*base, "entropy"]).alias("spans"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality_cascade(read_table(spark, sf_dir, "documents"), report=names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *names, failed.alias("base_failed"), "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), id_crc32() % 3 == 1
    found = quality_classifier.classify(docs, quality_classifier.train(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
