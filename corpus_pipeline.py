"""From documents to packed training windows: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all that the stage
before has kept. A stage's result is written as Parquet and read again before the next one begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import language_id
from veilframe.llm.components import written
from veilframe.llm.decontaminate import decontaminate
from veilframe.llm.jaccard_join import JaccardSettings, keep_one_each
from veilframe.llm.packing import pack
from veilframe.llm.secret_scan import redact_secrets
from veilframe.llm.textio import read_table


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


#: What counts as a near copy in the pipeline: sets of five-word shingles with a similarity of 0.8 or more.
NEAR = JaccardSettings(percent=80, k=5)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty ones among them, or in a language that no label names go. Without a
    label only the former do; repeated rows are each judged alike; an empty table stays empty; all columns are kept, and
    lang is the language found in the text, by which the last stage packs."""
    return language_id.keep_known(docs, language_id.train(docs, F.lit(True)), lang_col="lang")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the Jaccard join the one with the smallest id stays, of rows under one id one, and all
    rows without an id. Null and empty texts link with nothing; an empty table stays empty; all columns are kept."""
    return keep_one_each(docs, NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; a document that is little else goes. Null and empty texts stay as they
    are, as all do where benchmark is empty; repeated rows are treated alike; all columns are kept, and n_chars
    follows the text."""
    return _recount(decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no row goes. Null and empty texts stay as they are; repeated rows are treated
    alike; an empty table stays empty; all columns are kept, and n_chars follows the text."""
    return _recount(redact_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows, with their token ids; a window holds documents of one language alone. A null or empty text is its end mark alone; repeated rows are
    packed each by itself; an empty table gives no piece; columns other than id and text are left behind."""
    pieces = pack(docs, group_col="lang" if "lang" in docs.columns else None)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer nor the packing; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
