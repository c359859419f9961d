"""From documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
a DataFrame that is written as Parquet before the next stage reads it. All but the last return
the columns of documents.

Edge cases: stages read the five columns of documents and no others, so further columns may have any name and are
not kept. An empty table passes through all stages. Null doc_ids are rows like any other. What a stage does with null and
empty texts, ties and repeated rows is said at the stage; very long texts are worked on whole by all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm import decontaminate, language, packing, secrets, simhash, tokens
from cadentia.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found: at least one letter and a posterior of 0.5 or more.

    Null texts, empty ones and those without a letter have no language and go. Repeated rows are judged alike. Where no row
    has a lang to learn from, no language is found.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = language.identify(docs.select(*COLUMNS), language.fit(docs, path))
    sure = (F.col("language.lang_pred") != "und") & (F.col("language.score") >= LEAST_SCORE)
    return found.where(sure).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of every group of linked fingerprints.

    A null doc_id comes last; of rows that share doc_id and text, one stays. Null and empty texts, if any are
    left, are one group.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least a twentieth of the words are benchmark passages.

    Null and empty texts have no words and stay. Repeated rows are judged one by one. An empty benchmark drops nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(docs.select(*COLUMNS), benchmark)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document; reported spans become ``[SECRET]`` and n_chars counts the new text.

    Null texts stay null with their n_chars; empty texts stay empty. Repeated rows are cleaned alike.
    """
    cleaned = secrets.redact(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048, as the packing query returns them.

    Null and empty texts are documents of the end token alone. Repeated rows are packed one by one.
    """
    return packing.pack_documents(docs, public_tokenizers.path(tokens.BYTE_BPE), added=tokens.ADDED)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# Hashes, compressed sizes and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
