"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadentia.llm import (
    chat,
    decontaminate,
    filter_audit,
    language,
    ledger,
    licenses,
    packing,
    pii,
    prefix_trie,
    secrets,
    sharding,
    simhash,
    syncmers,
    tokens,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# A key for the registered query; production passes its own.
SURROGATE_KEY = b"registered query"


@_query
def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(table(spark, folder, "documents"), SURROGATE_KEY)


@_query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return language.language_report(table(spark, folder, "documents"), path)


@_query
def op3_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    names = ("byte_bpe_50k", "byte_bpe_multi_50k")
    paths = {n: public_tokenizers.path(f"{n}.tiktoken") for n in names}
    return ledger.maintained_counts(table(spark, folder, "documents"), paths)


@_query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


ORACLES["op5_license_scan"] = licenses.ORACLE


@_query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op8_decontamination"] = decontaminate.ORACLE


@_query
def op9_syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, folder, "documents"))


@_query
def op7_simhash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@_query
def op10_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


@_query
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(tokens.BYTE_BPE), added=tokens.ADDED)


@_query
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


@_query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


ORACLES["op11_prefix_trie"] = prefix_trie.ORACLE


@_query
def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.formatting_report(chat.with_trap(table(spark, folder, "conversations")))


ORACLES["op12_chat_formatting"] = chat.ORACLE


@_query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLES["op13_filter_audit"] = filter_audit.ORACLE
