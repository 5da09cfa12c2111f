"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fringeflow.llm import (
    decontaminate,
    jaccard_join,
    language,
    line_labels,
    nearest,
    oracle,
    packing,
    phrases,
    repeats,
    sharding,
    spelling,
    token_count,
    tool_calls,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SHARDS = 8
SEQUENCE_TOKENS = 2048
TOKEN_LIMIT = 1024
SHINGLE_WORDS = 3
SIMILAR_PERCENT = 90
NEIGHBOURS = 20
REPEATED_BYTES = 200
PHRASE_WORDS = 3
PHRASE_COUNT = 10
COVER_PERCENT = 50
FIRST_PHRASES = 2000
VARIANT_CHARS = 7
VARIANT_COUNT = 2
VARIANT_RATIO = 10
DELETE_ONE_IN = 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.redirect_blocks(table(spark, sf_dir, "pages"), URL_RULES)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, sharding.topology(SHARDS), sharding.topology(SHARDS + 1))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer, SEQUENCE_TOKENS)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), SHINGLE_WORDS, SIMILAR_PERCENT)


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.exchange_events(table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.EXCHANGE_SCHEMAS)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer, TOKEN_LIMIT)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), REPEATED_BYTES)
    return cut.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) as kept_sha256")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", NEIGHBOURS)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), copies=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spelling.variant_groups(docs, VARIANT_CHARS, VARIANT_COUNT, VARIANT_RATIO, DELETE_ONE_IN)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return phrases.collocations(docs, PHRASE_WORDS, PHRASE_COUNT, COVER_PERCENT, FIRST_PHRASES)


def op13_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_labels.judge_lines(docs, line_labels.learn_lines(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_tool_calls": op6_tool_calls,
    "op7_token_count": op7_token_count,
    "op8_repeats": op8_repeats,
    "op9_nearest": op9_nearest,
    "op10_decontamination": op10_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_line_labels": op13_line_labels,
}

# The others are beyond SQL; tests hold them against brute force or the library they follow.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": oracle.url_filter(URL_RULES),
    "op2_sharding": oracle.sharding(SHARDS),
    "op6_tool_calls": oracle.tool_calls(),
    "op12_collocations": oracle.collocations(PHRASE_WORDS, PHRASE_COUNT, COVER_PERCENT, FIRST_PHRASES),
}
