"""Clean a corpus and pack it into training sequences, stage by stage.

Each stage works on all rows its predecessor kept and is stored before the
next one starts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm import decontaminate, jaccard_join, language, packing, repeats
from fringeflow.llm.queries import SEQUENCE_TOKENS, table
from fringeflow.sources import stage_store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
REPEATED_BYTES = 200


# What stages have settled on the way to their last result.
_OWN: list[str] = []


def _stored_stage(stage: Stage) -> Stage:
    """A stage that first removes what the stages before it settled on their way.

    Their results are stored by then, as the input of this one; if the
    input still reads what they settled, that stays.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = " ".join(docs.inputFiles())
        if not any(path.split("/")[-2] in read for path in _OWN):
            while _OWN:
                stage_store.remove_stage(spark, _OWN.pop())
        before = len(stage_store.SETTLED)
        result = stage(spark, docs, sf_dir)
        _OWN.extend(stage_store.SETTLED[before:])
        del stage_store.SETTLED[before:]
        return result

    return run_stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return language.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return jaccard_join.keep_one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings of 200 bytes; those that have nothing left go."""
    cut = repeats.drop_repeats(docs, REPEATED_BYTES)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where("text <> ''")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _stored_stage(identify_language)),
    ("near_copies", _stored_stage(drop_near_copies)),
    ("repeats", _stored_stage(cut_repeats)),
    ("decontamination", _stored_stage(drop_benchmark_leaks)),
    ("packing", _stored_stage(pack)),
]

# Token ids and repeated strings are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = stage_store.write_stage(result, stage_store.new_stage_path(spark, name))
        docs = stage_store.read_stage(spark, path, result.schema)
    return docs
