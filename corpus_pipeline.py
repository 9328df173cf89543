"""The training-data pipeline: four operators, one after the other, on the documents.

1. ``language_id``: error-correcting output codes; texts without a language (null, without a letter, or clearly
   farther from every codeword than all but a thousandth of the labelled ones) go. Without labels all stay.
2. ``jaccard_join``: of the documents that links of word-shingle similarity connect, the one with the
   smallest ``doc_id`` stays.
3. ``decontamination``: documents that hold a benchmark item, also with other numbers or
   names, go.
4. ``bpe_encoding``: what is left is encoded and decoded; one row per document with its
   ids and whether decoding gave the text back.

Every stage but the last returns the columns it was given. Rows without a ``doc_id`` pass
stages 2 and 3, which cannot name them; rows that share a ``doc_id`` and a text are one
document for stage 2. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clinote.llm import bpe_automaton, jaccard_join, language_id, template_decontamination
from clinote.session import store

#: SQL cannot express the stages; ``tests/llm/test_learned.py`` holds them against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.filter(~language_id.is_held_out())
    model = language_id.train(known)
    # A short clean text may lie between two languages, but near them; noise is far from all.
    return language_id.keep_determined(
        docs, model, min_lead=0.0, max_distance=language_id.rejection_distance(known, model)
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return template_decontamination.drop_contaminated(docs, benchmark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
