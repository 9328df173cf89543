"""The registered query of each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clinote.llm import (
    bpe_automaton, iblt_fingerprint, jaccard_join, language_id, resharding, source_audit, source_mixing,
    template_decontamination, token_archive, token_counts, url_rules, vector_codes, warc_archive,
)
from clinote.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt_fingerprint.compare_versions(_table(spark, sf_dir, "documents"))


def op2_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by the checksum of the id to 24 of equal bytes."""
    return _resharded(_table(spark, sf_dir, "documents"))


def _resharded(documents: DataFrame) -> DataFrame:
    placed = documents.withColumn("old_shard", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16)
    plan = resharding.plan(placed, "old_shard", 24)
    rows = resharding.rewrite(placed, "old_shard", plan, scratch_path(documents.sparkSession, "resharded"))
    if len(plan.affected()) < 24:
        rows = rows.unionByName(resharding.untouched(placed, "old_shard", plan))
    return rows.select(
        "doc_id",
        resharding.row_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
    )


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return bpe_automaton.round_trip(documents, public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return token_counts.count_tokens(documents, public_tokenizers.path("piece_bpe_32k.model"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc_archive.write(_table(spark, sf_dir, "pages"), path)
    return warc_archive.pages(spark, path)


def op8_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-archive")
    token_archive.write(documents, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_archive.digests(documents.select("doc_id"), path)


#: The given rules; longer ones win.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the label of their number: unwanted if toxic or of low quality."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select(
        "url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked")
    )
    return url_rules.judge(pages, url_rules.mine(labelled), URL_RULES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = language_id.train(documents.filter(~language_id.is_held_out()))
    predicted = language_id.predict(documents, model)
    return predicted.select("doc_id", language_id.is_held_out().alias("held_out"), "lang_pred", "score", "is_ambiguous")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = source_mixing.mix(_table(spark, sf_dir, "documents"))
    return source_mixing.taken_words(made).withColumnRenamed("key", "doc_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_iblt_fingerprint": op1_iblt_fingerprint,
    "op2_min_cost_resharding": op2_min_cost_resharding,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_warc_archive": op7_warc_archive,
    "op8_token_archive": op8_token_archive,
    "op9_url_rules": op9_url_rules,
    "op10_language_id": op10_language_id,
    "op11_source_mixing": op11_source_mixing,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_audit": op13_source_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc_archive": warc_archive.sql(),
    "op12_vector_codes": vector_codes.sql(),
    "op13_source_audit": source_audit.sql(),
}
