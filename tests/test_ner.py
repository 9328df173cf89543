import math

import pytest
from pyspark.sql import functions as F

from clinote.operators import annotate, ner
from clinote.plans import corpus as corpus_plan
from clinote.session import scratch_path

SNIPPET = "has fever and dry cough, no feverish"


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame([(1, "Fever"), (2, "Cough")], "concept_id int, concept_name string")


@pytest.fixture(scope="module")
def mentions(spark):
    rows = [
        (1, 10, SNIPPET, "fever", 1, "certainty=Positive,e=P"),
        (2, 10, " " + SNIPPET + "\n", "fever", 1, "certainty=Negated,e=P"),
        (3, 9, "x 01/02/2020 03:04 EST " + SNIPPET, "cough", 2, "certainty=Negated,e=P"),
        (4, 10, SNIPPET, "Fever", 1, "certainty=Positive"),
        (5, 11, "attack on action", "tion", 3, "certainty=Positive"),
        (6, 11, "attack on action", "action", 4, "certainty=Positive"),
        (7, 12, None, "tion", 3, "certainty=Positive"),
        (8, 12, SNIPPET, "dry", 99, None),
        (9, 12, SNIPPET, "dry", 99, "uncertain"),
        (10, 13, SNIPPET, "dry", 99, "certainty=Positive"),
        (11, 13, SNIPPET, "dry", 4266367, "certainty=Positive"),
    ]
    return spark.createDataFrame(
        rows,
        "note_nlp_id long, note_id long, snippet string, lexical_variant string, note_nlp_concept_id int, "
        "term_modifiers string",
    )


@pytest.fixture(scope="module")
def located(mentions):
    return ner.prepare(mentions, exclude_ids=[ner.EXCLUDED_CONCEPT_ID])


def test_located(located, rows):
    assert rows(located, "note_nlp_id", "start", "end") == [
        (1, 4, 9), (10, 14, 17), (2, 4, 9), (3, 18, 23), (5, 12, 16), (6, 10, 16), (9, 14, 17)
    ]
    assert located.select("sha1").distinct().count() == 2
    assert ner.metadata(located).count() == 7


def test_first_variant_wins_before_the_label_filter(located, rows):
    first = ner.first_variants(located)
    assert rows(first, "note_nlp_id", "lexical_variant", "certainty") == [
        (1, "fever", "Positive"), (10, "dry", "Positive"), (3, "cough", "Negated"),
        (5, "tion", "Positive"), (6, "action", "Positive"),
    ]


def ents(df):
    return {r["text"]: [(e["start"], e["end"], e["label"]) for e in r["ents"]] for r in df.collect()}


def test_styles(located, concepts):
    first = ner.first_variants(located)
    assert ents(ner.corpus(first, concepts, ner.TERM_USAGE)) == {
        SNIPPET: [(4, 9, "Positive"), (14, 17, "Positive"), (18, 23, "Negated")]
    }
    assert ents(ner.corpus(first, concepts, ner.POSITIVE_CONCEPTS)) == {
        SNIPPET: [(4, 9, "Fever|1"), (14, 17, "99")]
    }
    # Without labels of this style nothing overlaps, and the document stays with no entity.
    assert ents(ner.corpus(first, concepts, ner.NEGATED_CONCEPTS)) == {
        SNIPPET: [(18, 23, "Cough|2")], "attack on action": []
    }
    with pytest.raises(ValueError):
        ner.label(first, concepts, "other")


def test_overlap_after_expansion_drops_the_document_but_not_its_metadata(located, concepts, rows):
    documents = ner.documents(ner.first_variants(located), concepts, ner.TERM_USAGE)
    assert rows(documents, "text", "overlaps") == [("attack on action", True), (SNIPPET, False)]
    assert ner.metadata(located).filter(F.col("note_id") == 11).count() == 2


def test_cap(mentions, rows):
    assert rows(ner.cap_mentions(mentions, 2), "note_nlp_id") == [(1,), (3,)]
    assert ner.cap_mentions(mentions, None).count() == 11


def test_snippet_groups(located, rows):
    assert rows(ner.snippet_groups(located), "n_mentions", "n_notes", "n_variants", "first_note_id") == [
        (2, 1, 2, 11), (5, 4, 3, 9)
    ]


def test_a_snippet_copied_into_a_third_of_all_notes(spark, concepts):
    copies = spark.range(3000).select(
        F.col("id").alias("note_nlp_id"),
        F.col("id").alias("note_id"),
        F.when(F.col("id") % 3 == 0, F.lit("has fever")).otherwise(
            F.concat(F.lit("fever "), F.col("id").cast("string"))
        ).alias("snippet"),
        F.lit("fever").alias("lexical_variant"),
        F.lit(1).alias("note_nlp_concept_id"),
        F.when(F.col("id") == 0, "certainty=Negated").otherwise("certainty=Positive").alias("term_modifiers"),
    )
    documents = corpus_plan.build_corpus(copies, concepts, ner.TERM_USAGE, exclude_ids=[])
    assert documents.count() == 2001
    assert ents(documents.filter(F.col("text") == "has fever")) == {"has fever": [(4, 9, "Negated")]}


@pytest.mark.parametrize("fraction", [0.0, 0.3, 1.0])
def test_split_is_exact_and_repeatable(spark, fraction):
    keys = spark.range(101).select(F.sha1(F.col("id").cast("string")).alias("sha1"))
    first = {r["sha1"]: r["split"] for r in ner.split(keys, test_fraction=fraction).collect()}
    again = {r["sha1"]: r["split"] for r in ner.split(keys, test_fraction=fraction).collect()}
    other = {r["sha1"]: r["split"] for r in ner.split(keys, test_fraction=fraction, seed="1").collect()}
    assert list(first.values()).count("test") == math.floor(101 * fraction)
    assert first == again
    assert (first != other) == (fraction == 0.3)


def test_split_checks(spark):
    keys = spark.range(3).select(F.sha1(F.col("id").cast("string")).alias("sha1"))
    with pytest.raises(ValueError):
        ner.split(keys, test_fraction=1.5)
    with pytest.raises(ValueError):
        ner.split_by_group(keys, "sha1", test_fraction=-0.1)


def test_split_by_group_keeps_a_note_together(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("note_id"))
    placed = ner.split_by_group(df, "note_id").distinct()
    assert placed.count() == 200
    assert 30 < placed.filter("split = 'test'").count() < 90


def test_store_corpus(spark, located, concepts, rows):
    documents = ner.corpus(ner.first_variants(located), concepts, ner.NEGATED_CONCEPTS)
    stored = corpus_plan.store_corpus(
        spark, documents, ner.NEGATED_CONCEPTS, scratch_path(spark, "work"), scratch_path(spark, "corpus"),
        test_fraction=0.5,
    )
    assert sorted(r["split"] for r in stored.collect()) == ["test", "train"]
    assert rows(stored, "text", "ents") == rows(documents, "text", "ents")


def test_records_and_batches(spark, located, concepts):
    documents = ner.corpus(ner.first_variants(located), concepts, ner.TERM_USAGE)
    record = annotate.token_records(documents).first()
    assert record["tokens"][:2] == ["has", "fever"]
    assert [tuple(p) for p in record["prediction"]][0] == ("Positive", 4, 9)
    assert annotate.token_records(documents, limit=0).count() == 0
    batches = annotate.with_batch_id(spark.range(101).withColumnRenamed("id", "key"), 50, key="key")
    assert sorted(r["count"] for r in batches.groupBy("batch_id").count().collect()) == [1, 50, 50]


def test_text_records(spark):
    notes = spark.createDataFrame(
        [(1, "text", "p", None, "t", "loc", 5)],
        "document_id long, file_text string, patient_id string, mapped_document_type string, document_type string, "
        "service_delivery_location string, encounter_id long",
    )
    record = annotate.text_records(notes).first()
    assert record["inputs"] == {"text": "text"} and record["multi_label"] is True
    assert record["metadata"]["encounter_id"] == "5" and record["metadata"]["mapped_document_type"] is None
