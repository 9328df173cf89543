import datetime as dt

import pytest
from pyspark.sql import functions as F

from clinote import schemas
from clinote.operators import ingest, profile
from clinote.plans import comparison
from clinote.session import scratch_path
from clinote.sources import readers, sinks

AWKWARD = ['plain', 'a "quoted" word', 'two\nlines', 'comma, here', 'back\\slash', ' edges ', '', 'a\rb', 'c\r\nd', '\ttab']


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, str(i), str(i + 50), dt.datetime(2020, 1, 1, 1, 2, 3), "t", None, s) for i, s in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, schemas.RAW_DOCUMENT)


def test_csv_round_trip(spark, documents, rows):
    path = scratch_path(spark, "csv")
    sinks.write_csv(documents, path)
    wanted = documents
    assert rows(readers.read_staging(spark, path)) == rows(wanted)


def test_json_and_table_round_trip(spark, documents, rows):
    path = scratch_path(spark, "json")
    sinks.write_json(documents, path)
    assert rows(readers.read_json(spark, path, documents.schema)) == rows(documents)
    path = scratch_path(spark, "table")
    sinks.write_table(documents, path)
    narrow = readers.read_table(spark, path, ["id"])
    assert narrow.columns == ["id"]
    assert "file_text" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_corpus_partitions_are_pruned(spark):
    path = scratch_path(spark, "corpus")
    rows = [("s1", "t", [], "a", "test"), ("s2", "t", [], "a", "train"), ("s3", "t", [], "b", "test")]
    df = spark.createDataFrame(
        rows, "sha1 string, text string, ents array<struct<start:int,end:int,label:string>>, style string, split string"
    )
    sinks.write_corpus(df, path)
    chosen = readers.read_corpus(spark, path, "a", "test")
    assert [r["sha1"] for r in chosen.collect()] == ["s1"]
    assert "PartitionFilters: [isnotnull(style" in chosen._jdf.queryExecution().executedPlan().toString()


def test_jdbc_options():
    options = readers.partitioned_jdbc_options(
        "jdbc:x:y", query="select note_id, note_text from note", id_column="note_id",
        lower=1, upper=1000, partitions=16, driver="d", user="u", fetch_size=100,
    )
    assert options == {
        "url": "jdbc:x:y", "dbtable": "(select note_id, note_text from note) source_rows", "fetchsize": "100",
        "driver": "d", "user": "u", "partitionColumn": "note_id", "lowerBound": "1", "upperBound": "1000",
        "numPartitions": "16",
    }
    assert readers.jdbc_options("jdbc:x:y", query="select 1")["query"] == "select 1"
    written = sinks.jdbc_write_options("jdbc:x:y", "note_nlp", batch_size=50)
    assert written == {"url": "jdbc:x:y", "dbtable": "note_nlp", "batchsize": "50"}


def test_documents_to_note(documents):
    note = ingest.documents_to_note(documents)
    assert note.columns == schemas.NOTE.names
    schemas.require(note, schemas.NOTE)
    row = note.filter("note_id = 1").first()
    assert (row["person_id"], row["visit_occurrence_id"], row["note_date"]) == (1, 51, dt.date(2020, 1, 1))
    assert row["provider_id"] is None


def test_mapping_cuts_snippet_and_renames_the_date(spark):
    row = {f.name: None for f in schemas.NOTE_NLP.fields}
    row.update(note_nlp_id=1, note_id=2, lexical_variant="v", snippet="x" * 6000,
               nlp_date=dt.date(2020, 1, 1), nlp_datetime=dt.datetime(2021, 3, 15, 12, 30))
    frame = spark.createDataFrame([tuple(row[n] for n in schemas.NOTE_NLP.names)], schemas.NOTE_NLP)
    mapped = sinks.map_columns(frame)
    assert mapped.columns == [target for target, _ in sinks.NOTE_NLP_MAPPING]
    found = mapped.first()
    assert len(found["snippet"]) == 5000 and found["nlp_date"] == dt.date(2021, 3, 15)


def test_require_and_violations(spark, rows):
    df = spark.createDataFrame([(1, None, "x" * 251), (None, 2, "ok")], "note_id long, person_id long, note_title string")
    report = rows(schemas.violations(df, schemas.NOTE))
    assert [r for r in report if r[1] != "missing"] == [
        ("note_id", "not_null", 1), ("note_title", "max_length_250", 1), ("person_id", "not_null", 1)
    ]
    assert [r[0] for r in report if r[1] == "missing"] == sorted([
        "note_date", "note_type_concept_id", "note_class_concept_id", "encoding_concept_id", "language_concept_id"
    ])
    assert all(r[2] == 2 for r in report if r[1] == "missing")
    schemas.require(df, schemas.NOTE, ["note_id", "person_id"])
    with pytest.raises(ValueError, match="missing column note_date"):
        schemas.require(df, schemas.NOTE)
    with pytest.raises(ValueError, match="is string, expected bigint"):
        schemas.require(df.withColumn("note_id", F.lit("a")), schemas.NOTE, ["note_id"])
    assert schemas.describe(df)[0] == ("note_id", "bigint", True)


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([(2, None), (None, "b"), (1, "a"), (1, None)], "a int, b string")
    assert [tuple(r) for r in sinks.sort_nulls_last(df, "a", "b").collect()] == [
        (1, "a"), (1, None), (2, None), (None, "b")
    ]


def test_ids(spark):
    df = spark.range(20).select(
        F.col("id").alias("note_id"), F.lit("0").alias("offset"), F.lit(1).alias("note_nlp_concept_id"),
        F.lit("v").alias("lexical_variant"),
    )
    hashed = ingest.assign_nlp_id(df)
    assert hashed.select("note_nlp_id").distinct().count() == 20
    dense = ingest.assign_nlp_id(df, dense=True)
    assert sorted(r["note_nlp_id"] for r in dense.collect()) == list(range(1, 21))


def test_profiles_count_repeated_note_rows_like_a_join(spark, rows):
    notes = spark.createDataFrame(
        [(1, 5, 7, 10), (1, 5, 7, 10), (2, 5, 7, 11), (3, 6, 8, 10)],
        "note_id long, visit_occurrence_id long, person_id long, note_class_concept_id int",
    )
    mentions = spark.createDataFrame(
        [(1, 1, "certainty=Positive"), (1, 1, "certainty=Negated"), (2, 2, "certainty=Positive")],
        "note_id long, note_nlp_concept_id int, term_modifiers string",
    )
    concepts = spark.createDataFrame(
        [(1, "Fever"), (2, "Cough"), (10, "A"), (11, "A")], "concept_id int, concept_name string"
    )
    assert rows(profile.match_coverage(notes, mentions, concepts)) == [("A", 5, 2, 1, 1)]
    assert rows(profile.by_class_and_concept(notes, mentions, concepts, certainty="Positive"), "n_r", "note_nlp_concept_name") == [
        (1, "Cough"), (2, "Fever")
    ]
    totals = profile.totals(notes).first()
    assert (totals["n_r"], totals["n_visits"], totals["n"]) == (4, 2, 2)
    assert sum(r["n_r"] for r in profile.by_class(notes, concepts).collect()) == totals["n_r"]
    assert profile.totals(notes, approximate=True).first()["n"] == 2
    assert profile.preview(notes, "note_id", 1).count() == 1


def test_stage_counts(spark, rows):
    report = comparison.stage_counts({"a": spark.range(3), "b": spark.range(0)})
    assert rows(report) == [("a", 3), ("b", 0)]
    with pytest.raises(ValueError):
        comparison.stage_counts({})


def test_read_query(spark, rows):
    found = readers.read_query(spark, "select id from {t} where id > 1", t=spark.range(4))
    assert rows(found) == [(2,), (3,)]


TEXTS = ["", None, "a\nb", 'say "x"', "\\n back\\slash", "\r\n", "-1", "  spaced ", "\\\\N", ","]


@pytest.mark.parametrize("one_line", [False, True])
def test_csv_gives_back_what_was_written(spark, tmp_path, one_line):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    path = str(tmp_path / "csv")
    sinks.write_csv(df, path, one_line=one_line)
    back = readers.read_csv(spark, path, df.schema, one_line=one_line)
    assert {r["id"]: r["text"] for r in back.collect()} == dict(enumerate(TEXTS))


def test_bad_keys_become_null_and_are_counted(spark):
    documents = spark.createDataFrame(
        [("1", "12abc", "7", None, "t", "m", "x"), ("y", "2", "8", None, "t", "m", "x")],
        "id string, patient_id string, encounter_id string, document_datetime timestamp_ntz, document_type string, "
        "mapped_document_type string, file_text string",
    )
    note = ingest.documents_to_note(documents)
    counted = {(r["column_name"], r["rule"]): r["n_rows"] for r in schemas.violations(note, schemas.NOTE).collect()}
    assert counted["note_id", "not_null"] == counted["person_id", "not_null"] == 1


def test_profiles_are_sorted_for_reading(spark):
    df = spark.createDataFrame([("b", "y"), ("a", "z"), ("a", "x")], "note_class_concept_name string, note_nlp_concept_name string")
    assert [tuple(r) for r in profile.for_reading(df).collect()] == [("a", "x"), ("a", "z"), ("b", "y")]
