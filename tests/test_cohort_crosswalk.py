import datetime as dt

import pytest
from pyspark.sql import functions as F

from clinote.operators import cohort, crosswalk, features, review

DAY = dt.datetime(2020, 3, 1)


@pytest.fixture(scope="module")
def concepts(spark):
    rows = [(1, "Fever"), (2, "Influenza"), (3, "NC"), (10, "Emergency medicine"), (11, "Progress")]
    return spark.createDataFrame(rows, "concept_id int, concept_name string")


@pytest.fixture(scope="module")
def visits(spark):
    rows = [
        (901, "1", DAY, DAY, "in", "positive"),
        (902, "2", DAY, DAY, "in", "positive"),
        (903, "12abc", DAY, DAY, "in", "positive"),
        (904, None, DAY, DAY, "in", "positive"),
        (905, "5", DAY, DAY, "in", "negative"),
        (906, "6", DAY, DAY, "in", "positive"),
    ]
    return spark.createDataFrame(
        rows,
        "visit_occurrence_id long, encounter_number string, visit_start_datetime timestamp_ntz, "
        "visit_end_datetime timestamp_ntz, visit_concept_name string, covid19_status string",
    )


@pytest.fixture(scope="module")
def checked(spark):
    return spark.createDataFrame([(i,) for i in (901, 901, 902, 903, 904, 905)], "visit_occurrence_id long")


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(100, 7, 1, 10), (101, 7, 1, 10), (102, 7, 2, 10), (103, 7, 2, 11), (104, 8, 6, 10)]
    return spark.createDataFrame(
        rows, "note_id long, person_id long, visit_occurrence_id long, note_class_concept_id int"
    )


@pytest.fixture(scope="module")
def mentions(spark):
    rows = [
        (1, 100, 1, "certainty=Positive,x=y"),
        (2, 100, 1, "certainty=Positive,x=y"),
        (3, 101, 1, "certainty=Negated,x=y"),
        (4, 102, 2, "certainty=Positive,x=y"),
        (5, 103, 3, "certainty=Positive,x=y"),
        (6, 103, None, "certainty=Positive,x=y"),
        (7, 103, 1, None),
    ]
    return spark.createDataFrame(
        rows, "note_nlp_id long, note_id long, note_nlp_concept_id int, term_modifiers string"
    )


@pytest.fixture(scope="module")
def positive(visits, checked, notes, concepts, mentions):
    chosen = cohort.distinct_selected_visits(visits, checked)
    return crosswalk.build(chosen, notes, concepts, mentions, certainty="Positive")


def test_selected_visits_keep_index_repeats(visits, checked, rows):
    assert rows(cohort.selected_visits(visits, checked), "encounter_number") == [(1,), (1,), (2,)]
    assert rows(cohort.distinct_selected_visits(visits, checked), "encounter_number") == [(1,), (2,)]


def test_unmatched_notes_survive_as_nc(positive, rows):
    assert rows(positive, "note_id", "note_nlp_id", "note_nlp_concept_name", "counter") == sorted([
        (100, 1, "Fever", 1),
        (100, 2, "Fever", 1),
        (101, None, "NC", None),
        (102, None, "NC", None),
        (103, 5, "NC", 1),
    ], key=repr)


def test_negated(visits, checked, notes, concepts, mentions, rows):
    chosen = cohort.distinct_selected_visits(visits, checked)
    negated = crosswalk.build(chosen, notes, concepts, mentions, certainty="Negated", classes=["Emergency medicine"])
    assert rows(negated, "note_id", "note_nlp_id") == sorted([(100, None), (101, 3), (102, None)], key=repr)


def test_a_concept_named_nc_is_a_match(positive, rows):
    assert rows(features.concept_counts(positive)) == [
        (1, "Emergency medicine", "Fever", 2), (2, "Progress", "NC", 1)
    ]


def test_unmatched_classes_equal_the_anti_join(positive, rows):
    keys = features.KEYS
    anti = (
        crosswalk.unmatched(positive).select(*keys).distinct()
        .join(crosswalk.matched(positive).select(*keys).distinct(), keys, "left_anti")
    )
    assert rows(features.unmatched_classes(positive)) == rows(anti) == [(2, "Emergency medicine")]


def test_lists_and_one_hot(positive, rows):
    counts = features.with_unmatched(features.concept_counts(positive), features.unmatched_classes(positive))
    assert rows(counts.filter(F.col("counter").isNull()), *features.KEYS) == [(2, "Emergency medicine")]
    assert rows(features.concept_lists(counts)) == [(1, ["Fever"]), (2, ["NC"])]
    matrix = features.one_hot(counts, ["NC", "Fever", "Absent"])
    assert matrix.columns == [
        "encounter_number",
        "note_nlp_concept_name=Absent",
        "note_nlp_concept_name=Fever",
        "note_nlp_concept_name=NC",
    ]
    assert rows(matrix) == [(1, None, "Yes", None), (2, None, None, "Yes")]


def test_exclusions(mentions, concepts, rows):
    kept = crosswalk.exclude_concept_ids(mentions, [2])
    assert rows(kept, "note_nlp_id") == [(1,), (2,), (3,), (5,), (7,)]
    assert crosswalk.exclude_concept_ids(mentions, []).count() == 6


def test_reviews_keep_index_repeats_and_bound(spark, notes, concepts, visits, checked, rows):
    late = DAY + dt.timedelta(days=100)
    reviews = spark.createDataFrame(
        [("1", 901, DAY, late, "Yes", "c"), ("2", 902, late, DAY, "No", "c"), ("9", 901, DAY, late, "No", "c")],
        "encounter_number string, visit_occurrence_id long, visit_start_datetime timestamp_ntz, "
        "load_time timestamp_ntz, fever_v string, fever_c string",
    )
    chosen = review.select_reviews(
        reviews, notes, concepts, visits, checked, classes=["Emergency medicine"], before=F.col("load_time")
    )
    assert rows(chosen, "encounter_number", "fever_v") == [("1", "Yes"), ("1", "Yes")]
    assert chosen.columns == reviews.columns
    assert "fever_c" not in features.drop_suffix(chosen).columns
    everything = review.select_reviews(
        reviews, notes, concepts, visits, checked,
        classes=["Emergency medicine"], before=F.lit("2021-01-01").cast("timestamp_ntz"),
    )
    assert [r["encounter_number"] for r in review.newest_first(everything).collect()] == ["2", "1", "1"]


def test_hot_encounter_is_joined_whole(spark, visits, checked, concepts):
    hot = spark.range(3000).select(
        F.col("id").alias("note_id"),
        F.lit(7).cast("long").alias("person_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(2).cast("long").alias("visit_occurrence_id"),
        F.lit(10).alias("note_class_concept_id"),
    )
    hot_mentions = hot.select(
        F.col("note_id").alias("note_nlp_id"), "note_id", F.lit(1).alias("note_nlp_concept_id"),
        F.lit("certainty=Positive").alias("term_modifiers"),
    )
    built = crosswalk.build(
        cohort.distinct_selected_visits(visits, checked), hot, concepts, hot_mentions, certainty="Positive"
    )
    assert {tuple(r)[0::3] for r in features.concept_counts(built).collect()} == {(1, 1000), (2, 2000)}


def test_followup_notes(spark, rows):
    at = dt.datetime
    notes = spark.createDataFrame(
        [
            (1, "p", "e1", at(2021, 2, 28), "Progress Note"),
            (2, "p", "e1", at(2021, 2, 27), "Progress Note"),
            (3, "p", "e2", at(2021, 6, 1), "Progress Note"),
            (4, "p", "e1", at(2021, 6, 1), "Ambulatory Patient Summary"),
            (5, "p", "e1", at(2021, 6, 1), None),
            (6, "q", "e1", at(2021, 6, 1), "Progress Note"),
            (7, "r", "e1", at(2021, 6, 1), "Progress Note"),
        ],
        "document_id long, patient_id string, encounter_id string, document_datetime timestamp_ntz, document_type string",
    )
    encounters = spark.createDataFrame(
        [("e1", "LOC", "Outpatient"), ("e2", "LOC", "Inpatient")],
        "encounter_number string, service_delivery_location string, classification_display string",
    )
    results = spark.createDataFrame(
        [
            ("p", 1, at(2021, 1, 31)), ("p", 1, at(2021, 5, 1)), ("p", 1, None),
            ("q", 2, None), ("r", 3, at(2021, 1, 1)),
        ],
        "mrn string, person_id long, positive_datetime timestamp_ntz",
    )
    conditions = spark.createDataFrame(
        [(1, "U09.9"), (1, "U09.9"), (2, "U09.9"), (3, "Z00.0")],
        "person_id long, condition_source_concept_code string",
    )
    # 31 January plus a month is 28 February; repeated conditions do not repeat a note.
    assert rows(cohort.followup_notes(notes, encounters, results, conditions), "document_id") == [(1,)]
