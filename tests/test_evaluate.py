import pytest
from pyspark.sql import functions as F

from clinote.operators import errors, evaluate, review

PAIRS = [("fever_v", "note_nlp_concept_name=Fever"), ("dry_cough_v", "note_nlp_concept_name=Dry cough")]


@pytest.fixture(scope="module")
def compared(spark):
    rows = [
        (1, "Yes", "Yes", "No", None),
        (2, "Yes", "Yes", "No", None),
        (3, "Yes", None, "No", None),
        (4, "No", "Yes", "No", None),
        (5, "No", None, "No", None),
        (6, "No", None, "Unknown", "Yes"),
        (7, "No", None, None, None),
        (8, "Unknown", "Yes", "No", None),
    ]
    names = ["encounter_number", "fever_v", "note_nlp_concept_name=Fever", "dry_cough_v", "note_nlp_concept_name=Dry cough"]
    return spark.createDataFrame(rows, "a long, b string, c string, d string, e string").toDF(*names)


def test_hand_worked_metrics(compared, rows):
    found = {r["chart_review"]: r for r in evaluate.metrics(evaluate.confusion(compared, PAIRS)).collect()}
    fever = found["fever"]
    assert (fever["tp"], fever["fn"], fever["fp"], fever["tn"]) == (2, 1, 1, 3)
    assert fever["note_nlp_concept_name"] == "Fever"
    assert fever["sensitivity"] == 2 / 3
    assert fever["specificity"] == 3 / 4
    assert fever["ppv"] == 2 / 3
    assert fever["frequency"] == 3 / 7


def test_empty_denominators_are_null(compared):
    cough = evaluate.metrics(evaluate.confusion(compared, PAIRS)).filter("chart_review = 'dry_cough'").first()
    assert (cough["tp"], cough["fn"], cough["fp"], cough["tn"]) == (0, 0, 0, 6)
    assert cough["sensitivity"] is None and cough["ppv"] is None
    assert cough["specificity"] == 1.0 and cough["frequency"] == 0.0


def test_flags_sum_to_the_rows_that_count(compared):
    counted = evaluate.confusion(compared, PAIRS).selectExpr("sum(fp + fn + tp + tn) as n").first()["n"]
    assert counted == 7 + 6


def test_wide_flags(compared):
    wide = evaluate.with_flags(compared, PAIRS)
    assert wide.columns[-4:] == [f"note_nlp_concept_name=Dry cough|{f}" for f in ("fp", "fn", "tp", "tn")]
    row = wide.filter("encounter_number = 8").first()
    assert row["note_nlp_concept_name=Fever|fp"] is None
    with pytest.raises(ValueError):
        evaluate.with_flags(compared, [("fever_v", "x"), ("dry_cough_v", "x")])


def test_error_rows(compared, rows):
    assert rows(errors.error_rows(compared, PAIRS, "fp")) == [(4, "Fever")]
    assert rows(errors.error_rows(compared, PAIRS, "fn")) == [(3, "Fever")]
    with pytest.raises(ValueError):
        errors.error_rows(compared, PAIRS, "tp")


def test_examples_follow_the_crosswalk(spark, compared, rows):
    walk = spark.createDataFrame(
        [(4, "Fever", 50, 500, 10), (4, "Fever", 50, 501, 10), (4, "Dry cough", 50, 502, 10), (3, "Fever", 51, 503, 10)],
        "encounter_number long, note_nlp_concept_name string, note_id long, note_nlp_id long, note_class_concept_id int",
    )
    mentions = spark.createDataFrame(
        [(500, 50, "-fever", "fever", 1, "certainty=Positive"), (501, 50, "a fever", "fever", 1, "certainty=Positive"),
         (777, 50, "-fever", "fever", 1, "certainty=Positive")],
        "note_nlp_id long, note_id long, snippet string, lexical_variant string, note_nlp_concept_id int, "
        "term_modifiers string",
    )
    corpus = mentions.filter("note_nlp_id = 500").select(F.sha1("snippet").alias("sha1"), F.col("snippet").alias("text"))
    found = errors.error_mentions(compared, PAIRS, "fp", walk)
    found = errors.examples(found, mentions, corpus, exclude_ids=[])
    assert rows(found, "note_nlp_id", "meta_note_id", "position", "text") == [(500, 50, 0, "'-fever'")]


def test_reviews_without_concepts_stay(spark, compared):
    reviews = spark.createDataFrame([("4",), ("9",), ("x",)], "encounter_number string")
    joined = review.with_concepts(reviews, compared)
    assert joined.count() == 3
    assert dict(joined.dtypes)["encounter_number"] == "bigint"
