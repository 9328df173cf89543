"""Notes against chart review: from tables to performance figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clinote import schemas
from clinote.functions.text import NEGATED, POSITIVE
from clinote.operators import cohort, crosswalk, evaluate, features, review
from clinote.session import store_counted

# Note classes compared with the review and the review's date bound.
COMPARED_CLASSES = ["Emergency medicine", "Admission evaluation"]
REVIEWED_BEFORE = "2020-05-01"


@dataclass(frozen=True)
class Tables:
    """Inputs of a comparison."""

    notes: DataFrame
    mentions: DataFrame
    concepts: DataFrame
    visits: DataFrame
    checked: DataFrame
    reviews: DataFrame


def checked_tables(tables: Tables) -> Tables:
    """The tables, or ValueError where one lacks a column that a comparison reads."""
    for df, schema, columns in [
        (tables.notes, schemas.NOTE, ["note_id", "person_id", "note_class_concept_id", "visit_occurrence_id"]),
        (tables.concepts, schemas.CONCEPT, None),
    ]:
        schemas.require_columns(df, schema, columns)
    return tables


def build_crosswalk(
    tables: Tables, certainty: str, classes: list[str] | None = None, names: list[str] | None = None
) -> DataFrame:
    checked = checked_tables(tables)
    visits = cohort.distinct_selected_visits(checked.visits, checked.checked)
    return crosswalk.build(
        visits, checked.notes, checked.concepts, checked.mentions, certainty=certainty, classes=classes, names=names
    )


def positive_crosswalk(tables: Tables, classes: list[str] | None = None) -> DataFrame:
    return build_crosswalk(tables, POSITIVE, COMPARED_CLASSES if classes is None else classes)


def negated_crosswalk(tables: Tables, classes: list[str] | None = None) -> DataFrame:
    return build_crosswalk(tables, NEGATED, COMPARED_CLASSES if classes is None else classes)


def eligible_reviews(
    tables: Tables, before: Column | None = None, classes: list[str] | None = None
) -> DataFrame:
    bound = F.lit(REVIEWED_BEFORE).cast("timestamp_ntz") if before is None else before
    return review.select_reviews(
        tables.reviews, tables.notes, tables.concepts, tables.visits, tables.checked,
        classes=COMPARED_CLASSES if classes is None else classes, before=bound,
    )


def comparison_table(
    tables: Tables, names: list[str], before: Column | None = None, classes: list[str] | None = None
) -> DataFrame:
    """Eligible reviews with one Yes / null column per concept name.

    The reviews come first: only notes of reviewed encounters and mentions of the named
    concepts meet.
    """
    reviews = features.drop_suffix(eligible_reviews(tables, before, classes))
    reviewed = reviews.select(F.col("encounter_number").try_cast("bigint").alias("visit_occurrence_id")).distinct()
    notes = tables.notes.join(reviewed, "visit_occurrence_id", "left_semi")
    built = build_crosswalk(
        replace(tables, notes=notes), POSITIVE, COMPARED_CLASSES if classes is None else classes, names
    )
    matrix = features.one_hot(features.concept_counts(built), names)
    return review.with_concepts(reviews, matrix)


def pair_names(pairs: Sequence[evaluate.Pair]) -> list[str]:
    """Concept names that the pairs refer to."""
    prefix = features.COLUMN_PREFIX
    return [concept.removeprefix(prefix) for _, concept in pairs]


def performance(
    tables: Tables,
    pairs: Sequence[evaluate.Pair],
    before: Column | None = None,
    classes: list[str] | None = None,
) -> DataFrame:
    """Performance figures per pair of review column and concept column."""
    compared = comparison_table(tables, pair_names(pairs), before, classes)
    return evaluate.metrics(evaluate.confusion(compared, pairs))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """``stage, n_rows`` for every named frame, in one job."""
    report = None
    for name, df in stages.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        report = row if report is None else report.unionByName(row)
    if report is None:
        raise ValueError("no stages given")
    return report


class CountedStages:
    """Stages that are stored one after the other, and the rows of each as its write saw them: no stage is run twice."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.counts: dict[str, int] = {}

    def store(self, name: str, df: DataFrame, parts: dict[str, Column] | None = None) -> DataFrame:
        """The stored frame; ``parts`` names conditions whose rows are counted in the same write."""
        stored, counts = store_counted(self.spark, df, name, parts)
        self.counts.update(counts)
        return stored

    def report(self) -> DataFrame:
        """``stage, n_rows``."""
        return self.spark.createDataFrame(list(self.counts.items()), "stage string, n_rows long")
