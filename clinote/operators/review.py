"""Manual chart reviews that can be compared with the notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clinote.functions.keys import text_key
from clinote.operators import cohort, profile


def select_reviews(
    reviews: DataFrame,
    notes: DataFrame,
    concepts: DataFrame,
    visits: DataFrame,
    checked: DataFrame,
    *,
    classes: list[str],
    before: Column,
    status: str = "positive",
) -> DataFrame:
    """Reviews of encounters with a note in the classes and a checked visit, started before a bound.

    ``before`` is a literal or a column of the review. Repeats in the checked index repeat
    the review. Encounter keys meet as text, the form in which reviews hold them.
    """
    # Reduced to distinct keys before the join: an encounter with very many notes is one row.
    documented = (
        profile.notes_in_class(notes.select("visit_occurrence_id", "note_class_concept_id"), concepts, classes)
        .select(text_key(F.col("visit_occurrence_id")).alias("encounter_number"))
        .distinct()
    )
    gate = cohort.checked_visits(visits, checked, status=status).select("visit_occurrence_id")
    return (
        reviews.filter(F.col("visit_start_datetime") < before)
        .join(documented, "encounter_number", "left_semi")
        .join(gate, "visit_occurrence_id")
        .select(*reviews.columns)
    )


def newest_first(reviews: DataFrame) -> DataFrame:
    """Presentation order: latest visit first, missing dates before all."""
    return reviews.orderBy(F.col("visit_start_datetime").desc_nulls_first())


def with_concepts(reviews: DataFrame, matrix: DataFrame) -> DataFrame:
    """Reviews with the concept columns of their encounter; the key becomes a bigint."""
    keyed = reviews.withColumn("encounter_number", F.col("encounter_number").try_cast("bigint"))
    return keyed.join(matrix, "encounter_number", "left")
