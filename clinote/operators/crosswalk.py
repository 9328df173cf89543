"""The visit, note and concept crosswalk.

A note without a mention of the wanted certainty keeps one row with a null mention.
Operators test that null; the printed name ``NC`` never decides anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clinote.functions.text import certainty_is

# Printed name of "no concept" and the concept left out of comparisons.
NO_CONCEPT = "NC"
EXCLUDED_CONCEPT = "Influenza"

# Columns of the crosswalk.
_NOTE_COLUMNS = [
    "encounter_number",
    "visit_start_datetime",
    "visit_end_datetime",
    "visit_concept_name",
    "note_id",
    "mrn",
    "note_class_concept_name",
    "note_class_concept_id",
]


def mentions_with_certainty(mentions: DataFrame, certainty: str) -> DataFrame:
    return mentions.filter(certainty_is(F.col("term_modifiers"), certainty))


def exclude_concept_name(named: DataFrame, name: str, column: str = "note_nlp_concept_name") -> DataFrame:
    """Rows of other concepts; a null name is dropped too."""
    return named.filter(F.col(column) != name)


def exclude_concept_ids(mentions: DataFrame, ids: list[int]) -> DataFrame:
    """Mentions of other concepts; a null id is dropped too."""
    column = F.col("note_nlp_concept_id")
    return mentions.filter(~column.isin(ids) if ids else column.isNotNull())


def named_mentions(
    mentions: DataFrame, concepts: DataFrame, certainty: str, exclude: str | None = EXCLUDED_CONCEPT
) -> DataFrame:
    """``note_id, note_nlp_id, note_nlp_concept_id, note_nlp_concept_name`` of one certainty."""
    names = concepts.select(
        F.col("concept_id").alias("note_nlp_concept_id"), F.col("concept_name").alias("note_nlp_concept_name")
    )
    if exclude is not None:
        names = exclude_concept_name(names, exclude)
    wanted = mentions_with_certainty(mentions, certainty).select("note_id", "note_nlp_id", "note_nlp_concept_id")
    return wanted.join(names, "note_nlp_concept_id")


def build(
    visits: DataFrame,
    notes: DataFrame,
    concepts: DataFrame,
    mentions: DataFrame,
    *,
    certainty: str,
    exclude: str | None = EXCLUDED_CONCEPT,
    classes: list[str] | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """Distinct rows of visit x note x mention for one certainty.

    Mentions are filtered before they meet the notes: a note with negated mentions only
    stays in the positive crosswalk as ``NC``. ``names`` limits the mentions to some
    concepts, for callers that look at no others. ``visits`` is the result of
    ``cohort.distinct_selected_visits``.
    """
    class_names = concepts.select(
        F.col("concept_id").alias("note_class_concept_id"), F.col("concept_name").alias("note_class_concept_name")
    )
    if classes is not None:
        class_names = class_names.filter(F.col("note_class_concept_name").isin(classes))
    cohort_notes = (
        notes.select(
            F.col("visit_occurrence_id").alias("encounter_number"),
            "note_id",
            F.col("person_id").alias("mrn"),
            "note_class_concept_id",
        )
        .join(class_names, "note_class_concept_id")
        .join(visits, "encounter_number")
    )
    known = concepts if names is None else concepts.filter(F.col("concept_name").isin(names))
    found = named_mentions(mentions, known, certainty, exclude)
    # The notes are the large side of the outer join and may be split where keys are skewed.
    return (
        cohort_notes.join(found.withColumn("counter", F.lit(1)), "note_id", "left")
        .select(
            *_NOTE_COLUMNS, "note_nlp_id", "note_nlp_concept_id",
            F.coalesce("note_nlp_concept_name", F.lit(NO_CONCEPT)).alias("note_nlp_concept_name"), "counter",
        )
        .distinct()
    )


def matched(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.filter(F.col("counter").isNotNull())


def unmatched(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.filter(F.col("counter").isNull())


def visit_core(crosswalk: DataFrame) -> DataFrame:
    """Distinct visits of a crosswalk."""
    return crosswalk.select(
        "encounter_number", "mrn", "visit_start_datetime", "visit_end_datetime", "visit_concept_name"
    ).distinct()
