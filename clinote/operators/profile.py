"""Counts of notes, visits and persons, overall and by note class and concept.

Mentions are reduced to one row per note (and concept) before they meet the notes, so
the distinct counts expand note rows and not mention rows. The distinct counts are exact
unless ``approximate`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clinote.functions.text import certainty_is


def _distinct(column: str, approximate: bool) -> Column:
    return F.approx_count_distinct(column) if approximate else F.count_distinct(column)


def _class_names(concepts: DataFrame) -> DataFrame:
    return concepts.select(
        F.col("concept_id").alias("note_class_concept_id"),
        F.col("concept_name").alias("note_class_concept_name"),
    )


def _mention_names(concepts: DataFrame) -> DataFrame:
    return concepts.select(
        F.col("concept_id").alias("note_nlp_concept_id"),
        F.col("concept_name").alias("note_nlp_concept_name"),
    )


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows by key."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def totals(notes: DataFrame, *, approximate: bool = False) -> DataFrame:
    return notes.agg(
        F.count("*").alias("n_r"),
        _distinct("visit_occurrence_id", approximate).alias("n_visits"),
        _distinct("person_id", approximate).alias("n"),
    )


def notes_in_class(notes: DataFrame, concepts: DataFrame, classes: list[str]) -> DataFrame:
    """Notes whose class has one of the given names, with that name."""
    wanted = _class_names(concepts).filter(F.col("note_class_concept_name").isin(classes))
    return notes.join(wanted, "note_class_concept_id")


def by_class(notes: DataFrame, concepts: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Notes, visits and persons per note class; the class name is looked up after counting."""
    counts = notes.groupBy("note_class_concept_id").agg(
        F.count("*").alias("n_r"),
        _distinct("visit_occurrence_id", approximate).alias("n_visits"),
        _distinct("person_id", approximate).alias("n"),
    )
    return counts.join(_class_names(concepts), "note_class_concept_id").select(
        "n_r", "n_visits", "n", "note_class_concept_name", "note_class_concept_id"
    )


def match_coverage(
    notes: DataFrame, mentions: DataFrame, concepts: DataFrame, *, approximate: bool = False
) -> DataFrame:
    """Mentions, and notes, visits and persons with at least one mention, per note class."""
    per_note = mentions.groupBy("note_id").agg(F.count("*").alias("n_mentions"))
    matched = (
        notes.select("note_id", "visit_occurrence_id", "person_id", "note_class_concept_id")
        .join(per_note, "note_id")
        .join(_class_names(concepts), "note_class_concept_id")
    )
    return matched.groupBy("note_class_concept_name").agg(
        F.sum("n_mentions").alias("n_r"),
        _distinct("note_id", approximate).alias("n_notes"),
        _distinct("visit_occurrence_id", approximate).alias("n_visits"),
        _distinct("person_id", approximate).alias("n"),
    )


def by_class_and_concept(
    notes: DataFrame,
    mentions: DataFrame,
    concepts: DataFrame,
    *,
    certainty: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """``match_coverage`` split by mention concept too, for one certainty or for all mentions."""
    if certainty is not None:
        mentions = mentions.filter(certainty_is(F.col("term_modifiers"), certainty))
    per_note = mentions.groupBy("note_id", "note_nlp_concept_id").agg(F.count("*").alias("n_mentions"))
    matched = (
        notes.select("note_id", "visit_occurrence_id", "person_id", "note_class_concept_id")
        .join(per_note, "note_id")
        .join(_class_names(concepts), "note_class_concept_id")
    )
    counts = matched.groupBy("note_class_concept_name", "note_nlp_concept_id").agg(
        F.sum("n_mentions").alias("n_r"),
        _distinct("note_id", approximate).alias("n_notes"),
        _distinct("visit_occurrence_id", approximate).alias("n_visits"),
        _distinct("person_id", approximate).alias("n"),
    )
    return counts.join(_mention_names(concepts), "note_nlp_concept_id").select(
        "n_r", "n_notes", "n_visits", "n",
        "note_class_concept_name", "note_nlp_concept_id", "note_nlp_concept_name",
    )


def with_encounter(mentions: DataFrame, notes: DataFrame) -> DataFrame:
    """Mentions with the ``encounter_number`` of their note, to be stored by it; mentions of unknown notes go."""
    numbers = notes.select("note_id", F.col("visit_occurrence_id").alias("encounter_number"))
    return mentions.join(numbers, "note_id")


def drill_down(
    notes: DataFrame, mentions: DataFrame, concepts: DataFrame, *, encounter_number: int, concept_name: str
) -> DataFrame:
    """All mentions of one concept in the notes of one encounter, with both names.

    Mentions ``with_encounter`` are filtered by it in their scan, which skips what a clustered table holds of others.
    """
    if "encounter_number" in mentions.columns:
        mentions = mentions.filter(F.col("encounter_number") == encounter_number).drop("encounter_number")
    wanted_notes = notes.filter(F.col("visit_occurrence_id") == encounter_number)
    wanted_concept = _mention_names(concepts).filter(F.col("note_nlp_concept_name") == concept_name)
    return (
        wanted_notes.join(mentions, "note_id")
        .join(wanted_concept, "note_nlp_concept_id")
        .join(_class_names(concepts), "note_class_concept_id")
    )


def for_reading(profile: DataFrame) -> DataFrame:
    """Presentation order of a profile: by note class, then concept, where it has them."""
    names = [c for c in ("note_class_concept_name", "note_nlp_concept_name") if c in profile.columns]
    return profile.orderBy(*names) if names else profile
