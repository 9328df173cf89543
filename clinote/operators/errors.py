"""Text behind false positives and false negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from clinote.functions.text import after_last_equals, spreadsheet_safe
from clinote.operators import evaluate, ner

FALSE_POSITIVE = "fp"
FALSE_NEGATIVE = "fn"


def error_rows(compared: DataFrame, pairs: Sequence[evaluate.Pair], kind: str) -> DataFrame:
    """``encounter_number, note_nlp_concept_name`` of every wrong row and pair, all pairs at once."""
    if kind not in (FALSE_POSITIVE, FALSE_NEGATIVE):
        raise ValueError("kind is 'fp' or 'fn'")
    return (
        evaluate.long_flags(compared, pairs, keep=["encounter_number"])
        .filter(F.col(kind) == 1)
        .select("encounter_number", after_last_equals(F.col("concept_column")).alias("note_nlp_concept_name"))
    )


def error_mentions(compared: DataFrame, pairs: Sequence[evaluate.Pair], kind: str, crosswalk: DataFrame) -> DataFrame:
    """Crosswalk rows of the errors.

    Pass the positive crosswalk for ``fp`` and the negated one for ``fn``: a false negative is looked up
    among the mentions tagged as negated, so one without any gives no row.
    """
    return error_rows(compared, pairs, kind).join(crosswalk, ["encounter_number", "note_nlp_concept_name"])


def examples(found: DataFrame, mentions: DataFrame, corpus: DataFrame, *, exclude_ids: list[int]) -> DataFrame:
    """Errors (``error_mentions``) with their mentions and texts.

    Mentions are reduced to those of the errors before they are cleaned and located.
    ``found`` and ``corpus`` (``sha1, text``) should be written tables, as both are read
    twice; documents are numbered on their keys alone, and the text is joined last.
    """
    wanted = mentions.join(found.select("note_nlp_id").distinct(), "note_nlp_id", "left_semi")
    meta = ner.metadata(ner.prepare(wanted, exclude_ids=exclude_ids)).select(
        "sha1",
        "lexical_variant",
        F.col("note_id").alias("meta_note_id"),
        "note_nlp_id",
        "term_modifiers",
        F.col("note_nlp_concept_id").alias("meta_note_nlp_concept_id"),
        "offsets",
    )
    return (
        found.join(meta, "note_nlp_id")
        .join(ner.with_position(corpus.select("sha1")), "sha1")
        .join(corpus.select("sha1", "text"), "sha1")
        .withColumn("text", spreadsheet_safe(F.col("text")))
    )


def for_reading(found: DataFrame) -> DataFrame:
    """Presentation order of the examples."""
    return found.orderBy("encounter_number", "note_class_concept_id", "note_id", "sha1")
