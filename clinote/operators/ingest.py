"""Raw documents to notes, and ids for new mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clinote.functions import ranking

# Standard concept ids of the CDM note table.
EHR_NOTE_TYPE = 32817
DISCHARGE_SUMMARY_CLASS = 706531
UTF8_ENCODING = 32678
ENGLISH_LANGUAGE = 4180186


def documents_to_note(
    documents: DataFrame,
    *,
    note_type_concept_id: int = EHR_NOTE_TYPE,
    note_class_concept_id: int = DISCHARGE_SUMMARY_CLASS,
    encoding_concept_id: int = UTF8_ENCODING,
    language_concept_id: int = ENGLISH_LANGUAGE,
) -> DataFrame:
    """Map staged documents onto the note table: renames, casts, constant concepts, typed nulls.

    A key that is not a number becomes null; ``schemas.violations`` on the result counts them.
    """
    return documents.select(
        F.col("id").try_cast("bigint").alias("note_id"),
        F.col("patient_id").try_cast("bigint").alias("person_id"),
        F.to_date("document_datetime").alias("note_date"),
        F.col("document_datetime").alias("note_datetime"),
        F.lit(note_type_concept_id).alias("note_type_concept_id"),
        F.lit(note_class_concept_id).alias("note_class_concept_id"),
        F.col("document_type").alias("note_title"),
        F.col("file_text").alias("note_text"),
        F.lit(encoding_concept_id).alias("encoding_concept_id"),
        F.lit(language_concept_id).alias("language_concept_id"),
        F.lit(None).cast("int").alias("provider_id"),
        F.col("encounter_id").try_cast("bigint").alias("visit_occurrence_id"),
        F.lit(None).cast("int").alias("visit_detail_id"),
        F.col("mapped_document_type").alias("note_source_value"),
    )


def _mention_key(mentions: DataFrame) -> list[str]:
    key = ["note_id", "offset", "note_nlp_concept_id", "lexical_variant"]
    return [*key, "term"] if "term" in mentions.columns else key


def assign_nlp_id(mentions: DataFrame, *, dense: bool = False) -> DataFrame:
    """Add ``note_nlp_id`` to new mentions.

    By default a 64-bit hash of (note, offset, concept, variant) and the term where there
    is one: no shuffle, and the same mention always gets the same id. Hashes of some
    billions of mentions meet by chance. With ``dense`` the ids run 1..n without gaps, as a
    sequence would give, in order of a digest of that key so that ranking stays parallel;
    the keys alone are ranked, and the number is joined to the rows.
    """
    key = _mention_key(mentions)
    if not dense:
        return mentions.select(F.xxhash64(*key).alias("note_nlp_id"), "*")
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key[:4]]))
    ranked = ranking.with_key_position(mentions, key, digest, "_position")
    return ranked.select((F.col("_position") + 1).alias("note_nlp_id"), *mentions.columns)
