"""Cohorts: checked positive visits, and follow-up notes after a positive result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clinote.functions.keys import numeric_key


def with_numeric_encounter(visits: DataFrame) -> DataFrame:
    """Visits with a usable encounter number, as bigint; bad keys are dropped."""
    return visits.withColumn("encounter_number", numeric_key(F.col("encounter_number"))).filter(
        F.col("encounter_number").isNotNull()
    )


def checked_visits(visits: DataFrame, checked: DataFrame, *, status: str = "positive") -> DataFrame:
    """Visits with an encounter number and the status, once per entry in the checked index."""
    eligible = visits.filter(F.col("encounter_number").isNotNull() & (F.col("covid19_status") == status))
    return eligible.join(checked.select("visit_occurrence_id"), "visit_occurrence_id")


def selected_visits(visits: DataFrame, checked: DataFrame, *, status: str = "positive") -> DataFrame:
    """Checked visits with a numeric encounter number; repeats in the checked index repeat the visit."""
    return with_numeric_encounter(checked_visits(visits, checked, status=status)).select(
        "encounter_number", "visit_start_datetime", "visit_end_datetime", "visit_concept_name"
    )


def distinct_selected_visits(visits: DataFrame, checked: DataFrame, *, status: str = "positive") -> DataFrame:
    """``selected_visits`` without repeats: being in the index is tested, not joined.

    The index is made distinct first, which combines before the shuffle: the tested side of
    a semi join cannot be split, so one visit listed very often must not reach it whole.
    """
    index = checked.select("visit_occurrence_id").distinct()
    eligible = visits.filter(F.col("covid19_status") == status).join(index, "visit_occurrence_id", "left_semi")
    return with_numeric_encounter(eligible).select(
        "encounter_number", "visit_start_datetime", "visit_end_datetime", "visit_concept_name"
    ).distinct()


def followup_notes(
    physician_notes: DataFrame,
    encounters: DataFrame,
    results: DataFrame,
    conditions: DataFrame,
    *,
    condition_code: str = "U09.9",
    excluded_types: tuple[str, ...] = ("Ambulatory Patient Summary",),
    classification: str = "Outpatient",
    months: int = 1,
) -> DataFrame:
    """Outpatient notes of documents dated at least ``months`` after a positive result.

    Only persons with the condition code count. A later positive result never qualifies a
    note that the earliest one does not, so one date per patient is enough. The notes to
    return are settled on keys alone; their text is joined once, at the end, by a key pair
    that spreads evenly even where one encounter holds very many notes.
    """
    with_condition = (
        conditions.filter(F.col("condition_source_concept_code") == condition_code).select("person_id").distinct()
    )
    first_positive = (
        results.filter(F.col("positive_datetime").isNotNull())
        .join(with_condition, "person_id", "left_semi")
        .groupBy(F.col("mrn").alias("patient_id"))
        .agg(F.min("positive_datetime").alias("first_positive"))
    )
    earliest = F.col("first_positive") + F.expr(f"interval {int(months)} month")
    qualifying = (
        physician_notes.select("document_id", "patient_id", "document_datetime")
        .join(first_positive, "patient_id")
        .filter(F.col("document_datetime") >= earliest)
        .select("document_id")
        .distinct()
    )
    outpatient = encounters.filter(F.col("classification_display") == classification).select(
        F.col("encounter_number").alias("encounter_id"), "service_delivery_location"
    )
    wanted = physician_notes.filter(~F.col("document_type").isin(*excluded_types))
    keys = (
        wanted.select("document_id", "encounter_id")
        .distinct()
        .join(qualifying, "document_id", "left_semi")
        .join(outpatient, "encounter_id")
    )
    return wanted.join(keys, ["document_id", "encounter_id"]).select(
        *physician_notes.columns, "service_delivery_location"
    )
