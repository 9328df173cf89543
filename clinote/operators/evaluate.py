"""Scoring of concept columns against reviewed columns.

Outcome per row and pair: the reviewed value decides whether the row counts at all
(``Yes`` or ``No``), and a missing concept value counts as negative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clinote.functions.text import after_last_equals, drop_last_segment

FLAGS = ["fp", "fn", "tp", "tn"]
Pair = tuple[str, str]


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def outcome_flags(gold: Column, predicted: Column) -> dict[str, Column]:
    """Four 1 / 0 / null columns; null where the reviewed value does not decide the flag."""
    is_yes = F.coalesce(predicted == "Yes", F.lit(False))
    missing = predicted.isNull()
    on_no, on_yes = gold == "No", gold == "Yes"
    return {
        "fp": F.when(on_no, is_yes.cast("int")),
        "fn": F.when(on_yes, missing.cast("int")),
        "tp": F.when(on_yes, is_yes.cast("int")),
        "tn": F.when(on_no, missing.cast("int")),
    }


def long_flags(df: DataFrame, pairs: Sequence[Pair], keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row and pair with the four flags; one pass, whatever the number of pairs."""
    entries = []
    for chart, concept in pairs:
        flags = outcome_flags(_column(chart), _column(concept))
        entries.append(F.struct(
            F.lit(chart).alias("chart_column"),
            F.lit(concept).alias("concept_column"),
            *[flags[f].alias(f) for f in FLAGS],
        ))
    return df.select(*[_column(k) for k in keep], F.inline(F.array(*entries)))


def with_flags(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Append ``<concept column>|fp``, ``|fn``, ``|tp``, ``|tn`` for every pair."""
    concepts = [concept for _, concept in pairs]
    if len(set(concepts)) != len(concepts):
        raise ValueError("two pairs share a concept column; their flag columns would collide")
    added = [
        flag.alias(f"{concept}|{name}")
        for chart, concept in pairs
        for name, flag in outcome_flags(_column(chart), _column(concept)).items()
    ]
    return df.select("*", *added)


def confusion(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Sums of the flags per pair over the rows of ``df``; a pair without countable rows has zeros."""
    totals = [F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FLAGS]
    return long_flags(df, pairs).groupBy("chart_column", "concept_column").agg(*totals)


def metrics(counts: DataFrame) -> DataFrame:
    """Sensitivity, specificity, PPV and frequency per pair; null on an empty denominator."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        drop_last_segment(F.col("chart_column")).alias("chart_review"),
        after_last_equals(F.col("concept_column")).alias("note_nlp_concept_name"),
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tp, tp + fp).alias("ppv"),
        F.try_divide(tp + fn, tp + fn + tn + fp).alias("frequency"),
        "tp", "tn", "fp", "fn",
    )
