"""Profiles that are kept up by period: counts add up and sketches of distinct keys merge, so old notes are not read again.

A sketch of ``2 ** lg_k`` registers has a relative standard error of about ``1.04 / sqrt(2 ** lg_k)``; ``error_bound``
is three of these. Rows and notes are exact, as a note lies in one period.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, BinaryType, StructField, StructType

LG_K = 12
CLASS, CONCEPT = "note_class_concept_id", "note_nlp_concept_id"

STORED = StructType([
    StructField(CLASS, IntegerType()),
    StructField(CONCEPT, IntegerType()),
    StructField("n_r", LongType()),
    StructField("n_notes", LongType()),
    StructField("visits", BinaryType()),
    StructField("persons", BinaryType()),
    StructField("period", DateType()),
])


def error_bound(lg_k: int = LG_K) -> float:
    """Relative error that an estimate exceeds about once in 400 times."""
    return 3 * 1.04 / math.sqrt(2**lg_k)


def period_of(day: Column, unit: str) -> Column:
    return F.date_trunc(unit, day).cast("date")


def by_period(notes: DataFrame, mentions: DataFrame | None = None, *, unit: str = "day", lg_k: int = LG_K) -> DataFrame:
    """Counts and sketches per period and note class, and where mentions are given, per concept of the matched notes.

    Mentions are counted per note before they meet the notes. Without mentions ``n_r`` counts notes, and the concept is null.
    """
    rows = notes.select(
        period_of(F.col("note_date"), unit).alias("period"), CLASS, "note_id", "visit_occurrence_id", "person_id"
    )
    if mentions is None:
        rows = rows.withColumn(CONCEPT, F.lit(None).cast("int")).withColumn("n_mentions", F.lit(1))
    else:
        per_note = mentions.groupBy("note_id", F.col(CONCEPT).cast("int").alias(CONCEPT)).agg(F.count("*").alias("n_mentions"))
        rows = rows.join(per_note, "note_id")
    return rows.groupBy(F.col(CLASS).cast("int").alias(CLASS), CONCEPT, "period").agg(
        F.sum("n_mentions").cast("long").alias("n_r"),
        F.count("*").alias("n_notes"),
        F.hll_sketch_agg("visit_occurrence_id", lg_k).alias("visits"),
        F.hll_sketch_agg("person_id", lg_k).alias("persons"),
    ).select(*STORED.names)


def refresh(
    notes: DataFrame,
    path: str,
    mentions: DataFrame | None = None,
    *,
    periods: Sequence[dt.date] | None = None,
    unit: str = "day",
    lg_k: int = LG_K,
) -> None:
    """Write the profile of all periods, or anew that of the given ones (first days of a ``unit``); the rest stays.

    The given periods are a range filter on ``note_date``, so notes stored in folders or ranges of it are read for these
    periods alone. Running it twice equals once; a period that lost all its notes counts nothing.
    """
    spark = notes.sparkSession
    writer_mode = "static"
    if periods is not None:
        if not periods:
            return
        day = F.col("note_date")
        notes = notes.filter((day >= min(periods)) & period_of(day, unit).isin(list(periods)))
        notes = notes.filter(day < _after(max(periods), unit))
        writer_mode = "dynamic"
    profile = by_period(notes, mentions, unit=unit, lg_k=lg_k)
    if periods is not None:
        # A folder without rows would not be replaced: each given period has a row that counts nothing.
        nothing = spark.createDataFrame([(p,) for p in periods], "period date")
        profile = profile.unionByName(nothing, allowMissingColumns=True)
    profile.repartition("period").write.mode("overwrite").option("partitionOverwriteMode", writer_mode).partitionBy(
        "period"
    ).parquet(path)


def _after(first: dt.date, unit: str) -> dt.date:
    """The first day behind a period."""
    days = {"day": 1, "week": 7}
    if unit in days:
        return first + dt.timedelta(days=days[unit])
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    index = first.year * 12 + first.month - 1 + months
    return dt.date(index // 12, index % 12 + 1, 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path).filter(F.col("n_r") > 0)


def merge(stored: DataFrame, *by: str) -> DataFrame:
    """``n_r, n_notes`` exact, ``n_visits, n`` estimated, per given columns or overall, from stored periods.

    With mentions, a note counts in ``n_notes`` once per concept: group by the concept, or read ``n_r`` alone.
    """
    merged = stored.groupBy(*by).agg(
        F.sum("n_r").alias("n_r"),
        F.sum("n_notes").alias("n_notes"),
        F.hll_sketch_estimate(F.hll_union_agg("visits")).alias("n_visits"),
        F.hll_sketch_estimate(F.hll_union_agg("persons")).alias("n"),
    )
    return merged


def within(estimate: Column, exact: Column, lg_k: int = LG_K) -> Column:
    """True where an estimate keeps to the error bound; counts below 1 / bound must agree to one."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * error_bound(lg_k))
