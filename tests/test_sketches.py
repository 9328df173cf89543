"""Stored profiles by period: exact counts, estimates within their bound, refreshes that read their period alone."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from clinote.operators import profile, sketches
from clinote.sources import sinks

START = dt.date(2020, 1, 30)


@pytest.fixture
def notes(spark):
    n = F.col("id")
    return spark.range(20_000).select(
        n.alias("note_id"), (n % 6000 * 31).alias("person_id"), F.when(n % 50 != 0, n % 15_000).alias("visit_occurrence_id"),
        F.date_add(F.lit(START), (n % 5).cast("int")).alias("note_date"),
        # Class 201 holds most notes.
        F.when(n % 10 == 0, 202).otherwise(201).alias("note_class_concept_id"),
    )


def figures(spark, path):
    found = sketches.merge(sketches.read(spark, path), sketches.CLASS)
    return {r[sketches.CLASS]: r.asDict() for r in found.collect()}


def test_estimates_keep_to_the_bound(spark, notes, tmp_path):
    path = str(tmp_path / "p")
    sketches.refresh(notes, path)
    exact = notes.groupBy(sketches.CLASS).agg(
        F.count("*").alias("n_r"), F.count_distinct("visit_occurrence_id").alias("n_visits"),
        F.count_distinct("person_id").alias("n"),
    )
    merged = figures(spark, path)
    for row in exact.collect():
        got = merged.pop(row[sketches.CLASS])
        assert got["n_r"] == got["n_notes"] == row["n_r"]
        for name in ("n_visits", "n"):
            assert abs(got[name] - row[name]) <= sketches.error_bound() * row[name]
    assert not merged
    overall = sketches.merge(sketches.read(spark, path)).first()
    wanted = profile.totals(notes).first()
    assert overall["n_r"] == wanted["n_r"]
    assert abs(overall["n"] - wanted["n"]) <= sketches.error_bound() * wanted["n"]


def test_a_day_is_refreshed_alone(spark, notes, tmp_path):
    path, source = str(tmp_path / "p"), str(tmp_path / "notes")
    days = [START + dt.timedelta(days=i) for i in range(5)]
    sketches.refresh(notes.filter(F.col("note_date") < F.lit(days[4])), path)
    assert sum(r["n_r"] for r in figures(spark, path).values()) == 16_000
    sinks.write_table(notes, source, partition_by=["note_date"])
    stored = spark.read.schema(notes.schema).parquet(source)
    for _ in range(2):
        sketches.refresh(stored, path, periods=[days[4]])
        assert sum(r["n_r"] for r in figures(spark, path).values()) == 20_000
    whole = str(tmp_path / "whole")
    sketches.refresh(notes, whole)
    assert figures(spark, path) == figures(spark, whole)
    # A day without notes any more.
    sketches.refresh(stored.filter(F.col("note_date") != F.lit(days[1])), path, periods=days[1:3])
    assert sum(r["n_r"] for r in figures(spark, path).values()) == 16_000
    sketches.refresh(stored, path, periods=[])
    assert sum(r["n_r"] for r in figures(spark, path).values()) == 16_000


def test_a_refresh_reads_its_folder_alone(spark, notes, tmp_path, monkeypatch):
    source = str(tmp_path / "notes")
    sinks.write_table(notes, source, partition_by=["note_date"])
    read = []

    def watched(df, *args, **kwargs):
        files = df.select(F.input_file_name()).distinct().collect()
        read.extend(re.search(r"note_date=([^/]+)", r[0])[1] for r in files)
        return by_period(df, *args, **kwargs)

    by_period = sketches.by_period
    monkeypatch.setattr(sketches, "by_period", watched)
    sketches.refresh(spark.read.schema(notes.schema).parquet(source), str(tmp_path / "p"), periods=[START])
    assert set(read) == {str(START)}


@pytest.mark.parametrize("unit, first, n_r", [("month", dt.date(2020, 2, 1), 12_000), ("week", dt.date(2020, 1, 27), 16_000)])
def test_longer_periods(spark, notes, tmp_path, unit, first, n_r):
    path = str(tmp_path / "p")
    sketches.refresh(notes, path, unit=unit, periods=[first])
    assert sum(r["n_r"] for r in figures(spark, path).values()) == n_r
    assert {r["period"] for r in sketches.read(spark, path).collect()} == {first}


@pytest.mark.parametrize("unit, first, after", [
    ("day", dt.date(2020, 2, 28), dt.date(2020, 2, 29)), ("week", dt.date(2020, 12, 28), dt.date(2021, 1, 4)),
    ("month", dt.date(2020, 12, 1), dt.date(2021, 1, 1)), ("quarter", dt.date(2020, 10, 1), dt.date(2021, 1, 1)),
    ("year", dt.date(2020, 1, 1), dt.date(2021, 1, 1)),
])
def test_ends_of_periods(unit, first, after):
    assert sketches._after(first, unit) == after


def test_mentions_by_concept(spark, notes, tmp_path, rows):
    path = str(tmp_path / "p")
    # A third of the mentions lies in one note.
    mentions = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 11).otherwise(F.col("id") % 25_000).alias("note_id"),
        (F.col("id") % 4).cast("int").alias("note_nlp_concept_id"),
    )
    sketches.refresh(notes, path, mentions)
    merged = sketches.merge(sketches.read(spark, path), sketches.CLASS, sketches.CONCEPT)
    exact = notes.join(mentions, "note_id").groupBy(sketches.CLASS, sketches.CONCEPT).agg(
        F.count("*").alias("n_r"), F.count_distinct("note_id").alias("n_notes")
    )
    assert rows(merged.drop("n_visits", "n")) == rows(exact)


def test_empty_notes_and_null_days(spark, notes, tmp_path):
    path = str(tmp_path / "p")
    sketches.refresh(notes.limit(0), path)
    assert figures(spark, path) == {}
    sketches.refresh(notes.withColumn("note_date", F.lit(None).cast("date")), path)
    assert sum(r["n_r"] for r in figures(spark, path).values()) == 20_000
