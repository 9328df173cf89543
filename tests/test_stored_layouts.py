"""Buckets that joins need not shuffle, files that filters skip, and counts that writes give."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clinote.operators import profile
from clinote.plans import comparison
from clinote.session import store_counted
from clinote.sources import layout

NO_BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def without_broadcast(spark):
    for key in NO_BROADCAST:
        spark.conf.set(key, "-1")
    yield
    for key in NO_BROADCAST:
        spark.conf.unset(key)


def stored(spark, tmp_path, name, df, **options):
    path = str(tmp_path / name)
    layout.write_bucketed(df, path, "note_id", 4, **options)
    return path


@pytest.fixture
def sides(spark):
    notes = spark.range(1000).select(
        F.col("id").alias("note_id"), (F.col("id") % 7).alias("person_id"), (F.col("id") % 300).alias("visit_occurrence_id"),
        (F.col("id") % 3 + 1).cast("int").alias("note_class_concept_id"),
    )
    # A third of the mentions lies in one note; some have none.
    note = F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 11 != 0, F.col("id") % 1200)
    return notes, spark.range(9000).select(note.alias("note_id"), F.col("id").alias("note_nlp_id"), F.lit("w").alias("word"))


@pytest.mark.parametrize("splits", [1, 3])
def test_stored_buckets_join_without_a_shuffle(spark, tmp_path, sides, without_broadcast, rows, splits):
    notes, mentions = sides
    read = [
        layout.read_bucketed(spark, stored(spark, tmp_path, name, df, splits=splits), df.schema)
        for name, df in (("notes", notes), ("mentions", mentions))
    ]
    assert [r.schema.simpleString() for r in read] == [notes.schema.simpleString(), mentions.schema.simpleString()]
    joined = read[0].join(read[1], "note_id")
    counted = read[1].groupBy("note_id").count()
    for df in (joined, counted):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(joined) == rows(notes.join(mentions, "note_id"))
    assert rows(counted) == rows(mentions.groupBy("note_id").count())
    assert rows(read[1]) == rows(mentions)
    names = spark.range(1, 4).select(F.col("id").cast("int").alias("concept_id"), F.lit("c").alias("concept_name"))
    covered = profile.match_coverage(*read, names)
    assert "hashpartitioning(note_id" not in covered._jdf.queryExecution().executedPlan().toString()


def test_a_large_bucket_is_read_without_its_layout(spark, tmp_path, sides, without_broadcast, rows):
    """One task would read the bucket of a hot note: the files are read as they are."""
    notes, mentions = sides
    paths = [stored(spark, tmp_path, name, df) for name, df in (("notes", notes), ("mentions", mentions))]
    sizes = layout.bucket_bytes(spark, paths[1])
    assert set(sizes) <= set(range(4)) and sum(sizes.values()) > 0
    read = layout.read_bucketed(spark, paths[1], mentions.schema, max_bucket_bytes=max(sizes.values()) - 1)
    joined = layout.read_bucketed(spark, paths[0], notes.schema).join(read, "note_id")
    assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    assert rows(joined) == rows(notes.join(mentions, "note_id"))


def test_a_table_of_another_session_and_empty_ones(spark, tmp_path, sides, rows):
    _, mentions = sides
    path = stored(spark, tmp_path, "mentions", mentions)
    for table in [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]:
        spark.sql(f"drop table {table}")
    assert rows(layout.read_bucketed(spark, path, mentions.schema)) == rows(mentions)
    with pytest.raises(ValueError, match="holds a bucketed table"):
        layout.write_bucketed(mentions, path, "note_id", 8)
    with pytest.raises(ValueError, match="holds no bucketed table"):
        layout.read_bucketed(spark, str(tmp_path / "none"), mentions.schema)
    empty = stored(spark, tmp_path, "empty", mentions.limit(0))
    assert layout.read_bucketed(spark, empty, mentions.schema).count() == 0


def rows_scanned(df):
    """Rows that the scan gave to the plan: those of the row groups that it read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def row_groups(path):
    files = [pq.ParquetFile(name).metadata for name in glob.glob(f"{path}/*.parquet")]
    return [f.row_group(i) for f in files for i in range(f.num_row_groups)]


@pytest.fixture
def clustered(spark, tmp_path):
    """400,000 mentions by encounter in many row groups; their notes' numbers are scattered."""
    # Half of the rows lie in encounter 7.
    encounter = F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000)
    df = spark.range(400_000).select(
        F.xxhash64("id").alias("note_id"), encounter.alias("encounter_number"), F.sha1(F.col("id").cast("string")).alias("word")
    )
    path = str(tmp_path / "clustered")
    layout.write_clustered(df, path, ["encounter_number"], bloom={"note_id": 20_000}, row_group_bytes=512 * 1024)
    return df, path


def test_scan_skips_other_encounters(spark, clustered, rows):
    df, path = clustered
    groups = row_groups(path)
    stated = [g.column(1).statistics for g in groups]
    holding = [g.num_rows for g, s in zip(groups, stated) if s.min <= 4321 <= s.max]
    assert len(groups) >= 16 and len(holding) <= 2
    read = spark.read.schema(df.schema).parquet(path)
    found = read.filter("encounter_number = 4321")
    assert 0 < rows_scanned(found) <= sum(holding)
    assert rows(found) == rows(df.filter("encounter_number = 4321"))
    assert rows(read) == rows(df)


def test_a_hot_encounter_is_dealt_to_many_files(spark, clustered):
    df, path = clustered
    files = [pq.ParquetFile(name).metadata.num_rows for name in glob.glob(f"{path}/*.parquet")]
    assert len(files) >= 6 and max(files) < 400_000 / 3


def test_scan_skips_by_bloom_filters(spark, clustered, rows):
    """The wanted number lies within the bounds of every row group."""
    df, path = clustered
    one = df.filter("encounter_number = 4321").agg(F.min("note_id")).first()[0]
    holding = [g for g in row_groups(path) if g.column(0).statistics.min <= one <= g.column(0).statistics.max]
    found = spark.read.schema(df.schema).parquet(path).filter(F.col("note_id") == one)
    assert len(holding) >= 16
    # About one of 100 groups passes its filter by chance.
    assert 0 < rows_scanned(found) <= 400_000 / 5
    assert rows(found) == rows(df.filter(F.col("note_id") == one))


def test_writes_count_their_rows(spark, sides):
    notes, mentions = sides
    joined = notes.join(mentions, "note_id").withColumn("even", F.col("note_nlp_id") % 2 == 0)
    frame, counts = store_counted(spark, joined, "all of them", {"even": F.col("even"), "none": F.lit(False)})
    assert counts == {"all of them": joined.count(), "even": joined.filter("even").count(), "none": 0}
    assert frame.count() == counts["all of them"]


def test_counts_of_empty_frames(spark, sides):
    for empty in (sides[0].limit(0), sides[0].filter("false"), spark.createDataFrame([], "a int")):
        assert store_counted(spark, empty, "empty", {"part": F.lit(True)})[1] == {"empty": 0, "part": 0}


def test_stages_report_what_they_wrote(spark, sides, rows):
    stages = comparison.CountedStages(spark)
    notes = stages.store("notes", sides[0], {"first class": F.col("note_class_concept_id") == 1})
    stages.store("visits", notes.select("visit_occurrence_id").distinct())
    assert rows(stages.report()) == [("first class", 334), ("notes", 1000), ("visits", 300)]
