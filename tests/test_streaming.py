from pyspark.sql import functions as F

from clinote import schemas
from clinote.plans.tagging import tag_notes
from clinote.session import scratch_path
from clinote.streaming import tagging


def note_rows(spark, ids):
    texts = spark.createDataFrame([(i, f"patient {i} has cough, no fever") for i in ids], "note_id long, note_text string")
    columns = [
        F.col(f.name) if f.name in texts.columns
        else (F.lit(None) if f.nullable else F.lit("2020-01-01" if f.name == "note_date" else 1)).cast(f.dataType).alias(f.name)
        for f in schemas.NOTE.fields
    ]
    return texts.select(*columns)


def test_stream_equals_batch_and_resumes(spark):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("notes", "mentions", "stream"))
    lexicon = spark.createDataFrame([(1, "cough"), (2, "fever")], "concept_id int, term string")

    def run():
        query = tagging.start(tagging.read_notes(spark, source), lexicon, target, checkpoint)
        query.awaitTermination(60)

    note_rows(spark, range(3)).write.parquet(source)
    run()
    note_rows(spark, range(3, 5)).write.mode("append").parquet(source)
    run()
    stored = {r["note_nlp_id"] for r in spark.read.parquet(target).collect()}
    batch = {r["note_nlp_id"] for r in tag_notes(note_rows(spark, range(5)), lexicon).collect()}
    assert stored == batch and len(stored) == 10
    assert spark.read.parquet(target).count() == 10


def test_rules_join_the_dictionary(spark):
    lexicon = spark.createDataFrame([(1, "cough")], "concept_id int, term string")
    both = tag_notes(note_rows(spark, range(2)), lexicon, rules=[(2, "fev[a-z]+")], cue_window=1)
    assert both.groupBy("note_nlp_concept_id").count().count() == 2
    negated = both.filter("note_nlp_concept_id = 2").select("term_modifiers").distinct().collect()
    assert [r[0] for r in negated] == ["certainty=Negated,experiencer=Patient"]
