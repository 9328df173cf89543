import random
import re

import pytest
from pyspark.sql import functions as F
from test_tagger import LEXICON, NOTE, long_note, notes

from clinote.operators import automaton, tagger
from workload import fixtures as fx


def both(spark, texts, terms, **options):
    lexicon = spark.createDataFrame(terms, "concept_id int, term string")
    frame = notes(spark, *texts)
    found = [sorted(map(repr, d.collect())) for d in (tagger.tag(frame, lexicon, **options), automaton.tag(frame, lexicon, **options))]
    return found


def test_finds_what_the_join_finds(spark):
    join, scan = both(spark, [NOTE, "", None, NOTE * 3], LEXICON)
    assert join == scan and len(join) == 22


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_and_lexicons(spark, seed):
    draw = random.Random(seed)
    words = ["a", "b", "A-b", "é", "x1", "(a", "b)", "c++", "日本"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", "  ", "-", ", ", "\n", ". "]) for _ in range(draw.choice([1, 5, 700]))) for _ in range(12)]
    terms = [(k % 5, "".join(draw.choice(words) + draw.choice([" ", "-", ", "]) for _ in range(draw.randrange(1, 5))).rstrip(" -,"))
             for k in range(60)]
    join, scan = both(spark, texts, terms, cues=["b", "x1"], cue_window=3, snippet_radius=10)
    assert join == scan and join


@pytest.mark.parametrize("words", [127, 128, 129, 3000])
def test_lanes_lose_no_term(spark, words):
    join, scan = both(spark, [long_note(words, words)] * 2, LEXICON + [(9, "no the abc"), (9, "the abc the abc no")])
    assert join == scan


def test_repeated_ids_and_terms_stay(spark):
    frame = notes(spark, "cough cough").union(notes(spark, "cough cough"))
    lexicon = spark.createDataFrame([(1, "cough"), (1, "Cough"), (2, "cough")], "concept_id int, term string")
    assert automaton.tag(frame, lexicon).count() == tagger.tag(frame, lexicon).count() == 8


def test_leftmost_longest(spark, rows):
    terms = [(1, "shortness of breath"), (2, "shortness"), (3, "of breath at rest"), (4, "at rest"), (5, "breath"), (6, "Shortness of Breath")]
    lexicon = spark.createDataFrame(terms, "concept_id int, term string")
    text = "shortness of breath at rest, breath; of breath at rest"
    found = automaton.tag(notes(spark, text, text), lexicon, overlaps=automaton.LONGEST)
    assert rows(found.filter("note_id = 1"), "start", "concept_id") == sorted([(0, 1), (0, 6), (20, 4), (29, 5), (37, 3)], key=repr)
    with pytest.raises(ValueError):
        automaton.tag(notes(spark, text), lexicon, overlaps="some")


def test_odd_lexicons(spark):
    none = spark.createDataFrame([], "concept_id int, term string")
    assert automaton.tag(notes(spark, "a b"), none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "--"), (4, "a")], "concept_id int, term string")
    assert [r["concept_id"] for r in automaton.tag(notes(spark, "-- a"), odd).collect()] == [4]
    assert automaton.tag(notes(spark, None), odd).count() == 0


def test_equal_lexicons_have_one_version(spark):
    lexicon = spark.createDataFrame(LEXICON, "concept_id int, term string")
    version = automaton.compile_lexicon(lexicon).version
    assert automaton.compile_lexicon(lexicon.orderBy(F.desc("concept_id")).repartition(3)).version == version
    assert automaton.compile_lexicon(lexicon.limit(3)).version != version


def test_a_large_lexicon_shuffles_no_text(spark):
    """Beyond the broadcast threshold of the join, the text still stays where it was read."""
    numbers = spark.range(300_000).select(
        (F.col("id") % 1000).cast("int").alias("concept_id"), F.concat(F.lit("term "), F.col("id").cast("string")).alias("term")
    )
    made = automaton.compile_lexicon(numbers)
    found = automaton.tag(notes(spark, "a Term 7 and term-299999, term 300000, term 1 2"), made)
    assert sorted(r["term"] for r in found.collect()) == ["term 1", "term 299999", "term 7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and re.search("MapInArrow", plan)


def test_too_large_a_lexicon_is_refused(spark, monkeypatch):
    monkeypatch.setattr(automaton, "MAX_TERMS", 3)
    with pytest.raises(ValueError):
        automaton.compile_lexicon(fx.wide_lexicon(spark))
