import random
import re
import time

import pytest
from pyspark.sql import functions as F

from clinote.operators import tagger

LEXICON = [(1, "cough"), (2, "fever"), (3, "shortness of breath"), (4, "covid 19"), (5, "--"), (6, "crohn's")]
NOTE = "No cough. Patient denies any fever, has Shortness-of  Breath and COVID-19\nétat cough; Crohn's"


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "concept_id int, term string")


def notes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "note_id long, note_text string")


def long_note(seed, words):
    draw = random.Random(seed)
    vocabulary = ["no", "the", "abc", "Shortness", "of", "breath", "cough", "x1", "é", "fever"]
    return "".join(draw.choice(vocabulary) + draw.choice([" ", " ", ". ", ",\n", "-"]) for _ in range(words))


def test_terms_words_and_case(spark, lexicon, rows):
    found = tagger.tag(notes(spark, NOTE, "", None), lexicon)
    assert rows(found, "start", "concept_id", "lexical_variant", "certainty") == sorted([
        (3, 1, "cough", "Negated"),
        (29, 2, "fever", "Negated"),
        (40, 3, "Shortness-of  Breath", "Negated"),
        (65, 4, "COVID-19", "Positive"),
        (79, 1, "cough", "Positive"),
        (86, 6, "Crohn's", "Positive"),
    ], key=repr)


def expected(text, window):
    out = set()
    spaced = {1: r"cough", 2: r"fever", 3: r"shortness[\s-]+of[\s-]+breath"}
    for concept, pattern in spaced.items():
        for m in re.finditer(rf"(?<!\w){pattern}(?!\w)", text, re.I):
            reached = re.split(tagger.CUE_STOPS, text[: m.start()])[-1]
            before = re.findall(r"\w+", reached.lower())[-window:]
            negated = any(w in tagger.NEGATION_CUES for w in before)
            snippet = text[max(0, m.start() - 120): m.end() + 120]
            out.add((m.start(), concept, m.group(), "Negated" if negated else "Positive", snippet))
    return out


@pytest.mark.parametrize("hint", ["broadcast", "merge"])
@pytest.mark.parametrize("words", [1, 63, 64, 65, 1000])
def test_whole_long_notes_with_and_without_broadcast(spark, lexicon, words, hint):
    text = long_note(words, words)
    found = tagger.tag(notes(spark, text), lexicon.hint(hint))
    got = {tuple(r) for r in found.select("start", "concept_id", "lexical_variant", "certainty", "snippet").collect()}
    assert got == expected(text, tagger.CUE_WINDOW)


def test_text_is_not_shuffled_with_a_small_lexicon(spark, lexicon):
    plan = tagger.tag(notes(spark, NOTE), lexicon.hint("broadcast"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(note_id", plan)


def test_repeated_notes_give_the_same_on_every_plan(spark, lexicon, rows):
    twice = notes(spark, NOTE).union(notes(spark, NOTE))
    plans = [rows(tagger.tag(twice, lexicon.hint(hint))) for hint in ("broadcast", "merge")]
    assert plans[0] == plans[1] and len(plans[0]) == 12


def test_symbols_of_a_term_count(spark, rows):
    signs = spark.createDataFrame([(1, "HER2+"), (2, "HER2-"), (3, "HER2"), (4, "(no)")], "concept_id int, term string")
    found = tagger.tag(notes(spark, "HER2- tumour, her2+ (NO) no"), signs)
    assert rows(found, "start", "concept_id", "lexical_variant") == sorted(
        [(0, 2, "HER2-"), (0, 3, "HER2"), (14, 1, "her2+"), (14, 3, "her2"), (20, 4, "(NO)")], key=repr
    )


def test_unusable_terms_are_reported(spark, lexicon):
    assert [r["term"] for r in tagger.unusable_terms(lexicon).collect()] == ["--"]


def test_ids_are_unique_over_terms_and_rules(spark):
    doubled = spark.createDataFrame([(1, "dry cough"), (1, "dry-cough"), (1, "cough")], "concept_id int, term string")
    text = notes(spark, "a dry cough, dry-cough")
    found = tagger.tag(text, doubled).unionByName(tagger.tag_rules(text, [(1, "dry.cough"), (1, "cough")]))
    for dense in (False, True):
        ids = [r[0] for r in tagger.to_note_nlp(found, dense_ids=dense).select("note_nlp_id").collect()]
        assert len(ids) == len(set(ids)) == 8


def test_cues(spark, lexicon, rows):
    found = tagger.tag(notes(spark, "No fever. Cough present; no fever"), lexicon)
    assert rows(found, "start", "certainty") == [(10, "Positive"), (28, "Negated"), (3, "Negated")]
    everywhere = tagger.tag(notes(spark, "No fever. Cough present"), lexicon, cue_stops=None)
    assert {r["certainty"] for r in everywhere.collect()} == {"Negated"}
    with pytest.raises(ValueError):
        tagger.tag(notes(spark, NOTE), lexicon, cues=["no evidence of"])


def test_time_grows_with_the_length_of_a_note(spark):
    """Twice the lines take about twice the time; a square would take four times."""
    def seconds(lines):
        text = notes(spark, "abc def\n" * lines)
        best = []
        for _ in range(3):
            started = time.perf_counter()
            tagger.tag_rules(text, [(1, "def")]).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - started)
        return min(best)

    seconds(1000)
    assert seconds(128_000) < 3 * seconds(64_000)


def test_rules(spark, rows):
    found = tagger.tag_rules(notes(spark, NOTE + "\nno rash", ""), [(7, "cough"), (8, r"short\w+[\s-]+of"), (9, "^no")])
    assert rows(found, "start", "concept_id", "lexical_variant", "certainty") == sorted([
        (3, 7, "cough", "Negated"),
        (79, 7, "cough", "Positive"),
        (40, 8, "Shortness-of", "Negated"),
        (0, 9, "No", "Positive"),
        (94, 9, "no", "Positive"),
    ], key=repr)


def test_rules_over_a_long_line(spark):
    text = long_note(3, 1500).replace("\n", " ")
    found = tagger.tag_rules(notes(spark, text), [(1, r"cough[^\p{L}]+fever")])
    wanted = [(m.start(), m.group()) for m in re.finditer(r"cough[^\w]+fever", text, re.I)]
    assert sorted(tuple(r) for r in found.select("start", "lexical_variant").collect()) == sorted(wanted)


def test_context_limit(spark, lexicon):
    with pytest.raises(ValueError):
        tagger.tag(notes(spark, NOTE), lexicon, cue_window=500)


def test_note_nlp_form(spark, lexicon):
    from clinote import schemas
    frame = tagger.to_note_nlp(tagger.tag(notes(spark, NOTE), lexicon))
    schemas.require(frame, schemas.NOTE_NLP)
    again = tagger.to_note_nlp(tagger.tag(notes(spark, NOTE), lexicon))
    assert {r[0] for r in frame.select("note_nlp_id").collect()} == {r[0] for r in again.select("note_nlp_id").collect()}
    first = frame.filter(F.col("offset") == "3").first()
    assert (first["term_modifiers"], first["term_exists"]) == ("certainty=Negated,experiencer=Patient", "N")


def test_no_word_carries_text_through_a_shuffle(spark, lexicon):
    """A lexicon that is not sent around meets distinct words under a chunk's hash; each chunk is shuffled once."""
    found = tagger.tag(notes(spark, NOTE), lexicon.hint("merge")).select("note_id", "start")
    physical = found._jdf.queryExecution().executedPlan().toString()
    formatted = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    exchanged = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", formatted)
    with_text = [columns for columns in exchanged if "body" in columns]
    assert "BroadcastHashJoin" not in physical
    assert len(with_text) == 1 and "chunk_start" in with_text[0] and "token" not in with_text[0]
    assert "words" not in with_text[0] and "tiles" not in with_text[0]


def test_patterns_run_once_for_a_chunk(spark, lexicon):
    """What cuts a chunk into words stands below the join, so it does not run again for each match."""
    plan = tagger.tag(notes(spark, NOTE), lexicon.hint("broadcast"))._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("BroadcastHashJoin", 1)
    assert "AS tiles" in below and "AS tiles" not in above


def test_places_of_a_term_are_compared_in_compiled_code(spark, lexicon):
    """A lexicon that is not sent around: no function over arrays stands above the join, as it would be interpreted."""
    plan = tagger.tag(notes(spark, NOTE), lexicon.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("SortMergeJoin", 1)
    assert "lambdafunction" not in above and "posexplode" in above and "AS words" in below


@pytest.mark.parametrize("hint", ["broadcast", "merge"])
def test_null_and_shared_ids_chunk_ends_and_forms_of_lower_case(spark, rows, hint):
    terms = spark.createDataFrame([(1, "fever"), (2, "fever now here"), (3, "ΟΔΟΣ"), (4, "(a")], "concept_id int, term string")
    ends = "w " * 62 + "fever now here; fever"
    texts = [(None, "fever"), (None, "fever"), (1, "a fever"), (1, "no fever"), (2, ends), (3, "ΟΔΟΣ ΟΔΟΣ'Α"), (4, "a (a"), (5, "..."), (6, None)]
    df = spark.createDataFrame(texts, "note_id long, note_text string")
    found = tagger.tag(df, terms.hint(hint))
    assert rows(found, "note_id", "start", "concept_id", "lexical_variant") == sorted([
        (None, 0, 1, "fever"), (None, 0, 1, "fever"), (1, 2, 1, "fever"), (1, 3, 1, "fever"),
        (2, 124, 1, "fever"), (2, 124, 2, "fever now here"), (2, 140, 1, "fever"),
        (3, 0, 3, "ΟΔΟΣ"), (4, 2, 4, "(a"),
    ], key=repr)
