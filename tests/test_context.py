import random
import re

import pytest
from test_tagger import notes

from clinote.operators import automaton, context, intervals, tagger
from clinote.plans import corpus, tagging

TERMS = [(1, "fever"), (2, "pneumonia"), (3, "cough"), (4, "diabetes")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(TERMS, "concept_id int, term string")


def told(spark, lexicon, text, cues=context.CUES):
    frame = notes(spark, text)
    found = context.with_assertion(tagger.tag(frame, lexicon), frame, cues)
    return [(r["lexical_variant"], r["certainty"], r["status"], r["experiencer"]) for r in found.orderBy("start").collect()]


@pytest.mark.parametrize("text, wanted", [
    ("There is no evidence of pneumonia or fever.", ["Negated Present Patient"] * 2),
    ("Pneumonia was ruled out. Fever persists.", ["Negated Present Patient", "Positive Present Patient"]),
    ("His mother had diabetes, but he has a cough.", ["Positive Present Other", "Positive Present Patient"]),
    ("No increase in cough.", ["Positive Present Patient"]),
    ("History of pneumonia; fever today", ["Positive HistoryOf Patient", "Positive Present Patient"]),
    ("No Evidence-of\tfever", ["Negated Present Patient"]),
    ("Temp 38.5 without fever, however cough", ["Negated Present Patient", "Positive Present Patient"]),
    ("possible pneumonia, denies cough", ["Possible Present Patient", "Negated Present Patient"]),
    ("fever and cough 3 years ago", ["Positive HistoryOf Patient"] * 2),
    ("nothing but fever. noted cough", ["Positive Present Patient"] * 2),
    ("no history of diabetes", ["Negated HistoryOf Patient"]),
])
def test_scopes_of_cues(spark, lexicon, text, wanted):
    assert [" ".join(r[1:]) for r in told(spark, lexicon, text)] == wanted


def test_cues_of_both_directions_and_odd_texts(spark, lexicon):
    cues = [("x", context.NEGATION, context.BOTH), ("stop", context.STOP, "")]
    assert [r[1] for r in told(spark, lexicon, "fever stop cough x pneumonia stop diabetes", cues)] == [
        "Positive", "Negated", "Negated", "Positive"]
    for text in (None, "", "...", ";\n;", "x", "x" * 10_000, "1." * 5000 + " x fever"):
        assert len(told(spark, lexicon, text, cues)) == (1 if text and text.endswith("fever") else 0)
    with pytest.raises(ValueError):
        context.cue_scopes(notes(spark, "a"), [])
    with pytest.raises(ValueError):
        context.cue_scopes(notes(spark, "a"), [("x", context.NEGATION, context.BOTH), ("X", context.STOP, "")])


def test_sections_reach_to_the_next_header(spark, lexicon, rows):
    headers = spark.createDataFrame(
        [("History of present illness", 11), ("PLAN", 12), ("plan", 13)], "header string, section_concept_id int")
    text = "fever\n  history  of Present-Illness: cough\nNote: fever\nPlan : diabetes\nplan without colon, cough"
    frame = notes(spark, text, text.replace("Plan :", "Other:"), "", None).unionByName(notes(spark, text))
    found = context.with_section(tagger.tag(frame, lexicon), frame, headers)
    want = [("fever", None), ("cough", 11), ("fever", 11), ("diabetes", 12), ("cough", 12)]
    assert rows(found.filter("note_id = 0"), "lexical_variant", "section_concept_id") == sorted(want * 2, key=repr)
    assert rows(found.filter("note_id = 1"), "lexical_variant", "section_concept_id") == sorted(
        [("fever", None), ("cough", 11), ("fever", 11), ("diabetes", 11), ("cough", 11)], key=repr)


def test_places_meet_the_spans_that_hold_them(spark):
    draw = random.Random(6)
    spans = [(k % 3, a, a + draw.choice([0, 1, 7, 40, 400]), k % 4) for k in range(200) for a in [draw.randrange(1000)]]
    places = [(k % 4, draw.randrange(1100)) for k in range(300)]
    listed = intervals.list_by_piece(spark.createDataFrame(spans, "note_id long, first int, last int, kind int"), "note_id", 64)
    got = intervals.attach(spark.createDataFrame(places, "note_id long, start int"), listed, "note_id", "start", 64)
    found = sorted((r["note_id"], r["start"], sorted({tuple(s) for s in r["spans"]})) for r in got.collect())
    assert found == sorted((n, p, sorted({(a, b, k) for m, a, b, k in spans if m == n and a <= p < b})) for n, p in places)


def test_a_long_note_is_many_pieces(spark, lexicon):
    """Sections and cues of one long note do not meet in one row."""
    text = "".join(f"Plan: no cough\nPlan: fever {k}\n" for k in range(3000))
    frame = notes(spark, text)
    headers = spark.createDataFrame([("plan", 12)], "header string, section_concept_id int")
    listed = intervals.list_by_piece(context.section_spans(frame, headers), "note_id")
    assert listed.count() > 10 and max(len(r["spans"]) for r in listed.collect()) < 400
    found = context.with_assertion(tagger.tag(frame, lexicon), frame)
    assert {(r["concept_id"], r["certainty"]): r["count"] for r in found.groupBy("concept_id", "certainty").count().collect()} == {
        (3, "Negated"): 3000, (1, "Positive"): 3000}


def test_text_is_not_shuffled(spark, lexicon):
    frame = notes(spark, "no fever")
    headers = spark.createDataFrame([("plan", 12)], "header string, section_concept_id int")
    for found in (context.section_spans(frame, headers), intervals.list_by_piece(context.cue_scopes(frame), "note_id")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if "Exchange" in line:
                assert not re.search(r"note_text|\bpiece#\d+(?![\dL])", line)


def test_note_nlp_takes_context_over(spark, lexicon):
    headers = spark.createDataFrame([("plan", 12)], "header string, section_concept_id int")
    rows = tagging.tag_notes(
        notes(spark, "Plan: no evidence of fever"), lexicon, compiled=True, headers=headers, scoped_cues=context.CUES
    ).collect()
    assert [(r["section_concept_id"], r["term_exists"], r["term_temporal"], r["term_modifiers"]) for r in rows] == [
        (12, "N", "Present", "certainty=Negated,experiencer=Patient,status=Present")]


def test_frames_without_their_columns_are_refused(spark, lexicon):
    """Where tagging, corpora and loads begin, not within a task."""
    frame = notes(spark, "fever")
    with pytest.raises(ValueError, match="note_text"):
        tagging.tag_notes(frame.drop("note_text"), lexicon)
    with pytest.raises(ValueError, match="term"):
        tagging.tag_notes(frame, lexicon.drop("term"))
    with pytest.raises(ValueError, match="header"):
        tagging.tag_notes(frame, lexicon, headers=lexicon)
    rows = tagging.tag_notes(frame, automaton.compile_lexicon(lexicon))
    assert rows.count() == 1
    with pytest.raises(ValueError, match="snippet"):
        tagging.load_rows(rows.drop("snippet"))
    with pytest.raises(ValueError, match="term_modifiers"):
        corpus.build_corpus(rows.drop("term_modifiers"), lexicon, "label_term_usage", exclude_ids=[])
