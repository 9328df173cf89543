import hashlib
import random
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinote.functions import tokenizer
from clinote.operators import ner


def tokens(text, rules=tokenizer.Rules()):
    starts, ends = tokenizer._Reader(rules).spans(text)
    return [text[a:b] for a, b in zip(starts, ends)]


@pytest.mark.parametrize("text, wanted", [
    ("3.5mg daily", "3.5|mg|daily"),
    ("I don't know.", "I|do|n't|know|."),
    ("Can’t breathe", "Ca|n’t|breathe"),
    ("in the U.S. today", "in|the|U.S.|today"),
    ("the U.S.", "the|U.S."),
    ("(see https://a.org/x?y=1&z=2).", "(|see|https://a.org/x?y=1&z=2|)|."),
    ("mail a.b@c.org, please", "mail|a.b@c.org|,|please"),
    ("patient's cough...", "patient|'s|cough|..."),
    ("x-ray and follow-up", "x|-|ray|and|follow|-|up"),
    ("COVID-19", "COVID-19"),
    ("120/80mmHg at 5p.m.", "120/80|mmHg|at|5p.m|."),
    ("\"Quoted\" [text], {x}", "\"|Quoted|\"|[|text|]|,|{|x|}"),
    ("$5, 10% and 2+2", "$|5|,|10|%|and|2|+|2"),
    ("end.Next one", "end|.|Next|one"),
    ("q.i.d. dosing", "q.i.d.|dosing"),
    ("!!! ...", "!|!|!|..."),
    ("they're We'll", "they|'re|We|'ll"),
    ("日本 été, ça", "日本|été|,|ça"),
    ("", ""), (" \n\t", ""),
])
def test_hand_cases(text, wanted):
    assert "|".join(tokens(text)) == wanted


def test_tokens_cover_what_is_not_blank():
    draw = random.Random(5)
    marks = ["a", "B", "9", ".", ",", "'", "s", "-", "(", ")", " ", "\n", "é", "mg", "…", "http://", "don't", "n't", "%"]
    for _ in range(3000):
        text = "".join(draw.choice(marks) for _ in range(draw.randrange(14)))
        starts, ends = tokenizer._Reader(tokenizer.Rules()).spans(text)
        covered = [k for a, b in zip(starts, ends) for k in range(a, b)]
        assert covered == [k for k, c in enumerate(text) if not c.isspace()]
        assert all(a < b for a, b in zip(starts, ends))


def test_an_exception_must_spell_its_chunk():
    with pytest.raises(ValueError):
        tokenizer.Rules(exceptions={"don't": ("do", "not")})


def test_columns(spark):
    rows = [(1, "It's 5mg.", "x"), (2, None, "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "id long, text string, tokens string")
    made = {r["id"]: r["tokens"] for r in tokenizer.with_rule_tokens(df).collect()}
    assert [tuple(t) for t in made[1]] == [(0, 2), (2, 4), (5, 6), (6, 8), (8, 9)] and made[2] is None and made[3] == []
    assert ner.with_tokens(df.filter("id = 1"), tokenizer.Rules()).first()["tokens"] == ["It", "'s", "5", "mg", "."]
    assert tokenizer.with_rule_tokens(df.filter("false")).count() == 0


def test_spans_grow_to_tokens(spark):
    text = "no x-ray; don't give 3.5mg  now"
    spans = [(0, 1), (4, 6), (3, 8), (12, 13), (21, 22), (23, 26), (26, 27), (26, 28), (9, 9), (30, 99)]
    df = spark.createDataFrame([(text, a, b) for a, b in spans] + [(None, 1, 2)], "snippet string, start int, end int")
    got = [(r["start"], r["end"]) for r in ner.expand_spans(df.coalesce(1), tokenizer.Rules()).collect()]
    words = list(zip(*tokenizer._Reader(tokenizer.Rules()).spans(text)))
    for (a, b), found in zip(spans, got):
        touched = [w for w in words if w[0] < b and w[1] > a]
        assert found == ((touched[0][0], touched[-1][1]) if touched else (a, b)), (a, b)
    assert got[-1] == (1, 2)


def test_a_long_text_and_a_long_chunk(spark):
    df = spark.createDataFrame([(1, "(a)" * 20_000), (2, "5mg, " * 50_000)], "id long, text string")
    sizes = {r["id"]: r["n"] for r in tokenizer.with_rule_tokens(df).select("id", F.size("tokens").alias("n")).collect()}
    assert sizes[2] == 150_000 and sizes[1] >= 3


def test_tokens_of_many_texts_take_little_memory():
    """Offsets are flat numbers and leave in parts: an object per token would take some 250 bytes."""
    import tracemalloc

    class Frame:
        columns = ["id", "text"]
        schema = type("Schema", (), {"fields": []})

        def select(self, *_):
            return self

    texts = ["fever, cough (no rash). " * 100, None, ""] * 700
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokenizer, "map_arrow", lambda rows, run, schema: run)
        run = tokenizer.with_rule_tokens(Frame(), "text")
    tracemalloc.start()
    n_rows = n_tokens = n_null = 0
    for made in run(iter([batch])):
        tokens = made.column(2)
        n_rows, n_null, n_tokens = n_rows + len(tokens), n_null + tokens.null_count, n_tokens + len(tokens.flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n_rows, n_null, n_tokens) == (2100, 700, 700 * 800)
    assert peak < 20 << 20


@pytest.mark.parametrize("slice_bytes, remembered", [(1 << 20, 400_000), (5, 400_000), (5, 3)])
def test_tokens_as_texts_are_what_the_offsets_cut_out(monkeypatch, slice_bytes, remembered):
    monkeypatch.setattr(tokenizer, "_SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(tokenizer, "_REMEMBERED_CUTS", remembered)
    draw = random.Random(7)
    marks = ["a", "B", "9", ".", ",", "'", "s", "-", "(", ")", " ", "\n", "\u3000", "\x85", "\x1c", "é", "😀", "mg", "…", "don’t", "x" * 70]
    texts = ["".join(draw.choice(marks) for _ in range(draw.randrange(30))) for _ in range(600)]
    for rules in (tokenizer.Rules(), tokenizer.Rules(prefixes=(), suffixes=(), infixes=("-",), exceptions={}, whole=None)):
        column = pa.array([None, "", *texts, None, " \n"])
        cuts = tokenizer._Cuts(rules)
        for part in (column, column.slice(100, 50), column.slice(0, 2), column.slice(0, 1)):
            made = tokenizer._token_texts(part, cuts)
            made.validate(full=True)
            assert made.to_pylist() == [None if t is None else tokens(t, rules) for t in part.to_pylist()]


def test_blanks_are_the_same_to_both_forms():
    text = "".join(f"a{chr(k)}" for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000)
    made = tokenizer._token_texts(pa.array([text]), tokenizer._Cuts(tokenizer.Rules(prefixes=(), suffixes=(), infixes=(), exceptions={}, whole=None)))
    assert made.to_pylist()[0] == tokenizer._CHUNK.findall(text)


def test_tokens_of_a_long_text_are_not_each_counted_from_its_begin(spark):
    """Spark's substring walks a text from its begin, so that a text took the square of its length."""
    df = spark.createDataFrame([(1, "fever, (é) " * 100_000), (2, None)], "id long, text string")
    made = ner.with_tokens(df, tokenizer.Rules())
    assert "substring(" not in made._jdf.queryExecution().executedPlan().toString()
    rows = {r["id"]: r for r in made.select("id", F.size("tokens").alias("n"), F.sha1(F.array_join("tokens", "|")).alias("sha1")).collect()}
    wanted = hashlib.sha1("|".join(["fever", ",", "(", "é", ")"] * 100_000).encode()).hexdigest()
    assert rows[1]["n"] == 500_000 and rows[1]["sha1"] == wanted
    assert rows[2]["n"] is None and rows[2]["sha1"] is None
