import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from clinote.functions import text
from clinote.functions.columns import compute_once
from clinote.functions.keys import numeric_key

TEXTS = [
    "  plain  ",
    "  wide　",
    "\x1c\x1dseparators\x1f",
    "lead 03/04/2020 10:20 EST  body 05/06/2021 11:22 EST tail ",
    "03/04/2020 10:20 EST",
    "no stamp, EST only",
    "line\n01/01/2001 01:01 EST\n after",
    "",
    "-",
]


def values(spark, items, *expressions):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(items)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *expressions).orderBy("i").collect()]


def test_strip_is_unicode_strip(spark):
    assert [v[0] for v in values(spark, TEXTS, text.strip_space(F.col("s")))] == [s.strip() for s in TEXTS]


def test_clean_snippet_drops_through_first_stamp(spark):
    def expected(s):
        s = s.strip()
        found = re.search(text.HEADER_STAMP, s)
        return s[found.end():].strip() if found else s
    assert [v[0] for v in values(spark, TEXTS, text.clean_snippet(F.col("s")))] == [expected(s) for s in TEXTS]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t  \x1cé-", max_size=30), min_size=1, max_size=20))
def test_strip_on_random_text(spark, items):
    assert [v[0] for v in values(spark, items, text.strip_space(F.col("s")))] == [s.strip() for s in items]


def test_sha1_is_of_utf8(spark):
    assert values(spark, ["é"], F.sha1("s"))[0][0] == hashlib.sha1("é".encode()).hexdigest()


def test_certainty(spark):
    items = ["certainty=Positive,experiencer=Patient", "certainty=Negated", "bare,certainty=Positive", ""]
    found = values(
        spark, items,
        text.certainty_value(F.col("s")),
        text.certainty_is(F.col("s"), "Positive"),
    )
    assert found == [("Positive", True), ("Negated", False), (None, False), (None, False)]


def test_start_counts_code_points(spark):
    found = values(spark, ["\U0001f600ab", "xx", "Ab"], text.start_of(F.col("s"), F.lit("ab")))
    assert [v[0] for v in found] == [1, -1, -1]
    assert values(spark, ["abc"], text.start_of(F.col("s"), F.lit("")))[0][0] == 0


def test_spreadsheet_safe(spark):
    found = values(spark, ["-1", "a-1", "", "-"], text.spreadsheet_safe(F.col("s")))
    assert [v[0] for v in found] == ["'-1'", "a-1", "", "'-'"]


def test_names(spark):
    found = values(
        spark, ["dyspnea_admission_v", "plain", "a=b=c"],
        text.drop_last_segment(F.col("s")), text.after_last_equals(F.col("s")),
    )
    assert found == [("dyspnea_admission", "dyspnea_admission_v"), ("", "plain"), ("", "c")]


@pytest.mark.parametrize(
    ("sentence", "start", "end", "wanted"),
    [
        ("has cough now", 4, 9, (4, 9)),
        ("has coughing now", 4, 9, (4, 12)),
        ("uncoughing", 2, 7, (0, 10)),
        ("a (cough) b", 3, 8, (3, 8)),
        ("a (cough) b", 2, 8, (2, 8)),
        ("a  cough  b", 2, 9, (3, 8)),
        ("étatique", 1, 3, (0, 8)),
        ("a   b", 2, 3, (2, 3)),
        ("x", 0, 1, (0, 1)),
    ],
)
def test_expand_to_tokens(spark, sentence, start, end, wanted):
    df = spark.createDataFrame([(sentence, start, end)], "s string, a int, b int")
    left, right = text.expand_to_tokens(F.col("s"), F.col("a"), F.col("b"))
    assert tuple(df.select(left, right).first()) == wanted


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab1 .-\nü", min_size=1, max_size=25), st.data())
def test_expand_agrees_with_token_list(spark, sentence, data):
    start = data.draw(st.integers(0, len(sentence) - 1))
    end = data.draw(st.integers(start + 1, len(sentence)))
    touched = [m.span() for m in re.finditer(r"\w+|[^\w\s]", sentence) if m.start() < end and m.end() > start]
    wanted = (touched[0][0], touched[-1][1]) if touched else (start, end)
    df = spark.createDataFrame([(sentence, start, end)], "s string, a int, b int")
    left, right = text.expand_to_tokens(F.col("s"), F.col("a"), F.col("b"))
    assert tuple(df.select(left, right).first()) == wanted


def test_tokens(spark):
    assert values(spark, ["No cough, (dry)."], text.tokens(F.col("s")))[0][0] == [
        "No", "cough", ",", "(", "dry", ")", "."
    ]


def test_numeric_key(spark):
    items = ["12", "12abc", "E13", None, "", " 7", "007", "99999999999999999999"]
    assert [v[0] for v in values(spark, items, numeric_key(F.col("s")))] == [
        12, None, None, None, None, None, 7, None
    ]


def test_compute_once_keeps_a_filter_from_copying_the_expression(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    once = compute_once(df, {"t": F.upper("s")}).filter(F.col("t") == "A")
    assert [tuple(r) for r in once.collect()] == [("a", "A")]
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
