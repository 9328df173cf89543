"""Column expressions on text: trimming, stamps, modifiers, names, spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The header stamp that may open a note, and the certainty markers
# that lead the modifier list of a mention.
HEADER_STAMP = "[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2} EST"
HEADER_STAMP_END = " EST"
CERTAINTY_PREFIX = "certainty="
POSITIVE = "Positive"
NEGATED = "Negated"

# Unicode white space plus the four ASCII separator controls.
_SPACE = r"[\s\x1c-\x1f]"


def strip_space(text: Column) -> Column:
    """Trim Unicode white space at both ends (SQL ``trim`` removes blanks only)."""
    leading = F.when(
        F.left(text, F.lit(1)).rlike(f"(?U){_SPACE}"), F.regexp_replace(text, f"(?U)^{_SPACE}+", "")
    ).otherwise(text)
    # Anchored behind a non-space so that long inner runs are scanned only once.
    return F.when(
        F.right(text, F.lit(1)).rlike(f"(?U){_SPACE}"),
        F.regexp_replace(leading, rf"(?U)(?<!{_SPACE}){_SPACE}+$", ""),
    ).otherwise(leading)


def clean_snippet(snippet: Column) -> Column:
    """Trim, drop everything through the first header stamp, trim again.

    Trimming before the stamp is sought changes nothing that trimming after it would not.
    """
    unstamped = F.when(
        snippet.contains(HEADER_STAMP_END), F.regexp_replace(snippet, f"(?s)^.*?{HEADER_STAMP}", "")
    ).otherwise(snippet)
    return strip_space(unstamped)


def certainty_is(modifiers: Column, certainty: str) -> Column:
    """True when the modifier list opens with the given certainty."""
    return modifiers.startswith(CERTAINTY_PREFIX + certainty)


def certainty_value(modifiers: Column) -> Column:
    """Value of the first modifier; null when it has no ``=``."""
    first = F.split(modifiers, ",", 2).getItem(0)
    return F.try_element_at(F.split(first, "="), F.lit(2))


def start_of(text: Column, variant: Column) -> Column:
    """0-based position of the first occurrence, -1 if there is none (code points)."""
    return F.instr(text, variant) - 1


def spreadsheet_safe(text: Column) -> Column:
    """Wrap text in single quotes when it opens with ``-``, which a spreadsheet reads as a formula."""
    return F.when(text.startswith("-"), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)


def drop_last_segment(name: Column) -> Column:
    """Name without its last ``_`` segment; empty when there is no ``_``."""
    return F.when(F.instr(name, F.lit("_")) > 0, F.regexp_replace(name, "_[^_]*$", "")).otherwise("")


def after_last_equals(name: Column) -> Column:
    """Part of a name after its last ``=``."""
    return F.substring_index(name, "=", -1)


# Documents are tokenised into word runs and single punctuation characters.
TOKEN = r"(?U)\w+|[^\w\s]"
_WORD = r"(?U)\w"
_BLANK = r"(?U)\s"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def expand_to_tokens(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Grow the span [start, end) to the tokens it touches; white space at its ends is left out.

    Only a span that opens or closes inside a word run changes, so the edges follow
    from the word characters just outside the span: no token list is built.
    """
    before = F.substring(text, F.lit(1), start)
    span = F.substring(text, start + 1, end - start)
    after = F.substring(text, end + 1, F.length(text) - end)
    opens, closes = F.left(span, F.lit(1)), F.right(span, F.lit(1))
    left = (
        F.when(
            opens.rlike(_WORD) & F.right(before, F.lit(1)).rlike(_WORD),
            -F.length(F.regexp_extract(before, r"(?U)(?<!\w)\w+$", 0)),
        )
        .when(opens.rlike(_BLANK), F.length(F.regexp_extract(span, r"(?U)^\s+", 0)))
        .otherwise(0)
    )
    right = (
        F.when(
            closes.rlike(_WORD) & F.left(after, F.lit(1)).rlike(_WORD),
            F.length(F.regexp_extract(after, r"(?U)^\w+", 0)),
        )
        .when(closes.rlike(_BLANK), -F.length(F.regexp_extract(span, r"(?U)(?<!\s)\s+$", 0)))
        .otherwise(0)
    )
    blank = span.rlike(r"(?U)^\s*$")
    return F.when(blank, start).otherwise(start + left), F.when(blank, end).otherwise(end + right)


#: Marks null in CSV files of this package, where empty text is empty.
CSV_NULL = "\\N"


def _each_text(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return df.select(*[
        change(F.col(f"`{name}`")).alias(name) if kind == "string" else F.col(f"`{name}`") for name, kind in df.dtypes
    ])


def without_lines(df: DataFrame) -> DataFrame:
    """Line ends in texts as ``\\n`` and ``\\r``, backslashes doubled."""
    return _each_text(df, lambda text: F.replace(F.replace(F.replace(
        text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")
    ))


def with_lines(df: DataFrame) -> DataFrame:
    """What ``without_lines`` was made from: read between doubled backslashes."""
    return _each_text(df, lambda text: F.array_join(F.transform(
        F.split(text, r"\\\\"),
        lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
    ), "\\"))
