"""Key conversions that never fail on bad input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def numeric_key(text: Column) -> Column:
    """Text key as a 64-bit integer; null unless it starts with a digit and casts whole."""
    return F.when(text.rlike("^[0-9]"), text.try_cast("bigint"))


def text_key(number: Column) -> Column:
    return number.cast("string")
