"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns so that each expression is evaluated once per row.

    Catalyst copies a plain computed column into every filter and projection above it and
    may move such a filter below a join, onto many more rows. The columns pass through a
    one-row ``inline`` instead, which it does not look into. Nothing is shuffled, and
    filters on the other columns still move down.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    computed = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    return df.select(*kept, F.inline(F.array(computed)))
