"""Places in a text and the spans that hold them, joined on pieces of the text of fixed width.

A span is listed under every piece that it touches, and the spans of a piece become one row. A piece
holds as many places and spans as so many characters can, so no note, however long, meets in
one task, and a place meets one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PIECE_CHARACTERS = 4096


def list_by_piece(spans: DataFrame, key: str, width: int = PIECE_CHARACTERS) -> DataFrame:
    """``key, piece, spans``: the distinct ``(first, last, ...)`` of a piece, in order of their first character.

    ``last`` is behind the last character; empty spans hold nothing.
    """
    columns = ["first", "last", *[c for c in spans.columns if c not in (key, "first", "last")]]
    pieces = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))
    return (
        spans.filter(F.col("first") < F.col("last"))
        .select(key, F.struct(*columns).alias("span"), F.explode(pieces).alias("piece"))
        .groupBy(key, "piece").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    )


def attach(places: DataFrame, listed: DataFrame, key: str, at: str, width: int = PIECE_CHARACTERS) -> DataFrame:
    """``places`` with ``spans``: those that hold the character ``at``; an empty list where none does."""
    own = listed.select(F.col(key).alias("__key"), F.col("piece").alias("__piece"), F.col("spans").alias("__spans"))
    same = (F.col(key) == F.col("__key")) & (F.floor(F.col(at) / width) == F.col("__piece"))
    holding = F.filter("__spans", lambda s: (s["first"] <= F.col(at)) & (F.col(at) < s["last"]))
    nothing = F.array().cast(listed.schema["spans"].dataType)
    return places.join(own, same, "left").withColumn("spans", F.coalesce(holding, nothing)).drop("__key", "__piece", "__spans")


def last_of(spans: Column, field: str) -> Column:
    """A field of the last span; null where there is none."""
    return F.try_element_at(spans, F.lit(-1))[field]
