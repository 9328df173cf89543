"""Notes to stored mentions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from clinote import schemas
from clinote.operators import automaton, context, tagger
from clinote.sources import sinks


def tag_notes(
    notes: DataFrame,
    lexicon: DataFrame | automaton.Automaton,
    *,
    rules: Sequence[tuple[int, str]] = (),
    nlp_datetime: dt.datetime | None = None,
    compiled: bool = False,
    headers: DataFrame | None = None,
    scoped_cues: Sequence[tuple[str, str, str]] | None = None,
    **options,
) -> DataFrame:
    """Dictionary and rule mentions of the notes as ``note_nlp`` rows.

    ``compiled`` looks terms up by an automaton. ``headers`` give mentions their section, ``scoped_cues`` (such as
    ``context.CUES``) their certainty, status and experiencer by scopes instead of the word window. ValueError where
    a frame lacks a column that tagging reads.
    """
    schemas.require_columns(notes, schemas.NOTE, schemas.TEXT_COLUMNS)
    if isinstance(lexicon, DataFrame):
        schemas.require_columns(lexicon, schemas.LEXICON, ["concept_id", "term"])
    missing = {"header", "section_concept_id"} - set(headers.columns if headers is not None else ("header", "section_concept_id"))
    if missing:
        raise ValueError("; ".join(f"missing column {name}" for name in sorted(missing)))
    scan = compiled or not isinstance(lexicon, DataFrame)
    found = (automaton if scan else tagger).tag(notes, lexicon, **options)
    if rules:
        shared = {k: v for k, v in options.items() if k in ("cues", "cue_window", "cue_stops", "snippet_radius")}
        found = found.unionByName(tagger.tag_rules(notes, rules, **shared))
    if headers is not None:
        found = context.with_section(found, notes, headers)
    if scoped_cues is not None:
        found = context.with_assertion(found, notes, scoped_cues)
    return tagger.to_note_nlp(found, nlp_datetime=nlp_datetime)


def load_rows(note_nlp: DataFrame) -> DataFrame:
    """``note_nlp`` rows in the column order of the database insert; ValueError where one of its columns is absent."""
    schemas.require_columns(note_nlp, schemas.NOTE_NLP, sorted({source for _, source in sinks.NOTE_NLP_MAPPING}))
    return sinks.map_columns(note_nlp)
