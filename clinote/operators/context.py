"""What the text around a mention says about it: its section, and the scopes of cues in its sentence.

A section reaches from its header to the next one. A cue has a kind and a direction: its scope reaches
forward or backward through its sentence, up to the next word that ends scopes. Longer cues come before
shorter ones, so that a pseudo-cue (``no increase``) keeps the cue inside it from acting. Headers and
scopes are found where the text is read; only their places are shuffled, and they meet the mentions
as intervals.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinote.functions.columns import compute_once
from clinote.functions.text import NEGATED, POSITIVE
from clinote.operators import intervals, tagger

FORWARD, BACKWARD, BOTH = "forward", "backward", "both"
#: Kinds of cues. The last two have no scope: one ends the scopes of others, one only hides the cues in it.
NEGATION, POSSIBILITY, HISTORY, OTHER_PERSON, STOP, PSEUDO = "negation", "possibility", "history", "other", "stop", "pseudo"
POSSIBLE, PRESENT, PAST, PATIENT, OTHER = "Possible", "Present", "HistoryOf", "Patient", "Other"

# A basic set of English cues.
CUES: list[tuple[str, str, str]] = [
    ("no", NEGATION, FORWARD), ("not", NEGATION, FORWARD), ("without", NEGATION, FORWARD), ("denies", NEGATION, FORWARD),
    ("denied", NEGATION, FORWARD), ("no evidence of", NEGATION, FORWARD), ("no sign of", NEGATION, FORWARD),
    ("negative for", NEGATION, FORWARD), ("free of", NEGATION, FORWARD), ("absence of", NEGATION, FORWARD),
    ("rules out", NEGATION, FORWARD), ("ruled out for", NEGATION, FORWARD), ("was ruled out", NEGATION, BACKWARD),
    ("were ruled out", NEGATION, BACKWARD), ("is ruled out", NEGATION, BACKWARD), ("unlikely", NEGATION, BACKWARD),
    ("not seen", NEGATION, BACKWARD), ("has resolved", NEGATION, BACKWARD),
    ("possible", POSSIBILITY, FORWARD), ("suspected", POSSIBILITY, FORWARD), ("rule out", POSSIBILITY, FORWARD),
    ("concern for", POSSIBILITY, FORWARD), ("cannot be excluded", POSSIBILITY, BACKWARD), ("is suspected", POSSIBILITY, BACKWARD),
    ("history of", HISTORY, FORWARD), ("previous", HISTORY, FORWARD), ("status post", HISTORY, FORWARD),
    ("in the past", HISTORY, BACKWARD), ("years ago", HISTORY, BACKWARD),
    ("mother", OTHER_PERSON, FORWARD), ("father", OTHER_PERSON, FORWARD), ("brother", OTHER_PERSON, FORWARD),
    ("sister", OTHER_PERSON, FORWARD), ("mother had", OTHER_PERSON, FORWARD), ("family history of", OTHER_PERSON, FORWARD),
    ("but", STOP, ""), ("however", STOP, ""), ("although", STOP, ""), ("except", STOP, ""), ("aside from", STOP, ""),
    ("patient", STOP, ""), ("secondary to", STOP, ""),
    ("no increase", PSEUDO, ""), ("no change", PSEUDO, ""), ("not only", PSEUDO, ""), ("without difficulty", PSEUDO, ""),
    ("not certain whether", PSEUDO, ""), ("gram negative", PSEUDO, ""),
]
#: A sentence ends behind these, a full stop, question or exclamation mark only before a blank or the end of the text.
_SENTENCE = r"(?s)[^.!?;\n]*+(?:[.!?](?!\s|\z)[^.!?;\n]*+){0,200}+(?:[.!?;\n]|\z)"
_HEADER = r"^[ \t]*([^:\n]{1,80}):"


def _pieces(notes: DataFrame, pattern: str) -> DataFrame:
    """``note_id, piece, piece_start, length``: the text of every note cut by a pattern, nothing left out."""
    cut = F.filter(tagger._find_all("note_text", pattern), lambda piece: piece != "")
    parts = F.arrays_zip(F.col("pieces").alias("piece"), tagger._starts(F.col("pieces")).alias("piece_start"))
    return notes.select("note_id", F.length("note_text").alias("length"), cut.alias("pieces")).select(
        "note_id", "length", F.inline(parts)
    )


def section_spans(notes: DataFrame, headers: DataFrame) -> DataFrame:
    """``note_id, first, last, section_concept_id``: from each header to the next one of any name that ``headers`` has.

    ``headers`` has ``header, section_concept_id``. A header stands at the begin of a line, before a colon; case,
    and runs of blanks and hyphens, do not count. Text before the first header is in no section.
    """
    lines = _pieces(notes, tagger._LINE).filter(F.col("piece").rlike(_HEADER))
    named = lines.select(
        "note_id", "length", F.col("piece_start").alias("first"),
        F.trim(tagger._loose(F.regexp_extract("piece", _HEADER, 1))).alias("name"),
    )
    known = headers.select(F.trim(tagger._loose(F.col("header"))).alias("name"), "section_concept_id")
    known = known.groupBy("name").agg(F.min("section_concept_id").alias("section_concept_id"))
    # One row per header line; repeated notes are one.
    found = named.join(known, "name").select("note_id", "first", "length", "section_concept_id").distinct()
    following = F.lead("first").over(Window.partitionBy("note_id").orderBy("first"))
    return found.select(
        "note_id", "first", F.coalesce(following, F.col("length")).cast("int").alias("last"), "section_concept_id"
    )


def with_section(mentions: DataFrame, notes: DataFrame, headers: DataFrame) -> DataFrame:
    """``mentions`` with ``section_concept_id``, null where the mention lies in no section."""
    listed = intervals.list_by_piece(section_spans(notes, headers), "note_id")
    placed = intervals.attach(mentions, listed, "note_id", "start")
    return placed.withColumn("section_concept_id", intervals.last_of(F.col("spans"), "section_concept_id")).drop("spans")


def _cue_pattern(cues: Sequence[tuple[str, str, str]]) -> str:
    """Any cue, longer ones first, with blanks or hyphens between its words."""
    def spelled(cue: str) -> str:
        return r"[\s-]+".join(re.escape(word) for word in re.split(r"[\s-]+", cue))

    longest = sorted({cue for cue, _, _ in cues}, key=lambda cue: (-len(cue), cue))
    return f"(?<!{tagger.WORD})(?:{'|'.join(spelled(cue) for cue in longest)})(?!{tagger.WORD})"


def _of_cue(cues: Sequence[tuple[str, str, str]], field: int) -> Column:
    pairs = [F.lit(v) for cue in cues for v in (re.sub(r"[\s-]+", " ", cue[0].lower()), cue[field])]
    return F.create_map(*pairs)


def cue_scopes(notes: DataFrame, cues: Sequence[tuple[str, str, str]] = CUES) -> DataFrame:
    """``note_id, first, last, kind``: where the cues of a note act.

    ``cues`` are ``(words, kind, direction)``. A forward scope reaches from the cue to the next stop of its
    sentence, a backward one from the stop before; without a stop, to the end or begin of the sentence.
    """
    if not cues:
        raise ValueError("at least one cue is needed")
    if len({cue.lower() for cue, _, _ in cues}) < len(cues):
        raise ValueError("a cue has one kind and one direction")
    pattern = _cue_pattern(cues)
    sentences = _pieces(notes, _SENTENCE).filter(F.col("piece").rlike(f"(?i){pattern}"))
    # Anchored to the end of the match before, so a sentence is scanned once.
    hits = compute_once(sentences, {
        "gaps": tagger._find_all("piece", rf"(?is)\G(.*?)({pattern})", 1),
        "found": tagger._find_all("piece", rf"(?is)\G(.*?)({pattern})", 2),
    })
    starts = tagger._starts(F.transform(F.arrays_zip("gaps", "found"), lambda p: F.concat(p["gaps"], p["found"])))
    cut = hits.select("note_id", "piece_start", F.length("piece").alias("size"), "found", "gaps", starts.alias("starts"))
    kinds, directions = _of_cue(cues, 1), _of_cue(cues, 2)

    def cue(k: Column) -> Column:
        name = tagger._loose(F.get("found", k))
        begin = F.get("starts", k) + F.length(F.get("gaps", k))
        return F.struct(
            begin.alias("begin"), (begin + F.length(F.get("found", k))).alias("end"),
            F.element_at(kinds, name).alias("kind"), F.element_at(directions, name).alias("direction"),
        )

    listed = compute_once(
        cut, {"cues": F.transform(F.sequence(F.lit(0), F.size("found") - 1), cue)}
    ).select("note_id", "piece_start", "size", "cues")
    stops = F.filter("cues", lambda c: c["kind"] == STOP)
    acting = F.filter("cues", lambda c: c["direction"] != "")
    each = listed.select("note_id", "piece_start", "size", stops.alias("stops"), F.explode(acting).alias("cue"))
    # Stops are in the order of the text.
    after = F.filter("stops", lambda s: s["begin"] >= F.col("cue.end"))
    before = F.filter("stops", lambda s: s["end"] <= F.col("cue.begin"))
    ahead = F.struct(
        F.col("cue.end").alias("first"), F.coalesce(F.get(after, F.lit(0))["begin"], F.col("size")).alias("last")
    )
    behind = F.struct(
        F.coalesce(F.try_element_at(before, F.lit(-1))["end"], F.lit(0)).alias("first"), F.col("cue.begin").alias("last")
    )
    direction = F.col("cue.direction")
    spans = F.when(direction == FORWARD, F.array(ahead)).when(direction == BACKWARD, F.array(behind)).otherwise(
        F.array(ahead, behind)
    )
    return each.select("note_id", "piece_start", F.col("cue.kind").alias("kind"), F.inline(spans)).select(
        "note_id", (F.col("piece_start") + F.col("first")).alias("first"), (F.col("piece_start") + F.col("last")).alias("last"), "kind"
    ).filter(F.col("first") < F.col("last"))


def with_assertion(mentions: DataFrame, notes: DataFrame, cues: Sequence[tuple[str, str, str]] = CUES) -> DataFrame:
    """``mentions`` with ``certainty``, ``status`` and ``experiencer`` by the scopes that hold their first character.

    A negated mention is negated whatever else is said of it. ``certainty`` replaces a column of that name.
    """
    listed = intervals.list_by_piece(cue_scopes(notes, cues), "note_id")
    placed = intervals.attach(mentions, listed, "note_id", "start")

    def says(kind: str) -> Column:
        return F.exists("spans", lambda s: s["kind"] == kind)

    return compute_once(placed, {
        "certainty": F.when(says(NEGATION), NEGATED).when(says(POSSIBILITY), POSSIBLE).otherwise(POSITIVE),
        "status": F.when(says(HISTORY), PAST).otherwise(PRESENT),
        "experiencer": F.when(says(OTHER_PERSON), OTHER).otherwise(PATIENT),
    }).drop("spans")
