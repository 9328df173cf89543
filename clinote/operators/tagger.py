"""Dictionary and rule tagging of note text, with assertion status per mention.

Notes are cut into chunks of a fixed number of words, so the work per match does not
depend on the length of the note and one long note becomes many rows. A chunk travels
with its two neighbours; as every chunk but the last has ``CHUNK_WORDS`` words, context
windows up to that size are exact. The lexicon is joined on the first word of its terms
with whatever plan its size calls for; a broadcast lexicon leaves the text unshuffled. The
result does not depend on the plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clinote.functions.columns import compute_once
from clinote.functions.text import CERTAINTY_PREFIX, NEGATED, POSITIVE
from clinote.operators.ingest import assign_nlp_id

CHUNK_WORDS = 64
WORD = r"[\p{L}\p{M}\p{N}]"
GAP = r"[^\p{L}\p{M}\p{N}]"
_CHUNK = f"(?:{WORD}++|{GAP}++){{1,{2 * CHUNK_WORDS}}}+"
_GAP_AND_WORD = f"{GAP}*{WORD}+"
_LINE = r"[^\n]*\n|[^\n]+"
_SUM_BLOCK = 256

NEGATION_CUES = ("no", "not", "denies", "without")
CUE_WINDOW = 5
#: A cue does not reach over these.
CUE_STOPS = r"[.;\n]"
SNIPPET_RADIUS = 120
SYSTEM_NAME = "clinote"


def _find_all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _running(lengths: Column, start: Column) -> Column:
    """Start of each piece of the given lengths; one entry more than there are pieces."""
    return F.aggregate(
        lengths, F.array(start), lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n))
    )


def _starts(pieces: Column) -> Column:
    """0-based start of each piece when the pieces are laid end to end.

    Summed in blocks, then within them: appending to one array for all pieces would take
    the square of their number. The lengths are bound once, as each block reads them.
    """
    lengths = F.transform(pieces, lambda piece: F.length(piece))
    return F.element_at(F.transform(F.array(lengths), _block_starts), 1)


def _block_starts(lengths: Column) -> Column:
    n_blocks = F.greatest(F.ceil(F.size(lengths) / _SUM_BLOCK).cast("int"), F.lit(1))
    blocks = F.transform(
        F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(lengths, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK))
    )

    def starts(bound: Column) -> Column:
        sums = F.transform(bound, lambda block: F.aggregate(block, F.lit(0), lambda x, y: x + y))
        firsts = F.slice(_running(sums, F.lit(0)), F.lit(1), F.size(bound))
        return F.flatten(F.zip_with(
            bound, firsts, lambda block, first: F.slice(_running(block, first), F.lit(1), F.size(block))
        ))

    return F.element_at(F.transform(F.array(blocks), starts), 1)


def _chunks(notes: DataFrame) -> DataFrame:
    """``note_id, before, body, after, chunk_start``: whole text, in word-bounded chunks."""
    pieces = F.col("pieces")
    parts = F.arrays_zip(
        F.concat(F.array(F.lit("")), pieces).alias("before"),
        pieces.alias("body"),
        F.concat(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit(""))).alias("after"),
        _starts(pieces).alias("chunk_start"),
    )
    return (
        notes.select("note_id", _find_all("note_text", _CHUNK).alias("pieces"))
        .select("note_id", F.explode(parts).alias("part"))
        .select("note_id", "part.*")
        .filter(F.col("body").isNotNull())
    )


def _with_words(chunks: DataFrame) -> DataFrame:
    """Adds the ``words`` of the body in lower case, and ``tiles``, each word as it stands with the gap before it."""
    return chunks.select(
        "*", _find_all(F.lower("body"), WORD + "+").alias("words"), _find_all("body", _GAP_AND_WORD).alias("tiles")
    )


def _sent_around(terms: DataFrame) -> bool:
    """Whether the planner broadcasts the terms: a left join can be broadcast on the right side only."""
    word = terms.sparkSession.range(1).select(F.col("id").cast("string").alias("token"))
    plan = word.join(terms, "token", "left")._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan


def _candidates(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """Chunks with their words, a row for every term at every word that it begins with: ``word_no`` and the term.

    Terms that are sent around meet the words where the text was read. Terms that are not meet the distinct words of a
    chunk under its hash, and come to the chunk with it, so that a chunk is shuffled once and not once for each of its
    words. The words are then looked up in the chunk, so chunks that share a hash are told apart; chunks that are equal
    have the terms of all their copies, of which one is kept.

    The outer form of the explode keeps Catalyst from adding a not-empty filter that would
    cut the chunk into words again; the null row of a wordless chunk matches no term.
    """
    if chunks.isStreaming or _sent_around(terms):
        words = _with_words(chunks)
        return words.select("*", F.posexplode_outer("words").alias("word_no", "token")).join(terms, "token")
    keyed = chunks.withColumn("chunk", F.xxhash64("note_id", "chunk_start", "before", "body", "after"))
    distinct = F.array_distinct(_find_all(F.lower("body"), WORD + "+"))
    met = keyed.select("chunk", F.explode_outer(distinct).alias("token")).join(terms, "token")
    # What is cut from a chunk is cut behind its shuffle, once, and before the join.
    cut = _with_words(keyed.repartition("chunk"))
    found = cut.join(met.repartition("chunk").distinct(), "chunk")
    # Compared row by row: a function over the array would be interpreted, and with it all that stands above the join.
    return found.select("*", F.posexplode_outer("words").alias("word_no", "word")).filter(F.col("word") == F.col("token"))


def _loose(text: Column) -> Column:
    """Form in which terms are compared: lower case, runs of blanks and hyphens as one blank."""
    return F.regexp_replace(F.lower(text), r"[\s-]+", " ")


def _parsed(lexicon: DataFrame) -> DataFrame:
    """Terms with the symbols around them taken apart: ``lead, core, tail``."""
    return lexicon.withColumns({
        "core": F.regexp_extract("term", rf"(?s){WORD}(?:.*{WORD})?", 0),
        "lead": F.trim(F.regexp_extract("term", rf"^{GAP}*", 0)),
        "tail": F.trim(F.regexp_extract("term", rf"{GAP}*$", 0)),
    })


def unusable_terms(lexicon: DataFrame) -> DataFrame:
    """Lexicon rows that ``tag`` cannot look up: without a letter or digit, or null."""
    return _parsed(lexicon).filter(F.coalesce(F.col("core"), F.lit("")) == "").select(*lexicon.columns)


def _terms(lexicon: DataFrame) -> DataFrame:
    """Lexicon keyed by the first word of each term; terms of one concept that read the same are one."""
    words = _find_all("core", WORD + "+")
    keyed = _parsed(lexicon).filter(F.col("core") != "").select(
        "concept_id", "term", "lead", "tail",
        F.lower(words.getItem(0)).alias("token"),
        F.size(words).alias("n_words"),
        _loose(F.col("core")).alias("loose_term"),
    )
    return keyed.groupBy("concept_id", "lead", "tail", "token", "n_words", "loose_term").agg(F.min("term").alias("term"))


def _certainty(prefix: Column, cues: Sequence[str], window: int, stops: str | None) -> Column:
    """Negated when one of the last words of the prefix, behind the last stop, is a cue."""
    if not cues:
        raise ValueError("at least one negation cue is needed")
    if any(not c.isalnum() for c in cues):
        raise ValueError("a cue is a single word")
    reached = F.element_at(F.split(prefix, stops), -1) if stops else prefix
    near = _last(_find_all(F.lower(reached), WORD + "+"), F.lit(window))
    negated = F.arrays_overlap(near, F.array(*[F.lit(c.lower()) for c in cues]))
    return F.when(negated, F.lit(NEGATED)).otherwise(F.lit(POSITIVE))


def _last(words: Column, n: Column) -> Column:
    """The last ``n`` elements, or all of them."""
    kept = F.least(F.size(words), n)
    return F.slice(words, F.size(words) - kept + 1, kept)


def _snippet(prefix: Column, suffix: Column, radius: int) -> Column:
    return F.concat(F.right(prefix, F.lit(radius)), F.col("lexical_variant"), F.left(suffix, F.lit(radius)))


def tag(
    notes: DataFrame,
    lexicon: DataFrame,
    *,
    cues: Sequence[str] = NEGATION_CUES,
    cue_window: int = CUE_WINDOW,
    cue_stops: str | None = CUE_STOPS,
    snippet_radius: int = SNIPPET_RADIUS,
) -> DataFrame:
    """Find every lexicon term in every note.

    ``notes`` has ``note_id, note_text``; ``lexicon`` has ``concept_id, term``. A term of
    several words matches the same words with blanks or hyphens between them; case is
    ignored. Symbols at either end of a term (``HER2+``) must stand there in the text, and
    belong to the mention. ``cue_stops`` is a pattern that ends the reach of a cue. Result:
    ``note_id, concept_id, term, start, lexical_variant, certainty, snippet``.
    """
    if max(cue_window, snippet_radius // 2) > CHUNK_WORDS:
        raise ValueError(f"context is limited to {CHUNK_WORDS} words and {2 * CHUNK_WORDS} characters")
    found = _candidates(_chunks(notes), _terms(lexicon))
    # From here on the work is per match, not per word; only a term that runs on behind its chunk is sought by a pattern.
    word_no, n_words = F.col("word_no"), F.col("n_words")
    tile = F.get("tiles", word_no)
    gap = F.length(tile) - F.length(F.regexp_extract(tile, f"{WORD}+", 0))
    here = F.length(F.array_join(F.slice("tiles", F.lit(1), word_no), "")) + gap
    inside = F.substring(F.array_join(F.slice("tiles", word_no + 1, n_words), ""), gap + 1, F.length("body"))
    onwards = F.substring(F.concat("body", "after"), here + 1, F.length("body") + F.length("after"))
    behind = F.array_join(F.slice(_find_all(onwards, _GAP_AND_WORD), F.lit(1), n_words), "")
    core = F.when(word_no + n_words <= F.size("tiles"), inside).otherwise(behind)
    placed = compute_once(found, {"here": here, "core": core}).filter(
        (n_words == 1) | (_loose(F.col("core")) == F.col("loose_term"))
    )
    whole = F.concat("before", "body", "after")
    start = F.length("before") + F.col("here") - F.length("lead")
    length = F.length("lead") + F.length("core") + F.length("tail")
    cut = compute_once(placed, {"at": start, "lexical_variant": F.substring(whole, start + 1, length)})
    # The text around the words must be the term's own symbols.
    symbols = F.startswith(F.col("lexical_variant"), F.col("lead")) & F.endswith(F.col("lexical_variant"), F.col("tail"))
    prefix = F.substring(whole, F.lit(1), F.col("at"))
    suffix = F.substring(whole, F.col("at") + length + 1, F.lit(snippet_radius))
    return cut.filter(symbols).select(
        "note_id",
        "concept_id",
        "term",
        (F.col("chunk_start") - F.length("before") + F.greatest(F.col("at"), F.lit(0))).alias("start"),
        "lexical_variant",
        _certainty(prefix, cues, cue_window, cue_stops).alias("certainty"),
        _snippet(prefix, suffix, snippet_radius).alias("snippet"),
    )


def tag_rules(
    notes: DataFrame,
    rules: Sequence[tuple[int, str]],
    *,
    cues: Sequence[str] = NEGATION_CUES,
    cue_window: int = CUE_WINDOW,
    cue_stops: str | None = CUE_STOPS,
    snippet_radius: int = SNIPPET_RADIUS,
) -> DataFrame:
    """Find every match of ``(concept_id, pattern)`` rules, line by line.

    Patterns are Java regular expressions without capturing groups, matched without
    regard to case; they go into the plan as literals. Same result columns as ``tag``,
    with the pattern between slashes as ``term``; cues and snippets stay within the line.
    """
    any_rule = "(?is)" + "|".join(f"(?:{pattern})" for _, pattern in rules)
    lines = (
        notes.select("note_id", _find_all("note_text", _LINE).alias("pieces"))
        .select("note_id", F.inline(F.arrays_zip(
            F.col("pieces").alias("line"), _starts(F.col("pieces")).alias("line_start")
        )))
        .filter(F.col("line").rlike(any_rule))
    )

    def hits(pattern: str, group: int) -> Column:
        # Anchored to the end of the match before, so a line is scanned once.
        return _find_all("line", rf"(?is)\G(.*?)((?:{pattern}))", group)

    per_rule = F.array(*[
        F.struct(
            F.lit(concept_id).alias("concept_id"),
            F.lit(f"/{pattern}/").alias("term"),
            hits(pattern, 1).alias("gaps"),
            hits(pattern, 2).alias("found"),
        )
        for concept_id, pattern in rules
    ])
    ruled = lines.select("note_id", "line", "line_start", F.inline(per_rule)).filter(F.size("found") > 0)
    pairs = F.transform(F.arrays_zip("gaps", "found"), lambda p: F.concat(p["gaps"], p["found"]))
    placed = ruled.select(
        "note_id", "concept_id", "term", "line", "line_start",
        F.inline(F.arrays_zip(
            F.col("gaps").alias("gap"),
            F.col("found").alias("lexical_variant"),
            _starts(pairs).alias("pair_start"),
        )),
    ).filter(F.col("lexical_variant") != "")
    offset = F.col("pair_start") + F.length("gap")
    prefix = F.substring("line", F.lit(1), offset)
    suffix = F.substring("line", offset + F.length("lexical_variant") + 1, F.lit(snippet_radius))
    return placed.select(
        "note_id",
        "concept_id",
        "term",
        (F.col("line_start") + offset).alias("start"),
        "lexical_variant",
        _certainty(prefix, cues, cue_window, cue_stops).alias("certainty"),
        _snippet(prefix, suffix, snippet_radius).alias("snippet"),
    )


def to_note_nlp(
    mentions: DataFrame, *, nlp_datetime: dt.datetime | None = None, dense_ids: bool = False
) -> DataFrame:
    """Mentions in the form of the CDM table ``note_nlp``.

    The term or pattern is part of what an id is made of, so two of one concept at one
    place have ids of their own. Of mentions with ``section_concept_id``, ``status`` and ``experiencer``
    (see ``context``) these are taken over; ``term_temporal`` is the status.
    """
    known = mentions.columns
    section = F.col("section_concept_id") if "section_concept_id" in known else F.lit(None)
    experiencer = F.col("experiencer") if "experiencer" in known else F.lit("Patient")
    modifiers = [F.lit(CERTAINTY_PREFIX), F.col("certainty"), F.lit(",experiencer="), experiencer]
    if "status" in known:
        modifiers += [F.lit(",status="), F.col("status")]
    when = F.lit(nlp_datetime).cast("timestamp_ntz") if nlp_datetime else F.localtimestamp()
    rows = mentions.select(
        "note_id",
        section.cast("int").alias("section_concept_id"),
        "snippet",
        F.col("start").cast("string").alias("offset"),
        "lexical_variant",
        F.col("concept_id").alias("note_nlp_concept_id"),
        F.lit(0).alias("note_nlp_source_concept_id"),
        F.lit(SYSTEM_NAME).alias("nlp_system"),
        F.to_date(when).alias("nlp_date"),
        when.alias("nlp_datetime"),
        F.when(F.col("certainty") == POSITIVE, "Y").otherwise("N").alias("term_exists"),
        (F.col("status") if "status" in known else F.lit(None)).cast("string").alias("term_temporal"),
        F.concat(*modifiers).alias("term_modifiers"),
        "term",
    )
    return assign_nlp_id(rows, dense=dense_ids).drop("term")
