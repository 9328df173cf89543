"""Span-annotated corpus from mentions: clean, locate, label, expand, assemble, split.

The corpus key is the SHA-1 of the cleaned snippet. Many mentions can share a snippet, so
they are first reduced to one row per snippet and variant with an aggregate that combines
before the shuffle; a snippet copied into very many notes stays cheap. What is collected
per snippet afterwards is one entry per variant, bounded by the snippet itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clinote.functions import ranking, text
from clinote.functions.columns import compute_once
from clinote.functions.tokenizer import Rules, expand_to_rule_tokens, with_rule_tokens
from clinote.operators.crosswalk import exclude_concept_ids

TERM_USAGE = "label_term_usage"
POSITIVE_CONCEPTS = "label_positive_concepts"
NEGATED_CONCEPTS = "label_negated_concepts"
STYLES = (TERM_USAGE, POSITIVE_CONCEPTS, NEGATED_CONCEPTS)

# Concept kept out of the corpus and test share.
EXCLUDED_CONCEPT_ID = 4266367
TEST_FRACTION = 0.3


def cap_mentions(mentions: DataFrame, n: int | None = None) -> DataFrame:
    """First ``n`` mentions by note where a cap is asked for; all by default."""
    return mentions if n is None else mentions.orderBy("note_id", "note_nlp_id").limit(n)


def clean(mentions: DataFrame) -> DataFrame:
    """Replace the snippet by its cleaned form and add its SHA-1; rows without modifiers go."""
    usable = mentions.filter(F.col("snippet").isNotNull() & F.col("term_modifiers").isNotNull())
    cleaned = compute_once(usable, {"snippet": text.clean_snippet(F.col("snippet"))})
    return cleaned.withColumn("sha1", F.sha1("snippet"))


def locate(cleaned: DataFrame) -> DataFrame:
    """Add ``start, end`` of the variant's first occurrence; mentions not found are dropped."""
    start = text.start_of(F.col("snippet"), F.col("lexical_variant"))
    return (
        cleaned.withColumn("start", start)
        .filter(F.col("start") >= 0)
        .withColumn("end", F.col("start") + F.length("lexical_variant"))
    )


def prepare(mentions: DataFrame, *, exclude_ids: list[int], cap: int | None = None) -> DataFrame:
    """Located mentions from raw ones: exclusion, cap, cleaning, location."""
    return locate(clean(cap_mentions(exclude_concept_ids(mentions, exclude_ids), cap)))


def metadata(located: DataFrame) -> DataFrame:
    """One row per located mention, repeats included."""
    return located.select(
        "sha1",
        "lexical_variant",
        "note_id",
        "note_nlp_id",
        F.split("term_modifiers", ",").alias("term_modifiers"),
        "note_nlp_concept_id",
        F.struct("start", "end").alias("offsets"),
    )


def snippet_groups(located: DataFrame) -> DataFrame:
    """Mentions, notes and variants per distinct snippet."""
    return located.groupBy("sha1").agg(
        F.count("*").alias("n_mentions"),
        F.count_distinct("note_id").alias("n_notes"),
        F.count_distinct("lexical_variant").alias("n_variants"),
        F.min("note_id").alias("first_note_id"),
    )


def first_variants(located: DataFrame) -> DataFrame:
    """The first mention of each variant per snippet, in note order, whatever its certainty.

    Result: ``sha1, lexical_variant, snippet, note_id, note_nlp_id, certainty,
    note_nlp_concept_id, start, end``.
    """
    labelled = located.withColumn("certainty", text.certainty_value(F.col("term_modifiers"))).filter(
        F.col("certainty").isNotNull()
    )
    first = F.min(F.struct("note_id", "note_nlp_id", "certainty", "note_nlp_concept_id", "start", "end"))
    return (
        labelled.groupBy("sha1", "lexical_variant")
        .agg(first.alias("first"), F.any_value("snippet").alias("snippet"))
        .select("sha1", "lexical_variant", "snippet", "first.*")
    )


def concept_label(concept_id: Column, concept_name: Column) -> Column:
    """``name|id``, or the id alone for an unknown concept."""
    number = concept_id.cast("string")
    return F.coalesce(F.concat(concept_name, F.lit("|"), number), number)


def with_concept_label(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    names = concepts.select(F.col("concept_id").alias("note_nlp_concept_id"), "concept_name")
    labelled = rows.join(names, "note_nlp_concept_id", "left")
    return labelled.withColumn(
        "concept_label", concept_label(F.col("note_nlp_concept_id"), F.col("concept_name"))
    ).drop("concept_name")


def used_concepts(concepts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Concepts that occur in the mentions."""
    used = mentions.select(F.col("note_nlp_concept_id").alias("concept_id")).distinct()
    return concepts.join(used, "concept_id", "left_semi")


def label(first: DataFrame, concepts: DataFrame, style: str) -> DataFrame:
    """Add ``label`` for the annotation style; null where the style leaves the mention out."""
    certainty = F.col("certainty")
    if style == TERM_USAGE:
        return first.withColumn("label", certainty)
    if style not in STYLES:
        raise ValueError(f"unknown annotation style {style!r}; choose one of {', '.join(STYLES)}")
    wanted = text.POSITIVE if style == POSITIVE_CONCEPTS else text.NEGATED
    named = with_concept_label(first, concepts)
    return named.withColumn("label", F.when(certainty == wanted, F.col("concept_label"))).drop("concept_label")


def expand_spans(rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Grow ``start, end`` to whole tokens of the snippet: word runs, or the tokens of a rule tokenizer."""
    if rules is not None:
        return expand_to_rule_tokens(rows, rules=rules)
    start, end = text.expand_to_tokens(F.col("snippet"), F.col("start"), F.col("end"))
    return compute_once(rows, {"start": start, "end": end})


def _overlapping(ents: Column) -> Column:
    """True when two spans of the sorted list share a character."""
    walked = F.aggregate(
        ents,
        F.struct(F.lit(0).alias("reach"), F.lit(False).alias("clash")),
        lambda seen, span: F.struct(
            F.greatest(seen["reach"], span["end"]).alias("reach"),
            (seen["clash"] | (span["start"] < seen["reach"])).alias("clash"),
        ),
        lambda seen: seen["clash"],
    )
    return walked


def documents(first: DataFrame, concepts: DataFrame, style: str, rules: Rules | None = None) -> DataFrame:
    """One row per snippet: ``sha1, text, ents, overlaps``; ``ents`` may be empty."""
    labelled = expand_spans(label(first, concepts, style), rules)
    entity = F.when(F.col("label").isNotNull(), F.struct("start", "end", "label"))
    return (
        labelled.groupBy("sha1")
        .agg(F.any_value("snippet").alias("text"), F.array_sort(F.collect_list(entity)).alias("ents"))
        .withColumn("overlaps", _overlapping(F.col("ents")))
    )


def corpora(
    first: DataFrame, concepts: DataFrame, styles: tuple[str, ...] = STYLES, rules: Rules | None = None
) -> DataFrame:
    """Annotated documents of several styles with their ``style``, from one pass over the mentions.

    A style in which the spans of a document overlap leaves that document out.
    """
    rows = expand_spans(with_concept_label(first, concepts), rules)
    certainty = F.col("certainty")
    labels = {
        TERM_USAGE: certainty,
        POSITIVE_CONCEPTS: F.when(certainty == text.POSITIVE, F.col("concept_label")),
        NEGATED_CONCEPTS: F.when(certainty == text.NEGATED, F.col("concept_label")),
    }
    entity = {s: F.struct("start", "end", labels[s].alias("label")) for s in styles}
    grouped = rows.groupBy("sha1").agg(
        F.any_value("snippet").alias("text"),
        *[F.array_sort(F.collect_list(F.when(labels[s].isNotNull(), entity[s]))).alias(s) for s in styles],
    )
    per_style = F.array(*[F.struct(F.lit(s).alias("style"), F.col(s).alias("ents")) for s in styles])
    each = grouped.select("sha1", "text", F.inline(per_style))
    return each.filter(~_overlapping(F.col("ents"))).select("sha1", "text", "ents", "style")


def corpus(first: DataFrame, concepts: DataFrame, style: str, rules: Rules | None = None) -> DataFrame:
    """Annotated documents; one whose spans overlap is left out whole."""
    return documents(first, concepts, style, rules).filter(~F.col("overlaps")).drop("overlaps")


def with_position(corpus_rows: DataFrame) -> DataFrame:
    """0-based position of each document, in order of its SHA-1."""
    return ranking.with_position(corpus_rows, "sha1", "position")


def split(corpus_rows: DataFrame, *, test_fraction: float = TEST_FRACTION, seed: str = "0") -> DataFrame:
    """Add ``split``: exactly floor(n * test_fraction) documents are ``test``, the rest ``train``.

    Drawn by a seeded digest, so the same corpus always splits the same way.
    """
    if not 0.0 <= test_fraction <= 1.0:
        raise ValueError("test_fraction must lie between 0 and 1")
    drawn = corpus_rows.withColumn("_draw", F.sha1(F.concat(F.lit(seed), F.col("sha1"))))
    is_test = ranking.lowest_fraction(drawn, "_draw", test_fraction)
    return drawn.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_draw")


def split_by_group(
    rows: DataFrame, group: str, *, test_fraction: float = TEST_FRACTION, seed: str = "0"
) -> DataFrame:
    """Add ``split`` so that a whole group (such as a note) falls on one side.

    The share is met on average, not exactly: each group is placed by its own digest. ``splits`` meets it exactly.
    """
    if not 0.0 <= test_fraction <= 1.0:
        raise ValueError("test_fraction must lie between 0 and 1")
    steps = 1_000_000
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(steps))
    return rows.withColumn("split", F.when(draw < int(test_fraction * steps), "test").otherwise("train"))


def with_tokens(corpus_rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Add ``tokens``, the texts of the tokens in order."""
    if rules is not None:
        return with_rule_tokens(corpus_rows, "text", rules, as_texts=True)
    return corpus_rows.withColumn("tokens", text.tokens(F.col("text")))
