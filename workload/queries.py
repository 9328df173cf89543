"""One query per operator, each over the whole tables of a data folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clinote import schemas
from clinote.functions.text import NEGATED, POSITIVE, spreadsheet_safe
from clinote.operators import (
    annotate, automaton, cohort, context, crosswalk, errors, evaluate, features, ingest, ner, profile, review, sketches,
    splits, tagger,
)
from clinote.plans import comparison, corpus as corpus_plan, tagging
from clinote.session import scratch_path, store
from clinote.sources import layout, readers, registry, sinks
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NLP_TIME = dt.datetime(2021, 3, 15, 12, 30)
CLASSES_3 = ["Emergency medicine", "Admission evaluation", "Discharge summary"]
DRILL_ENCOUNTER = 2


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def reviewed_before() -> Column:
    return F.lit(fx.REVIEWED_BEFORE).cast("timestamp_ntz")


def spans_text(ents: str) -> Column:
    return F.array_join(
        F.transform(ents, lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["label"])),
        ";",
    )


# Sources and sinks

@query
def scan_note(spark, sf):
    documents = fx.table(spark, sf, "documents")
    return readers.read_query(
        spark, "select doc_id as note_id, text as note_text from {documents}", documents=documents
    )


@query
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "staging")
    sinks.write_csv(fx.raw_documents(spark, sf), path)
    return readers.read_staging(spark, path)


@query
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "concept-lists")
    lists = features.concept_lists(_reviewed(spark, sf))
    sinks.write_json(lists, path)
    return _list_text(readers.read_json(spark, path, lists.schema))


@query
def corpus_roundtrip(spark, sf):
    documents = _corpus(spark, sf, ner.POSITIVE_CONCEPTS)
    stored = corpus_plan.store_corpus(
        spark, documents, ner.POSITIVE_CONCEPTS, scratch_path(spark, "documents"), scratch_path(spark, "corpus")
    )
    return stored.select("sha1", "text", spans_text("ents").alias("ents"), "style", "split")


@query
def load_mapping(spark, sf):
    note_nlp = tagging.tag_notes(fx.note_texts(spark, sf), fx.lexicon(spark), nlp_datetime=NLP_TIME, cues=fx.CUES)
    return tagging.load_rows(note_nlp).withColumn("nlp_date", F.col("nlp_date").cast("string"))


@query
def documents_to_note(spark, sf):
    note = ingest.documents_to_note(fx.raw_documents(spark, sf))
    return note.withColumn("note_date", F.col("note_date").cast("string"))


@query
def schema_violations(spark, sf):
    documents = fx.table(spark, sf, "documents")
    dirty = documents.select(
        F.col("doc_id").alias("note_id"),
        F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")).alias("person_id"),
        F.col("text").alias("note_title"),
        F.col("source").alias("note_source_value"),
    )
    return schemas.violations(dirty, schemas.NOTE)


@query
def assign_nlp_id(spark, sf):
    rows = _tagged(spark, sf).select(
        "note_id",
        F.col("start").cast("string").alias("offset"),
        F.col("concept_id").alias("note_nlp_concept_id"),
        "lexical_variant",
    )
    return ingest.assign_nlp_id(store(spark, rows, "new-mentions"), dense=True)


@query
def continuing_ids(spark, sf):
    """Mentions of every second note are loaded first, then those of all: the numbers go on, known ones stay."""
    rows = store(spark, _tagged(spark, sf).select(
        "note_id", F.col("start").cast("string").alias("offset"), F.col("concept_id").alias("note_nlp_concept_id"),
        "lexical_variant",
    ), "new-mentions")
    path, key = scratch_path(spark, "registry"), rows.columns
    registry.number_keys(rows.filter("note_id % 2 = 0"), key, path, "note_nlp_id")
    return registry.number_keys(rows, key, path, "note_nlp_id")


@query
def repeated_load(spark, sf):
    """All notes loaded, and loaded again."""
    note_nlp = tagging.tag_notes(fx.note_texts(spark, sf), fx.lexicon(spark), nlp_datetime=NLP_TIME, cues=fx.CUES)
    rows, path = tagging.load_rows(note_nlp), scratch_path(spark, "note-nlp")
    for _ in range(2):
        registry.replace_notes(rows, fx.note_texts(spark, sf), path)
    loaded = registry.read_notes(spark, path, rows.schema)
    return loaded.withColumn("nlp_date", F.col("nlp_date").cast("string"))


@query
def token_records(spark, sf):
    records = annotate.token_records(_corpus(spark, sf, ner.POSITIVE_CONCEPTS))
    return records.select(
        "text",
        F.array_join("tokens", "|").alias("tokens"),
        spans_text("prediction").alias("prediction"),
        "prediction_agent",
        F.col("metadata")["sha1"].alias("sha1"),
    )


@query
def text_records(spark, sf):
    records = annotate.text_records(_followup(spark, sf))
    return records.select(
        "id",
        F.col("inputs")["text"].alias("text"),
        *[F.col("metadata")[c].alias(c) for c in annotate.METADATA_COLUMNS],
        F.col("multi_label").cast("int").alias("multi_label"),
    )


@query
def record_batches(spark, sf):
    records = store(spark, annotate.text_records(_followup(spark, sf)), "records")
    return annotate.with_batch_id(records, 50).select("id", F.col("inputs")["text"].alias("text"), "batch_id")


# Filters and small reports

@query
def preview_notes(spark, sf):
    notes = fx.notes(spark, sf).select("note_id", "person_id", "note_class_concept_id", "visit_occurrence_id")
    return profile.preview(notes, "note_id", 10)


@query
def chart_value_columns(spark, sf):
    return features.drop_suffix(fx.reviews(spark, sf))


@query
def notes_in_class(spark, sf):
    return profile.notes_in_class(fx.notes(spark, sf), fx.concepts(spark), comparison.COMPARED_CLASSES).select(
        "note_id", "note_class_concept_id", "note_class_concept_name", "visit_occurrence_id"
    )


@query
def mentions_positive(spark, sf):
    return crosswalk.mentions_with_certainty(fx.mentions(spark, sf), POSITIVE)


@query
def mentions_negated(spark, sf):
    return crosswalk.mentions_with_certainty(fx.mentions(spark, sf), NEGATED)


@query
def exclude_concept_name(spark, sf):
    return crosswalk.named_mentions(fx.mentions(spark, sf), fx.concepts(spark), POSITIVE)


@query
def exclude_concept_ids(spark, sf):
    kept = crosswalk.exclude_concept_ids(fx.mentions(spark, sf), [fx.EXCLUDED_ID])
    return kept.select("note_nlp_id", "note_id", "note_nlp_concept_id")


@query
def numeric_encounters(spark, sf):
    return cohort.with_numeric_encounter(fx.visits(spark, sf))


@query
def selected_visits(spark, sf):
    return cohort.selected_visits(fx.visits(spark, sf), fx.checked(spark, sf))


@query
def visit_concept_drilldown(spark, sf):
    return profile.drill_down(
        fx.notes(spark, sf), fx.mentions(spark, sf), fx.concepts(spark),
        encounter_number=DRILL_ENCOUNTER, concept_name="Connective",
    ).select(
        "note_id", "person_id", "visit_occurrence_id", "note_class_concept_name",
        "note_nlp_id", "lexical_variant", "term_modifiers", "note_nlp_concept_id", "note_nlp_concept_name",
    )


@query
def clustered_drilldown(spark, sf):
    """The same from mentions that are stored by encounter, of which the scan skips the others."""
    path = scratch_path(spark, "mentions-by-encounter")
    mentions = profile.with_encounter(fx.mentions(spark, sf), fx.notes(spark, sf))
    layout.write_clustered(mentions, path, ["encounter_number", "note_id"], bloom={"note_id": 100_000})
    return profile.drill_down(
        fx.notes(spark, sf), readers.read_table(spark, path, schema=mentions.schema), fx.concepts(spark),
        encounter_number=DRILL_ENCOUNTER, concept_name="Connective",
    ).select(
        "note_id", "person_id", "visit_occurrence_id", "note_class_concept_name",
        "note_nlp_id", "lexical_variant", "term_modifiers", "note_nlp_concept_id", "note_nlp_concept_name",
    )


# Profiles

@query
def bucketed_coverage(spark, sf):
    """Coverage from notes and mentions that are stored in buckets of the note."""
    stored = []
    for name, df in [("notes", fx.notes(spark, sf)), ("mentions", fx.mentions(spark, sf))]:
        path = scratch_path(spark, f"bucketed-{name}")
        layout.write_bucketed(df, path, "note_id", 8)
        stored.append(layout.read_bucketed(spark, path, df.schema))
    return profile.match_coverage(*stored, fx.concepts(spark))


@query
def merged_profile(spark, sf):
    """Notes per class from stored months, two of which are refreshed; estimates beside the exact distinct counts."""
    notes, path = fx.notes(spark, sf), scratch_path(spark, "profile")
    sketches.refresh(notes, path, unit="month")
    sketches.refresh(notes, path, unit="month", periods=[dt.date(1995, 3, 1), dt.date(1997, 11, 1)])
    merged = sketches.merge(sketches.read(spark, path), sketches.CLASS)
    estimates = merged.select(sketches.CLASS, "n_notes", F.col("n_visits").alias("visits"), F.col("n").alias("persons"))
    exact = profile.by_class(notes, fx.concepts(spark)).drop("n_r")
    return exact.join(estimates, sketches.CLASS).select(
        F.col("n_notes").alias("n_r"), "n_visits", "n", "note_class_concept_name",
        sketches.within(F.col("visits"), F.col("n_visits")).alias("visits_within_bound"),
        sketches.within(F.col("persons"), F.col("n")).alias("persons_within_bound"),
    )


@query
def merged_concepts(spark, sf):
    """Mentions and matched notes per class and concept from stored months."""
    path = scratch_path(spark, "profile")
    sketches.refresh(fx.notes(spark, sf), path, fx.mentions(spark, sf), unit="month")
    merged = sketches.merge(sketches.read(spark, path), sketches.CLASS, sketches.CONCEPT)
    return merged.select(sketches.CLASS, sketches.CONCEPT, "n_r", "n_notes")


@query
def note_totals(spark, sf):
    return profile.totals(fx.notes(spark, sf))


@query
def notes_by_class(spark, sf):
    return profile.by_class(fx.notes(spark, sf), fx.concepts(spark))


@query
def match_coverage_by_class(spark, sf):
    return profile.match_coverage(fx.notes(spark, sf), fx.mentions(spark, sf), fx.concepts(spark))


@query
def mentions_by_class_concept(spark, sf):
    counted = profile.by_class_and_concept(fx.notes(spark, sf), fx.mentions(spark, sf), fx.concepts(spark))
    return profile.for_reading(counted)


@query
def positive_mentions_by_class_concept(spark, sf):
    return profile.by_class_and_concept(
        fx.notes(spark, sf), fx.mentions(spark, sf), fx.concepts(spark), certainty=POSITIVE
    )


@query
def used_concepts(spark, sf):
    return ner.used_concepts(fx.concepts(spark), fx.mentions(spark, sf))


# Crosswalk, features, reviews

def _all_classes(spark, sf, certainty):
    return comparison.build_crosswalk(fx.comparison(spark, sf), certainty)


def _crosswalk(spark, sf):
    return comparison.positive_crosswalk(fx.comparison(spark, sf))


def _counts(spark, sf):
    return features.concept_counts(_crosswalk(spark, sf))


def _with_unmatched(spark, sf):
    built = store(spark, _crosswalk(spark, sf), "crosswalk")
    return features.with_unmatched(features.concept_counts(built), features.unmatched_classes(built))


def _reviewed(spark, sf):
    """Counts and pairs without mentions, of reviewed encounters."""
    keyed = _reviews(spark, sf).withColumn("encounter_number", F.col("encounter_number").try_cast("bigint"))
    return features.reviewed_concepts(_with_unmatched(spark, sf), keyed)


def _reviews(spark, sf):
    return comparison.eligible_reviews(fx.comparison(spark, sf), reviewed_before())


def _list_text(lists):
    return lists.select("encounter_number", F.array_join("note_nlp_concept_name", "|").alias("names"))


def _compared(spark, sf):
    return comparison.comparison_table(fx.comparison(spark, sf), fx.NAMES, reviewed_before())


def _plain(df):
    """Column names without the characters that need quoting."""
    return df.toDF(*[c.replace("note_nlp_concept_name=", "concept_").replace("|", "_") for c in df.columns])


@query
def crosswalk_positive(spark, sf):
    return _all_classes(spark, sf, POSITIVE)


@query
def crosswalk_negated(spark, sf):
    return _all_classes(spark, sf, NEGATED)


@query
def crosswalk_sorted(spark, sf):
    return sinks.sort_nulls_last(
        _crosswalk(spark, sf), "encounter_number", "note_class_concept_name", "note_nlp_concept_id"
    )


@query
def visit_core(spark, sf):
    return crosswalk.visit_core(_crosswalk(spark, sf))


@query
def concept_counts(spark, sf):
    return _counts(spark, sf)


@query
def unmatched_classes(spark, sf):
    return features.unmatched_classes(_crosswalk(spark, sf))


@query
def concept_counts_with_unmatched(spark, sf):
    return _with_unmatched(spark, sf)


@query
def unmatched_notes(spark, sf):
    return crosswalk.unmatched(_crosswalk(spark, sf)).select("encounter_number", "note_id", "note_class_concept_name")


@query
def reviewed_concepts(spark, sf):
    return _reviewed(spark, sf)


@query
def concept_lists(spark, sf):
    return _list_text(features.concept_lists(_reviewed(spark, sf)))


@query
def concept_one_hot(spark, sf):
    return _plain(features.one_hot(_reviewed(spark, sf), fx.NAMES))


@query
def concepts_without_column(spark, sf):
    return features.left_out(_reviewed(spark, sf), fx.NAMES[:4])


@query
def chart_reviews(spark, sf):
    return review.newest_first(_reviews(spark, sf))


@query
def chart_reviews_before_load(spark, sf):
    return comparison.eligible_reviews(fx.comparison(spark, sf), F.col("load_time"), CLASSES_3)


@query
def review_with_concepts(spark, sf):
    return _plain(_compared(spark, sf))


@query
def review_with_flags(spark, sf):
    return _plain(evaluate.with_flags(_compared(spark, sf), fx.PAIRS))


@query
def outcome_flags(spark, sf):
    return evaluate.long_flags(_compared(spark, sf), fx.PAIRS, keep=["encounter_number"])


@query
def confusion_counts(spark, sf):
    return evaluate.confusion(_compared(spark, sf), fx.PAIRS)


@query
def nlp_performance(spark, sf):
    return comparison.performance(fx.comparison(spark, sf), fx.PAIRS, reviewed_before())


@query
def stage_counts(spark, sf):
    tables = fx.comparison(spark, sf)
    everything = store(spark, comparison.build_crosswalk(tables, POSITIVE), "crosswalk")
    positive = everything.filter(F.col("note_class_concept_name").isin(comparison.COMPARED_CLASSES))
    counts = features.concept_counts(positive)
    rows = store(spark, features.with_unmatched(counts, features.unmatched_classes(positive)), "concept-rows")
    reviews = comparison.eligible_reviews(tables, reviewed_before())
    keyed = reviews.withColumn("encounter_number", F.col("encounter_number").try_cast("bigint"))
    split = ner.split(store(spark, _corpus(spark, sf, ner.POSITIVE_CONCEPTS).select("sha1"), "corpus-keys"))
    return comparison.stage_counts({
        "positive crosswalk": everything,
        "positive crosswalk in classes": positive,
        "negated crosswalk": comparison.build_crosswalk(tables, NEGATED),
        "negated crosswalk in classes": comparison.negated_crosswalk(tables),
        "visits": crosswalk.visit_core(positive),
        "chart reviews": reviews,
        "concept rows": counts,
        "concept rows before review": rows,
        "concept rows after review": features.reviewed_concepts(rows, keyed),
        "snippets": ner.snippet_groups(_located(spark, sf)),
        "training documents": split.filter("split = 'train'"),
        "test documents": split.filter("split = 'test'"),
    })


@query
def written_stage_counts(spark, sf):
    """The same stages stored one by one, each counted by its write."""
    tables, stages = fx.comparison(spark, sf), comparison.CountedStages(spark)
    in_classes = F.col("note_class_concept_name").isin(comparison.COMPARED_CLASSES)
    everything = stages.store(
        "positive crosswalk", comparison.build_crosswalk(tables, POSITIVE), {"positive crosswalk in classes": in_classes}
    )
    stages.store(
        "negated crosswalk", comparison.build_crosswalk(tables, NEGATED), {"negated crosswalk in classes": in_classes}
    )
    positive = everything.filter(in_classes)
    stages.store("visits", crosswalk.visit_core(positive))
    reviews = stages.store("chart reviews", comparison.eligible_reviews(tables, reviewed_before()))
    keyed = reviews.withColumn("encounter_number", F.col("encounter_number").try_cast("bigint"))
    counts = stages.store("concept rows", features.concept_counts(positive))
    rows = features.with_unmatched(counts, features.unmatched_classes(positive))
    rows = stages.store("concept rows before review", rows)
    stages.store("concept rows after review", features.reviewed_concepts(rows, keyed))
    stages.store("snippets", ner.snippet_groups(_located(spark, sf)))
    keys = store(spark, _corpus(spark, sf, ner.POSITIVE_CONCEPTS).select("sha1"), "corpus-keys")
    train, test = (F.col("split") == side for side in ("train", "test"))
    stages.store("documents", ner.split(keys), {"training documents": train, "test documents": test})
    return stages.report().filter("stage <> 'documents'")


# Tagging

def _tagged(spark, sf):
    return tagger.tag(fx.note_texts(spark, sf), fx.lexicon(spark), cues=fx.CUES, cue_window=2)


@query
def tag_mentions(spark, sf):
    return _tagged(spark, sf).select("note_id", "concept_id", "term", "start", "lexical_variant")


@query
def mention_certainty(spark, sf):
    return _tagged(spark, sf).select("note_id", "start", "concept_id", "certainty")


@query
def tag_wide_terms(spark, sf):
    """Terms of several words, with hyphens and with symbols."""
    found = tagger.tag(fx.note_texts(spark, sf), fx.wide_lexicon(spark))
    return found.select("note_id", "concept_id", "term", "start", "lexical_variant")


@query
def tag_wide_terms_shuffled(spark, sf):
    """The same with a lexicon that is joined by shuffling, as one too large to be sent around."""
    found = tagger.tag(fx.note_texts(spark, sf), fx.wide_lexicon(spark).hint("merge"))
    return found.select("note_id", "concept_id", "term", "start", "lexical_variant")


@query
def tag_wide_terms_compiled(spark, sf):
    """The same by an automaton."""
    found = automaton.tag(fx.note_texts(spark, sf), fx.wide_lexicon(spark))
    return found.select("note_id", "concept_id", "term", "start", "lexical_variant")


@query
def tag_longest_terms(spark, sf):
    """From the left, the longest term at each place, then on behind it."""
    found = automaton.tag(fx.note_texts(spark, sf), fx.wide_lexicon(spark), overlaps=automaton.LONGEST)
    return found.select("note_id", "concept_id", "term", "start", "lexical_variant")


def _tagged_sections(spark, sf):
    return tagger.tag(fx.sectioned_texts(spark, sf), fx.lexicon(spark), cues=fx.CUES)


@query
def note_sections(spark, sf):
    return context.section_spans(fx.sectioned_texts(spark, sf), fx.headers(spark))


@query
def mention_sections(spark, sf):
    placed = context.with_section(_tagged_sections(spark, sf), fx.sectioned_texts(spark, sf), fx.headers(spark))
    return placed.select("note_id", "start", "concept_id", "section_concept_id")


@query
def mention_assertions(spark, sf):
    """Certainty, status and experiencer by the scopes of cues."""
    told = context.with_assertion(_tagged(spark, sf), fx.note_texts(spark, sf), fx.SCOPED_CUES)
    return told.select("note_id", "start", "concept_id", "certainty", "status", "experiencer")


@query
def note_nlp_in_context(spark, sf):
    """Mentions as ``note_nlp`` rows with their section and modifiers."""
    rows = tagging.tag_notes(
        fx.sectioned_texts(spark, sf), fx.lexicon(spark), nlp_datetime=NLP_TIME, compiled=True, cues=fx.CUES,
        headers=fx.headers(spark), scoped_cues=fx.SCOPED_CUES,
    )
    return rows.select(
        "note_id", "offset", "note_nlp_concept_id", "section_concept_id", "term_exists", "term_temporal", "term_modifiers"
    )


@query
def tag_rules(spark, sf):
    found = tagger.tag_rules(fx.note_texts(spark, sf), fx.RULES)
    return found.select("note_id", "concept_id", "term", "start", "lexical_variant")


@query
def note_nlp(spark, sf):
    tagged = store(spark, _tagged(spark, sf), "tagged")
    rows = tagger.to_note_nlp(tagged, nlp_datetime=NLP_TIME, dense_ids=True)
    return rows.withColumn("nlp_date", F.col("nlp_date").cast("string"))


# Corpus

def _located(spark, sf):
    return ner.prepare(fx.mentions(spark, sf), exclude_ids=[fx.EXCLUDED_ID])


def _first(spark, sf):
    return ner.first_variants(_located(spark, sf))


def _corpus(spark, sf, style):
    return ner.corpus(_first(spark, sf), fx.concepts(spark), style)


def _corpus_text(documents):
    return documents.select("sha1", "text", spans_text("ents").alias("ents"))


@query
def capped_mentions(spark, sf):
    kept = crosswalk.exclude_concept_ids(fx.mentions(spark, sf), [fx.EXCLUDED_ID])
    return ner.cap_mentions(kept, 1000).select("note_nlp_id", "note_id", "note_nlp_concept_id")


@query
def clean_snippets(spark, sf):
    return ner.clean(fx.mentions(spark, sf)).select("note_nlp_id", "snippet", "sha1")


@query
def located_mentions(spark, sf):
    return _located(spark, sf).select("note_nlp_id", "sha1", "lexical_variant", "start", "end")


@query
def mention_metadata(spark, sf):
    return ner.metadata(_located(spark, sf)).select(
        "sha1", "lexical_variant", "note_id", "note_nlp_id",
        F.array_join("term_modifiers", "|").alias("term_modifiers"),
        "note_nlp_concept_id",
        F.col("offsets.start").alias("start"),
        F.col("offsets.end").alias("end"),
    )


@query
def snippet_groups(spark, sf):
    return ner.snippet_groups(_located(spark, sf))


@query
def first_variants(spark, sf):
    return _first(spark, sf).drop("snippet")


@query
def concept_labels(spark, sf):
    known = fx.concepts(spark).filter(F.col("concept_id") != 110)
    rows = fx.mentions(spark, sf).select("note_nlp_concept_id").distinct()
    return ner.with_concept_label(rows, known)


@query
def ner_term_usage(spark, sf):
    return _corpus_text(_corpus(spark, sf, ner.TERM_USAGE))


@query
def ner_positive_concepts(spark, sf):
    return _corpus_text(_corpus(spark, sf, ner.POSITIVE_CONCEPTS))


@query
def ner_negated_concepts(spark, sf):
    return _corpus_text(_corpus(spark, sf, ner.NEGATED_CONCEPTS))


@query
def ner_corpus(spark, sf):
    """All three styles side by side, from one pass."""
    documents = ner.corpora(_first(spark, sf), fx.concepts(spark))
    return documents.select("sha1", "text", spans_text("ents").alias("ents"), "style")


@query
def expanded_spans(spark, sf):
    return ner.expand_spans(_first(spark, sf)).select("sha1", "lexical_variant", "start", "end")


@query
def non_overlapping_docs(spark, sf):
    documents = ner.documents(_first(spark, sf), fx.concepts(spark), ner.TERM_USAGE)
    return documents.filter(~F.col("overlaps")).select("sha1")


@query
def document_tokens(spark, sf):
    return ner.with_tokens(_corpus(spark, sf, ner.TERM_USAGE)).select(
        "sha1", F.array_join("tokens", "|").alias("tokens"), F.size("tokens").alias("n_tokens")
    )


@query
def rule_tokens(spark, sf):
    """Tokens of whole notes by a table of affixes and exceptions."""
    texts = fx.note_texts(spark, sf).withColumnRenamed("note_text", "text")
    return ner.with_tokens(texts, fx.TOKEN_RULES).select(
        "note_id", F.array_join("tokens", "|").alias("tokens"), F.size("tokens").alias("n_tokens")
    )


@query
def exact_group_split(spark, sf):
    """Mentions split by whole notes: rows, test rows, and notes on both sides."""
    drawn = store(spark, splits.split_by_group_exactly(fx.mentions(spark, sf).select("note_id"), "note_id"), "group-split")
    sides = drawn.groupBy("note_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("test"), F.count_distinct("split").alias("sides")
    )
    return sides.agg(
        F.sum("n").alias("n_rows"), F.sum("test").alias("n_test"), F.count_if(F.col("sides") > 1).alias("n_torn")
    )


@query
def corpus_positions(spark, sf):
    keys = store(spark, _corpus(spark, sf, ner.POSITIVE_CONCEPTS).select("sha1"), "corpus-keys")
    return ner.with_position(keys)


@query
def ner_split(spark, sf):
    keys = store(spark, _corpus(spark, sf, ner.POSITIVE_CONCEPTS).select("sha1"), "corpus-keys")
    return ner.split(keys)


@query
def excel_safe_text(spark, sf):
    """Whole texts; every seventh one is made to open like a formula."""
    opened = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("-"), F.col("text"))).otherwise(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", spreadsheet_safe(opened).alias("text"))


# Errors and follow-up

def _examples(spark, sf, kind, certainty, style):
    """Mentions, errors and corpus are stored first, as each is read in several places."""
    tables = fx.comparison(spark, sf)
    tables = replace(tables, mentions=store(spark, tables.mentions, "mentions"))
    documents = corpus_plan.build_corpus(tables.mentions, tables.concepts, style, exclude_ids=[fx.EXCLUDED_ID])
    names = comparison.pair_names(fx.PAIRS)
    found = errors.error_mentions(
        comparison.comparison_table(tables, names, reviewed_before()), fx.PAIRS, kind,
        comparison.build_crosswalk(tables, certainty, comparison.COMPARED_CLASSES, names),
    )
    examples = errors.examples(
        store(spark, found, "error-mentions"), tables.mentions, store(spark, documents, "corpus"),
        exclude_ids=[fx.EXCLUDED_ID],
    )
    flat = examples.withColumns({
        "term_modifiers": F.array_join("term_modifiers", "|"),
        "start": F.col("offsets.start"),
        "end": F.col("offsets.end"),
    }).drop("offsets")
    return errors.for_reading(flat)


@query
def false_positive_examples(spark, sf):
    return _examples(spark, sf, errors.FALSE_POSITIVE, POSITIVE, ner.POSITIVE_CONCEPTS)


@query
def false_negative_examples(spark, sf):
    return _examples(spark, sf, errors.FALSE_NEGATIVE, NEGATED, ner.NEGATED_CONCEPTS)


def _followup(spark, sf):
    return cohort.followup_notes(
        fx.physician_notes(spark, sf), fx.encounters(spark, sf), fx.results(spark, sf), fx.conditions(spark, sf)
    )


@query
def long_followup_notes(spark, sf):
    return _followup(spark, sf)


# From notes to figures, all by the tagger

def _tagged_nlp(spark, sf):
    """Stored ``note_nlp`` rows of the tagger, of notes whose encounter exists."""
    rows = store(spark, _tagged(spark, sf), "tagged")
    tagged = tagger.to_note_nlp(rows, nlp_datetime=NLP_TIME, dense_ids=True)
    known = fx.notes(spark, sf).select("note_id").distinct()
    return store(spark, tagged.join(known, "note_id", "left_semi"), "tagged")


@query
def tagged_performance(spark, sf):
    """Figures without ids: mentions keep their hashed ones, and are stored once."""
    known = fx.notes(spark, sf).select("note_id").distinct()
    rows = tagger.to_note_nlp(_tagged(spark, sf).join(known, "note_id", "left_semi"), nlp_datetime=NLP_TIME)
    tables = replace(fx.comparison(spark, sf), mentions=store(spark, rows, "tagged"))
    return comparison.performance(tables, fx.PAIRS, reviewed_before())


@query
def tagged_corpus(spark, sf):
    located = ner.prepare(_tagged_nlp(spark, sf), exclude_ids=[fx.EXCLUDED_ID])
    documents = ner.corpora(ner.first_variants(located), fx.concepts(spark))
    return documents.select("sha1", "text", spans_text("ents").alias("ents"), "style")
