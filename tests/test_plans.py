"""Physical plans: what must not be in them, and what must reach the scan."""

import re

import pytest

from clinote.session import store
from workload import queries as queries_module
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# These store a table first; their plans start from it.
STORING = {
    "csv_roundtrip", "json_roundtrip", "corpus_roundtrip", "corpus_positions", "ner_split", "assign_nlp_id",
    "record_batches", "concept_counts_with_unmatched", "reviewed_concepts", "concept_lists", "concept_one_hot",
    "concepts_without_column", "stage_counts", "note_nlp", "tagged_performance", "tagged_corpus",
    "false_positive_examples", "false_negative_examples", "continuing_ids", "exact_group_split",
    "written_stage_counts",
}
# The automaton and the rule tokenizer are Arrow functions on partitions; all else is expressions.
IN_ARROW = {"tag_wide_terms_compiled", "tag_longest_terms", "note_nlp_in_context", "rule_tokens"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check(plan, in_arrow=False):
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and ("Arrow" in plan) == in_arrow


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, name, monkeypatch):
    """Also in the part of the plan whose result is stored."""
    stored = []

    def watched(session, df, label):
        stored.append(plan_of(df))
        return store(session, df, label)

    monkeypatch.setattr(queries_module, "store", watched)
    check(plan_of(QUERIES[name](spark, SF_DIR)), name in IN_ARROW)
    for plan in stored:
        check(plan)
    assert not stored or name in STORING


def test_crosswalk_reads_each_table_once_per_role(spark):
    plan = plan_of(QUERIES["crosswalk_positive"](spark, SF_DIR))
    assert plan.count("FileScan parquet") <= 7


def test_reviews_limit_the_notes(spark):
    """The notes meet the reviewed encounters before the mentions."""
    plan = QUERIES["nlp_performance"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


@pytest.mark.parametrize("name", ["note_totals", "notes_by_class", "notes_in_class", "preview_notes"])
def test_text_is_not_read_for_counts(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("text" not in schema for schema in schemas)


def test_date_bound_reaches_the_scan(spark):
    plan = plan_of(QUERIES["chart_reviews"](spark, SF_DIR))
    assert re.search(r"DataFilters: \[[^\]]*o_orderdate#\d+ < 1999-01-01", plan)


def test_joins_without_broadcast_stay_exact(spark, rows):
    """The plans of a cluster, where no side is small, give the same rows."""
    names = ["nlp_performance", "crosswalk_positive", "long_followup_notes", "mentions_by_class_concept", "ner_corpus"]
    small = {n: rows(QUERIES[n](spark, SF_DIR)) for n in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2KB")
    try:
        for name in names:
            assert rows(QUERIES[name](spark, SF_DIR)) == small[name]
    finally:
        for key in (
            "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        ):
            spark.conf.unset(key)
