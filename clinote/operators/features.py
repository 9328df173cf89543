"""Roll-up of a crosswalk to encounters: counts, lists, and the Yes / missing matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clinote.operators import crosswalk as xw

COLUMN_PREFIX = "note_nlp_concept_name="
KEYS = ["encounter_number", "note_class_concept_name"]


def concept_column(name: str) -> str:
    return COLUMN_PREFIX + name


def concept_counts(crosswalk: DataFrame) -> DataFrame:
    """Mentions per encounter, note class and concept."""
    return xw.matched(crosswalk).groupBy(*KEYS, "note_nlp_concept_name").agg(F.sum("counter").alias("counter"))


def unmatched_classes(crosswalk: DataFrame) -> DataFrame:
    """Encounter and class pairs with notes but without any mention.

    The pairs with an unmatched row minus those with a matched one; as a count of
    mentions that comes out zero, it takes one aggregate and no join.
    """
    return (
        crosswalk.groupBy(*KEYS)
        .agg(F.count("counter").alias("n_mentions"))
        .filter(F.col("n_mentions") == 0)
        .select(*KEYS)
    )


def with_unmatched(counts: DataFrame, without: DataFrame) -> DataFrame:
    """Counts plus the pairs without mentions, whose concept and count are null."""
    return counts.unionByName(without, allowMissingColumns=True)


def reviewed_concepts(counts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows of reviewed encounters; an encounter reviewed twice repeats its rows."""
    return counts.join(reviews.select("encounter_number"), "encounter_number")


def concept_lists(counts: DataFrame) -> DataFrame:
    """Sorted distinct concept names per encounter; list length is bounded by the vocabulary."""
    return (
        counts.filter(F.col("note_nlp_concept_name").isNotNull())
        .groupBy("encounter_number")
        .agg(F.array_sort(F.collect_set("note_nlp_concept_name")).alias("note_nlp_concept_name"))
    )


def one_hot(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row per encounter with a ``Yes`` / null column per concept name, in sorted order.

    The names are given, so the schema is fixed and no pass over the data finds them; a
    name that never occurs gives a null column, and ``left_out`` reports the others.
    """
    def flag(name: str):
        # An integer maximum keeps the aggregate hash-based; a text one would sort.
        seen = F.max(F.when(F.col("note_nlp_concept_name") == name, 1))
        return F.when(seen == 1, "Yes").alias(concept_column(name))

    found = counts.filter(F.col("note_nlp_concept_name").isNotNull())
    return found.groupBy("encounter_number").agg(*[flag(name) for name in sorted(set(names))])


def left_out(counts: DataFrame, names: list[str]) -> DataFrame:
    """``note_nlp_concept_name, n_encounters``: concepts that ``one_hot`` with these names has no column for."""
    name = F.col("note_nlp_concept_name")
    other = counts.filter(name.isNotNull() & ~name.isin(names) if names else name.isNotNull())
    pairs = other.select("note_nlp_concept_name", "encounter_number").distinct()
    return pairs.groupBy("note_nlp_concept_name").agg(F.count("*").alias("n_encounters"))


def drop_suffix(df: DataFrame, suffix: str = "_c") -> DataFrame:
    """All columns but those whose name ends in the suffix."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.endswith(suffix)])
