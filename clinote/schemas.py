"""Table schemas and input checks.

Ids are 64-bit throughout: note and mention counts outgrow 32 bits at scale.
``NOTE`` keeps the CDM column name ``visit_occurrence_id``, which in this data
model holds the *encounter number* of the visit; operators rename it to
``encounter_number`` as soon as they read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _text(name: str, length: int | None = None, nullable: bool = True) -> StructField:
    metadata = {"max_length": length} if length else {}
    return StructField(name, StringType(), nullable, metadata)


def _required(name: str, data_type) -> StructField:
    return StructField(name, data_type, False)


NOTE = StructType([
    _required("note_id", LongType()),
    _required("person_id", LongType()),
    _required("note_date", DateType()),
    StructField("note_datetime", TimestampNTZType()),
    _required("note_type_concept_id", IntegerType()),
    _required("note_class_concept_id", IntegerType()),
    _text("note_title", 250),
    _text("note_text"),
    _required("encoding_concept_id", IntegerType()),
    _required("language_concept_id", IntegerType()),
    StructField("provider_id", IntegerType()),
    StructField("visit_occurrence_id", LongType()),
    StructField("visit_detail_id", IntegerType()),
    _text("note_source_value", 50),
])

NOTE_NLP = StructType([
    _required("note_nlp_id", LongType()),
    _required("note_id", LongType()),
    StructField("section_concept_id", IntegerType()),
    _text("snippet", 5000),
    _text("offset", 250),
    _text("lexical_variant", 250, nullable=False),
    StructField("note_nlp_concept_id", IntegerType()),
    StructField("note_nlp_source_concept_id", IntegerType()),
    _text("nlp_system", 250),
    _required("nlp_date", DateType()),
    StructField("nlp_datetime", TimestampNTZType()),
    _text("term_exists", 1),
    _text("term_temporal", 50),
    _text("term_modifiers", 2000),
])

CONCEPT = StructType([
    _required("concept_id", IntegerType()),
    _required("concept_name", StringType()),
])

LEXICON = StructType([
    _required("concept_id", IntegerType()),
    _required("concept_name", StringType()),
    _required("term", StringType()),
])

RAW_DOCUMENT = StructType([
    _required("id", LongType()),
    StructField("patient_id", StringType()),
    StructField("encounter_id", StringType()),
    StructField("document_datetime", TimestampNTZType()),
    StructField("document_type", StringType()),
    StructField("mapped_document_type", StringType()),
    StructField("file_text", StringType()),
])

VISIT = StructType([
    _required("visit_occurrence_id", LongType()),
    StructField("encounter_number", StringType()),
    StructField("visit_start_datetime", TimestampNTZType()),
    StructField("visit_end_datetime", TimestampNTZType()),
    StructField("visit_concept_name", StringType()),
    StructField("covid19_status", StringType()),
])

CORPUS = StructType([
    _required("sha1", StringType()),
    _required("text", StringType()),
    StructField("ents", ArrayType(StructType([
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("label", StringType()),
    ]))),
])


def require(df: DataFrame, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """Return ``df`` when it has the wanted columns with the wanted types, else raise ValueError."""
    actual = {field.name: field.dataType for field in df.schema.fields}
    problems = []
    for field in schema.fields:
        if columns is not None and field.name not in columns:
            continue
        if field.name not in actual:
            problems.append(f"missing column {field.name}")
        elif actual[field.name] != field.dataType:
            problems.append(
                f"column {field.name} is {actual[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    if problems:
        raise ValueError("; ".join(problems))
    return df


def require_columns(df: DataFrame, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """Like ``require`` for the names alone: tables of a source may hold keys in wider types."""
    absent = [f.name for f in schema.fields if (columns is None or f.name in columns) and f.name not in df.columns]
    if absent:
        raise ValueError("; ".join(f"missing column {name}" for name in absent))
    return df


#: What the entry points read, by the frame's part.
TEXT_COLUMNS = ["note_id", "note_text"]
MENTION_COLUMNS = ["note_nlp_id", "note_id", "snippet", "lexical_variant", "note_nlp_concept_id", "term_modifiers"]


def describe(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Column metadata of a frame: name, type, nullable."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def violations(df: DataFrame, schema: StructType) -> DataFrame:
    """Count null and over-length values per constrained column in one pass over ``df``.

    Result: ``column_name, rule, n_rows`` with one row per declared constraint. A required
    column that the frame lacks is reported as ``missing`` in every row.
    """
    rules = []
    for field in schema.fields:
        if field.name not in df.columns:
            if not field.nullable:
                rules.append((field.name, "missing", F.lit(True)))
            continue
        if not field.nullable:
            rules.append((field.name, "not_null", F.col(field.name).isNull()))
        limit = field.metadata.get("max_length")
        if limit:
            rules.append((field.name, f"max_length_{limit}", F.length(field.name) > limit))
    counts = df.agg(*[F.count_if(broken).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)])
    report = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n_rows"))
        for i, (name, rule, _) in enumerate(rules)
    ])
    return counts.select(F.inline(report))
