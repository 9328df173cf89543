"""The driver's tables as clinical tables (see FIXTURES.md).

Fixed values: the lexicons, the note classes and the negation cues of the synthetic text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from clinote import schemas
from clinote.functions.columns import compute_once
from clinote.functions.tokenizer import Rules
from clinote.plans.comparison import Tables
from clinote.sources.readers import read_table

LEXICON = [
    (101, "Contempt", "trash"),
    (101, "Contempt", "scum"),
    (101, "Contempt", "worthless"),
    (102, "Ridicule", "clown"),
    (102, "Ridicule", "loser"),
    (102, "Ridicule", "pathetic"),
    (103, "Insult", "idiot"),
    (103, "Insult", "moron"),
    (103, "Insult", "stupid"),
    (104, "Disgust", "disgusting"),
    (105, "Licensing", "license"),
    (106, "Influenza", "token"),
    (107, "Connective", "with"),
    (108, "Demonstrative", "this"),
    (109, "Suffix", "tion"),
    (110, "Stem", "attion"),
]
CLASSES = [
    (201, "Emergency medicine"),
    (202, "Admission evaluation"),
    (203, "Discharge summary"),
    (204, "Progress"),
]
# Terms of several words, with hyphens and with symbols.
WIDE_LEXICON = [
    (301, "Phrase", "of the"),
    (301, "Phrase", "of-the"),
    (301, "Phrase", "in-the"),
    (302, "Other phrase", "de la"),
    (303, "Shouted", "the!!"),
    (304, "Plain", "the"),
    (305, "Marked", "(the"),
]
RULES = [(401, r"licen[cs]e\w*"), (402, r"worthless \w+"), (403, r"\btoken\b")]
# Words at the begin of a line that the notes with sections turn into headers, and the sections they open.
HEADERS = [("The", 501), ("De", 502), ("In", 503), ("Of", 504), ("And", 505), ("La", 506)]
# Words of the synthetic text as cues of every kind and direction.
SCOPED_CUES = [
    ("of the", "negation", "forward"), ("in", "negation", "forward"), ("it", "negation", "backward"),
    ("to", "possibility", "forward"), ("was", "history", "backward"), ("is", "history", "both"),
    ("that", "other", "forward"), ("de", "other", "backward"), ("for", "stop", ""), ("as", "stop", ""),
    ("in the", "pseudo", ""), ("of the to", "pseudo", ""),
]
# A small table of affixes that SQL can follow.
TOKEN_RULES = Rules(
    prefixes=(r"\(", '"'), suffixes=(",", r"\.", "!", r"\)"), infixes=("-",), exceptions={"The.": ("The.",)}, whole=None
)
EXCLUDED_ID = 106
CUES = ["the", "of", "and", "in"]
BLOCK = 12
STAMP = " 03/04/2020 10:20 EST "
VISIT_KEY_SHIFT = 1_000_000
PERSON_KEY_SHIFT = 5_000_000
REVIEWED_BEFORE = "1999-01-01"
NAMES = ["Connective", "Contempt", "Demonstrative", "Disgust", "Insult", "Licensing", "Ridicule", "Stem", "Suffix"]
PAIRS = [
    ("toxic_v", "note_nlp_concept_name=Insult"),
    ("toxic_v", "note_nlp_concept_name=Connective"),
    ("quality_v", "note_nlp_concept_name=Suffix"),
    ("quality_v", "note_nlp_concept_name=Demonstrative"),
]


# Declared, so that building a query opens no file.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", schema=SCHEMAS[name])


def _inline(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Fixed rows as a VALUES relation, whose size the planner knows."""
    values = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )
    return spark.sql(f"select * from values {values} as t({', '.join(schema.names)})")


def lexicon(spark: SparkSession) -> DataFrame:
    return _inline(spark, LEXICON, schemas.LEXICON)


def wide_lexicon(spark: SparkSession) -> DataFrame:
    return _inline(spark, WIDE_LEXICON, schemas.LEXICON)


def concepts(spark: SparkSession) -> DataFrame:
    known = sorted({(i, name) for i, name, _ in LEXICON}) + CLASSES
    return _inline(spark, known, schemas.CONCEPT)


def _encounter(doc_id: str):
    """Three documents per encounter."""
    return F.expr(f"{doc_id} div 3")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("o_orderkey", _encounter("doc_id"))
    return documents.join(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("doc_id").alias("note_id"),
        F.col("o_custkey").alias("person_id"),
        F.to_date("o_orderdate").alias("note_date"),
        F.col("o_orderdate").alias("note_datetime"),
        (F.col("doc_id") % 4 + 201).cast("int").alias("note_class_concept_id"),
        F.col("text").alias("note_text"),
        F.col("o_orderkey").alias("visit_occurrence_id"),
    )


def note_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``note_id, note_text`` for tagging, read without a join."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("note_id"), F.col("text").alias("note_text")
    )


def sectioned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note texts in which the header words open sections."""
    words = "|".join(word for word, _ in HEADERS)
    return note_texts(spark, sf_dir).withColumn("note_text", F.regexp_replace("note_text", f"(?md)^({words}) ", "$1: "))


def headers(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{word}', {section})" for word, section in HEADERS)
    return spark.sql(f"select * from values {values} as t(header, section_concept_id)")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    encounter = (
        F.when(key % 50 == 7, F.lit(None).cast("string"))
        .when(key % 50 == 13, F.concat(F.lit("E"), key.cast("string")))
        .otherwise(key.cast("string"))
    )
    return table(spark, sf_dir, "orders").select(
        (key + VISIT_KEY_SHIFT).alias("visit_occurrence_id"),
        encounter.alias("encounter_number"),
        F.col("o_orderdate").alias("visit_start_datetime"),
        (F.col("o_orderdate") + F.expr("interval 3 days")).alias("visit_end_datetime"),
        F.col("o_orderpriority").alias("visit_concept_name"),
        F.when(F.col("o_orderstatus") == "O", "negative").otherwise("positive").alias("covid19_status"),
    )


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .select((F.col("l_orderkey") + VISIT_KEY_SHIFT).alias("visit_occurrence_id"))
        .distinct()
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per encounter; the load time lies before, at or after the visit's start."""
    per_encounter = (
        table(spark, sf_dir, "labels")
        .groupBy(_encounter("doc_id").alias("o_orderkey"))
        .agg(
            F.max("toxic").alias("toxic"),
            F.min("quality").alias("low_quality"),
            F.max("quality").alias("high_quality"),
        )
    )
    key = F.col("o_orderkey")
    return per_encounter.join(table(spark, sf_dir, "orders"), "o_orderkey").select(
        key.cast("string").alias("encounter_number"),
        (key + VISIT_KEY_SHIFT).alias("visit_occurrence_id"),
        F.col("o_orderdate").alias("visit_start_datetime"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 3 - 1).cast("int"))).alias("load_time"),
        F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("toxic_v"),
        F.lit("from labels").alias("toxic_c"),
        F.when(F.col("low_quality") == 1, "Yes")
        .when(F.col("low_quality") != F.col("high_quality"), "Unknown")
        .otherwise("No")
        .alias("quality_v"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon words of the notes with certainty from the word before and a 12-word snippet.

    Found in the documents as scanned, so the text is not shuffled; only mentions whose
    encounter exists are kept, as for the notes.
    """
    words = (
        table(spark, sf_dir, "documents").select("doc_id", "text")
        .select(
            F.col("doc_id").alias("note_id"),
            F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"),
        )
        .select("note_id", "words", F.posexplode_outer("words").alias("at", "word"))
    )
    terms = lexicon(spark).select("concept_id", "term")
    at = F.col("at")
    before = F.when(at > 0, F.get("words", at - 1))
    block = F.array_join(F.slice("words", F.floor(at / BLOCK).cast("int") * BLOCK + 1, F.lit(BLOCK)), " ")
    # The lexicon above is sixteen fixed rows.
    hits = words.join(F.broadcast(terms), F.col("word") == F.col("term"))
    found = compute_once(hits.withColumnsRenamed({"term": "lexical_variant", "concept_id": "note_nlp_concept_id"}), {
        "note_nlp_id": F.col("note_id") * 1_000_000_000 + at + 1,
        "snippet": F.when(F.col("note_id") % 5 == 0, F.concat(F.lit(STAMP), block)).otherwise(block),
        "term_modifiers": F.when(before.isin(CUES), "certainty=Negated,experiencer=Patient").otherwise(
            "certainty=Positive,experiencer=Patient"
        ),
    }).select(
        "note_nlp_id", "note_id", "snippet", "lexical_variant", "note_nlp_concept_id", "term_modifiers"
    )
    known = table(spark, sf_dir, "orders").select("o_orderkey")
    return found.withColumn("o_orderkey", _encounter("note_id")).join(known, "o_orderkey", "left_semi").drop(
        "o_orderkey"
    )


def comparison(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        notes=notes(spark, sf_dir),
        mentions=mentions(spark, sf_dir),
        concepts=concepts(spark),
        visits=visits(spark, sf_dir),
        checked=checked(spark, sf_dir),
        reviews=reviews(spark, sf_dir),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged documents: every key as text."""
    documents = table(spark, sf_dir, "documents").withColumn("o_orderkey", _encounter("doc_id"))
    return documents.join(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("doc_id").alias("id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.col("o_orderkey").cast("string").alias("encounter_id"),
        F.col("o_orderdate").alias("document_datetime"),
        F.col("source").alias("document_type"),
        F.col("lang").alias("mapped_document_type"),
        F.col("text").alias("file_text"),
    )


def physician_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("o_orderkey", _encounter("doc_id"))
    key = F.col("doc_id")
    return documents.join(table(spark, sf_dir, "orders"), "o_orderkey").select(
        key.alias("document_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderkey").alias("encounter_id"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 60).cast("int"))).alias("document_datetime"),
        F.when(key % 7 == 0, "Ambulatory Patient Summary")
        .when(key % 11 == 0, F.lit(None).cast("string"))
        .otherwise("Progress Note")
        .alias("document_type"),
        F.col("lang").alias("mapped_document_type"),
        F.col("text").alias("file_text"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("encounter_number"),
        F.concat(F.lit("LOC"), (F.col("o_custkey") % 5).cast("string")).alias("service_delivery_location"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Inpatient")
        .otherwise("Outpatient")
        .alias("classification_display"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("mrn"))
        .agg(F.min("o_orderdate").alias("first_order"))
        .select(
            "mrn",
            (F.col("mrn") + PERSON_KEY_SHIFT).alias("person_id"),
            F.when(F.col("mrn") % 9 != 0, F.col("first_order")).alias("positive_datetime"),
        )
    )


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") + PERSON_KEY_SHIFT).alias("person_id"),
        F.when(F.col("o_orderstatus") == "F", "U09.9").otherwise("Z00.0").alias("condition_source_concept_code"),
    )
