"""Writers. ``sort_nulls_last`` is applied here only: order is for the reader of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clinote.functions.text import CSV_NULL, without_lines

# Target column and its source, in insert order. The time of tagging
# fills the date column.
NOTE_NLP_MAPPING = [
    ("note_id", "note_id"),
    ("section_concept_id", "section_concept_id"),
    ("lexical_variant", "lexical_variant"),
    ("offset", "offset"),
    ("snippet", "snippet"),
    ("note_nlp_concept_id", "note_nlp_concept_id"),
    ("note_nlp_source_concept_id", "note_nlp_source_concept_id"),
    ("nlp_date", "nlp_datetime"),
    ("term_modifiers", "term_modifiers"),
]
SNIPPET_LENGTH = 5000


def sort_nulls_last(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def map_columns(
    df: DataFrame, mapping: list[tuple[str, str]] = NOTE_NLP_MAPPING, snippet_length: int = SNIPPET_LENGTH
) -> DataFrame:
    """Rows in target order and names, the date cut from its time, the snippet cut to length."""
    def value(target: str, source: str):
        column = F.col(source)
        if target == "snippet":
            column = F.left(column, F.lit(snippet_length))
        elif target == "nlp_date":
            column = F.to_date(column)
        return column.alias(target)

    return df.select(*[value(target, source) for target, source in mapping])


def write_csv(df: DataFrame, path: str, mode: str = "error", *, one_line: bool = False) -> None:
    """CSV with a header that ``readers.read_csv`` gives back unchanged; null is marked, empty text is not null.

    With ``one_line`` line ends in texts are escaped, so that a large file can be split.
    """
    (
        (without_lines(df) if one_line else df).write.mode(mode)
        .option("nullValue", CSV_NULL)
        .option("emptyValue", '""')
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_corpus(df: DataFrame, path: str, mode: str = "error") -> None:
    """Corpus with one folder per annotation style and split; the full set is the style folder."""
    write_table(df, path, mode, ["style", "split"])


def jdbc_write_options(
    url: str,
    table: str,
    *,
    driver: str | None = None,
    user: str | None = None,
    password: str | None = None,
    batch_size: int = 10_000,
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "batchsize": str(batch_size)}
    options.update({k: v for k, v in {"driver": driver, "user": user, "password": password}.items() if v})
    return options


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").mode(mode).options(**jdbc_write_options(url, table, **options)).save()
