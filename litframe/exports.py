"""Text lines, report and records of stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litframe import schemas as S

# Order of the fields in a text line.
LINE_FIELDS = (
    "doctitle", "short_author", "full_author", "short_journal", "full_journal",
    "PMID", "freemark",
)


def write_mode(override: bool) -> str:
    """An existing target is replaced only on request; else the write raises."""
    return "overwrite" if override else "errorifexists"


def hit_lines(hits: DataFrame) -> DataFrame:
    """One line per hit: its eight fields, joined by single spaces."""
    review = F.when(F.col("reviewmark"), "True").otherwise("False")
    return hits.select(F.concat_ws(" ", *LINE_FIELDS, review).alias("value"))


def write_text(hits: DataFrame, path: str, override: bool = False) -> None:
    """Write hit lines in insertion order (``id``) as text files.

    A range sort by run and id: part files follow the order of the rows.
    """
    ordered = hits.orderBy("run_id", "id")
    hit_lines(ordered).write.mode(write_mode(override)).text(path)


def report(publications: DataFrame) -> DataFrame:
    """The 15 stored columns in stored order, under the headings of the report."""
    columns = {name: F.col(name) for name in S.PUBLICATION_COLUMNS}
    columns["reviewmark"] = F.col("reviewmark").cast("int")
    return publications.select(
        *[columns[name].alias(heading) for name, heading in S.REPORT_HEADINGS.items()]
    )


def write_report(publications: DataFrame, path: str, override: bool = False) -> None:
    """Write the report as CSV with a heading line.

    Texts that need it are quoted and may hold newlines; a missing value is an empty
    field, an empty text a quoted one.
    """
    report(publications).write.mode(write_mode(override)).csv(
        path, header=True, escape='"', nullValue="", emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def records(publications: DataFrame) -> DataFrame:
    """Each record as JSON with its 14 keys; missing values are written as null."""
    fields = [F.col(column).alias(key) for key, column in S.RECORD_KEYS.items()]
    return publications.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json")
    )
