"""Captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_captures(spark: SparkSession, path: str, failed: bool = False) -> DataFrame:
    """Captured pages from Parquet; those that failed (NULL html) only with ``failed``.

    Search captures also hold run_id and page_no; where page_no is missing it
    is read from the address.
    """
    frame = with_page_no(spark.read.parquet(path))
    return frame if failed else usable(frame)


def usable(captures: DataFrame) -> DataFrame:
    return captures.where(F.col("html").isNotNull())


def with_page_no(captures: DataFrame) -> DataFrame:
    """Add ``page_no`` from the ``page=`` parameter of the address if it is missing."""
    if "page_no" in captures.columns:
        return captures
    number = F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).try_cast("int")
    return captures.withColumn("page_no", number)


def with_run(captures: DataFrame, run_id: str) -> DataFrame:
    return captures.withColumn("run_id", F.lit(run_id))


def spread_captures(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal captures out over ``partitions`` tasks; None leaves them as they are.

    Parsing costs far more than moving a page, and a Parquet row group can
    hold thousands of pages that one task would parse alone. Whether the input
    comes in too few splits is for the caller to say. Rows are dealt in turn, so
    no key decides how many a task gets.
    """
    return captures if partitions is None else captures.repartition(partitions)


def parse_tasks(spark: SparkSession, least: int) -> int:
    """Tasks to deal captures out to: four per core of the session, ``least`` or more.

    With a fixed number a larger cluster does not parse faster, and where the
    tasks are few more than the cores, most cores wait for the last ones.
    """
    return max(least, 4 * spark.sparkContext.defaultParallelism)


def read_html_dir(spark: SparkSession, directory: str) -> DataFrame:
    """Saved HTML files as captures, one row per file: page_id, path, url, html.

    ``page_id`` is a hash of the path, so it stays the same; ``url`` is the path.
    ``with_run`` and ``with_page_no`` make them search captures.
    """
    files = spark.read.text(directory, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(
        F.xxhash64(path).alias("page_id"), path.alias("path"), path.alias("url"), F.col("value").alias("html")
    )
