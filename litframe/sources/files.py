"""Saved full texts: a directory of files, or a table of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def saved_files(spark: SparkSession, directory: str, glob: str = "*.pdf") -> DataFrame:
    """Inventory of a directory: path and length. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return files.select("path", "length")


def store_fulltext(fetched: DataFrame, path: str, mode: str = "append") -> None:
    """Write fetched contents (PMCID, savepath, content) with their lengths.

    Failed fetches are not stored. The length is a column of its own, so that
    the inventory never reads contents.
    """
    fetched.where(F.col("content").isNotNull()).select(
        "PMCID", "savepath", F.octet_length("content").cast("long").alias("length"), "content"
    ).write.mode(mode).parquet(path)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """Inventory of ``store_fulltext`` output, in the shape of ``saved_files``."""
    return spark.read.parquet(path).select(F.col("savepath").alias("path"), "length")
