"""Counts that describe a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_summary(captures: DataFrame, hits: DataFrame) -> DataFrame:
    """Per run and page: number of hits, and whether the capture failed.

    Both sides are reduced to one row per page before they meet; the page text
    itself is never shuffled, nor read where captures hold a ``failed`` column.
    Pages without a number are one row of their run, as are those without a run.
    """
    keys = ["run_id", "page_no"]
    failed = F.col("failed") if "failed" in captures.columns else F.col("html").isNull()
    pages = captures.groupBy(*keys).agg(F.count_if(failed).alias("pages_failed"))
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    same = F.col("l.run_id").eqNullSafe(F.col("r.run_id")) & F.col("l.page_no").eqNullSafe(F.col("r.page_no"))
    return pages.alias("l").join(counts.alias("r"), same, "left").select(
        "l.run_id", "l.page_no", F.coalesce("r.hits", F.lit(0)).cast("long").alias("hits"), "l.pages_failed"
    )


def run_summary(pages: DataFrame, publications: DataFrame) -> DataFrame:
    """Per run: pages, pages failed, hits, and records with a detail page."""
    per_run = pages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("pages_failed").alias("pages_failed"),
        F.sum("hits").alias("hits"),
    )
    details = publications.groupBy("run_id").agg(
        F.count("PMCID").alias("details")
    )
    return per_run.join(details, "run_id", "left").select(
        "run_id", "pages", "pages_failed", "hits",
        F.coalesce("details", F.lit(0)).cast("long").alias("details"),
    )
