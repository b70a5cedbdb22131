"""From a table of keywords to the requests of a search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe import schemas as S
from litframe.functions.text import WHITESPACE_CLASS, blank_to_null


# everything that counts as numeric: by category, and the numerals among letters
_NUMERALS = "".join(
    c for c in map(chr, range(0x110000)) if c.isnumeric() and unicodedata.category(c)[0] != "N"
)
NUMERIC = rf"\A[\p{{N}}{_NUMERALS}]+\z"


def valid_requests(requests: DataFrame) -> DataFrame:
    """Add ``valid`` and ``reason``; unset limits get their defaults.

    ``requests``: request_id, keyword, year, page_limit, result_num and, if
    wanted, download_limit.
    """
    keyword, year = F.col("keyword"), F.col("year")
    reason = (
        F.when(keyword.rlike(rf"\A{WHITESPACE_CLASS}+\z"), "whitespace")
        .when(keyword.rlike(NUMERIC), "numeric")
        .when(year.isNotNull() & ~year.isin(*S.YEAR_CHOICES), "year")
    )
    downloads = (
        F.col("download_limit") if "download_limit" in requests.columns else F.lit(None).cast("int")
    )
    return requests.select(
        "request_id", "keyword", "year",
        F.coalesce("page_limit", F.lit(S.DEFAULT_PAGE_LIMIT)).alias("page_limit"),
        F.coalesce(downloads, F.lit(S.DEFAULT_DOWNLOADS)).alias("download_limit"),
        "result_num", reason.isNull().alias("valid"), reason.alias("reason"),
    )


def form_encode(col: Column) -> Column:
    """Form encoding: blanks become ``+``; letters, digits and ``_.-~`` stay."""
    return F.replace(
        F.replace(F.url_encode(col), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def request_params(requests: DataFrame) -> DataFrame:
    """Add ``params``: term and filter where set, and always the page size."""
    term = F.concat(F.lit("term="), form_encode(blank_to_null(F.col("keyword"))))
    # a NULL year makes the whole part NULL, and concat_ws leaves it out
    year = F.concat(F.lit("filter=datesearch.y_"), F.col("year").cast("string"))
    return requests.withColumn(
        "params", F.concat_ws("&", term, year, F.lit(f"size={S.PAGE_SIZE}"))
    )


def plan_pages(requests: DataFrame, base: str = S.SEARCH_BASE_URL) -> DataFrame:
    """One row per result page to fetch, up to the page limit, last page included.

    Takes the output of ``valid_requests``; invalid requests plan nothing.
    """
    full = F.col("result_num") + (S.PAGE_SIZE - 1)
    pages = F.call_function("div", full, F.lit(S.PAGE_SIZE))
    n = F.least(pages, F.col("page_limit")).cast("int")
    planned = request_params(requests.where("valid")).select(
        "request_id", "params",
        F.explode(
            F.when(pages.isNotNull() & (n >= 1), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        ).alias("page_no"),
    )
    return planned.select(
        "request_id", "page_no",
        F.concat(
            F.lit(f"{base}?"), "params", F.lit("&page="), F.col("page_no").cast("string")
        ).alias("url"),
    )


def detail_requests(hits: DataFrame, base: str = S.SEARCH_BASE_URL) -> DataFrame:
    """One article page to fetch per hit."""
    return hits.select("run_id", "id", "PMID", F.concat(F.lit(base), "PMID").alias("url"))
