"""Any captured pages, any selectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litframe.functions.markup import Selector, clean_markup
from litframe.functions.text import decode_entities


def extract_pages(
    captures: DataFrame, selectors: Sequence[Selector], keep: Sequence[str] = ("page_id",)
) -> DataFrame:
    """One row per page, one column per selector; failed pages give no rows."""
    cleaned = captures.where(F.col("html").isNotNull()).select(
        *keep, F.explode(F.array(clean_markup(F.col("html")))).alias("html")
    )
    html = F.col("html")
    raw = [s for s in selectors if s.get != "all_text"]
    whole = {s.name: s.result(s.found(html)) for s in selectors if s.get == "all_text"}
    # all raw matches are decoded in one step
    matches = F.array(*[s.found(html) for s in raw]).cast("array<array<string>>")
    read = cleaned.select(
        *keep, *[column.alias(name) for name, column in whole.items()],
        F.transform(matches, lambda found: F.transform(found, decode_entities)).alias("_found"),
    )
    results = {s.name: s.result(F.get("_found", F.lit(i))) for i, s in enumerate(raw)}
    return read.select(
        *keep, *[results.get(s.name, F.col(s.name)).alias(s.name) for s in selectors]
    )
