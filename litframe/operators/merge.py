"""Row-wise updates by key, as one join each."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe import schemas as S

SPREAD = 4096  # how many ways rows without a usable key are spread
DETAIL_FIELDS = ("PMCID", "doi", "abstract", "keyword", "affiliations")


def join_key(key: Column) -> Column:
    """Key of a side that was reduced to one row per key before.

    A new expression, so this side gets an exchange of its own after the
    aggregate. Only then can adaptive execution split a partition of the other
    side that one key blows up, as it looks for a join of two shuffles. It is
    never NULL (a NULL key becomes ``-``, which ``spread_key`` never yields), so
    no filter is inferred that would parse pages once more to test their key.
    """
    return F.coalesce(F.concat(F.lit("k"), key), F.lit("-"))


def spread_key(key: Column, *vary: str) -> Column:
    """Key of the side that keeps all rows, matching ``join_key``.

    Rows whose key is NULL or empty match nothing and may be most of the table.
    An outer join would still send them all to one task; they are spread over
    ``SPREAD`` keys of their own instead.
    """
    usable = key.isNotNull() & (key != "")
    bucket = F.pmod(F.xxhash64(*vary), F.lit(SPREAD)).cast("string")
    real = F.concat(F.lit("k"), key)
    return F.when(usable, real).otherwise(F.concat(F.lit("x"), bucket))


def last_per_key(
    rows: DataFrame, key: str, order: str, *columns: str, group: tuple[str, ...] = ()
) -> DataFrame:
    """One row per key (per ``group``), the one with the highest ``order``.

    An aggregate with map-side combine, so a key with very many copies (or no
    key at all) leaves each task as one row.
    """
    # equal orders: the larger row; a row without an order counts only alone
    order_of = F.struct(F.col(order).isNotNull(), F.col(order), F.xxhash64(*columns))
    last = F.max_by(F.struct(*columns), order_of).alias("last")
    return rows.groupBy(*group, key).agg(last).select(*group, key, "last.*")


def ranked(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """Rows as ``pick_last`` wants them stored: with a number and a rank of their own.

    The rank says what ``last_per_key`` says: the order, a whole number, then a hash of
    ``columns``; rows without an order come first. Both are fixed-width numbers.
    """
    width = Decimal(1 << 62)
    tie = F.shiftrightunsigned(F.xxhash64(*columns), 2).cast("decimal(19,0)")
    place = F.col(order).cast("decimal(19,0)") * F.lit(width)
    unplaced = F.lit(Decimal(-(1 << 125) - (1 << 62))).cast("decimal(38,0)")
    rank = (F.coalesce(place, unplaced) + tie).cast("decimal(38,0)")
    return rows.withColumns({"_rank": rank, "_row": F.monotonically_increasing_id()})


def pick_last(stored: DataFrame, key: str, *columns: str) -> DataFrame:
    """``last_per_key`` of stored ``ranked`` rows that have a key, without moving losers.

    A hash aggregate over key, rank and row number finds the winners, a join by row
    number, which no two rows share, fetches their columns. The rows are read twice,
    so they must come from a table; the first time only those three columns are.
    """
    best = stored.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("_row", "_rank").alias("_row"))
    return stored.join(best.select("_row"), "_row", "left_semi").select(key, *columns)


def merge_details(hits: DataFrame, details: DataFrame) -> DataFrame:
    """Set the detail fields on all hits of equal PMID; the later detail wins.

    ``hits``: hit columns plus ``id``; ``details``: flat details (see
    ``flat_details``). Hits without a detail keep NULL, hits whose page lacks a
    field get ``''``: the test is whether a detail row matched, never its values.
    Result: ``PUBLICATION``. The details are read once, so pages may be parsed on the
    way; ``merge_latest`` takes stored ones.
    """
    return merge_latest(hits, last_per_key(details, "PMID", "page_id", *DETAIL_FIELDS))


def merge_latest(hits: DataFrame, latest: DataFrame) -> DataFrame:
    """``merge_details`` where ``latest`` has one detail per PMID (``pick_last``)."""
    left = hits.withColumn("_key", spread_key(F.col("PMID"), "page_id", "position"))
    right = latest.select(join_key(F.col("PMID")).alias("_key"), *DETAIL_FIELDS)
    joined = left.join(right, "_key", "left")
    return joined.withColumn("savepath", F.lit(None).cast("string")).select(*S.PUBLICATION.names)


def apply_details(publications: DataFrame, details: DataFrame) -> DataFrame:
    """``merge_details`` on stored records: unmatched rows keep what they hold."""
    return apply_latest(publications, last_per_key(details, "PMID", "page_id", *DETAIL_FIELDS))


def apply_latest(publications: DataFrame, latest: DataFrame) -> DataFrame:
    """``apply_details`` where ``latest`` has one detail per PMID (``pick_last``)."""
    left = publications.withColumn("_key", spread_key(F.col("PMID"), "run_id", "id"))
    return overlaid(left, latest, "_key").select(*S.PUBLICATION.names)


def overlaid(records: DataFrame, latest: DataFrame, *keys: str) -> DataFrame:
    """Records with a key column (``spread_key``), overlaid with the detail of their key.

    ``latest`` may hold more of ``keys`` than ``_key``, which it then holds as columns.
    """
    right = latest.select(
        join_key(F.col("PMID")).alias("_key"), *[k for k in keys if k != "_key"], F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_{c}") for c in DETAIL_FIELDS],
    )
    new = {
        c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in DETAIL_FIELDS
    }
    return records.join(right, list(keys), "left").withColumns(new).select(*records.columns)


def mark_saved(publications: DataFrame, saved: DataFrame) -> DataFrame:
    """Set ``savepath`` on all rows of a run with the PMCID of a saved full text.

    ``saved``: run_id, id, PMCID, savepath; of several rows with one PMCID the
    last by ``id`` counts, so rows never multiply.
    """
    last = last_per_key(saved, "PMCID", "id", "savepath", group=("run_id",)).select(
        "run_id", join_key(F.col("PMCID")).alias("_key"), F.col("savepath").alias("_saved")
    )
    left = publications.withColumn("_key", spread_key(F.col("PMCID"), "run_id", "id"))
    path = F.coalesce(F.col("_saved"), F.col("savepath"))
    return (
        left.join(last, ["run_id", "_key"], "left")
        .withColumn("savepath", path).select(*S.PUBLICATION.names)
    )


def new_articles(details: DataFrame, publications: DataFrame) -> DataFrame:
    """Details of articles that no stored record names yet."""
    # details without a PMID are dropped before the join, so they do not meet in a
    # task; an array keeps that filter from being pushed into the parsing of pages
    known = publications.select("PMID").distinct()
    right = known.select(join_key(F.col("PMID")).alias("_key"))
    key = F.when(F.col("PMID").isNotNull(), join_key(F.col("PMID")))
    left = details.withColumn("_key", F.explode(F.array_compact(F.array(key))))
    return left.join(right, "_key", "left_anti").drop("_key")
