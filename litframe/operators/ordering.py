"""Positions 1..n inside a run without one window over the whole run.

A run may hold a third of all rows, so no window here sees a run row by row.
Rows are counted per block first (partial aggregation), only the block counts
are summed up in order, and rows are numbered inside their own bounded block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_PER_BLOCK = 4096
ROWS_PER_BLOCK = 65536


def _div(col: Column, by: int) -> Column:
    """Whole-number division, exact for any BIGINT; NULL counts as 0."""
    return F.coalesce(F.call_function("div", col, F.lit(by)), F.lit(0).cast("long"))


def _known(col: Column, name: str) -> Column:
    """The order of a row; a row without one raises.

    Such rows would all meet in one block, which then has no bound.
    """
    return F.when(col.isNull(), F.raise_error(F.lit(f"a row has no {name}, so it has no place in its run"))).otherwise(col)


def _offsets(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Running sum of ``n`` before each row, in ``order``, per group."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def page_offsets(hits: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Number of hits before each page of its run: (run_id, page_no, page_id, n, before).

    Two levels: pages inside blocks of page numbers, and the blocks of a run.
    """
    block = _div(F.col("page_no"), pages_per_block).alias("block")
    pages = (
        hits.groupBy("run_id", "page_no", "page_id").agg(F.count(F.lit(1)).alias("n"))
        .select("run_id", "page_no", "page_id", "n", block)
    )
    blocks = _offsets(
        pages.groupBy("run_id", "block").agg(F.sum("n").alias("n")), ["run_id"], "block"
    ).select("run_id", "block", F.col("offset").alias("block_offset"))
    inside = Window.partitionBy("run_id", "block").orderBy("page_no", "page_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    numbered = pages.withColumn("offset", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return _same(numbered, blocks, "run_id", "block").select(
        "l.run_id", "page_no", "page_id", "n",
        (F.col("block_offset") + F.col("offset")).alias("before"),
    )


def _same(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys that may be NULL, so that no row is lost; sides ``l``, ``r``."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.alias("l").join(right.alias("r"), condition)


def with_run_order(
    hits: DataFrame, start: Column | int = 0, pages_per_block: int = PAGES_PER_BLOCK
) -> DataFrame:
    """Add ``id``: 1..n in page order inside each run, then ``start`` on top.

    Reads its input twice, once for the page counts (three key columns only),
    so hand it stored hits rather than a plan that still parses pages.
    """
    offsets = page_offsets(hits, pages_per_block).drop("n")
    first = F.lit(start) if isinstance(start, int) else start
    placed = _same(hits, offsets, "run_id", "page_no", "page_id")
    return placed.select(
        (F.col("r.before") + F.col("l.position") + first).cast("long").alias("id"), "l.*"
    )


def dense_position(
    rows: DataFrame, group: list[str], order: str = "id", rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Add ``pos``: 1..n by a unique whole-number column, gaps closed, per group.

    A row whose order is NULL raises.
    """
    blocked = rows.withColumn("_block", _div(_known(F.col(order), order), rows_per_block))
    counts = blocked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("n"))
    offsets = _offsets(counts, group, "_block").drop("n")
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    numbered = blocked.withColumn("_row", F.row_number().over(inside))
    return _same(numbered, offsets, *group, "_block").select(
        *[f"l.{c}" for c in rows.columns], (F.col("offset") + F.col("_row")).alias("pos")
    )


def plan_batches(
    rows: DataFrame, key: str, size: int, order: str = "id", dense: bool = False
) -> DataFrame:
    """Cut the key list of each run into batches of ``size``: order kept, last short.

    ``dense`` says that ``order`` already runs 1..n without gaps (a whole run);
    the batch number is then plain arithmetic. A row whose order is NULL raises.
    """
    placed = (
        rows.select("run_id", F.col(order).alias("pos"), key) if dense
        else dense_position(rows.select("run_id", order, key), ["run_id"], order)
    )
    batch = _div(_known(F.col("pos"), order) - 1, size).alias("batch_no")
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(key).alias("key"))))
    return (
        placed.groupBy("run_id", batch)
        .agg(pairs.alias("pairs"))
        .select(
            "run_id", "batch_no", F.size("pairs").alias("n_keys"),
            F.transform("pairs", lambda p: p["key"]).alias("keys"),
        )
    )
