"""Hard negatives: rows of another label that score close to an anchor's positives.

Components are made whole numbers, so that scores are exact. Rows are cut into
blocks of bounded size and anchors into runs; each pair of a block and a run is a
group of its own, in which the threshold algorithm (`threshold`) looks for every
anchor's best rows. A first pass, on blocks of one label, finds the positives, a
second one, on mixed blocks, the negatives in the windows that the positives
set. What blocks return is ranked per anchor: a handful of rows from each.

A stated set of anchors is put against all rows in blocks; nothing is broadcast,
and no group grows with the table or with one label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litframe.llm import threshold
from litframe.llm.frames import ship, stage

#: Rows of a block and anchors of a run, about.
BLOCK_ROWS, RUN_ANCHORS = 2048, 1024
#: Steps into which the range of a component from 0 to 1 is cut.
STEPS = 256
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 10
#: Least and greatest score of a negative, in percent of the positive's.
LEAST, GREATEST = 30, 90

_AS_ANCHOR = {"no": "a_no", "label": "a_label", "vector": "anchor"}
_FOUND = "a_no long, p_no int, no long, vec_id long, score long"


def whole_numbers(vector: str, steps: int = STEPS) -> Column:
    """Components as multiples of 1 / ``steps``, rounded down."""
    cell = F.transform(vector, lambda x: F.floor(x.cast("double") * steps))
    large = F.exists(cell, lambda x: F.abs(x) > threshold.LARGEST)
    return F.when(large, F.raise_error(F.lit("a component is too large for exact scores"))).otherwise(
        F.transform(cell, lambda x: x.cast("int"))
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; components that a shorter one lacks are 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy().astype(np.int64)
    made = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    made[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return made


def _wide(made: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(made, ((0, 0), (0, dims - made.shape[1])))


def _search(anchors: pa.Table, rows: pa.Table, k: int, same: bool) -> pa.Table:
    """The first ``k`` rows of a block in each window of each anchor."""
    names = ["a_no", "p_no", "no", "vec_id", "score"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if not anchors.num_rows or not rows.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    # ties: smaller vec_id first, null ones last
    rows = rows.take(pc.sort_indices(rows, [("vec_id", "ascending"), ("no", "ascending")]))
    vectors, own = _matrix(rows["vector"]), _matrix(anchors["anchor"])
    dims = max(vectors.shape[1], own.shape[1])
    block, own = threshold.Block(_wide(vectors, dims)), _wide(own, dims)
    no, label = rows["no"].to_numpy(), rows["label"].to_numpy()
    lows, highs = anchors["lows"].to_pylist(), anchors["highs"].to_pylist()
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for i, (a_no, a_label) in enumerate(zip(anchors["a_no"].to_pylist(), anchors["a_label"].to_pylist(), strict=True)):
        windows = np.array([lows[i], highs[i]], np.int64).T.reshape(-1, 2)
        allowed = no != a_no if same else label != a_label
        for p, (at, scores) in enumerate(block.search(own[i], windows, k, allowed)):
            if len(at):
                parts[0].append(np.full(len(at), a_no))
                parts[1].append(np.full(len(at), p))
                parts[2].append(at)
                parts[3].append(scores)
    a, p, at, scores = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in parts)
    return pa.table(
        [pa.array(a), pa.array(p.astype(np.int32)), pa.array(no[at]), rows["vec_id"].take(pa.array(at)), pa.array(scores)],
        names,
    )


def _best(anchors: DataFrame, rows: DataFrame, keys: dict[str, str], k: int, same: bool) -> DataFrame:
    """The first ``k`` of all blocks for each window, with ``rank`` from 1.

    ``keys`` names what the groups of anchors and of rows have in common."""
    found = anchors.groupBy(*keys).cogroup(rows.groupBy(*keys.values())).applyInArrow(
        lambda left, right: _search(left, right, k, same), _FOUND
    )
    order = Window.partitionBy("a_no", "p_no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "no")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _part(no: Column, parts: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(no, F.lit(seed)), parts).cast("int")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    greatest: int = GREATEST,
    steps: int = STEPS,
    block_rows: int = BLOCK_ROWS,
    run_anchors: int = RUN_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` and ``label_col`` may be expressions on the columns of ``rows``.
    Rows with a null label, a null vector or a null or non-finite component
    take no part. Every other row counts, repeated ones each for itself; a row
    is not its own positive, an equal one may be. Null ids come last among ties. Vectors may
    differ in length: missing components are 0. A negative's score lies between ``least`` and
    ``greatest`` percent of the positive's, so a positive with a negative score
    has none. An empty table gives no rows. Components beyond 2^24 steps
    raise, as scores could leave 64 bits. Other columns are not read.
    """
    spark = rows.sparkSession
    ship(spark)
    cell = F.col(vector_col)
    odd = F.exists(cell, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    marked = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), cell.alias("cell"), odd.alias("odd"),
    ).filter(F.col("label").isNotNull() & F.col("cell").isNotNull() & ~F.col("odd"))
    # numbers are written once, so that they stay what they are
    all_rows = stage(
        marked.select(
            F.monotonically_increasing_id().alias("no"), "vec_id", "label", "is_anchor",
            whole_numbers("cell", steps).alias("vector"),
        ),
        "vectors",
    )
    # one row per label: blocks of its rows and runs of its anchors
    sizes = all_rows.groupBy("label").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"),
        F.ceil(F.count_if("is_anchor") / run_anchors).alias("runs"),
    )
    sized = all_rows.join(sizes.filter("runs > 0"), "label")
    block, run = _part(F.col("no"), F.col("blocks"), 1), _part(F.col("no"), F.col("runs"), 2)
    anchors = sized.filter("is_anchor").select(
        *(F.col(c).alias(a) for c, a in _AS_ANCHOR.items()), run.alias("a_run"), _numbers(F.col("blocks")).alias("a_block"),
        F.array(F.lit(-threshold.OPEN)).alias("lows"), F.array(F.lit(threshold.OPEN)).alias("highs"),
    )
    own = sized.select("label", "no", "vec_id", "vector", block.alias("block"), _numbers(F.col("runs")).alias("run"))
    near = _best(anchors, own, {"a_label": "label", "a_block": "block", "a_run": "run"}, positives, same=True)
    # windows of each anchor, in the order of its positives
    near = near.select("a_no", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stage(near, "positives")
    windows = near.groupBy("a_no").agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("near")
    )
    # whole percents rounded into the window, in long arithmetic
    low = F.expr(f"transform(near, x -> ({least} * x.positive_score + pmod(-{least} * x.positive_score, 100L)) div 100)")
    high = F.expr(f"transform(near, x -> ({greatest} * x.positive_score - pmod({greatest} * x.positive_score, 100L)) div 100)")
    total = all_rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_anchor").alias("anchors")
    ).first()
    blocks, runs = (F.lit(max(1, -(-total[n] // size))) for n, size in (("rows", block_rows), ("anchors", run_anchors)))
    anchors = all_rows.filter("is_anchor").join(windows.withColumnRenamed("a_no", "of"), F.col("no") == F.col("of")).select(
        *(F.col(c).alias(a) for c, a in _AS_ANCHOR.items()), _part(F.col("no"), runs, 4).alias("a_run"), _numbers(blocks).alias("a_block"),
        low.alias("lows"), high.alias("highs"),
    )
    others = all_rows.select(
        "label", "no", "vec_id", "vector", _part(F.col("no"), blocks, 3).alias("block"), _numbers(runs).alias("run")
    )
    far = _best(anchors, others, {"a_block": "block", "a_run": "run"}, negatives, same=False)
    named = near.join(all_rows.filter("is_anchor").select(F.col("no").alias("a_no"), F.col("vec_id").alias("anchor_id")), "a_no")
    named = named.withColumn("p_no", F.col("rank") - 1).drop("rank")
    return far.join(named, ["a_no", "p_no"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
