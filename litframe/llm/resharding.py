"""Move documents from old shards to new capacities with the fewest bytes moved.

The sizes of the old shards and the capacities of the new ones form a transport
problem: bytes that stay in their shard cost nothing, bytes that go elsewhere
their number. Its minimum-cost flow gives the transfers. Inside an old shard
documents are ordered from large to small, in blocks of equal size and hash
bucket; the shard keeps the front of that order and the transfers are cut from
its end, so what moves is made of small documents and the cuts are fine. Only
the two or three blocks that a cut goes through are looked at more closely.

Shards that neither gain nor lose a block keep their files; the others are
written anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litframe.llm.flow import Network
from litframe.llm.frames import empty_text, packed, stage

#: Hash buckets inside a size, the finest place of a cut.
BUCKETS = 1 << 16
#: Rows whose slots are counted together.
SLOT_ROWS = 20_000
#: Bytes that a document takes besides its text.
EXTRA = 8


def document_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed amount."""
    return F.octet_length(empty_text(text)).cast("long") + EXTRA


def transfers(old: dict[int, int], capacity: dict[int, int]) -> list[tuple[int, int, int]]:
    """``(old shard, new shard, bytes)`` with the fewest bytes moved in all.

    Capacities must hold all bytes. What stays is listed as well.
    """
    olds, news = sorted(old), sorted(capacity)
    net = Network(2 + len(olds) + len(news))
    at = {s: 2 + i for i, s in enumerate(olds)}
    to = {s: 2 + len(olds) + i for i, s in enumerate(news)}
    for s in olds:
        net.arc(0, at[s], old[s], 0)
    for s in news:
        net.arc(to[s], 1, capacity[s], 0)
    arcs = {(a, b): net.arc(at[a], to[b], old[a], int(a != b)) for a in olds for b in news}
    sent, _ = net.push(0, 1)
    if sent != sum(old.values()):
        raise ValueError("the capacities hold less than there is")
    return [(a, b, net.flow(e)) for (a, b), e in arcs.items() if net.flow(e)]


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {s: total // shards + (s < total % shards) for s in range(shards)}


@dataclass(frozen=True)
class Cut:
    """Documents of ``old`` whose key is at or behind (size, bucket) go to ``new``."""

    old: int
    new: int
    size: int
    bucket: int


def _bucket(id_col: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, size), F.lit(BUCKETS)).cast("int")


def plan(narrow: DataFrame, shards: int, capacity: dict[int, int] | None = None) -> tuple[list[tuple[int, int, int]], list[Cut]]:
    """Transfers and cuts for rows of ``old, size, bucket``."""
    by_size = stage(
        narrow.groupBy("old", "size").agg(F.count(F.lit(1)).alias("n")), "sizes"
    )
    # one row per old shard
    old = {r["old"]: int(r["b"]) for r in by_size.groupBy("old").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect()}
    capacity = capacity or even_capacities(sum(old.values()), shards)
    moves = transfers(old, capacity)
    points = []  # old, new, where its bytes begin in the shard's order
    for shard in old:
        own = sorted((m for m in moves if m[0] == shard), key=lambda m: (m[1] != shard, m[1]))
        at = 0
        for _, new, amount in own:
            points.append((shard, new, at))
            at += amount
    spark = narrow.sparkSession
    inner = [p for p in points if p[2]]
    cuts = [Cut(a, b, 1 << 62, 0) for a, b, at in points if not at]
    if not inner:
        return moves, cuts
    wanted = F.broadcast(spark.createDataFrame(inner, "old int, new int, at long"))  # fewer than old + new shards
    down = Window.partitionBy("old").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    begun = by_size.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(down), F.lit(0)))
    hit = stage(begun.join(wanted, "old").filter("before <= at and at < before + n * size"), "hit")
    within = narrow.join(F.broadcast(hit.select("old", "size").distinct()), ["old", "size"], "left_semi")
    counts = within.groupBy("old", "size", "bucket").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("old", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counts.withColumn("ahead", F.coalesce(F.sum("c").over(run), F.lit(0)))
    # the bucket whose start is nearest to the cut; past the last one, the next size
    near = F.abs(F.col("before") + F.col("ahead") * F.col("size") - F.col("at"))
    end = F.abs(F.col("before") + F.col("n") * F.col("size") - F.col("at"))
    found = hit.join(counted, ["old", "size"]).groupBy("old", "new").agg(
        F.min(F.struct(near.alias("off"), F.col("bucket"))).alias("best"),
        F.first("size").alias("size"), F.min(end).alias("end"),
    )
    for r in found.collect():  # one row per cut
        bucket = r["best"]["bucket"] if r["best"]["off"] <= r["end"] else BUCKETS
        cuts.append(Cut(r["old"], r["new"], r["size"], bucket))
    return moves, cuts


def _target(cuts: list[Cut], old: Column, size: Column, bucket: Column) -> Column:
    """The shard of the last cut that a row is at or behind."""
    expr = None
    for shard in sorted({c.old for c in cuts}):
        own = sorted((c for c in cuts if c.old == shard), key=lambda c: (c.size, -c.bucket))
        picked = None
        for c in own:  # from the far end of the order
            behind = (size < c.size) | ((size == c.size) & (bucket >= c.bucket))
            picked = F.when(behind, c.new) if picked is None else picked.when(behind, c.new)
        expr = F.when(old == shard, picked) if expr is None else expr.when(old == shard, picked)
    return F.lit(None).cast("int") if expr is None else expr


@dataclass(frozen=True)
class Resharded:
    """The new layout: rows with ``shard`` and ``slot``, and what was moved."""

    rows: DataFrame
    moves: list[tuple[int, int, int]]

    @property
    def changed(self) -> set[int]:
        """Shards that gain or lose rows."""
        return {s for a, b, _ in self.moves if a != b for s in (a, b)}


def reshard(
    docs: DataFrame,
    old_shard: Column,
    shards: int,
    capacity: dict[int, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Resharded:
    """Give every row a new ``shard`` (0 to ``shards`` - 1) and a ``slot`` in it.

    Shards come out nearly equal in bytes, or near the capacities given, with
    the fewest bytes moved out of ``old_shard``. Rows of equal id and text are
    moved together and take slots next to each other. An empty table gives no
    rows. Null texts have no bytes of their own; null ids are one value.
    Existing columns named ``shard`` and ``slot`` are replaced.
    """
    size = document_size(F.col(text_col))
    rows = packed(
        docs, ("shard", "slot"), old=old_shard.cast("int"), size=size, bucket=_bucket(F.col(id_col), size),
        id=F.col(id_col), text_hash=F.xxhash64(text_col),
    )
    moves, cuts = plan(rows.select("old", "size", "bucket"), shards, capacity)
    placed = rows.withColumn("shard", _target(cuts, F.col("old"), F.col("size"), F.col("bucket")))
    # slots: rows of a shard are counted by blocks, blocks by shard
    per_shard = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per shard
    blocks = max([1, *(-(-r["n"] // SLOT_ROWS) for r in per_shard)])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "block").orderBy("id", "text_hash")
    rows = (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "block"])
        .select("row.*", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))
    )
    return Resharded(rows, moves)


def rewrite(done: Resharded, path: str, old_path: str | None = None) -> DataFrame:
    """Write the shards that changed under ``path`` and read the whole layout.

    One folder per shard. With ``old_path`` (folders ``shard=N`` of the layout
    before) shards that did not change are read from there and not written.
    """
    spark: SparkSession = done.rows.sparkSession
    changed = done.changed
    rows = done.rows if old_path is None else done.rows.filter(F.col("shard").isin(sorted(changed) or [-1]))
    rows.write.partitionBy("shard").mode("overwrite").parquet(path)
    schema = done.rows.schema
    new = spark.read.schema(schema).parquet(path)
    if old_path is None:
        return new
    # rows of unchanged shards: same documents, in the files there are
    kept = spark.read.parquet(old_path).filter(~F.col("shard").isin(sorted(changed) or [-1]))
    return new.unionByName(kept, allowMissingColumns=True)
