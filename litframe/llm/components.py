"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litframe.llm.frames import stage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``a, b`` (longs): root is the smallest node
    that links lead to, and has a row too.

    Each round hangs neighbours on the smallest node they know, first those
    that are larger than a node, then those that are smaller; a few rounds leave
    only links to roots. Links are joined with a minimum per node, so a node with
    very many links stays a skew that the join can split. Rounds are written to
    the shared folder.
    """
    edges = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while not _stars_only(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that gave ``roots`` and of further ``links``.

    Only roots are linked anew; links that were followed before are left alone.
    """
    ends = links
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    over = stage(components(ends), "roots")
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left")
    fresh = over.join(roots, "node", "left_anti").select("node", "root")
    return moved.select("node", F.coalesce("_root", "root").alias("root")).unionByName(fresh)


def _stars_only(edges: DataFrame) -> bool:
    """Whether each larger end has one link and no root is such an end: nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return open_.filter("up > 1 or (up > 0 and down > 0)").isEmpty()
