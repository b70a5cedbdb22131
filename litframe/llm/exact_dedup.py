"""Exact duplicates: one row per text stays.

Texts are grouped by a 128-bit hash of their bytes together with the text
itself, so rows only meet in a group if their bytes are the same; the hash
comes first in the key and settles almost all comparisons. Partial
aggregation runs before the shuffle: of a text that a third of all rows
share, every task sends one row. The groups are written without their texts.
Rows then look up their group by the hash alone. A hash that two different
texts share (a collision) keeps the text in its groups, and rows of such
hashes are matched by hash and bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe.llm.frames import empty_text, packed, stage


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """The group of every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says which id of equal texts stays: the smallest (``min``) or the
    largest (``max``). Null texts count as empty, so all of them are one group
    with the empty ones. Null ids order before all others, so one stays under
    ``min`` only. Rows that repeat an id and its text count each; ``kept`` is
    true for the rows that bear the id that stays. An empty table gives an
    empty result; columns besides the two named ones are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep: {keep}")
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_text(text_col).alias("text"))
    rows = rows.withColumn("h", hash_fn(F.col("text")))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    pick = (F.min if keep == "min" else F.max)(order).getField("doc_id")
    groups = rows.groupBy("h", "text").agg(
        pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = stage(groups.select("h", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"), "exact")
    shared = groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h")

    ids = rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    if not shared.take(1):
        found = ids.join(groups.drop("sha"), "h")
    else:
        # different texts under one hash: their groups once more, with the text
        shared = stage(shared, "collisions")
        by_text = rows.join(shared, "h", "left_semi").groupBy("h", "text").agg(
            pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        plain = ids.join(shared, "h", "left_anti").join(groups.drop("sha"), "h")
        clashing = rows.join(shared, "h", "left_semi").join(by_text, ["h", "text"]).select(
            "h", "doc_id", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"
        )
        found = plain.unionByName(clashing)
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns.

    Rows that repeat an id and its text stay as often as they are there.
    """
    kept = exact_groups(docs, id_col, text_col, keep).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")
    ).distinct()
    rows = packed(docs, id=F.col(id_col), sha=F.sha2(empty_text(text_col), 256))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    return rows.join(kept, same, "left_semi").select("row.*")
