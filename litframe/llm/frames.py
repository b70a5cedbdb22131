"""Small frame helpers that the operators share."""

from __future__ import annotations

import gc
import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litframe.sources.scratch import scratch_dir, stage

__all__ = ["stage", "table", "empty_text", "packed", "release", "ship"]


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever it is installed.

    Its sources go to the shared folder as a zip file, once per application.
    """
    context = spark.sparkContext
    if getattr(context, "_litframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.writestr(str(source.relative_to(root.parent)), source.read_text())
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, "package"), "litframe.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path.toString())
    context._litframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more.

    It does so when the driver's garbage is collected, which may be late; between
    steps that shuffle much this keeps disks from filling up.
    """
    gc.collect()
    spark._jvm.System.gc()


def packed(docs: DataFrame, added: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, and the given ones beside it.

    Names in ``docs`` cannot clash with those an operator works with; columns
    named like the ``added`` ones are left out, as these replace them.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    return docs.select(F.struct(*own).alias("row"), *(c.alias(n) for n, c in columns.items()))


def empty_text(column: str | Column) -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
