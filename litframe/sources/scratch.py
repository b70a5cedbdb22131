"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
WAREHOUSE_KEY = "spark.sql.warehouse.dir"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors see.

    Where that is unset, the folder lies in the session's warehouse, which its
    tables share as well; without either this raises.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        warehouse = spark.conf.get(WAREHOUSE_KEY, None)
        if not warehouse:
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        root = f"{warehouse.rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/litframe-{name}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs no recomputation of what
    came before, and readers get column pruning and pushed filters.
    """
    path = scratch_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder once its rows are safe elsewhere."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staged_at(frame: DataFrame, name: str):
    """``stage`` for the length of a block: the rows and their folder, which goes
    away when the block ends well.

    If the block fails the copy stays, and the error says where it is: it may
    be the only whole copy of rows that were being replaced.
    """
    spark, path = frame.sparkSession, scratch_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    try:
        yield spark.read.schema(frame.schema).parquet(path), path
    except Exception as error:
        error.add_note(f"the staged rows are kept at {path}")
        raise
    remove(spark, path)


@contextmanager
def staged(frame: DataFrame, name: str):
    """``staged_at`` without the folder."""
    with staged_at(frame, name) as (rows, _):
        yield rows
