"""A stored inventory of very many full texts.

The files lie in folders by the first hex digits of the MD5 of their name
(``fulltext_paths`` with ``digits`` plans such paths). Tasks list the folders, one
folder at a time; the driver knows their names only. What was listed is kept in a
Parquet table, and a refresh adds the files that it does not hold yet, so jobs that
ask which texts exist read that table and list nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litframe.operators.merge import join_key, spread_key
from litframe.sources.scratch import exists

_SCHEMA = "path string, length long"
#: Files that a task hands on at once.
BATCH = 10_000


def _list_folders(root: str, suffix: str, names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files right in these folders of ``root``; a folder that is not there has none."""
    disk, base = fs.FileSystem.from_uri(root)
    for batch in names:
        for name in batch.column("folder").to_pylist():
            inside = disk.get_file_info(fs.FileSelector(f"{base}/{name}", allow_not_found=True))
            files = [f for f in inside if f.type == fs.FileType.File and f.base_name.endswith(suffix)]
            for start in range(0, len(files), BATCH):
                some = files[start : start + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{root}/{name}/{f.base_name}" for f in some], pa.string()), pa.array([f.size for f in some], pa.int64())],
                    ["path", "length"],
                )


class FileManifest:
    """Inventory at ``path`` of the files below ``root``, an absolute path or URI.

    ``digits`` is the number of hex digits that name a folder; choose it so that a
    folder's listing fits into a task: 3 give 4,096 folders. Files elsewhere under
    ``root`` and files without ``suffix`` do not count. A file stays as it was taken
    in first; where files may change or go away, start a manifest anew now and then.
    """

    def __init__(self, spark: SparkSession, root: str, path: str, digits: int = 2, suffix: str = ".pdf"):
        self.spark, self.path, self.digits, self.suffix = spark, path.rstrip("/"), digits, suffix
        self.root = root.rstrip("/")

    def listed(self, tasks: int | None = None) -> DataFrame:
        """Path and length of the files as they are now, listed by ``tasks`` tasks."""
        folders = 16**self.digits
        tasks = min(folders, tasks or max(self.spark.sparkContext.defaultParallelism * 4, 32))
        name = F.lower(F.lpad(F.hex("id"), self.digits, "0")).alias("folder")
        root, suffix = self.root, self.suffix

        def files(names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _list_folders(root, suffix, names)

        return self.spark.range(0, folders, 1, tasks).select(name).mapInArrow(files, _SCHEMA)

    def refresh(self, tasks: int | None = None) -> None:
        """Take in files that the manifest does not hold.

        A refresh that breaks off has added nothing and is done again.
        """
        found = self.listed(tasks)
        if exists(self.spark, self.path):
            known = self.files().select(join_key(F.col("path")).alias("_key"))
            found = found.withColumn("_key", spread_key(F.col("path"), "path")).join(known, "_key", "left_anti").drop("_key")
        found.hint("rebalance").write.mode("append").parquet(self.path)

    def files(self) -> DataFrame:
        """The inventory in the shape of ``saved_files``."""
        return self.spark.read.schema(_SCHEMA).parquet(self.path)
