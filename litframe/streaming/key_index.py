"""Keys that a feed has written, in folders by a prefix of their hash.

A batch looks up its own keys only, so it reads the folders of their prefixes,
and of each a bounded number of files: where more have come together, they are
written as one. Doubled rows do no harm, so a write that broke off is simply
done again, and files go only after what replaces them is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litframe.sources.scratch import exists

#: Folders of an index; a batch of n keys reads n of them at most.
PREFIXES = 1024
#: Files of a folder beyond which they are made one.
MOST_FILES = 8

_SCHEMA = "PMID string, feed string, batch long, prefix int"


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, prefixes: int = PREFIXES):
        self.spark, self.path, self.prefixes = spark, path.rstrip("/"), prefixes

    def prefix(self, key: str = "PMID") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.prefixes)).cast("int").alias("prefix")

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def _files(self, prefix: int) -> list:
        """Data files of one folder."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/prefix={prefix}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet")]

    def touched(self, keys: DataFrame) -> list[int]:
        """Prefixes of these keys: at most as many as there are folders."""
        return sorted(r.prefix for r in keys.where(F.col("PMID").isNotNull()).select(self.prefix()).distinct().collect())

    def read(self, prefixes: list[int]) -> DataFrame | None:
        """``PMID, feed, batch, prefix`` of these folders; no other is listed."""
        paths = [f.toString() for p in prefixes for f in self._files(p)]
        if not paths:
            return None
        return self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(*paths)

    def add(self, keys: DataFrame) -> None:
        """Add ``PMID, feed, batch``; a NULL key is not kept."""
        rows = keys.where(F.col("PMID").isNotNull()).select("PMID", "feed", "batch", self.prefix())
        self._append(rows)
        self._compact(self.touched(keys))

    def _append(self, rows: DataFrame) -> None:
        rows.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.path)

    def _compact(self, prefixes: list[int]) -> None:
        many = {p: files for p in prefixes if len(files := self._files(p)) > MOST_FILES}
        if not many:
            return
        old = [f for files in many.values() for f in files]
        rows = self.spark.read.schema(_SCHEMA).option("basePath", self.path).parquet(*[f.toString() for f in old])
        self._append(rows.distinct())
        fs = old[0].getFileSystem(self.spark._jsc.hadoopConfiguration())
        for file in old:
            fs.delete(file, False)
