"""A feed of new articles from a folder that captures arrive in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from litframe.operators.details import extract_details, flat_details
from litframe.operators.merge import last_per_key, new_articles
from litframe.sources.scratch import exists, staged
from litframe.streaming.key_index import PREFIXES, KeyIndex

STREAM_CAPTURES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
     T.StructField("html", T.StringType())]
)


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FED = "PMID string, feed string, batch long"


def read_capture_stream(
    spark: SparkSession, path: str, files_per_trigger: int = 1000
) -> DataFrame:
    """Captured article pages (``STREAM_CAPTURES``) as Parquet files arrive."""
    reader = spark.readStream.schema(STREAM_CAPTURES)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_feed(
    captures: DataFrame, known: DataFrame, path: str, checkpoint: str, prefixes: int = PREFIXES
) -> StreamingQuery:
    """Append details of articles not in ``known`` to Parquet at ``path``, each once.

    What was fed before, by this feed or others with the same ``path``, is looked
    up in an index beside the output (``<path>_keys``), in as many of its
    ``prefixes`` folders as the batch has articles at most; no state expires. Where there
    is output without an index, the index is made from it first. Of what is found
    and of ``known`` only articles of the batch are shuffled. Copies of one article
    are reduced to the last one first. Each batch goes to a folder named after
    the feed and the batch and replaces that folder when it is run again, so a
    restart leaves no rows twice and no feed touches what another wrote. One feed
    at a time may write to a ``path``. ``path`` and ``checkpoint`` must be in
    folders all executors share.
    """
    details = flat_details(extract_details(captures))
    names = [c for c in details.columns if c != "PMID"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the id that the checkpoint gave this feed
        feed = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        with staged(last_per_key(batch, "PMID", "page_id", *names), "batch") as latest:
            seen = known.select("PMID")
            index = KeyIndex(spark, f"{path.rstrip('/')}_keys", prefixes)
            if not index.exists() and exists(spark, path):
                index.add(spark.read.schema(_FED).parquet(path))
            fed = index.read(index.touched(latest))
            if fed is not None:
                own = (fed.feed == feed) & (fed.batch >= batch_id)
                seen = seen.unionByName(fed.where(~own).select("PMID"))
            seen = seen.join(latest.select("PMID"), "PMID", "left_semi")
            fresh = new_articles(latest, seen)
            out = f"{path}/feed={feed}/batch={batch_id}"
            fresh.write.mode("overwrite").parquet(out)
            # after the output: a batch that breaks off here is run again
            keys = spark.read.schema("PMID string").parquet(out)
            index.add(keys.select("PMID", F.lit(feed).alias("feed"), F.lit(batch_id).cast("long").alias("batch")))

    return (
        details.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_state_feed(
    captures: DataFrame, known: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append details of articles not in ``known`` to Parquet at ``path``, each once,
    with the keys it has fed in Spark's state store.

    ``every`` is the pause between batches of a feed that goes on (such as ``1 minute``);
    without it, what has arrived is fed and the feed ends. Nothing is looked up
    in the output: a batch touches the state of its own keys, which RocksDB keeps
    on disk and the checkpoint restores after a restart or on another executor. Of
    several copies of an article one is fed; later ones, whenever they come,
    are dropped. The state holds one key per article and does not expire. It
    belongs to the checkpoint, so two feeds into one ``path`` do not know of each other.
    """
    spark = captures.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    details = flat_details(extract_details(captures))
    fresh = new_articles(details, known).dropDuplicates(["PMID"])
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        fresh.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )
