"""Five stages from raw documents to shards of a training mix.

Each stage is a function of (spark, docs, sf_dir) that returns the rows it keeps;
``run`` writes each stage's rows as Parquet to the shared folder and reads them
again as the next one's documents. All columns of the documents are kept, and
stages look at ``doc_id``, ``text`` and ``source`` only.

Rows of one id are judged together: if one of them is rejected as contaminated, or
kept for its quality, so are the others. Null texts count as empty. Each stage says
what it does with them, with ties and with tables without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litframe.llm import decontaminate, importance, mixing, ngram_join, resharding
from litframe.llm.frames import packed, stage, table

#: Columns that documents have; whatever else they have goes along.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OLD_SHARDS, NEW_SHARDS = 16, 24
#: Near duplicates: word 5-grams, Jaccard similarity of 0.8.
WORDS, PERCENT = 5, 80


def _by_id(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id, null or not, is among those found, or is not."""
    ids = found.select(F.col("doc_id").alias("other")).distinct()
    rows = packed(docs, own=F.col("doc_id"))  # other columns may have any name
    return rows.join(ids, F.col("own").eqNullSafe(F.col("other")), how).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps, with the target model of good labels.

    Null and empty texts have the ratio 0 and are judged by it; null ids get one
    common draw. Equal keys go by the id. Without labels all rows stay, without rows none.
    """
    weighed = importance.resample(docs, table(spark, sf_dir, "labels"))
    return _by_id(docs, weighed.filter("kept"), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones.

    Null and empty texts are similar to nothing, so all of them stay. Repeated
    rows are copies of each other. An empty table stays empty.
    """
    return ngram_join.one_of_each(docs, WORDS, PERCENT).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are passages of benchmark items.

    Texts without words hold no passage and stay. Without items all rows stay.
    """
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    dirty = found.filter(decontaminate.contaminated(F.col("n_hit"), F.col("n_words")))
    return _by_id(docs, dirty, "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the target weights of their sources, repeated as often as they are used.

    A null source is one of its own, the last. Texts without words take no room;
    equal draws go by the id. An empty table stays empty. Columns with the names that
    the mix adds (``mixing.ADDED``) are left out.
    """
    return mixing.repeated(mixing.mix(docs, F.array("source")).rows)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, from 16 shards by id to 24 of equal bytes.

    Null texts take 8 bytes, as empty ones do. Equal rows get slots of their own. ``shard`` and
    ``slot`` of the documents themselves are replaced. An empty table stays empty.
    """
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS))
    return resharding.reshard(docs, old, NEW_SHARDS).rows.select(*own, "shard", "slot")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", sharding),
]

#: The stages fit models, search an index and follow links, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.split()[0].lower())
    return docs
