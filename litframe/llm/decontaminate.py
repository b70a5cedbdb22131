"""Find passages of benchmark items in documents.

Every run of 13 words of an item (or all its words, if it has fewer) is a
phrase. Documents are indexed shard by shard inside the tasks that read them
(`fm_index`); phrases are searched in each shard, occurrences located, and
overlapping ones merged into spans. Texts are not shuffled.

Phrases go to the tasks in blocks of bounded size, one pass for each block, so
an item set of any size is searched whole. Words are compared by 64-bit hashes
of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe.llm import words as W
from litframe.llm.fm_index import FMIndex
from litframe.llm.frames import empty_text, ship, stage

#: Words of a phrase.
WINDOW = 13
#: Pairs of phrase and item that are sent to the tasks at once.
BLOCK_PAIRS = 100_000
#: Bytes of texts in a shard (a longer text is a shard of its own).
SHARD_BYTES = 4 << 20

_FOUND = (
    "doc_id long, digest binary, n_words long, n_hit long, "
    "spans array<struct<word:int,words:int,start:int,end:int>>, items array<string>"
)


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, phrase``: distinct phrases of items, as hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in W.chunks(batch.column(1)):
                found = W.Words(data, offsets, W.NON_ALNUM)
                names, made = [], []
                for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
                    raw = found.hash[a:b].tobytes()
                    span = 8 * min(window, b - a)
                    cut = {raw[k : k + span] for k in range(0, len(raw) - span + 1, 8)} if b > a else ()
                    made += cut
                    names += [batch.column(0)[row + i]] * len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n.as_py() for n in names], pa.string()), pa.array(made, pa.binary())],
                    ["item", "phrase"],
                )

    ship(items.sparkSession)
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), empty_text(text_col))
    return rows.mapInArrow(run, "item string, phrase binary").distinct()


class _Block:
    """Distinct phrases of a block and the items of each."""

    def __init__(self, pairs: list[tuple[str, bytes]], window: int):
        distinct = sorted({p for _, p in pairs})
        number = {p: i for i, p in enumerate(distinct)}
        self.lengths = np.array([len(p) // 8 for p in distinct], np.int64)
        self.words = np.zeros((len(distinct), window), np.uint64)
        for i, p in enumerate(distinct):
            self.words[i, window - len(p) // 8 :] = np.frombuffer(p, np.uint64)
        order = sorted((number[p], item) for item, p in pairs)
        self.items = [item for _, item in order]
        self.first = np.searchsorted([n for n, _ in order], np.arange(len(distinct) + 1))


def _search(batches: Iterator[pa.RecordBatch], block: _Block, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    vocabulary, place = np.unique(block.words, return_inverse=True)
    place = place.reshape(block.words.shape)
    for batch in batches:
        for row, end, data, offsets in W.chunks(batch.column(1), shard_bytes):
            # a call of its own, so that a shard's index is gone before the next one is built
            yield _searched(batch.slice(row, end - row), data, offsets, block, vocabulary, place)


def _searched(
    batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, block: _Block, vocabulary: np.ndarray, place: np.ndarray
) -> pa.RecordBatch:
    """What is found in the texts of one shard."""
    found = W.Words(data, offsets, W.NON_ALNUM)
    n = len(offsets) - 1
    hit = np.zeros(len(found.hash) + 1, np.int64)
    items: list[list[str]] = [[] for _ in range(n)]
    if len(found.hash) and len(block.lengths):
        known, numbers = np.unique(found.hash, return_inverse=True)
        at = np.searchsorted(known, vocabulary)
        there = known[np.minimum(at, len(known) - 1)] == vocabulary
        index = FMIndex(numbers + 1, found.count, len(known))
        low, high = index.search(np.where(there, at + 1, 0)[place], block.lengths)
        sizes = high - low
        phrase = np.repeat(np.arange(len(sizes)), sizes)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[phrase]
        where = index.locate(rows)
        text = np.searchsorted(found.first[1:] + np.arange(1, n + 1), where, side="right")
        word = where - text  # marks of the texts before
        np.add.at(hit, word, 1)
        np.add.at(hit, word + block.lengths[phrase], -1)
        for t, p in np.unique(np.stack([text, phrase], 1), axis=0):
            items[t] += block.items[block.first[p] : block.first[p + 1]]
    covered = np.cumsum(hit)[:-1] > 0
    before = np.concatenate([[0], np.cumsum(covered)])
    edge = covered.copy()
    edge[1:] &= ~covered[:-1] | (found.text[1:] != found.text[:-1])
    close = covered.copy()
    close[:-1] &= ~covered[1:] | (found.text[1:] != found.text[:-1])
    a, b = np.flatnonzero(edge), np.flatnonzero(close)
    of = found.text[a]
    spans = pa.StructArray.from_arrays(
        [
            pa.array((a - found.first[of]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32)),
            pa.array((found.start[a] - offsets[of]).astype(np.int32)),
            pa.array((found.end[b] - offsets[of]).astype(np.int32)),
        ],
        ["word", "words", "start", "end"],
    )
    cuts = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0), batch.column(2), pa.array(found.count),
            pa.array(before[found.first[1:]] - before[found.first[:-1]]),
            pa.ListArray.from_arrays(pa.array(cuts), spans),
            pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
        ],
        ["doc_id", "digest", "n_words", "n_hit", "spans", "items"],
    )


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_pairs: int = BLOCK_PAIRS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, spans, items``.

    ``spans`` are the merged occurrences (first word, words, first and end byte of
    the UTF-8 text), ``items`` the ids (as strings, sorted) of items with phrases
    that occur. Null and empty texts have no words; items without words are
    nowhere found, items with a null id are listed under the empty string.
    Repeated rows give repeated results. Without documents there are no rows,
    without items no hits. Ids must be whole numbers.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    pairs = stage(phrases(items, item_id_col, item_text_col, window), "phrases")
    blocks = max(1, -(-pairs.count() // block_pairs))
    block = F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks))
    digest = F.unhex(F.md5("text")) if blocks > 1 else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))
    rows = rows.withColumn("digest", digest)
    results = []
    for k in range(blocks):
        part = [(r["item"], r["phrase"]) for r in pairs.filter(block == k).collect()]
        sent = spark.sparkContext.broadcast(_Block(part, window))
        results.append(
            rows.mapInArrow(lambda b, sent=sent: _search(b, sent.value, shard_bytes), _FOUND)
        )
    if blocks == 1:
        return results[0].drop("digest")
    return _merged(results)


def _merged(results: list[DataFrame]) -> DataFrame:
    """Results of all blocks together; equal rows of a block have equal results."""
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    rows = found.groupBy("doc_id", "digest").agg(
        F.first("n_words").alias("n_words"), (F.count(F.lit(1)) / len(results)).cast("int").alias("times"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    span = "struct<word:int,words:int,start:int,end:int>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (x["word"] <= F.try_element_at(done, F.lit(-1))["word"] + F.try_element_at(done, F.lit(-1))["words"])
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(
            last["word"].alias("word"),
            (F.greatest(last["word"] + last["words"], x["word"] + x["words"]) - last["word"]).alias("words"),
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
        )
        return F.when(
            touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(x)))

    merged = rows.withColumn("spans", F.aggregate("all", F.lit(None).cast(f"array<{span}>"), lambda a, x: add(F.coalesce(a, F.array().cast(f"array<{span}>")), x)))
    merged = merged.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{span}>")))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        "doc_id", "n_words", hits.alias("n_hit"), "spans", "items"
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more lie in passages of items."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_spans(text: Column, spans: Column) -> Column:
    """The text with the bytes of its spans cut out."""
    raw = F.encode(text, "UTF-8")
    end = F.struct(F.lit(0).alias("at"), F.encode(F.lit(""), "UTF-8").alias("kept"))
    cut = F.aggregate(
        spans, end,
        lambda a, x: F.struct(
            x["end"].alias("at"),
            F.concat(a["kept"], F.substr(raw, a["at"] + 1, x["start"] - a["at"])).alias("kept"),
        ),
    )
    rest = F.substr(raw, cut["at"] + 1, F.octet_length(text) - cut["at"])
    return F.decode(F.concat(cut["kept"], rest), "UTF-8")
