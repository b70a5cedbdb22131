"""Quality by importance resampling.

Two generative models of hashed n-grams are fitted: one of raw text (all
documents) and one of target text (documents labelled good). A document's weight
is the log of the ratio of its probabilities under the two. Resampling without
replacement with these weights is Gumbel top-k: to every log weight a Gumbel
draw, seeded by the id, is added, and the k largest sums stay.

Grams are single words, pairs of words, and runs of one to three word forms (how
a word begins and ends, its case, its length, whether it repeats the word
before), all hashed into a fixed number of buckets. Counts are summed per task
before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe.llm import words as W
from litframe.llm.frames import empty_text, ship, stage

BUCKETS = 1 << 16
#: Labelled rows that the target model is fitted on, at most (drawn by a hash of the id).
FIT_ROWS = 20_000
#: Grams per bucket by which the target model leans on the raw one.
PRIOR = 50.0
#: Rows among which the last place of the top k is found by sorting.
SORTED_ROWS = 10_000

_UPPER = W.byte_table([(0x41, 0x5A)])
_ALNUM = W.byte_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def _forms(found: W.Words, data: np.ndarray) -> np.ndarray:
    """A number for the form of each word."""
    if not len(found.hash):
        return np.zeros(0, np.uint64)
    first, last, length = data[found.start], data[found.end - 1], found.end - found.start
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals = upper[found.end] - upper[found.start]
    case = np.where(capitals == 0, 0, np.where(capitals == 1, 1, 2))
    tail = np.where(_ALNUM[last], 0, last.astype(np.int64))
    second = data[np.maximum(found.end - 2, found.start)]
    twice = ~_ALNUM[last] & (second == last) & (length > 1)
    head = np.where(_ALNUM[first], 0, first.astype(np.int64))
    same = np.zeros(len(length), bool)
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (found.text[1:] == found.text[:-1])
    size = np.minimum(np.log2(length).astype(np.int64), 5)
    code = ((((head * 256 + tail) * 4 + case) * 2 + twice) * 2 + same) * 8 + size
    return W.mix(code.astype(np.uint64), 3)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every gram."""
    found = W.Words(data, offsets, W.SPACES)
    forms = _forms(found, data)
    step = np.uint64(0x9E3779B97F4A7C15)
    made, rows = [], []
    for values, longest, seed in ((found.hash, 2, 11), (forms, 3, 17)):
        run = values
        for n in range(1, longest + 1):
            if n > 1:
                run = run[:-1] * step + values[n - 1 :]
                ok = found.text[: len(run)] == found.text[n - 1 :]
                made.append(W.mix(run[ok], seed + n))
                rows.append(found.text[: len(run)][ok])
            else:
                made.append(W.mix(run, seed + n))
                rows.append(found.text)
    return (np.concatenate(made) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False)
        for row, end, data, offsets in W.chunks(batch.column(0)):
            bucket, of = grams(data, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[row:end][of] == 1], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])],
        ["bucket", "raw", "target"],
    )


def fit_sample(labels: DataFrame, id_col: str, label_col: str, rows: int = FIT_ROWS) -> DataFrame:
    """``fit_id, good``: at most about ``rows`` labelled ids, drawn by hash; ids
    with a null id or label are left out, ids that repeat count once as the larger."""
    known = labels.select(F.col(id_col).cast("long").alias("fit_id"), F.col(label_col).cast("int").alias("good")).dropna()
    total = known.count()
    share = min(1.0, rows / total) if total else 1.0
    drawn = known.filter(F.pmod(F.xxhash64("fit_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return stage(drawn.groupBy("fit_id").agg(F.max("good").alias("good")), "fit")


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability per bucket, as a fixed-size array.

    A document's own grams are in the raw model, and in the target model if it
    was fitted on, which would favour the latter; so one gram is taken out of
    either again. Row 0 holds the ratios for other documents, row 1 those for
    documents the target model was fitted on. Buckets that the target model
    has hardly seen get ratios near 0. The sample is bounded by its parameter,
    so it may be broadcast.
    """
    ship(docs.sparkSession)
    summed = (
        _marked(docs, sample, id_col, text_col).select("text", "good")
        .mapInArrow(_counts, "bucket int, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()  # one row per bucket
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[summed["bucket"]] = summed["raw"]
    target[summed["bucket"]] = summed["target"]
    expected = np.maximum(raw - 1, 0) * (target.sum() / max(raw.sum(), 1.0))
    own = np.stack([target, np.maximum(target - 1, 0)])
    return np.log((own + PRIOR) / (expected + PRIOR))


def _marked(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``fit_id, text, good``: 1 for rows that the target model is fitted on."""
    rows = docs.select(F.col(id_col).cast("long").alias("fit_id"), empty_text(text_col).alias("text"))
    return rows.join(F.broadcast(sample), "fit_id", "left").withColumn("good", F.coalesce("good", F.lit(0)))


def log_ratios(docs: DataFrame, sample: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, log_ratio`` of every row; 0 for a text without words."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = (batch.column(2).to_numpy(zero_copy_only=False) == 1).astype(np.int64)
            for row, end, data, offsets in W.chunks(batch.column(1)):
                bucket, of = grams(data, offsets)
                sums = np.bincount(of, sent.value[good[row:end][of], bucket], end - row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row:end], pa.array(np.round(sums, 6).astype(np.float64))], ["doc_id", "log_ratio"]
                )

    rows = _marked(docs, sample, id_col, text_col).select("fit_id", "text", "good")
    return rows.mapInArrow(run, "doc_id long, log_ratio double")


def best_cut(scored: DataFrame) -> float:
    """The log ratio that parts good from bad labelled rows (``log_ratio, good``)
    with the fewest errors; 0 without two kinds. The rows are the bounded sample."""
    rows = scored.toPandas().sort_values("log_ratio")
    good, value = rows["good"].to_numpy(), rows["log_ratio"].to_numpy()
    if not len(rows) or good.min() == good.max():
        return 0.0 if not len(rows) or not good.min() else -np.inf
    wrong = np.concatenate([[0], np.cumsum(good == 1)]) + (good == 0).sum() - np.concatenate([[0], np.cumsum(good == 0)])
    wrong[1:-1][value[1:] == value[:-1]] = len(rows)
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[value[0] - 1], (value[1:] + value[:-1]) / 2, [value[-1] + 1]])
    return float(edges[best[len(best) // 2]])


def gumbel(id_col: Column, seed: int) -> Column:
    """A standard Gumbel draw that the id decides."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def top_k(keyed: DataFrame, k: int) -> Column:
    """A condition on ``key, doc_id`` that holds for the ``k`` largest keys (of
    equal keys those of the smallest ids; rows equal in both stay or go together).

    The place is narrowed down by approximate quantiles of what is left; only
    the last few thousand rows are sorted.
    """
    total = keyed.count()
    if k >= total:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    low, high, above, n = -np.inf, np.inf, 0, total
    while n > SORTED_ROWS:
        inside = keyed.filter((F.col("key") > low) & (F.col("key") <= high))
        at = 1 - (k - above) / n
        want = [max(0.0, at - 0.002), min(1.0, at + 0.002)]
        a, b = inside.agg(F.percentile_approx("key", want, 20_000).alias("q")).first()["q"]
        a = np.nextafter(a, -np.inf)
        over, within = inside.agg(
            F.count_if(F.col("key") > b).alias("o"), F.count_if((F.col("key") > a) & (F.col("key") <= b)).alias("w")
        ).first()
        if not above + over < k <= above + over + within or within >= n:
            break
        low, high, above, n = a, b, above + over, within
    inside = keyed.filter((F.col("key") > low) & (F.col("key") <= high))
    last = (
        inside.orderBy(F.desc("key"), F.asc_nulls_first("doc_id")).limit(k - above)
        .agg(F.min(F.struct("key", (-F.col("doc_id")).alias("minus"))).alias("x")).first()["x"]
    )
    tie = (F.col("key") == last["key"]) & F.coalesce(F.col("doc_id") <= -last["minus"], F.lit(True)) if last["minus"] is not None else F.col("key") == last["key"]
    return (F.col("key") > last["key"]) | tie


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    k: int | None = None,
    fit_rows: int = FIT_ROWS,
    seed: int = 9,
) -> DataFrame:
    """``doc_id, log_ratio, key, kept`` of every row.

    ``k`` rows stay; by default as many as have a log ratio above the cut that
    parts good from bad among the labelled rows of the fit. Null and empty texts
    have the ratio 0. Rows of equal id and text stay or go together. Without
    labels nothing is known and all stay; an empty table gives no rows. Ids must
    be whole numbers; all null ids get the same draw.
    """
    sample = fit_sample(labels, id_col, label_col, fit_rows)
    weights = fit(docs, sample, id_col, text_col)
    scored = stage(log_ratios(docs, sample, weights, id_col, text_col), "ratios")
    if k is None:
        labelled = scored.join(F.broadcast(sample), F.col("doc_id") == F.col("fit_id")).select("log_ratio", "good")
        cut = best_cut(labelled)
        k = scored.filter(F.col("log_ratio") > cut).count() if np.isfinite(cut) else scored.count()
        if not sample.take(1):
            k = scored.count()
    keyed = scored.withColumn("key", F.col("log_ratio") + gumbel(F.col("doc_id"), seed))
    return keyed.withColumn("kept", top_k(keyed, k))
