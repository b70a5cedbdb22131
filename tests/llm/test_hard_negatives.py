import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litframe.llm import threshold
from litframe.llm.hard_negatives import hard_negatives
from litframe.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=5, positives=5, negatives=10, least=30, greatest=90):
    """The same by scoring all pairs; rows are told apart by their place."""
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for i, (a_id, a, a_label) in enumerate(kept):
        if a_id is None or a_id % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), v, label) for j, (v, b, label) in enumerate(kept) if j != i]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p_score, p_id, _ in [s for s in scored if s[2] == a_label][:positives]:
            inside = [s for s in scored if s[2] != a_label and least * p_score <= 100 * s[0] <= greatest * p_score]
            out += [(a_id, p_id, rank, v, p_score, s) for rank, (s, v, _) in enumerate(inside[:negatives], 1)]
    return sorted(out, key=repr)


def made(n, seed, dims=6, labels=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-0.3, 0.6) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        vector = [round(c + rng.gauss(0, 0.15), rng.choice([1, 3])) for c in centre]
        # the first label holds a good third of the rows
        rows.append((i, vector, 0 if rng.random() < 0.4 else rng.randrange(labels)))
    odd = [
        (None, [0.5] * dims, 0), (None, [0.5] * dims, 1), (5, [0.1] * dims, 1), (5, [0.1] * dims, 1), (5, [0.1] * dims, 1),
        (10, None, 1), (15, [0.1] * dims, None), (20, [0.1, None], 2), (25, [float("nan")] * dims, 1),
        (30, [float("inf")] * dims, 1), (35, [], 1), (40, [0.9], 2), (45, [-0.4] * dims, 2), (1000, [0.3] * dims, 77),
    ]
    return rows + odd


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "run_anchors": 3}, {"block_rows": 1, "run_anchors": 40}])
def test_against_all_pairs(spark, sizes):
    rows = made(160 if sizes != {"block_rows": 1, "run_anchors": 40} else 30, 5)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", no int, score string").repartition(4)
    got = hard_negatives(frame, F.col("vec_id") % 5 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_empty_tables_and_lone_rows(spark):
    def run(rows):
        return hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0).collect()

    assert run([]) == [] and run([(5, [0.5], 1)]) == [] and run([(1, [0.5], 1), (2, [0.4], 2)]) == []
    assert run([(5, [1.0], 1), (6, [1.0], 1), (7, [0.5], 2)])[0].asDict() == {
        "anchor_id": 5, "positive_id": 6, "rank": 1, "negative_id": 7, "positive_score": 256 * 256, "negative_score": 256 * 128
    }
    with pytest.raises(Exception, match="too large"):
        run([(5, [1e30], 1), (6, [1.0], 1)])


def best(vectors, anchor, windows, k, allowed):
    scores = [int(sum(int(x) * int(y) for x, y in zip(v, anchor))) for v in vectors]
    order = sorted((i for i in range(len(scores)) if allowed[i]), key=lambda i: (-scores[i], i))
    return [[(i, scores[i]) for i in order if low <= scores[i] <= high][:k] for low, high in windows]


@pytest.mark.parametrize("scale", [3, 300, 1 << 24])
@pytest.mark.parametrize("rows", [1, 15, 16, 17, 400])
def test_threshold_algorithm(rows, scale):
    rng = np.random.default_rng(rows)
    vectors = np.round(rng.normal(size=(rows, 4)) * scale / 4).astype(np.int64)
    vectors[rows // 2 :, 0] += scale // 2
    block = threshold.Block(vectors)
    allowed = rng.random(rows) < 0.7
    for _ in range(20):
        anchor = np.round(rng.normal(size=4) * scale / 4).astype(np.int64) * (rng.random(4) < 0.8)
        top = int((vectors @ anchor).max())
        windows = np.array(
            [(-threshold.OPEN, threshold.OPEN), (top // 2, top), (top * 9 // 10, top * 95 // 100), (top, top - 1), (top, top), (0, 0)], np.int64
        )
        for some in (windows, windows[1:3], windows[4:5], windows[:0]):
            got = block.search(anchor, some, 3, allowed)
            assert [list(zip(a.tolist(), s.tolist())) for a, s in got] == best(vectors, anchor, some, 3, allowed)


def test_the_walk_ends_early():
    """Where few rows stand out, most are never scored."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(0, 5, (20_000, 3))
    vectors[:40] += 500
    block, scored = threshold.Block(vectors), []
    plain_scores = block._scores
    block._scores = lambda anchor, rows: scored.append(len(rows)) or plain_scores(anchor, rows)
    block.search(np.array([3, 2, 1]), np.array([(-threshold.OPEN, threshold.OPEN)]), 5)
    assert 0 < sum(scored) < 1000


def test_registered_query_has_whole_windows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(v, e, (label + 1) % 10 if v % 7 == 0 else label) for v, e, label in rows]
    got = sorted((tuple(r) for r in op12_hard_negatives(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == plain(rows, every=100)
