import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE, edge_docs, empty_docs, space_words
from pyspark.sql import functions as F

from litframe.llm import boosting, quality_rules
from litframe.llm.queries import op13_quality_rules

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    text = text or ""
    words = space_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if space_words(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
    )


def texts(n, seed=13):
    rng = random.Random(seed)
    pieces = ["a", "b", "aa", "é", "漢", "\U0001f600", " ", " ", "\t", "\n", "\n", "\r", "\x0b", " ", "#", "a b a", "|", "A", "7", "!"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*made, None, "", "\n", "\n\n", "a\n", "\na\na", "a b c a b c", "a a a a", *(t for _, t in EDGE)]


def test_counts_against_plain_python(spark):
    rows = list(enumerate(texts(400)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = boosting.fit(np.zeros((0, len(quality_rules.FEATURES))), np.zeros(0))
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, forest).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = plain_counts(text)
        assert tuple(got[doc_id][c] for c in quality_rules.COUNTS) == want, text
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[doc_id]["base_failed"] == failed and got[doc_id]["kept"] == (not failed)


def walk(forest, x):
    total = forest.start
    for node in forest.roots.tolist():
        while forest.feature[node] >= 0:
            node = forest.left[node] if x[forest.feature[node]] <= forest.cut[node] else forest.right[node]
        total += forest.value[node]
    return total


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    x[:, 3] = np.round(x[:, 3])
    y = (rng.random(3000) < 1 / (1 + np.exp(2 * x[:, 0] - np.sin(3 * x[:, 1]) * 2 - x[:, 2] * x[:, 3]))).astype(int)
    return x, y


def test_flat_nodes_give_what_walking_gives(noisy):
    x, y = noisy
    forest = boosting.fit(x, y, rounds=15)
    assert forest.margin(x[:300]) == pytest.approx([walk(forest, row) for row in x[:300]])
    order = np.random.default_rng(5).permutation(len(x))
    again = boosting.fit(x[order], y[order], rounds=15)
    assert (forest.margin(x) == again.margin(x)).all()
    p = forest.score(x)
    assert np.mean((p > 0.5) == y) > np.mean(y == round(y.mean())) + 0.1


@pytest.mark.parametrize("sign", [-1, 1])
def test_monotonic_features(noisy, sign):
    x, y = noisy
    forest = boosting.fit(x, y, (sign, 0, sign, 0), rounds=40)
    for feature in (0, 2):
        moved = np.repeat(x[:200], 50, axis=0)
        moved[:, feature] = np.tile(np.linspace(-4, 4, 50), 200)
        steps = np.diff(forest.margin(moved).reshape(200, 50), axis=1) * sign
        assert (steps >= -1e-12).all()
    if sign < 0:
        assert forest.margin(x).std() > 0.3


@pytest.mark.parametrize(("y", "sign"), [([], 0), ([1, 1], 1), ([0, 0], -1)])
def test_one_class_gives_a_constant(y, sign):
    forest = boosting.fit(np.ones((len(y), 3)), np.array(y))
    assert np.sign(forest.margin(np.zeros((2, 3)))).tolist() == [sign, sign]


def test_held_out_quality(spark):
    more = "/root/testdata/sf0.1"  # half of the smaller table's labels are too few to learn from
    docs, labels = spark.read.parquet(f"{more}/documents.parquet"), spark.read.parquet(f"{more}/labels.parquet")
    half = F.col("doc_id") % 2 == 0
    forest = quality_rules.train(docs, labels.filter(half))
    got = quality_rules.apply_rules(docs, forest).join(labels.filter(~half), "doc_id").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in got)
    assert right >= 0.99 * len(got)


def test_the_query_returns_every_row(spark):
    got = op13_quality_rules(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in quality_rules.COUNTS) == plain_counts(texts[r["doc_id"]])


@pytest.mark.parametrize("labels", [[], [(4, 1)], [(4, 0), (5, 1)], [(4, 1), (8, 0), (None, 1), (5, None)]])
def test_edge_rows(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    forest = quality_rules.train(edge_docs(spark), marks)
    got = quality_rules.apply_rules(edge_docs(spark), forest).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in EDGE)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["n_words"] == 60_000 and by_id[1]["base_failed"] and not by_id[2]["kept"]
    assert quality_rules.apply_rules(empty_docs(spark), forest).count() == 0
