import numpy as np
import pytest
from helpers import EDGE, edge_docs, empty_docs
from pyspark.sql import functions as F

from litframe.llm import importance, toxicity
from litframe.llm.queries import op4_lexicon_toxicity, op9_importance_resampling

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("raw", "folded"),
    [
        ("L0SER", " loser "), ("In 2024 we", " in 2024 we "), ("idiоt", " idiot "), ("st​upid!", " stupid "),
        ("tr@sh, $cum", " trash scum "), ("ｌｏｓｅｒ", " loser "), ("", "  "), ("a_b-c", " a b c "),
        ("3 b1g d0gs", " 3 big dogs "), ("naïve été", " naïve été "),
    ],
)
def test_folding(raw, folded):
    assert toxicity.fold(raw) == folded


@pytest.mark.parametrize(
    ("raw", "folded"),
    [("sh!t", " shit "), ("!diot", " idiot "), ("You !diot, sh！t!", " you idiot shit "), ("Stop! Now!", " stop now ")],
)
def test_folding_of_exclamation_marks(raw, folded):
    assert toxicity.fold(raw) == folded
    assert toxicity.fold(raw + " 0") == folded + "0 "


def test_exceptions_and_overlaps():
    lexicon = toxicity.Lexicon({" kill ": 2.0, " kill": 1.0, " trash ": 3.0}, {" kill process "})
    assert lexicon.measure("Kill him")[0] == 2.0
    assert lexicon.measure("kill process now")[0] == 0.0
    assert lexicon.measure("killing")[0] == 1.0
    assert lexicon.measure("TR4SH")[0] == 3.0
    assert lexicon.measure("") == (0.0, 0)
    assert toxicity.Lexicon({}).measure("trash") == (0.0, 1)


@pytest.mark.parametrize("raw", ["\u24da\u24d8ll", "k\u0336i\u0336ll\u0336", "\U0001d424\U0001d422\U0001d425\U0001d425", "\uff4bill"])
def test_dressed_up_letters(raw):
    assert toxicity.fold(raw) == " kill "


def plain_measure(lexicon, text):
    """Plain substring search in place of the automaton."""
    folded = toxicity.fold(text)

    def places(term):
        return [i for i in range(len(folded)) if folded.startswith(term, i)]

    hidden = {i for p in lexicon.exceptions for a in places(p) for i in range(a, a + len(p))}
    best = {}
    for term, weight in lexicon.weights.items():
        for i in places(term):
            if i not in hidden:
                best[i] = max(best.get(i, 0.0), weight)
    return sum(best.values()), len(folded.split())


def test_scores_against_plain_search(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.train(docs, labels)
    assert lexicon.weights
    texts = {r["doc_id"]: r["text"] for r in docs.filter("n_chars < 600").collect()}
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    some = sorted(toxic & set(texts))[:40] + sorted(set(texts) - toxic)[:20]
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    for doc_id in some:
        weight, words = plain_measure(lexicon, texts[doc_id] or "")
        assert got[doc_id]["weight"] == pytest.approx(weight) and got[doc_id]["words"] == words
        z = sum(f * x for f, x in zip(lexicon.factors, toxicity.features(weight, words), strict=True))
        assert got[doc_id]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-8)


def test_exceptions_are_learned(spark):
    rows = [(f"you are a pest number{i}", 1) for i in range(60)]
    rows += [(f"the pest control man came to house{i}", 0) for i in range(5)] + [(f"all is well at place{i}", 0) for i in range(300)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert " pest " in lexicon.weights and " pest control " in lexicon.exceptions
    assert lexicon.score(*lexicon.measure("you pest")) > 0.5 > lexicon.score(*lexicon.measure("pest control"))


def test_all_terms_and_exceptions_are_kept(spark):
    words = ["".join("bcdfghjklm"[i // 10**k % 10] for k in range(4)) + "aeiou" for i in range(1200)]
    packed = [" ".join(words[i::200]) for i in range(200)]
    rows = [(f"pest {text}", 1) for text in packed for _ in range(3)]
    rows += [(f"pest {i}x", 1) for i in range(1600)]  # many toxic rows do not raise the support
    rows += [(" ".join(f"pest w{w}" for w in words), 0)] * 3 + [(f"all is well at place{i}", 0) for i in range(3300)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert {f" {w} " for w in words} <= set(lexicon.weights)
    assert {f" pest w{w} " for w in words} <= lexicon.exceptions
    assert {f" w{w} pest " for w in words[:-1]} <= lexicon.exceptions


def test_held_out_toxicity(spark):
    rows = op4_lexicon_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("labels", [[], [(4, 1)], [(4, 0), (5, 0)], [(4, 1), (5, 0), (None, 1), (8, None)]])
def test_toxicity_of_edge_rows(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.train(edge_docs(spark), marks)
    got = toxicity.score(edge_docs(spark), lexicon).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in EDGE)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty_docs(spark), lexicon).count() == 0


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = F.col("doc_id") % 2 == 0
    got = importance.resample(docs, labels.filter(half)).join(labels.filter(~half), "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in got)
    assert right >= 0.97 * len(got)


def test_resampling_is_repeatable_and_takes_k(spark):
    first = op9_importance_resampling(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    again = importance.resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {(r["doc_id"], r["kept"]) for r in first} == {(r["doc_id"], r["kept"]) for r in again}
    some = importance.resample(docs, spark.read.parquet(f"{SF}/labels.parquet"), k=77)
    assert some.filter("kept").count() == 77


@pytest.mark.parametrize("labels", [[], [(4, 1)], [(4, 0)], [(4, 1), (8, 0), (None, 1), (5, None)]])
def test_quality_of_edge_rows(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = importance.resample(edge_docs(spark), marks).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in EDGE)
    same = {(r["log_ratio"], r["kept"]) for r in got if r["doc_id"] == 6}
    assert len(same) == 1
    if not labels:
        assert all(r["kept"] for r in got)
    assert importance.resample(empty_docs(spark), marks).count() == 0


@pytest.mark.parametrize("k", [0, 1, 5, 499, 500, 2999, 3000, 4000])
def test_top_k_is_exact(spark, k, monkeypatch):
    monkeypatch.setattr(importance, "SORTED_ROWS", 100)
    rng = np.random.default_rng(7)
    keys = np.round(rng.normal(size=3000), 1)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(keys)], "doc_id long, key double")
    got = {r["doc_id"] for r in rows.filter(importance.top_k(rows, k)).collect()}
    assert got == set(sorted(range(3000), key=lambda i: (-keys[i], i))[:k])
