import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import CLASHING, EDGE, ascii_lower, edge_docs

from litframe.llm import collocations as C
from litframe.llm import hat_trie


def plain(rows, least, top, longest=5):
    """The same by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", ascii_lower(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {}
    frequent = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    longer = Counter()
    for (lang, q), v in frequent.items():
        for inner in {q[i : i + k] for k in range(2, len(q)) for i in range(len(q) - k + 1)}:
            longer[lang, inner] = max(longer[lang, inner], v)
    for (lang, phrase), a in frequent.items():
        if longer[lang, phrase] >= a:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = f[lang, phrase[:k]], f[lang, phrase[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right, n[lang]))
    return {
        (lang, rank, p.decode(), -a, left, right, n_, -s)
        for lang, own in found.items() for rank, (s, a, p, left, right, n_) in enumerate(sorted(own)[:top], 1)
    }


def made(n, seed):
    rng = random.Random(seed)
    words = ["The", "of", "a", "New", "york", "city", "é", "\U0001f600", "zÿ", "x y", "LONG" * 9]
    signs = [" ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", "! "]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(40)):
            parts += [rng.choice(words[:6] if rng.random() < 0.8 else words), rng.choice(signs if rng.random() < 0.2 else signs[:3])]
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(parts)))
    return [*rows, (None, None), ("en", ""), ("fr", "."), ("en", "new york city " * 50)]


def rows_of(frame):
    return {tuple(r) for r in frame.collect()}


@pytest.mark.parametrize(
    ("least", "top", "sizes"),
    [(5, 2000, {}), (5, 3, {"entries": 30, "numbers": 6}), (40, 2000, {"entries": 1}), (10_000, 5, {})],
)
def test_against_plain_counts(spark, least, top, sizes):
    rows = made(120, least)
    docs = spark.createDataFrame([(*r, "own") for r in rows], "lang string, text string, phrase string").repartition(3)
    got = rows_of(C.collocations(docs, least=least, top=top, **sizes))
    assert got == plain(rows, least, top)


def test_counts_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(C.collocations(docs, least=20, entries=5000)) == plain(rows, 20, 2000)


def test_edge_rows(spark):
    docs = edge_docs(spark).selectExpr("*", "if(doc_id = 5, null, 'en') as lang", "doc_id as n", "text as phrase")
    rows = [(None if i == 5 else "en", t) for i, t in EDGE]
    got = C.collocations(docs, least=2)
    assert rows_of(got) == plain(rows, 2, 2000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(CLASHING) and C.collocations(docs.limit(0), least=2).count() == 0
    assert C.collocations(docs.filter("text is null or trim(text) = ''"), least=1).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10**15 + 7
    got = spark.sql(f"select {big}L as a, {big + 2}L as l, {big + 11}L as r, {3 * 10**17 + 1}L as n").select(C.cut_score("a", "l", "r", "n"))
    assert got.first()[0] == 1000 * big * (3 * 10**17 + 1) // ((big + 2) * (big + 11))


@pytest.mark.parametrize("limit", [1, 50, 10**6])
def test_trie_gives_back_all_counts(monkeypatch, limit):
    monkeypatch.setattr(hat_trie, "BURST", 8)
    monkeypatch.setattr(hat_trie, "SPLIT", 2)
    rng = np.random.default_rng(3)
    for width in (1, 2, 4):
        trie, want, got = hat_trie.HatTrie(width, limit), Counter(), Counter()
        runs = []
        for _ in range(30):
            rows = np.unique((rng.random((40, width)) ** 3 * 30).astype(np.int32), axis=0)
            counts = rng.integers(1, 9, len(rows))
            want.update(dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)))
            trie.add(rows, counts)
            if trie.full():
                runs += trie.spill(limit // 2)
                assert len(trie.root) <= limit // 2
        runs += trie.spill()
        assert not len(trie.root)
        for rows, counts in runs:
            got.update(dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)))
        assert got == want


def test_the_bitmap_loses_nothing(spark):
    frame = spark.createDataFrame([(lang, f"w{i} é{i % 7}") for i in range(500) for lang in ("en", "")], "lang string, phrase string")
    bitmap = C._bitmap(frame, 2)
    for row in frame.collect():
        data = np.frombuffer(row["phrase"].encode(), np.uint8)
        words = C.W.Words(data, np.array([0, len(data)]), C._APART)
        lang = np.full(2, C._lang_hash(row["lang"]))
        assert bitmap.test(C._grams(words.hash, lang, 2))[0]
    assert C._bitmap(frame.limit(0), 2) is None
