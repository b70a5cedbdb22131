import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import EDGE, edge_docs, empty_docs

from litframe.llm import line_templates as L


def expected(rows, least, depth):
    docs = Counter()
    for _, text in rows:
        docs.update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    mask = lambda ws: [L.VARIABLE if re.search("[0-9]", w) else w for w in ws]
    words = {line: re.split(r"\s+", line) for line in docs}
    leaf = {line: (len(w), tuple(mask(w[:depth]))) for line, w in words.items()}
    per_leaf = Counter()
    for line, n in docs.items():
        per_leaf[leaf[line]] += n
    place = Counter()
    for line, n in docs.items():
        if per_leaf[leaf[line]] >= least:
            for at, w in enumerate(mask(words[line])):
                place[leaf[line], at, w] += n
    template, fits, often = {}, set(), Counter()
    for line, n in docs.items():
        if per_leaf[leaf[line]] < least:
            continue
        made = [w if w != L.VARIABLE and place[leaf[line], at, w] >= least else L.VARIABLE for at, w in enumerate(mask(words[line]))]
        fixed = sum(w != L.VARIABLE for w in made)
        template[line] = (leaf[line], tuple(made))
        if fixed >= L.FIXED_SHARE * len(made) and len(made) >= L.LEAST_WORDS:
            fits.add(line)
            often[template[line]] += n
    gone = {x for x in template if docs[x] >= least or (x in fits and often[template[x]] >= least)}
    out = Counter()
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if x.strip(" ") not in gone]
        out[(doc_id, len(lines), len(lines) - len(left), "\n".join(left))] += 1
    return out


def test_against_a_direct_count(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(3)]
        if i % 3 == 0:
            lines.append(f"Copyright {1990 + i} by {rng.choice(['Ann', 'Bob'])} all rights reserved")
        if i % 4 == 0:
            lines += ["  posted by user  ", f"Page {i} of 9"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[0][1]), (0, rows[0][1])] + EDGE
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.drop_recurring(docs, least_docs=12)
    want = expected(rows, 12, L.DEPTH)
    assert Counter(map(tuple, got.collect())) == want
    assert any(n for (_, _, n, _) in want)


def test_variable_fields_are_generalised(spark):
    rows = [(i, f"Version {i}.0 of the tool was released today\nown text{i} here") for i in range(30)]
    got = L.recurring(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["template"] for r in got.collect()} == {"Version <*> of the tool was released today"}


def test_edge_rows(spark):
    got = L.drop_recurring(edge_docs(spark), least_docs=3)
    assert Counter(map(tuple, got.collect())) == expected(EDGE, 3, L.DEPTH)
    assert L.drop_recurring(empty_docs(spark)).count() == 0
    with pytest.raises(Exception):
        L.drop_recurring(spark.range(1)).count()
    assert defaultdict


def passage(i, n=60):
    return " ".join(f"p{'abcdefghijklmnopqrst'[i]}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


def dropped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_dropped"], r["text"]) for r in L.drop_recurring(docs).collect()}


@pytest.mark.parametrize("times", [2, 3, 9])
def test_long_lines_of_few_documents(spark, times):
    rows = [(i, f"own text of {i} here\n{passage(0)}\nshort line of few documents\nlast {i}") for i in range(times)]
    rows += [(50 + i, passage(i + 1)) for i in range(9)]
    got = dropped(spark, rows)
    for i in range(times):
        assert got[i] == (1, f"own text of {i} here\nshort line of few documents\nlast {i}")
    assert all(got[50 + i] == (0, passage(i + 1)) for i in range(9))


@pytest.mark.parametrize("times", [2, 3, 9])
def test_long_templates_of_few_documents(spark, times):
    # two fields with few values each, no pair of which repeats; the first lead words are shared
    lines = [passage(0) + f" by {'xyz'[i % 3]} of {'uvw'[i // 3]} on 2024-01-{i}" for i in range(times)]
    got = dropped(spark, [(i, f"own {i}\n{line}") for i, line in enumerate(lines)])
    assert all(got[i] == (1, f"own {i}") for i in range(times))


def test_a_documents_own_long_lines_do_not_recur(spark):
    text = "\n".join([passage(0) + " row 1", passage(0) + " row 2", passage(0) + " row 1"])
    assert dropped(spark, [(1, text), (2, passage(1))])[1] == (0, text)
    assert dropped(spark, [(1, text), (1, text)])[1] == (3, "")


def test_words_from_which_two_documents_are_enough(spark):
    got = dropped(spark, [(1, passage(0, 50)), (2, passage(0, 50)), (3, passage(1, 49)), (4, passage(1, 49))])
    assert [got[i][0] for i in (1, 2, 3, 4)] == [1, 1, 0, 0]


def test_only_lines_that_may_recur_are_staged_with_their_text(spark, monkeypatch):
    staged = {}
    stage = L.stage
    monkeypatch.setattr(L, "stage", lambda frame, name: staged.setdefault(name, stage(frame, name)))
    rows = [(i, f"a line that stands in all\n{chr(97 + i)} own {i}") for i in range(12)]
    assert {r["docs"] for r in L.recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {12}
    held = {name: frame for name, frame in staged.items() if "text" in frame.columns}
    assert [r["text"] for frame in held.values() for r in frame.collect()] == ["a line that stands in all"]
    assert sum("docs" in f.columns and f.count() == 13 for f in staged.values()) == 1
