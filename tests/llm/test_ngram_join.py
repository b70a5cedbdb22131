import random

import numpy as np
import pytest
from helpers import EDGE, ascii_lower, edge_docs, empty_docs, space_words
from pyspark.sql import functions as F

from litframe.llm import ngram_join as N
from litframe.llm import words as W
from litframe.llm.components import components


def gram_set(text, n):
    w = space_words(ascii_lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def expected(rows, n, percent):
    sets = [gram_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    made = []
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        made.append((doc_id, len(sets[i]), min(known) if known else None))
    return sorted(made, key=str)


def family(rng, size, copies, change):
    base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    for _ in range(copies):
        text = [w if rng.random() > change else f"w{rng.randint(0, 400)}" for w in base]
        yield " ".join(text[: rng.randint(max(1, size - 3), size)])


def families(seed):
    rng = random.Random(seed)
    texts = []
    for size, copies, change in ((3, 6, 0.2), (12, 10, 0.03), (40, 25, 0.02), (90, 30, 0.01), (200, 12, 0.02), (400, 6, 0.01)):
        texts += family(rng, size, copies, change)
    line = " ".join(f"common{i}" for i in range(14))
    texts += [f"{line} " + " ".join(f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(4, 20))) for _ in range(60)]
    texts += texts[:20]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(
    ("n", "percent", "spare", "block"), [(3, 90, 100, 512), (5, 80, 2, 4), (2, 70, 1, 3), (1, 60, 4, 512), (3, 90, 1, 2)]
)
def test_groups_against_all_pairs(spark, n, percent, spare, block):
    rows = families(percent + n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = N.similar_groups(docs, n, percent, spare=spare, block_sets=block).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, n, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
@pytest.mark.parametrize("costly", [0.0, 0.5, 1.0])
def test_similar_sets_share_an_entry_whatever_values_are_costly(percent, costly):
    """The pigeonhole argument on its own: any choice of costly values is safe."""
    rng = np.random.default_rng(percent)
    bands = N.Bands(percent)
    for _ in range(400):
        union = rng.integers(0, 1 << 62, rng.integers(5, 120)).astype(np.uint64)
        least = -(-percent * len(union) // 100)
        both = rng.integers(least, len(union) + 1)
        split = rng.integers(both, len(union) + 1)
        a = np.sort(np.concatenate([union[:both], union[both:split]]))
        b = np.sort(np.concatenate([union[:both], union[split:]]))
        if not len(a) or not len(b) or (len(a) == len(b) and (a == b).all()):
            continue
        grams, begins = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        values = np.unique(N.entries(grams, begins, bands)[0])
        picked = values[(W.mix(values, 99) % np.uint64(1000)) < np.uint64(1000 * costly)]
        value, of, _ = N.entries(grams, begins, bands, [picked, picked])
        assert set(value[of == 0]) & set(value[of == 1])


def test_edge_rows(spark):
    got = N.similar_groups(edge_docs(spark), 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == expected(EDGE, 3, 90)
    assert N.similar_groups(empty_docs(spark)).count() == 0
    kept = N.one_of_each(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None", "None"]


def test_near_copies_without_an_id(spark):
    part = lambda c, a, b: " ".join(f"{c}{i}" for i in range(a, b))
    # only the row without an id links its neighbours
    rows = [(1, part("w", 0, 20)), (None, part("w", 1, 21)), (3, part("w", 2, 22)), (None, part("w", 1, 21))]
    rows += [(None, part("v", 0, 20)), (None, part("v", 1, 21)), (None, part("u", 0, 20)), (0, part("t", 0, 20))]
    rows += [(9, part("s", 0, 20)), (9, part("r", 0, 20)), (8, part("s", 1, 21)), (7, part("r", 1, 21))]
    want = expected(rows, 1, 90)
    assert (3, 20, 1) in want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 12):
        got = N.similar_groups(docs.repartition(parts), 1, 90).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_stars_are_streamed_over_batches():
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((rng.randint(0, 60), rng.randint(0, 9)) for _ in range(300))
    want = set()
    for v in {v for v, _ in rows}:
        own = sorted({k for x, k in rows if x == v})
        want |= {(v, k, own[0]) for k in own if len(own) > 1}
    for step in (1, 2, 7, 300):
        batches = (
            pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + step]], pa.int64()) for i in (0, 1)], ["value", "cls"])
            for k in range(0, len(rows), step)
        )
        got = [tuple(r.values()) for b in N._stars(batches) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_random_links(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(40)]
    links += [(5000, 5000 + k) for k in range(1, 100)] + [(-7, -7)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_are_stars_need_no_round(spark, monkeypatch):
    from litframe.llm import components as C

    staged = []
    stage = C.stage
    monkeypatch.setattr(C, "stage", lambda frame, name: staged.append(name) or stage(frame, name))
    links = spark.createDataFrame([(5, 1), (7, 1), (9, 2)], "a long, b long")
    roots = C.components(links)
    assert staged == ["links"]
    assert sorted(map(tuple, roots.collect())) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)]
    more = spark.createDataFrame([(7, 9), (20, 21), (21, 0), (5, 7), (3, 3)], "a long, b long")
    found = C.joined(roots, more)
    whole = C.components(links.unionByName(more))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_large_sets_that_are_not_alike_do_not_travel():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    union = np.unique(rng.integers(0, 1 << 62, 12_000).astype(np.uint64))
    a = union[:8000]
    # one pair each: similar, also over a boundary of lengths; too few in common; nothing in common
    others = [union[500:8300], union[100:9000], union[2000:10_000], union[8000:], union[:3000]]
    alike = [100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in others]
    assert alike == [True, True, False, False, False]
    small = [union[:700], union[20:720], union[:1030], union[1000:1700]]
    pairs = [(a, b) for b in others] + [(small[0], small[1]), (small[2], small[2][:1000]), (small[0], small[3])]
    rows = [(i, -i, len(x), len(y), N._parity(x), N._parity(y)) for i, (x, y) in enumerate(pairs)]
    assert len({len(r[4]) for r in rows} | {len(r[5]) for r in rows}) > 2
    batch = pa.RecordBatch.from_pylist([dict(zip("abcdef", r)) for r in rows])
    assert [b.column(0).to_pylist() for b in N._near_centre(iter([batch]), 80)] == [[0, 1, 5, 6]]
    # the same between members of a star
    units = [(7, 0, 0, 0, i, i, len(x), N._parity(x)) for i, x in enumerate([a, *others])]
    batch = pa.RecordBatch.from_pylist([dict(zip("abcdefgh", r)) for r in units])
    found = [b.column(1).to_pylist() for b in N._active(iter([batch]), 80)]
    assert found == [[0, 1, 2]]


def test_large_sets_against_all_pairs(spark):
    rng = random.Random(5)
    texts = [t for size in (450, 900, 1000, 2100) for t in family(rng, size, 5, 0.02)]
    texts += [" ".join(f"y{rng.randint(0, 10**6)}" for _ in range(3000)) for _ in range(6)]
    rows = list(enumerate(texts + texts[:2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for spare in (1, 100):
        got = N.similar_groups(docs, 5, 80, spare=spare).collect()
        assert sorted(map(tuple, got), key=str) == expected(rows, 5, 80)


def test_pairs_go_without_the_rows_of_their_stars(spark):
    # value, set, centre; (1, 7) shares two values, of which one is costly; rows may repeat
    rows = [(50, 1, 1), (50, 2, 1), (60, 2, 1), (50, 3, 1), (50, 3, 1), (60, 1, 1), (70, 7, 7), (70, 8, 7), (50, 9, 1), (60, 9, 1), (60, 9, 1)]
    stars = spark.createDataFrame(rows, "value long, cls long, centre long")
    shared = stars.groupBy("cls", "centre").agg(F.count(F.lit(1)).alias("values"))
    sets = spark.createDataFrame([(1, []), (3, [5, 6]), (8, [6])], "cls long, deleted array<long>")
    for gone, want in (((50,), {(2, 1), (9, 1), (8, 7), (8, 3)}), ((), {(2, 1), (3, 1), (9, 1), (8, 7), (8, 3)}), ((50, 60, 70), {(8, 3)})):
        costly = stars.filter(F.col("value").isin(*gone)) if gone else stars.limit(0)
        pairs = N._pairs(shared, costly, sets)
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert "LeftAnti" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_costly_rows_are_those_of_heavy_values(spark):
    # 9 sets meet under value 1 only, two more of its sets under others too
    rows = [(1, k, 0) for k in range(11)] + [(2, 9, 0), (2, 10, 0), (2, 0, 0), (3, 20, 19), (3, 19, 19)]
    stars = spark.createDataFrame(rows, "value long, cls long, centre long")
    shared = stars.groupBy("cls", "centre").agg(F.count(F.lit(1)).alias("values"))
    assert sorted(map(tuple, N._costly(stars, shared, 4).collect())) == sorted(r for r in rows if r[0] == 1)
    assert N._costly(stars, shared, 5).count() == 0


def test_few_rows_travel_that_no_key_asks_for(spark):
    rows = spark.range(40_000).select(F.col("id"), (F.col("id") * 7).alias("mark"), F.col("id").cast("string").alias("text"))
    for wanted in (0, 1, 600, 20_000):
        keys = spark.range(wanted).select("id", (F.col("id") * 7).alias("mark")).repartition(3)
        found = N._likely(rows, keys, "id", "mark")
        assert found.columns == rows.columns
        got = [r[0] for r in found.collect()]
        assert len(got) == len(set(got)) and set(range(wanted)) <= set(got)
        assert len(got) <= wanted + 0.07 * (40_000 - wanted)


def test_only_texts_of_wanted_sets_are_shuffled(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    rows = spark.range(5000).selectExpr("id as doc_id", "repeat('word ', 40) || id as text", "id * 3 as mark")
    named = rows.filter("doc_id < 50").select(*N._place(), F.col("doc_id").alias("cls"))
    texts = N._texts(rows, named, named)
    assert sorted(r[0] for r in texts.collect()) == list(range(50))
    plan, moved = texts._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []

    def walk(node):
        if node.nodeName() == "Exchange" and "text" in node.output().toString():
            moved.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = node.plan() if node.nodeName().endswith("QueryStage") else None
        children = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        for x in children:
            walk(x)

    walk(plan)
    assert moved and max(moved) < 1000
