"""The pipeline stage by stage against direct computations on the same rows."""

from collections import Counter

import compare
import pytest
from pyspark.sql import functions as F
from test_decontaminate import expected as passages
from test_ngram_join import expected as groups

import __spark_entry__ as registry
import corpus_pipeline as P
from litframe.llm import importance, mixing, queries, resharding
from litframe.llm.frames import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, step in P.STAGES:
        docs.append(stage(step(spark, docs[-1], SF), "test"))
    return docs


def ids(frame):
    return Counter(r["doc_id"] for r in frame.select("doc_id").collect())


def test_columns(steps):
    for frame in steps[:-1]:
        assert tuple(frame.columns) == P.COLUMNS
    assert steps[-1].columns == [*P.COLUMNS, "shard", "slot"]


def test_quality(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    kept = set(ids(steps[1]))
    assert len(bad & kept) <= 0.1 * len(bad) and len(good - kept) <= 0.03 * len(good)
    weighed = importance.resample(steps[0], labels)
    assert kept == {r["doc_id"] for r in weighed.filter("kept").collect()}


def test_near_duplicates(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    want = [i for i, _, root in groups(rows, P.WORDS, P.PERCENT) if i == root]
    assert ids(steps[2]) == Counter(want) and len(want) < len(rows)


def test_decontamination(spark, steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, n, hit, _ in passages(rows, items, 13) if hit and 20 * hit >= n}
    assert ids(steps[3]) == Counter(i for i, _ in rows if i not in dirty)


def test_mixture(steps):
    before, after = ids(steps[3]), ids(steps[4])
    mixed = mixing.mix(steps[3], F.array("source")).rows.collect()
    assert after == Counter({r["doc_id"]: r["mix_times"] for r in mixed if r["mix_times"]})
    assert set(after) <= set(before) and max(after.values()) <= 3


def test_sharding(steps):
    assert ids(steps[5]) == ids(steps[4])
    rows = steps[5].withColumn("b", resharding.document_size(F.col("text"))).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["b"]
    assert set(sizes) <= set(range(P.NEW_SHARDS))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["b"] for r in rows)
    for s in sizes:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_edge_documents_pass_through(spark):
    from helpers import edge_docs, empty_docs

    more = lambda d: d.selectExpr("doc_id", "text", "'xx' as lang", "cast(null as string) as source", "cast(3 as long) as n_chars", "'own' as kept", "'own' as id")
    for docs in (more(edge_docs(spark, extra=False)), more(empty_docs(spark))):
        for _, step in P.STAGES:
            docs = step(spark, docs, SF)
        docs.collect()


def test_registered_queries(spark):
    assert {f"op{n}_" for n in range(1, 11)} <= {q[: q.index("_") + 1] for q in queries.queries() if q.startswith("op")}
    assert set(queries.queries()) <= set(registry.queries())
    con = compare.connect(SF)
    for name, sql in queries.oracle_sql().items():
        assert compare.spark_rows(queries.queries()[name](spark, SF)) == compare.duck_rows(con, sql)


@pytest.mark.parametrize("name", ["op2_flow_resharding", "op7_flow_mixing"])
def test_contract_columns(spark, name):
    # the smallest tables have texts that are longer than a 24th of all
    rows = queries.queries()[name](spark, "/root/testdata/sf0.01").collect()
    if name.startswith("op2"):
        assert {r["law"] for r in rows} == {"bytes"} and {r["shard"] for r in rows} == set(range(24))
        sizes = Counter()
        for r in rows:
            sizes[r["shard"]] += r["size"]
        assert max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 24
    else:
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
        for source in {r["source"] for r in rows}:
            own = [r for r in rows if r["source"] == source]
            assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}


def test_other_columns_go_along(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "concat('own ', doc_id) as kept", "doc_id as row", "1 as slot")
    for _, step in P.STAGES:
        docs = stage(step(spark, docs, SF), "more")
    assert docs.columns == [*P.COLUMNS, "kept", "row", "shard", "slot"]
    assert docs.count() and docs.filter("kept <> concat('own ', doc_id) or row <> doc_id").count() == 0
