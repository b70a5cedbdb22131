import itertools
import random

import pytest
from helpers import CLASHING, edge_docs, empty_docs, space_words
from pyspark.sql import functions as F

from litframe.llm import mixing, resharding
from litframe.llm.flow import Network


def test_flow_against_all_assignments():
    rng = random.Random(1)
    for _ in range(60):
        supply = [rng.randint(0, 3) for _ in range(2)]
        demand = [rng.randint(0, 3) for _ in range(2)]
        cost = [[rng.randint(0, 5) for _ in range(2)] for _ in range(2)]
        net = Network(6)
        for i, s in enumerate(supply):
            net.arc(0, 2 + i, s, 0)
        for j, d in enumerate(demand):
            net.arc(4 + j, 1, d, 0)
        arcs = {(i, j): net.arc(2 + i, 4 + j, 9, cost[i][j]) for i in range(2) for j in range(2)}
        sent, paid = net.push(0, 1)
        best = {}
        for x in itertools.product(range(4), repeat=4):
            x = {(0, 0): x[0], (0, 1): x[1], (1, 0): x[2], (1, 1): x[3]}
            if all(x[i, 0] + x[i, 1] <= supply[i] for i in range(2)) and all(x[0, j] + x[1, j] <= demand[j] for j in range(2)):
                total = sum(x.values())
                price = sum(v * cost[i][j] for (i, j), v in x.items())
                best[total] = min(best.get(total, 1 << 30), price)
        assert sent == max(best) and paid == best[sent]
        assert paid == sum(net.flow(e) * cost[i][j] for (i, j), e in arcs.items())


def test_transfers_move_as_few_bytes_as_can_be():
    rng = random.Random(2)
    for _ in range(30):
        old = {s: rng.randint(0, 1000) for s in range(rng.randint(1, 6))}
        capacity = resharding.even_capacities(sum(old.values()), rng.randint(1, 9))
        moves = resharding.transfers(old, capacity)
        for s, b in old.items():
            assert sum(n for a, _, n in moves if a == s) == b
        for s, c in capacity.items():
            assert sum(n for _, t, n in moves if t == s) == c
        assert sum(n for a, t, n in moves if a != t) == sum(max(0, b - capacity.get(s, 0)) for s, b in old.items())
    with pytest.raises(ValueError):
        resharding.transfers({0: 5}, {0: 4})


def layout(rows):
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return shards


@pytest.mark.parametrize("slot_rows", [20_000, 7])
def test_shards_are_even_and_slots_gapless(spark, sf_dir, slot_rows, monkeypatch):
    monkeypatch.setattr(resharding, "SLOT_ROWS", slot_rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = resharding.reshard(docs, F.col("doc_id") % 5, 7)
    rows = done.rows.withColumn("b", resharding.document_size(F.col("text"))).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    sizes = [sum(r["b"] for r in own) for own in layout(rows).values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= max(r["b"] for r in rows)
    moved = sum(r["b"] for r in rows if r["doc_id"] % 5 != r["shard"])
    least = sum(n for a, b, n in done.moves if a != b)
    assert abs(moved - least) <= 0.1 * least


def test_one_size_for_all_rows_is_cut_by_hash(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'same' as text")
    rows = resharding.reshard(docs, F.lit(0), 4).rows.collect()
    assert all(abs(len(own) - 750) <= 2 for own in layout(rows).values())


def test_resharding_edge_rows(spark, tmp_path):
    docs = edge_docs(spark)
    done = resharding.reshard(docs, F.lit(0), 3)
    rows = done.rows.collect()
    layout(rows)
    assert len(rows) == docs.count()
    assert done.rows.columns == ["doc_id", "text", *(c for c in CLASHING if c not in ("shard", "slot")), "shard", "slot"]
    assert resharding.reshard(empty_docs(spark), F.lit(0), 3).rows.count() == 0


def test_shards_that_do_not_change_are_not_written(spark, tmp_path):
    docs = spark.range(90).selectExpr("id as doc_id", "repeat('x', 20) as text")
    old = resharding.reshard(docs, F.col("doc_id") % 3, 3)
    before = resharding.rewrite(old, str(tmp_path / "a"))
    sizes = {r["shard"]: r["b"] for r in before.groupBy("shard").agg(F.sum(F.octet_length("text") + 8).alias("b")).collect()}
    capacity = {0: sizes[0], 1: sizes[1] - 280, 2: sizes[2], 3: 280}
    done = resharding.reshard(before.drop("slot"), F.col("shard"), 4, capacity)
    assert done.changed == {1, 3}
    after = resharding.rewrite(done, str(tmp_path / "b"), str(tmp_path / "a"))
    assert sorted(p.name for p in (tmp_path / "b").glob("shard=*")) == ["shard=1", "shard=3"]
    rows = after.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(90))
    assert {s: len(own) for s, own in layout(rows).items()} == {0: 30, 1: 20, 2: 30, 3: 10}


def test_targets_share_the_excess_by_weight():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.targets([10, 1000, 1000], [3, 1, 2])
    assert got[0] == 30 and got[1] == pytest.approx(1980 / 3) and got[2] == pytest.approx(1980 * 2 / 3)
    assert mixing.targets([], []) == []


def test_flow_prefers_first_use_over_repetition():
    # the shared pattern serves what its own members cannot without repeating
    got = {r.pattern: r.use for r in mixing.route({(0,): 10, (0, 1): 10, (1,): 5}, [10, 15])}
    assert got == {(0,): 10, (0, 1): 10, (1,): 5}


def test_mix_meets_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs, F.array("source"))
    rows = mixed.rows.collect()
    assert all(r["mix_size"] == len(space_words(r["text"])) and 0 <= r["mix_times"] <= 3 for r in rows)
    for source, (size, target) in mixed.goals.items():
        own = [r for r in rows if r["source"] == source]
        assert sum(r["mix_size"] for r in own) == size
        taken = sum(r["mix_size"] * r["mix_times"] for r in own)
        assert abs(taken - target) <= max(0.05 * target, min(r["mix_size"] for r in own) + 1)
    again = mixing.mix(docs.repartition(5), F.array("source")).rows
    assert {(r["doc_id"], r["mix_times"]) for r in again.collect()} == {(r["doc_id"], r["mix_times"]) for r in rows}
    assert mixing.repeated(mixed.rows).count() == sum(r["mix_times"] for r in rows)


def test_mix_of_overlapping_sources(spark):
    docs = spark.range(600).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text",
        "case id % 3 when 0 then array('a') when 1 then array('b', 'a') else array('b', null) end as own",
    )
    mixed = mixing.mix(docs, F.col("own"), weights={"a": 1, "b": 1, None: 1})
    used = {r["mix_pattern"]: r["n"] for r in mixed.rows.groupBy("mix_pattern").agg(F.sum(F.col("mix_size") * F.col("mix_times")).alias("n")).collect()}
    assert set(mixed.goals) == {"a", "b", None}
    assert abs(sum(used.values()) - sum(t for _, t in mixed.goals.values())) <= 10


def test_mixing_edge_rows(spark):
    docs = edge_docs(spark).withColumn("source", F.when(F.col("doc_id") > 4, F.lit("s")))
    mixed = mixing.mix(docs, F.array("source"))
    assert mixed.rows.count() == docs.count()
    assert set(mixed.rows.columns) == {*docs.columns, "mix_size", "mix_pattern", "mix_times"}
    none = mixing.mix(empty_docs(spark).withColumn("source", F.lit("s")), F.array("source"))
    assert none.rows.count() == 0 and none.goals == {}
    assert mixing.mix(docs, F.array().cast("array<string>")).rows.filter("mix_times > 0").count() == 0
