"""Order inside runs: small blocks, so that every level has several rows."""

import random

import pytest

from litframe.operators import ordering as O


def hits(spark, seed=0, page_numbers=range(40)):
    rnd = random.Random(seed)
    rows = []
    for run in ("a", "b", None):
        for page in page_numbers:
            for position in range(1, rnd.randint(0, 5) + 1):
                rows.append((run, page, page * 10, position, f"{run}-{page}-{position}"))
    rnd.shuffle(rows)
    schema = "run_id string, page_no int, page_id long, position int, tag string"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def expected(rows):
    out = {}
    for run in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2], r[3]))
        out.update({r[4]: i for i, r in enumerate(own, 1)})
    return out


def test_run_order(spark):
    rows, frame = hits(spark)
    for block in (1, 7, 4096):
        got = {r.tag: r.id for r in O.with_run_order(frame, pages_per_block=block).collect()}
        assert got == expected(rows)


def test_run_order_keeps_rows_without_page_number(spark):
    schema = "run_id string, page_no int, page_id long, position int"
    rows = [("r", None, None, 1), ("r", None, None, 2), ("r", 3, 3, 1)]
    got = O.with_run_order(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    assert [(r.id, r.page_no, r.position) for r in got] == [(1, None, 1), (2, None, 2), (3, 3, 1)]


def test_start_is_added(spark):
    _, frame = hits(spark)
    plain = {r.tag: r.id for r in O.with_run_order(frame).collect()}
    moved = {r.tag: r.id for r in O.with_run_order(frame, start=100).collect()}
    assert moved == {tag: i + 100 for tag, i in plain.items()}


def test_dense_position_closes_gaps(spark):
    rnd = random.Random(3)
    ids = rnd.sample(range(2**53, 2**53 + 5000), 300)
    rows = [(rnd.choice("ab"), i) for i in ids]
    frame = spark.createDataFrame(rows, "run_id string, id long")
    got = {r.id: r.pos for r in O.dense_position(frame, ["run_id"], rows_per_block=64).collect()}
    for run in "ab":
        own = sorted(i for r, i in rows if r == run)
        assert [got[i] for i in own] == list(range(1, len(own) + 1))


def test_batches(spark):
    rows = [("r", i * 3, f"k{i}") for i in range(7)] + [("s", 1, "one")]
    frame = spark.createDataFrame(rows, "run_id string, id long, key string")
    got = O.plan_batches(frame, "key", 5).orderBy("run_id", "batch_no").collect()
    assert [(r.run_id, r.batch_no, r.n_keys, r["keys"]) for r in got] == [
        ("r", 0, 5, ["k0", "k1", "k2", "k3", "k4"]), ("r", 1, 2, ["k5", "k6"]), ("s", 0, 1, ["one"]),
    ]


def test_dense_batches_need_no_ranking(spark):
    frame = spark.range(1, 13).selectExpr("'r' as run_id", "id", "cast(id as string) as key")
    planned = O.plan_batches(frame, "key", 5, dense=True)
    got = planned.orderBy("batch_no").collect()
    assert [r.n_keys for r in got] == [5, 5, 2]
    assert "Window" not in planned._jdf.queryExecution().executedPlan().toString()


def test_rows_without_an_order_raise(spark):
    frame = spark.createDataFrame([("r", 1, "a"), ("r", None, "b")], "run_id string, id long, key string")
    for planned in (O.plan_batches(frame, "key", 5), O.plan_batches(frame, "key", 5, dense=True), O.dense_position(frame, ["run_id"])):
        with pytest.raises(Exception, match="has no id"):
            planned.collect()


def test_no_window_over_a_whole_run_of_rows(spark):
    _, frame = hits(spark)
    plan = O.with_run_order(frame)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert len(windows) == 2  # pages inside a block, blocks inside a run
    assert not any("position" in line for line in windows)
