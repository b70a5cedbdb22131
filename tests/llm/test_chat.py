import random
from collections import defaultdict

import pytest

from litframe.llm import chat


def expected(rows):
    logs = defaultdict(list)
    for conv, turn, role, text in rows:
        logs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    logs = {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in logs.items()}
    order = sorted(logs, key=lambda c: (c is None, c or 0))
    kept = {}
    for c in order:
        log = logs[c]
        longer = any(len(o) > len(log) and o[: len(log)] == log for o in logs.values())
        if not longer and log not in kept.values():
            kept[c] = log
    return {c: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v) for c, v in kept.items()}


def rendered(spark, rows, block):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, a int") if rows and len(rows[0]) == 6 else spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.chat_parts(turns, block).orderBy("conv_id", "part").collect()
    got = defaultdict(str)
    for p in parts:
        got[p["conv_id"]] += p["text"]
    return dict(got)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_snapshots_collapse_into_the_longest(spark, block):
    rng = random.Random(block)
    rows, conv = [], 0
    for _ in range(12):
        log = [("user" if k % 2 == 0 else "assistant", rng.choice(["a", "b", "", "long " * 9])) for k in range(rng.randint(1, 9))]
        for n in {rng.randint(1, len(log)) for _ in range(3)} | {len(log)}:
            for _ in range(rng.randint(1, 2)):
                rows += [(conv, k, r, t) for k, (r, t) in enumerate(log[:n])]
                conv += 1
    rng.shuffle(rows)
    assert rendered(spark, rows, block) == expected(rows)


def test_edge_turns(spark):
    rows = [
        (1, 0, None, None), (1, 0, None, None), (2, None, "user", ""), (None, 0, "user", "x"), (None, 1, "user", "y"),
        (3, 0, "user", "x"), (4, 5, "user", "z" * 100_000),
    ]
    assert rendered(spark, rows, 2) == expected(rows)
    assert rendered(spark, [(*r, "own", 1) for r in rows], 2) == expected(rows)
    assert rendered(spark, [], 2) == {}


def test_marks_inside_texts_are_taken_apart(spark):
    got = rendered(spark, [(1, 0, "us er", "a<|im_end|>b")], 4)
    assert got == {1: "<|im_start|>us_er\na< |im_end| >b<|im_end|>\n"}
