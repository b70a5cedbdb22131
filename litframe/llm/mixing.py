"""Mix sources to target weights, where a document may belong to several.

Documents are aggregated by membership pattern (their set of sources). A
minimum-cost flow routes words from patterns to sources: each pattern offers
its words once for nothing and again at a cost that rises with every
repetition, each source asks for its target. The flow says how many words of a
pattern each source gets; the sum over sources, divided by the pattern's
words, is how many times over the pattern is used.

Which documents of a pattern get the odd repetition is drawn by a seeded hash,
within classes of about equal size, from large to small: each class makes up
for what the larger ones are over or under, so the sum comes near the flow
without favouring long or short documents. Classes and draws are histograms,
so no task holds a pattern's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe.llm.flow import Network
from litframe.llm.frames import empty_text, packed, ship, stage

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A document is used this many times at most.
MOST = 3
#: Draws per size class; the last class of a pattern is off by one draw at most.
DRAWS = 4096
CUTS = "pattern string, size_class int, whole int, below int"
ADDED = ("mix_size", "mix_pattern", "mix_times")


def word_count(text: Column) -> Column:
    return F.regexp_count(empty_text(text), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of all words by weight; above ``most`` times a source's own size
    the excess goes to the others by weight, until no source is above."""
    total, capped = sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(weights[i] for i in open_)
        left = total - sum(capped.values())
        share = {i: left * weights[i] / weight for i in open_} if weight else {}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            return [float(capped[i] if i in capped else share[i]) for i in range(len(sizes))]
        capped |= {i: float(most * sizes[i]) for i in over}


@dataclass(frozen=True)
class Route:
    """Words of a pattern (a sorted tuple of source numbers) that are used."""

    pattern: tuple[int, ...]
    words: int
    use: int


def route(patterns: dict[tuple[int, ...], int], quotas: list[int], most: int = MOST) -> list[Route]:
    """Minimum-cost flow from patterns to source quotas with convex repetition costs."""
    keys = sorted(patterns)
    net = Network(2 + len(keys) + len(quotas))
    source, sink = 0, 1
    at = {p: 2 + i for i, p in enumerate(keys)}
    base = 2 + len(keys)
    entries = {
        p: [net.arc(source, at[p], patterns[p], k * k) for k in range(most)] for p in keys
    }
    for p in keys:
        for s in p:
            net.arc(at[p], base + s, most * patterns[p], 0)
    for s, quota in enumerate(quotas):
        net.arc(base + s, sink, quota, 0)
    net.push(source, sink)
    return [Route(p, patterns[p], sum(map(net.flow, entries[p]))) for p in keys]


def _size_class(size: Column) -> Column:
    """Large documents come first; a class spans a factor of two to the half."""
    return (-F.floor(F.log2(F.greatest(size, F.lit(1))) * 2)).cast("int")


def _draw(seed: int, id_col: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), id_col, size), F.lit(DRAWS)).cast("int")


def cuts(histogram: DataFrame, use: DataFrame) -> DataFrame:
    """``pattern, size_class, whole, below``: documents are used ``whole`` times, and
    once more if their draw is below ``below``."""

    ship(histogram.sparkSession)
    def choose(key, rows):
        import pandas as pd

        words, wanted = int(rows["total"].iloc[0]), int(rows["use"].iloc[0])
        whole, odd = divmod(wanted, words) if words else (0, 0)
        made, seen, got = [], 0, 0
        for size_class, part in rows.sort_values(["size_class", "draw"]).groupby("size_class", sort=True):
            summed = part["words"].cumsum().to_numpy()
            seen += int(summed[-1])
            goal = odd * seen / words - got if words else 0
            steps = [0, *summed.tolist()]
            best = min(range(len(steps)), key=lambda i: abs(steps[i] - goal))
            got += steps[best]
            below = 0 if best == 0 else int(part["draw"].iloc[best - 1]) + 1
            made.append((key[0], int(size_class), whole, below))
        return pd.DataFrame(made, columns=["pattern", "size_class", "whole", "below"])

    return histogram.join(use, "pattern").groupBy("pattern").applyInPandas(choose, CUTS)


@dataclass(frozen=True)
class Mix:
    """The rows and, by source name, its words and its target."""

    rows: DataFrame
    goals: dict[str | None, tuple[int, float]]


def mix(
    docs: DataFrame,
    members: Column,
    weights: dict[str | None, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = MOST,
    seed: int = 7,
) -> Mix:
    """``docs`` with ``mix_size``, ``mix_pattern`` and ``mix_times``, and the targets.

    ``members`` is an array of source names (a null name is a source of its
    own, an empty or null array belongs to none and is used 0 times). Sources
    are taken in code point order, null last; ``weights`` maps names to whole
    weights (none: 1, 2, 3, repeating). Null texts have size 0; documents of
    size 0 are used like the smallest of their pattern. Rows of equal id and
    size are drawn together. Reruns give the same rows; an empty table gives
    none. Existing columns of the added names are replaced.
    """
    tag = lambda s: F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s))
    pattern = F.to_json(F.array_sort(F.array_distinct(F.transform(members, tag))))
    size = word_count(F.col(text_col))
    sized = packed(
        docs, ADDED, size=size, pattern=F.coalesce(pattern, F.lit("[]")),
        size_class=_size_class(size), draw=_draw(seed, F.col(id_col), size),
    )
    made, goals = _plan(sized, weights, most)
    odd = F.when(F.col("draw") < F.col("below"), 1).otherwise(0)
    # the cuts are a few rows per pattern; Spark broadcasts them by their measured size
    rows = sized.join(made, ["pattern", "size_class"], "left").select(
        "row.*", F.col("size").alias("mix_size"), F.col("pattern").alias("mix_pattern"),
        F.coalesce(F.col("whole") + odd, F.lit(0)).alias("mix_times"),
    )
    return Mix(rows, goals)


def _plan(sized, weights, most):
    import json

    spark = sized.sparkSession
    histogram = stage(
        sized.groupBy("pattern", "size_class", "draw").agg(F.sum("size").alias("words")), "mix"
    )
    # one row per membership pattern
    rows = histogram.groupBy("pattern").agg(F.sum("words").alias("words")).collect()
    named = {r["pattern"]: tuple(json.loads(r["pattern"])) for r in rows}
    # tagged names order by code point; Python compares strings that way
    sources = sorted({s for p in named.values() for s in p})
    if not sources:
        return spark.createDataFrame([], CUTS), {}
    words = {r["pattern"]: int(r["words"]) for r in rows}
    sizes = [sum(words[p] for p, m in named.items() if s in m) for s in sources]
    given = [
        (weights or {}).get(None if s == "1" else s[1:], 0) if weights else 1 + i % 3
        for i, s in enumerate(sources)
    ]
    goal = targets(sizes, given, most)
    number = {s: i for i, s in enumerate(sources)}
    by_pattern = {tuple(sorted(number[s] for s in m)): p for p, m in named.items()}
    routes = route(
        {k: words[p] for k, p in by_pattern.items()}, [round(x) for x in goal], most
    )
    use = spark.createDataFrame(
        [(by_pattern[r.pattern], r.words, r.use) for r in routes], "pattern string, total long, use long"
    )
    goals = {None if s == "1" else s[1:]: (sizes[i], goal[i]) for i, s in enumerate(sources)}
    return stage(cuts(histogram, use), "mix-cuts"), goals


def repeated(mixed: DataFrame) -> DataFrame:
    """Rows of the mix, each as often as it is used, without the added columns."""
    times = F.sequence(F.lit(1), F.col("mix_times"))
    return (
        mixed.filter("mix_times > 0")
        .withColumn("mix_times", F.explode(times))
        .drop(*ADDED)
    )
