"""Toxicity by a weighted lexicon.

Texts are folded: composed letters without further marks, lower case, look-alike letters to Latin ones, digits and signs
that stand for letters inside words, everything else to single spaces. A lexicon
of words and word beginnings is learned from labelled rows, each with its log
odds as weight, together with exception phrases: pairs of words that hold a
lexicon term but stand in clean rows. An Aho-Corasick automaton finds both; a
term inside an exception phrase does not count. The score is a logistic function
of the summed weights, of the same per word, and of the length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litframe.llm.frames import empty_text, ship, stage
from litframe.llm.importance import FIT_ROWS, fit_sample

#: Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g",
    "ℓ": "l", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Characters that are not seen.
HIDDEN = "­​‌‍⁠﻿"
#: Full-width forms of ASCII, by rule.
WIDE = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}

#: Blocks of combining marks, which are dropped where they make no letter of their own.
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")

_FOLD = str.maketrans(WIDE | LOOKALIKES | dict.fromkeys(HIDDEN))
_DIGIT = str.maketrans(DIGITS)
_MIXED = re.compile(r"(?<![\w@$])(?=[\d@$!]*[^\W\d_])(?=[^\W\d_]*[\d@$!])[\w@$!]*[\w@$]")
_BREAKS = re.compile(r"[\W_]+")

#: Beginnings of words that may be lexicon terms, in letters.
STEMS = (4, 5, 6)
#: Toxic rows that a term needs, and clean rows that an exception phrase needs.
LEAST_ROWS = 3
LEAST_ODDS = 2.0
BY_CHANCE = 0.01


def fold(text: str) -> str:
    """Folded words between single spaces, with one at either end."""
    if not text.isascii():
        text = _MARKS.sub("", normalize("NFKC", text))
    text = text.lower().translate(_FOLD)
    if any(c in text for c in DIGITS):
        text = _MIXED.sub(lambda m: m[0].translate(_DIGIT), text)
    return " " + _BREAKS.sub(" ", text).strip() + " "


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    terms = {f" {w} " for w in words}
    for n in STEMS:
        terms.update(f" {w[:n]}" for w in words if len(w) > n)
    return terms


@dataclass
class Lexicon:
    """Weights of terms (`` word `` or `` begin``), exception phrases, and the
    factors of (one, summed weights, weights per word, length)."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    factors: tuple[float, ...] = (-3.0, 1.0, 0.0, 0.0)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                made.add_word(phrase, (len(phrase), None))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def measure(self, text: str) -> tuple[float, int]:
        """Summed weights of what is found, and words."""
        folded = fold(text)
        words = len(folded.split())
        if not self.weights and not self.exceptions:
            return 0.0, words
        found: dict[int, float] = {}
        excepted = []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                excepted.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight  # of terms that begin together the heaviest
        for a, b in excepted:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        return float(sum(found.values())), words

    def score(self, weight: float, words: int) -> float:
        z = sum(f * x for f, x in zip(self.factors, features(weight, words), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(weight: float, words: int) -> tuple[float, float, float, float]:
    return 1.0, float(np.log1p(weight)), float(np.sqrt(10 * weight / (words + 10))), float(np.log1p(words) / 5)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        terms = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())],
            ["term", "toxic", "clean"],
        )

    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            (toxic if label.as_py() else clean).update(_terms(fold(text.as_py())))
            if len(toxic) + len(clean) > 200_000:
                yield flush(toxic, clean)
                toxic, clean = Counter(), Counter()
    yield flush(toxic, clean)


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from rows of ``text, label``; all terms and phrases that pass the
    odds and the least support are collected, so the rows should be a bounded sample."""
    ship(rows.sparkSession)
    rows = stage(rows.select(empty_text("text").alias("text"), F.col("label").cast("int").alias("label")), "toxic")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon({}, set(), (30.0 if bad else -3.0, 0.0, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    chosen = (
        rows.mapInArrow(_counts, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= LEAST_ROWS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    )
    lexicon = Lexicon({r["term"]: round(float(r["odds"]), 4) for r in chosen.collect()})
    lexicon.exceptions = _exceptions(rows, lexicon, bad, good)
    lexicon._automaton = None
    lexicon.factors = _factors(rows, lexicon)
    return lexicon


def _exceptions(rows: DataFrame, lexicon: Lexicon, bad: int, good: int) -> set[str]:
    """Pairs of words around terms that clean rows hold far more often, or that
    no toxic row holds and so many clean ones that, were the pair as toxic as its
    term, this would hardly come by chance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, labels, odds = [], [], []
            for text, label in zip(batch.column(0), batch.column(1)):
                folded, own = fold(text.as_py()), {}
                for end, (length, weight) in lexicon.automaton.iter(folded) if lexicon.weights else ():
                    start = end - length + 1
                    close = folded.index(" ", start + 1)
                    after = folded.find(" ", close + 1)
                    before = folded.rfind(" ", 0, start)
                    near = ([folded[start : after + 1]] if after > 0 else []) + ([folded[before : close + 1]] if before >= 0 else [])
                    for phrase in near:
                        own[phrase] = min(own.get(phrase, weight), weight)
                phrases += own.keys()
                odds += own.values()
                labels += [label.as_py()] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(phrases, pa.string()), pa.array(labels, pa.int32()), pa.array(odds, pa.float64())],
                ["phrase", "label", "odds"],
            )

    counted = rows.mapInArrow(run, "phrase string, label int, odds double").groupBy("phrase").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"),
        F.min("odds").alias("term_odds"),
    )
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    # the share of clean rows among those with the term
    share = good / (good + bad * F.exp("term_odds"))
    by_chance = F.col("clean") * F.log(share)
    kept = counted.filter(
        (F.col("clean") >= LEAST_ROWS) & ((odds < -1) | ((F.col("toxic") == 0) & (by_chance < math.log(BY_CHANCE))))
    )
    return {r["phrase"] for r in kept.collect()}


def _measured(rows: DataFrame, lexicon: Lexicon, kept: list[str]) -> DataFrame:
    """``kept`` columns and ``weight, words`` for rows of these and ``text``."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.measure(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())],
                [*kept, "weight", "words"],
            )

    return rows.select(*kept, "text").mapInArrow(run, f"{schema}, weight double, words long")


def _factors(rows: DataFrame, lexicon: Lexicon, steps: int = 12) -> tuple[float, ...]:
    """Logistic regression by Newton steps over the (bounded) labelled rows."""
    data = _measured(rows, lexicon, ["label"]).toPandas()
    x = np.array([features(w, n) for w, n in zip(data["weight"], data["words"])])
    y = data["label"].to_numpy(float)
    f = np.zeros(x.shape[1])
    keep = np.diag([0.01, 0.1, 0.1, 0.1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ f, -30, 30)))
        f += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ f)
    return tuple(round(float(v), 6) for v in f)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, weight, words`` of every row.

    Null and empty texts have no words and the score of a text without finds;
    long ones are read whole, in one go. Repeated rows give repeated results, a
    null id stays null; an empty table gives none. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_text(text_col).alias("text"))
    measured = _measured(rows, lexicon, ["doc_id"])
    one, summed, dense, long = (F.lit(v) for v in lexicon.factors)
    z = (
        one + summed * F.log1p("weight")
        + dense * F.sqrt(10 * F.col("weight") / (F.col("words") + 10))
        + long * F.log1p("words") / 5
    )
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return measured.select("doc_id", F.round(1 / (1 + F.exp(-z)), 9).alias("score"), "weight", "words")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from at most about ``fit_rows`` of the labelled rows, drawn by
    hash of the id; the sample is bounded, so its ids may be broadcast."""
    sample = fit_sample(labels, id_col, label_col, fit_rows)
    rows = docs.select(F.col(id_col).alias("fit_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), "fit_id").select("text", F.col("good").alias("label"))
    return learn(rows)
