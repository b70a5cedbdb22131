"""Phrases whose words stand together more often than their parts would by chance.

Phrases are counted length by length. A phrase can be frequent only if it is made
of two frequent phrases one word shorter, so each pass over the texts counts
just those; the frequent phrases of the last pass travel as a bitmap of hashes,
which may let some phrases through too many, but never loses one. Its size goes
with the number of phrases up to a fixed bound.

Inside a task, words get numbers, and sequences of numbers are counted in a trie
with hash containers (`hat_trie`). Once it is full, whole subtrees are spilled as
runs, sorted by their words. Runs are merged per prefix partition: a first word,
or, for words that make up a thousandth of a language or more, one of 64 parts of what
follows, so that no first word holds too many phrases. A row of a run has all that
follows one prefix in it. Phrases are told apart by their words; hashes only leave out what
cannot be frequent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litframe.llm import words as W
from litframe.llm.frames import empty_text, ship, stage
from litframe.llm.hat_trie import HatTrie, summed

#: Words of the longest phrase, and how often a phrase must occur.
LONGEST, LEAST = 5, 100
#: Phrases returned for a language.
TOP = 2000
#: Entries of a task's trie, and words that have a number in it.
ENTRIES, NUMBERS = 1_500_000, 500_000
#: Bits of the bitmap for each phrase, and its bits at most (16 MB).
BITS_EACH, MOST_BITS = 32, 1 << 27
#: Rows of a run that are handed over at once.
RUN_ROWS = 1 << 16
#: Parts of a hot first word's phrases that are merged apart, and of a language's that are
#: ranked apart first.
PARTS = 64
#: Share of all words (one in so many) from which a first word is hot: at most so many are.
HOT = 1000

_BLANKS = W.byte_table([(0x20, 0x20), (0x09, 0x09)])
_BREAKS = W.byte_table([(0x0A, 0x0D)]) | np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_APART = _BLANKS | _BREAKS
_STEP = np.uint64(0xD1342543DE82EF95)


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()))


def _grams(hashes: np.ndarray, lang: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ones' are of no use."""
    made = W.mix(lang, 5) if len(lang) else lang
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        made = made * _STEP + padded[k : k + len(hashes)]
    return W.mix(made, size) if len(made) else made


class Bitmap:
    """Which hashes may belong to frequent phrases."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def test(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(frequent: DataFrame, size: int) -> Bitmap | None:
    """The bitmap of ``lang, phrase`` rows of ``size`` words; none if there are no rows."""
    n = frequent.count()
    if not n:
        return None
    bits = min(1 << int(n * BITS_EACH - 1).bit_length(), MOST_BITS)
    bits = max(bits, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.chunks(batch.column(1)):
                found = W.Words(data, offsets, _APART)
                lang = np.array([_lang_hash(x) for x in batch.column(0)[row:end].to_pylist()], np.uint64)
                made = _grams(found.hash, lang[found.text], size)[found.first[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array((made & np.uint64(bits - 1)).astype(np.int64))], ["at"])

    set_ = frequent.select("lang", "phrase").mapInArrow(run, "at long").groupBy(F.expr("at >> 6").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")
    ).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[set_["word"].to_numpy()] = set_["set"].to_numpy().view(np.uint64)
    return Bitmap(bits, words)


def _cells(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """The byte runs from ``start`` to ``end``, with a number for each distinct one."""
    lengths = end - start
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lengths)
    made = pa.Array.from_buffers(
        pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(W.LOWER[data[at]])]
    )
    return made.dictionary_encode()


def _changes(rows: np.ndarray) -> np.ndarray:
    """True for rows that differ from the one before."""
    return np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])


class _Counter:
    """Counts phrases of ``size`` words in the texts of a task."""

    def __init__(self, size: int, shorter: Bitmap | None, entries: int, numbers: int, hot: frozenset = frozenset()):
        self.size, self.shorter, self.numbers, self.hot = size, shorter, numbers, hot
        self.trie = HatTrie(size + 1, entries)
        self.names: list[str] = []
        self.number: dict[str, int] = {}

    def _number(self, names: list[str]) -> np.ndarray:
        own, found = self.number, np.empty(len(names), np.int32)
        for i, name in enumerate(names):
            n = own.get(name)
            if n is None:
                n = own[name] = len(self.names)
                self.names.append(name)
            found[i] = n
        return found

    def read(self, lang: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        found = W.Words(data, offsets, _APART)
        n, size = len(found.hash), self.size
        if n < size:
            return
        langs = lang.dictionary_encode()
        names = langs.dictionary.to_pylist()
        code = langs.indices.to_numpy()[found.text]
        seeds = np.array([_lang_hash(x) for x in names], np.uint64)[code]
        # pieces of texts that phrases do not reach over
        piece = np.cumsum(_BREAKS[data])[found.start]
        joined = np.zeros(n, bool)
        joined[:-1] = (piece[1:] == piece[:-1]) & (found.text[1:] == found.text[:-1])
        fits = np.ones(n, bool)  # size - 1 words from here on in one piece
        for k in range(size - 2):
            fits[: n - k] &= joined[k:]
            fits[n - k :] = False
        if self.shorter is not None:
            fits &= self.shorter.test(_grams(found.hash, seeds, size - 1))
        if size > 1:
            fits[:-1] &= fits[1:] & joined[:-1]
            fits[-1] = False
        at = np.flatnonzero(fits)
        if not len(at):
            return
        needed = np.zeros(n, bool)
        for k in range(size):
            needed[at + k] = True
        own = np.flatnonzero(needed)
        cells = _cells(data, found.start[own], found.end[own])
        ids = np.zeros(n, np.int32)
        ids[own] = self._number(cells.dictionary.to_pylist())[cells.indices.to_numpy()]
        rows = np.stack([self._number(names)[code[at]], *(ids[at + k] for k in range(size))], axis=1)
        self.trie.add(*summed(rows, np.ones(len(rows), np.int64)))

    def _parts(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which part of its first word's phrases a phrase is in; 0 unless that is hot."""
        part = np.zeros(len(rows), np.int64)
        if not self.hot or self.size < 2:
            return part
        begin = np.flatnonzero(_changes(rows[:, :2]))
        names = self.names
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True):
            if (names[rows[a, 0]], names[rows[a, 1]]) in self.hot:
                made = np.zeros(b - a, np.uint64)
                for column in rows[a:b, 2:].T:
                    made = made * _STEP + hashes[column]
                part[a:b] = W.mix(made, 9) % np.uint64(PARTS)
        return part

    def spill(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Runs of the subtrees that have to go: half of a full trie, or all."""
        renumber = len(self.names) > self.numbers
        if not (last or renumber or self.trie.full()):
            return
        names = pa.array(self.names, pa.large_string())
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        hashes = np.fromiter((zlib.crc32(n.encode()) for n in self.names), np.uint64, len(self.names))
        for rows, counts in self.trie.spill(0 if last or renumber else self.trie.limit // 2):
            order = np.lexsort(place[rows].T[::-1])
            rows, counts = rows[order], counts[order]
            part = self._parts(rows, hashes)
            if part.any():  # within a first word by part
                order = np.lexsort((part, np.cumsum(_changes(rows[:, :2]))))
                rows, counts, part = rows[order], counts[order], part[order]
            first = np.flatnonzero(_changes(np.column_stack([rows[:, :2], part])))
            cuts = pa.array(np.append(first, len(rows)).astype(np.int32))
            words = [names.take(pa.array(c)).cast(pa.string()) for c in rows[:, 2:].T]
            rest = pc.binary_join_element_wise(*words, " ") if words else pa.repeat(pa.scalar(""), len(rows))
            lines = [pc.binary_join(pa.ListArray.from_arrays(cuts, x), "\n") for x in (rest, pa.array(counts).cast(pa.string()))]
            own = [names.take(pa.array(rows[first, k])).cast(pa.string()) for k in (0, 1)]
            run = pa.table([*own, pa.array(part[first].astype(np.int32)), *lines], ["lang", "first", "part", "rests", "ns"])
            yield from run.combine_chunks().to_batches(RUN_ROWS)
        if renumber:
            self.names, self.number = [], {}


def _runs(docs: DataFrame, size: int, shorter: Bitmap | None, entries: int, numbers: int, hot: frozenset) -> DataFrame:
    """``lang, first, part, rests, ns``: phrases of ``size`` words by prefix, what follows
    it and the counts a line each, summed within runs."""
    sent = docs.sparkSession.sparkContext.broadcast((shorter, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(size, sent.value[0], entries, numbers, sent.value[1])
        for batch in batches:
            for row, end, data, offsets in W.chunks(batch.column(1)):
                counter.read(batch.column(0)[row:end], data, offsets)
                yield from counter.spill()
        yield from counter.spill(last=True)

    return docs.mapInArrow(run, "lang string, first string, part int, rests string, ns string")


def count_phrases(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    entries: int = ENTRIES,
    numbers: int = NUMBERS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases with ``f >= least``, and ``lang, n``,
    the number of all words."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), empty_text(text_col).alias("text"))
    frequent, totals, shorter, hot = [], None, None, frozenset()
    for size in range(1, longest + 1):
        runs = _runs(rows, size, shorter, entries, numbers, hot).repartition("lang", "first", "part")
        pair = F.explode(F.arrays_zip(F.split("rests", "\n").alias("rest"), F.split("ns", "\n").alias("n"))).alias("x")
        merged = runs.select("lang", "first", "part", pair).groupBy("lang", "first", "part", F.col("x.rest").alias("rest"))
        phrase = F.when(F.col("rest") == "", F.col("first")).otherwise(F.concat_ws(" ", "first", "rest"))
        merged = merged.agg(F.sum(F.col("x.n").cast("long")).alias("f")).select("lang", phrase.alias("phrase"), "f")
        if size == 1:
            merged = stage(merged, "words")
            totals = merged.groupBy("lang").agg(F.sum("f").alias("n"))
        found = merged.filter(F.col("f") >= least).withColumn("size", F.lit(size))
        found = stage(found, f"phrases-{size}")
        if size == 1:
            # at most HOT words of each language, and of all of them those that matter
            often = found.join(totals, "lang").filter(F.col("f") * HOT >= F.col("n"))
            most = totals.agg(F.sum("n")).first()[0] or 0
            hot = frozenset((r["lang"], r["phrase"]) for r in often.filter(F.col("f") * HOT * 10 >= most).collect())
        frequent.append(found)
        shorter = _bitmap(found, size)
        if shorter is None:
            break
    counted = frequent[0]
    for more in frequent[1:]:
        counted = counted.unionByName(more)
    return counted, totals


def cut_score(a: str, l: str, r: str, n: str) -> Column:
    """1000 a n / (l r), rounded down, by decimals of 38 digits; beyond these it raises."""
    wide = {c: f"cast({c} as decimal(19, 0))" for c in (a, l, r, n)}
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {wide[a]} * {wide[n]}) div ({wide[l]} * {wide[r]})")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    entries: int = ENTRIES,
    numbers: int = NUMBERS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    ``a`` is the number of occurrences, ``l`` and ``r`` those of the two parts of
    the cut with the lowest score, ``n`` all words; the score is 1000 a n / (l r),
    rounded down, in decimals of 38 digits. Phrases that stand in a longer one
    as often as anywhere are left out.

    Null texts count as empty, a null language as ``und``; empty texts and tables
    give nothing. A very long text is read in one go. Repeated rows count each
    time. Ties go by occurrences, then by the phrase's bytes. Other columns are not read.
    """
    counted, totals = count_phrases(docs, lang_col, text_col, longest, least, entries, numbers)
    phrases = counted.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", F.col("f").alias("a"), "k",
        F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("tail"),
    )
    head = counted.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = counted.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    parts = cut.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).join(totals, "lang")
    parts = parts.withColumn("score", cut_score("a", "l", "r", "n"))
    scored = parts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"), F.max("a").alias("a"), F.max("n").alias("n")
    )
    # what holds a phrase as often holds it through phrases of one more word each
    inside = phrases.filter("size > 2").select(
        "lang", "f",
        F.explode(F.array(
            F.array_join(F.slice("words", 1, F.col("size") - 1), " "), F.array_join(F.slice("words", 2, F.col("size")), " ")
        )).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = kept.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    some = some.filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
