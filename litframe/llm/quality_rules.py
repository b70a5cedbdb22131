"""Quality rules: fixed limits, then boosted trees over document statistics.

Statistics are counted with numpy over many texts at once, from whole texts.
Words, lines and windows of words are told apart by their bytes (Arrow's
dictionary encoding), not by hashes. The trees (`boosting`) are fitted on a
bounded sample of labelled rows and fall with the shares of symbols, repeated
lines and repeated words, whatever the sample says: a text never gains by more
of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litframe.llm import boosting
from litframe.llm import words as W
from litframe.llm.boosting import Forest
from litframe.llm.frames import empty_text, ship
from litframe.llm.importance import FIT_ROWS, fit_sample

#: Fewer words fail, as does a greater share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words of a window.
WINDOW = 3
#: Score from which a text stays.
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and the direction the score may take with each.
FEATURES = {
    "symbols per word": -1, "repeated lines": -1, "repeated words": -1, "log words": 0, "characters per word": 0,
    "capitals": 0, "digits": 0, "stops per word": 0, "exclamations per word": 0, "distinct words": 0,
    "words without letters": 0, "words per line": 0, "doubled words": 0, "words with a capital": 0,
}

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_CAPITAL = W.byte_table([(0x41, 0x5A)])
_DIGIT = W.byte_table([(0x30, 0x39)])
_LETTER = W.byte_table([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_LEADING = ~W.byte_table([(0x80, 0xBF)])


def _codes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each run of bytes, the same for equal runs only."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    runs = pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return runs.dictionary_encode().indices.to_numpy().astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, the same for equal pairs only."""
    if not len(a):
        return a
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _repeated(words: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """True for words in windows that stand twice or more in their text."""
    hit = np.zeros(len(words), bool)
    n = len(words) - window + 1
    if n < 2:
        return hit
    at = np.flatnonzero(text[:n] == text[window - 1 :])
    run = words[at]
    for k in range(1, window):
        run = _pairs(run, words[at + k])
    run = _pairs(text[at], run)
    if not len(run):
        return hit
    twice = at[np.bincount(run)[run] > 1]
    for k in range(window):
        hit[twice + k] = True
    return hit


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (``COUNTS``) and features (``FEATURES``) of each text, a row each."""
    rows, n = len(offsets) - 1, len(data)
    inside = ~W.SPACES[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    n_words = np.diff(bounds)
    text = np.repeat(np.arange(rows), n_words)
    word = _codes(data[inside], end - start)

    def per_text(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def words_per_text(mark: np.ndarray) -> np.ndarray:
        return np.bincount(text[mark], minlength=rows)

    # lines; a newline belongs to the line it ends
    newline = data == 0x0A
    opens = begins[:n].copy()
    opens[1:] |= newline[:-1]
    opened = np.flatnonzero(opens)
    worded = np.logical_or.reduceat(inside, opened) if n else np.zeros(0, bool)
    line = np.cumsum(opens) - 1
    taken = ~newline & worded[line] if n else newline
    lengths = np.bincount(line[taken], minlength=len(opened))[worded]
    line_text = (np.searchsorted(offsets, opened, side="right") - 1)[worded]
    same = _pairs(line_text, _codes(data[taken], lengths))
    seen = np.unique(same, return_index=True)[1]
    n_lines = np.bincount(line_text, minlength=rows)
    n_dup_lines = n_lines - np.bincount(line_text[seen], minlength=rows)

    word_chars = per_text(inside & _LEADING[data])
    n_symbols = per_text(_SYMBOLS[data])
    n_repeat = words_per_text(_repeated(word, text, WINDOW))
    distinct = np.unique(_pairs(text, word), return_index=True)[1]
    doubled = np.zeros(len(word), bool)
    doubled[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    capital = _CAPITAL[data]
    some, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack(
        [
            n_symbols / some, n_dup_lines / np.maximum(n_lines, 1), n_repeat / some, np.log1p(n_words),
            word_chars / some, per_text(capital) / chars, per_text(_DIGIT[data]) / chars,
            per_text(_STOPS[data]) / some, per_text(data == 0x21) / some,
            np.bincount(text[distinct], minlength=rows) / some,
            words_per_text(letters[end] == letters[start]) / some, n_words / np.maximum(n_lines, 1),
            words_per_text(doubled) / some, words_per_text(capital[start]) / some,
        ],
        axis=1,
    )
    return np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], axis=1), features


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
    rounds: int = 60,
    depth: int = 4,
) -> Forest:
    """Trees from at most about ``fit_rows`` labelled rows, drawn by hash of the id.

    Only the sample's features come to the driver, ``fit_rows`` short rows. Null
    ids and labels are left out. Without labels the score is one half
    everywhere, with labels of one kind a constant on that side.
    """
    ship(docs.sparkSession)
    sample = fit_sample(labels, id_col, label_col, fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("fit_id"), empty_text(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), "fit_id").select(F.col("good"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.chunks(batch.column(1)):
                found = statistics(data, offsets)[1]
                cuts = np.arange(end - row + 1, dtype=np.int32) * found.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], lists], ["good", "features"])

    known = rows.mapInArrow(run, "good int, features array<double>").toArrow()
    y = known.column("good").to_numpy()
    x = known.column("features").combine_chunks().flatten().to_numpy() if len(y) else np.zeros(0)
    return boosting.fit(x.reshape(-1, len(FEATURES)), y, tuple(FEATURES.values()), rounds, depth)


def apply_rules(
    docs: DataFrame,
    forest: Forest,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    least_words: int = LEAST_WORDS,
    most_repeated: int = MOST_REPEATED,
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed, kept, score`` of every row.

    Null and empty texts have no words and fail. A very long text is one chunk
    of its own and takes some 100 bytes of memory for each of its own. Equal texts
    get equal results, repeated rows repeated ones, null ids stay null; an empty
    table gives none. Other columns are not read.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.chunks(batch.column(1)):
                counts, features = statistics(data, offsets)
                score = sent.value.score(features)
                words, repeated = counts[:, 0], counts[:, 4]
                failed = (words < least_words) | (100 * repeated > most_repeated * words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row:end], *(pa.array(c) for c in counts.T.astype(np.int64)),
                        pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score),
                    ],
                    ["doc_id", *COUNTS, "base_failed", "kept", "score"],
                )

    longs = ", ".join(f"{c} long" for c in COUNTS)
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, {longs}, base_failed boolean, kept boolean, score double")
