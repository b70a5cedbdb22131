"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits, low ones first. Level 0 holds the first
chunk of every token, level 1 the second chunk of those that have one, and so
on. A bitmap per level says which tokens go on, and a rank directory (ones before
every 512th bit) says where in the next level: any token is read by as many
steps as it has chunks, without decoding its neighbours.

A file is a Parquet file whose rows are segments: the codes of a run of whole
documents in ascending id order, with their ids and lengths. Files and segments
are numbered in that order.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litframe.llm.frames import empty_text, ship
from litframe.llm.words import LOWER, chunks, text_buffers

CHUNK_BITS = 8
RANK_BITS = 512
#: Tokens after which a segment ends (with the document it is in).
SEGMENT_TOKENS = 1 << 20
#: Text bytes per file, about.
FILE_BYTES = 32 << 20
#: Text bytes that are encoded together.
BATCH_BYTES = 4 << 20
#: Words whose ids are remembered; beyond, the memory starts anew.
REMEMBERED = 1_000_000

SCHEMA = (
    "file int, segment int, doc_ids array<long>, lengths array<long>, tokens long, "
    "levels array<struct<chunks:binary,goes_on:binary,ranks:binary>>"
)
_LEVEL = pa.struct([("chunks", pa.binary()), ("goes_on", pa.binary()), ("ranks", pa.binary())])


def encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of codes; ids are unsigned and below 2^32."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        rest = left >> np.uint32(CHUNK_BITS)
        on = rest > 0
        packed = np.packbits(on, bitorder="little")
        blocks = np.zeros(-(-len(on) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        blocks[: len(packed)] = packed
        ones = np.bitwise_count(blocks).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64)
        levels.append({
            "chunks": (left & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(),
            "goes_on": blocks.tobytes(),
            "ranks": (np.cumsum(ones) - ones).astype(np.uint32).tobytes(),
        })
        if not on.any():
            return levels
        left = rest[on]


class TokenCodes:
    """Random access to the tokens of a segment."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [
            (
                np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["goes_on"], np.uint64),
                np.frombuffer(x["ranks"], np.uint32),
            )
            for x in levels
        ]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, at: np.ndarray) -> np.ndarray:
        """Ids of the tokens at the given places, in any order."""
        at = np.asarray(at, np.int64)
        ids, of, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for chunks, bits, ranks in self.levels:
            ids[of] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            on = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            at, of = at[on], of[on]
            if not len(at):
                break
            at = self._rank(bits, ranks, at)
            shift += CHUNK_BITS
        return ids

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids of the tokens from ``start`` up to ``stop``, in order.

        Those of a run that go on stand side by side in the next level too, so the
        rank of its ends is enough and no token is looked up by itself.
        """
        ids, of, shift = np.zeros(stop - start, np.uint32), None, 0
        for chunks, bits, ranks in self.levels:
            part = chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if of is None:
                ids[:] = part
            else:
                ids[of] |= part
            if start == stop:
                break
            on = np.unpackbits(bits.view(np.uint8)[start // 8 : -(-stop // 8)], bitorder="little")
            on = np.flatnonzero(on[start % 8 : start % 8 + stop - start])
            if not len(on):
                break
            of = on if of is None else of[on]
            first = int(self._rank(bits, ranks, np.array([start], np.int64))[0])
            start, stop = first, first + len(on)
            shift += CHUNK_BITS
        return ids

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory, then the words of its block.

        For very many places the words' own ranks are summed up once instead.
        """
        word, block = at >> 6, at // RANK_BITS
        if len(at) > len(bits):
            ones = np.bitwise_count(bits)
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            before = np.cumsum(ones, dtype=np.int64) - ones
            return before[word] + np.bitwise_count(bits[word] & mask)
        found = ranks[block].astype(np.int64)
        first = block * (RANK_BITS // 64)
        for k in range(RANK_BITS // 64 - 1):
            inside = first + k < word
            found += np.where(inside, np.bitwise_count(bits[np.minimum(first + k, len(bits) - 1)]), 0)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return found + np.bitwise_count(bits[word] & mask)


#: Normalizer and pre-tokenizer for which parting at blanks, line ends
#: and final marks was checked. Texts for any other tokenizer are encoded whole.
CHECKED = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {
            "type": "Split", "behavior": "Removed", "invert": True,
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: Letters of scripts beyond this one are not parted from a mark.
LAST_PARTED = "\u052f"


def _plain(word: str) -> str:
    return word.lower() if word.isascii() else word


@lru_cache(1 << 12)
def _is_letter(char: str) -> bool:
    """Whether a character is, composed and in lower case, one that ends in a letter.

    Some letters end in a combining mark then, which stays in one piece with a
    full stop after it.
    """
    if not "A" <= char <= LAST_PARTED:
        return False
    return category(normalize("NFC", char).lower()[-1])[0] == "L"


def _parted(word: str) -> bool:
    """Whether the word ends in a letter and then a mark, which is a piece of its own."""
    return word[-1:] in (".", ",") and _is_letter(word[-2:-1])


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of texts that are tokens of their own, and each text's first.

    Parts end at blanks and line ends, and between ASCII characters of which one is a
    letter and the other not, or of which one is a digit. Apostrophes and control
    characters part nothing, as they may belong to either side. Parts of ASCII
    characters alone are in lower case.
    """
    n, kind = len(data), _KIND[data]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    inside = kind > 0
    before = np.concatenate([[0], kind[:-1]]) if n else kind
    parts = (before < _OTHER) & (kind < _OTHER) & ((kind != before) | (kind == _DIGIT))
    starts = inside & (text_start[:n] | (before == 0) | parts)
    start = np.flatnonzero(starts)
    kept = data[inside]
    # the first byte that is kept starts a part
    begin = np.flatnonzero(starts[inside])
    ends = np.append(begin, len(kept))
    sizes = np.diff(ends)
    foreign = np.maximum.reduceat(kept, begin) >= 0x80 if len(begin) else np.zeros(0, bool)
    lower = LOWER[kept]
    kept = np.where(np.repeat(foreign, sizes), kept, lower) if foreign.any() else lower
    cells = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
    return cells, np.searchsorted(start, offsets)


#: Kinds of bytes: white space that parts, letters, digits, other signs, and what parts nothing.
_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.int8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x27] = _OTHER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[0x20, 0x0A]] = 0


class WordEncoder:
    """Ids of texts by a lower-casing tokenizer that never joins what a blank or
    line end parts, nor a letter and a sign or digit.

    Words are told apart by Arrow, and ids of the distinct ones are remembered;
    no Python object is made per word. Texts with a special token's string are
    handed over whole, as such a string may hold anything; so are all texts if
    the tokenizer is not of the kind that was checked.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        self.by_words = all(described[k] == v for k, v in CHECKED.items())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # words seen lately, and those seen before: what recurs moves up
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this process; its memory serves later tasks too."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ids(self, text: str) -> np.ndarray:
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pa.array(np.full(len(texts), not self.by_words))
        for mark in self.special:
            marked = pc.or_(marked, pc.match_substring(texts, mark))
        marked = marked.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(marked), "", texts) if marked.any() else texts
        cells, first = pieces(*text_buffers(plain))
        coded = cells.dictionary_encode()
        own = self._found(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        pool, begins = np.frombuffer(b"".join(own), np.uint32), np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        counts = sizes[code]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(begins[code] - ends[:-1], counts) + np.arange(ends[-1])]
        cuts = ends[first]
        return [
            np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if marked[i]
            else ids[cuts[i] : cuts[i + 1]]
            for i in range(len(texts))
        ]

    def _found(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > REMEMBERED // 2:
            self.before, self.known = self.known, {}
        self._know([w for w in words if w not in self.known])
        return [self.known[w] for w in words]

    def _know(self, words: list[str]) -> None:
        """Take words over from before, or from their parts, or learn them."""
        known, before, joined, new = self.known, self.before, [], set()
        for word in words:
            if word in before:
                known[word] = before[word]
            elif _parted(word):
                joined.append(word)
                new.update(p for p in (_plain(word[:-1]), word[-1]) if p not in known)
            elif word != (plain := _plain(word)):
                joined.append(word)
                new.add(plain)
            else:
                new.add(word)
        self._learn([w for w in new if w not in known and w not in before])
        known.update((w, before[w]) for w in new if w not in known)
        for word in joined:
            if _parted(word):
                known[word] = known[_plain(word[:-1])] + known[word[-1]]
            else:
                known[word] = known[_plain(word)]

    def _learn(self, words: list[str]) -> None:
        """Encode words at once, parted by a special token, which no word holds."""
        if not self.special:
            for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
                self.known[word] = np.array(found.ids, np.uint32).tobytes()
            return
        mark = self.special[0]
        end = self.tokenizer.token_to_id(mark)
        for start in range(0, len(words), 5000):
            part = words[start : start + 5000]
            found = self.tokenizer.encode_batch_fast([mark.join(part) + mark], add_special_tokens=False)[0]
            ids = np.array(found.ids, np.uint32)
            raw, stops = ids.tobytes(), (4 * np.flatnonzero(ids == end)).tolist()
            for word, at, stop in zip(part, [0, *(s + 4 for s in stops)], stops):
                self.known[word] = raw[at:stop]


def write_codes(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
    segment_tokens: int = SEGMENT_TOKENS,
    encoder: Callable[[str], object] | None = None,
) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, by ascending id.

    Null texts count as empty and give the end id alone; null ids come first.
    Rows of equal id stand side by side, by text. An empty table gives a file
    without segments. ``encoder`` makes an object with ``many(texts)``, which gives an
    array of ids for each string of an Arrow array, from the tokenizer's path.
    """
    ship(docs.sparkSession)
    make = encoder or WordEncoder.of
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, segment = TaskContext.get().partitionId(), 0
        own = make(tokenizer_path)
        end = np.array([end_id], np.uint32)
        ids, parts, lengths, tokens = [], [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file], pa.int32()), pa.array([segment], pa.int32()),
                    pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([tokens], pa.int64()),
                    pa.array([encode(np.concatenate(parts))], pa.list_(_LEVEL)),
                ],
                ["file", "segment", "doc_ids", "lengths", "tokens", "levels"],
            )

        for batch in batches:
            for row, last, _, _ in chunks(batch.column(1), BATCH_BYTES):
                found_all = own.many(batch.column(1)[row:last])
                for doc_id, found in zip(batch.column(0)[row:last].to_pylist(), found_all, strict=True):
                    ids.append(doc_id)
                    parts += [found, end]
                    lengths.append(len(found) + 1)
                    tokens += len(found) + 1
                    if tokens >= segment_tokens:
                        yield done()
                        ids, parts, lengths, tokens, segment = [], [], [], 0, segment + 1
        if ids:
            yield done()

    ordered = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def documents(codes: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read from the files' codes.

    ``start`` is the number of ids of all documents before. The checksum is
    that of the ids as little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = TokenCodes(row["levels"])
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                raw = memoryview(codes.span(0, len(codes)).astype("<u4", copy=False).tobytes())
                sums = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    ["file", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    ship(codes.sparkSession)
    # sums over files, then over the segments of each: one row per file in the first
    per_file = codes.groupBy("file").agg(F.sum("tokens").alias("all"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = per_file.select(F.col("file").alias("f"), F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = codes.select("file", "segment", "tokens").withColumn(
        "before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    ).join(files, F.col("file") == F.col("f")).select(
        F.col("file").alias("f"), F.col("segment").alias("s"), (F.col("file_start") + F.col("before")).alias("base")
    )
    read = codes.mapInArrow(run, "file int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return read.join(segments, (F.col("file") == F.col("f")) & (F.col("segment") == F.col("s"))).select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens_at(codes: DataFrame, places: DataFrame) -> DataFrame:
    """``file, segment, at, id`` for rows of ``file, segment, at``: random access.

    Only the segments that are asked for are joined; each place costs a step
    per chunk of its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["places"], np.int64)
                found = TokenCodes(row["levels"]).get(at)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(at), pa.array(found.astype(np.int64))],
                    ["file", "segment", "at", "id"],
                )

    ship(codes.sparkSession)
    wanted = places.groupBy("file", "segment").agg(F.collect_set("at").alias("places"))
    return codes.join(wanted, ["file", "segment"]).select("file", "segment", "levels", "places").mapInArrow(
        run, "file int, segment int, at long, id long"
    )
