"""Documents whose sets of word n-grams are alike, exactly.

Sets of size r <= s with Jaccard similarity t or more differ in at most
H(r) = r (1 - t) / t elements. Sizes are cut into bands; in a band the universe
of n-grams is hashed into m segments, a few more than H of the band's largest
size. By the pigeonhole principle similar sets agree in one of their first
H(r) + 1 segments at least; so each set indexes a hash of what it has in each of
its first H + 1 segments, in its own band and, if a smaller partner may lie there,
in the band below.

Not every segment is worth its cost. One that is empty, or holds the same
few n-grams in very many sets, brings many false candidates. Such a value is not
indexed by itself: as the sets agree there for nothing, they have one more
difference to spare elsewhere, and must then differ by one n-gram at most in the
next segment (if no other segment agrees). So the value is indexed together with
the next segment's one-deletion neighbourhood. Which values are treated so is
decided by their cost: the comparisons that a value alone brings about, against
the entries that replace it.

Sets under one index entry form a star around the smallest of them. Sets are
compared with their stars' centres first; linked ones are joined into components.
Only stars that then hold several components are compared throughout, in blocks
of bounded size, where blocks of the same component are left out. Before whole
sets travel, parity bits of each are compared, 2048 or, of larger sets, two for each
n-gram at least: an element that only one of two sets has flips one bit at most, so
sets with more differing bits than they may have differences are not similar. All
other comparisons are of whole sets, made from the texts of those that are left.
Texts that no join asks for do not travel: a filter of the wanted keys' hashes,
one bit each, goes to all tasks first.
N-grams are 64-bit hashes, and equal sets are recognised by a 64-bit hash of theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe.llm import words as W
from litframe.llm.components import components, joined
from litframe.llm.frames import empty_text, packed, release, ship, stage
from litframe.sources.scratch import remove, scratch_dir

#: Largest by smallest size of a band.
BAND = 1.5
#: Comparisons that one index entry's value may bring about by itself, per set
#: under it, before its one-deletion form is cheaper: it takes some 10 entries a
#: set, and an entry costs as much as some 10 comparisons.
SPARE = 100
#: Sets of a star that are compared at once, and n-grams of these.
BLOCK_SETS = 512
BLOCK_GRAMS = 1 << 20
#: Parity bits of a set that has at most half as many n-grams; a power of two.
PARITY = 2048
#: Bits of the filter of keys for each key, and at most: beyond, more rows travel in vain.
FILTER_BITS = 16
MOST_FILTER_BITS = 1 << 26
#: Bits of one of Spark's bitmaps, as a power of two.
BITMAP = 15

U64 = np.uint64


class Bands:
    """Size bands and numbers of segments for a threshold in percent."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 99:
            raise ValueError(f"percent: {percent}")
        self.percent = percent
        low = -(-percent // (100 - percent))  # smaller sets link with equal ones only
        lows = [low]
        while lows[-1] < 1 << 40:
            lows.append(int(lows[-1] * BAND) + 1)
        self.low = np.array(lows, np.int64)
        self.high = self.low[1:] - 1
        self.segments = self.spare(self.high) + 2

    def spare(self, size: np.ndarray) -> np.ndarray:
        """Differences that a set of this size and a larger similar one may have."""
        return size * (100 - self.percent) // self.percent

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def entries(grams: np.ndarray, begins: np.ndarray, bands: Bands, costly: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of sets: value, set, and whether it is a one-deletion form.

    ``costly`` holds, per set, the sorted values that are not to be used alone.
    """
    size = np.diff(begins)
    own = bands.of(size)
    made, owners, forms = [], [], []
    down = 0
    while True:
        band = own - down
        ok = (band >= 0) & (size > 0)
        if down:
            ok &= 100 * bands.high[np.maximum(band, 0)] >= bands.percent * size
        if not ok.any():
            break
        down += 1
        band = np.where(ok, band, 0)
        width = np.where(ok, bands.spare(np.minimum(size, bands.high[band])) + 2, 0)
        base = np.concatenate([[0], np.cumsum(width)])
        of = np.repeat(np.arange(len(size)), np.where(ok, size, 0))
        gram = grams[np.repeat(ok, size)]
        segment = (W.mix(gram, 5) % bands.segments[band][of].astype(U64)).astype(np.int64)
        near = segment < width[of]
        gram, of, segment = gram[near], of[near], segment[near]
        slot = base[of] + segment
        value = W.mix(gram, 6)
        total = W.sum_by(slot, value, base[-1])
        count = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(size)), width)
        index = np.arange(base[-1]) - base[owner]
        salt = W.mix((band[owner].astype(U64) << U64(40)) + index.astype(U64), 7)
        whole = W.mix(total + salt, 8)
        main = index < width[owner] - 1
        skipped = main & (count == 0)
        if costly is not None:
            for i in np.unique(owner[main]):
                if len(costly[i]):
                    mine = slice(base[i], base[i + 1])
                    skipped[mine] |= main[mine] & np.isin(whole[mine], costly[i])
        made.append(whole[main & ~skipped])
        owners.append(owner[main & ~skipped])
        forms.append(np.zeros(len(made[-1]), bool))
        at = np.flatnonzero(skipped)
        made.append(W.mix(whole[at] * U64(0x9E3779B97F4A7C15) + whole[at + 1], 9))
        owners.append(owner[at])
        after = (segment > 0) & skipped[np.maximum(slot - 1, 0)]
        fewer = W.mix(total[slot[after]] - value[after] + salt[slot[after]], 8)
        made.append(W.mix(whole[slot[after] - 1] * U64(0x9E3779B97F4A7C15) + fewer, 9))
        owners.append(of[after])
        forms.append(np.ones(len(at) + len(made[-1]), bool))
    if not made:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(made), np.concatenate(owners), np.concatenate(forms)


def set_hash(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    size = np.diff(begins)
    of = np.repeat(np.arange(len(size)), size)
    return W.mix(W.sum_by(of, W.mix(grams, 10), len(size)) + size.astype(U64), 11).view(np.int64)


def _lists(values: np.ndarray, owners: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values[order]))


def _indexed(batches: Iterator[pa.RecordBatch], bands: Bands, n: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents with the entries of their sets.

    Of sets of a run of rows that share an entry only the smallest goes on with
    it (``entries``); the others name it (``near``, ``centre``), which keeps an
    entry that very many sets share from being sent by each.
    """
    for batch in batches:
        for row, end, data, offsets in W.chunks(batch.column(1)):
            grams, begins = W.Words(data, offsets, W.SPACES).shingles(n)
            grams, begins = W.distinct(grams, begins)
            own = set_hash(grams, begins)
            size = np.diff(begins)
            value, of, _ = entries(grams, begins, bands)
            value, key = value.view(np.int64), own[of]
            order = np.lexsort((key, value))
            value, key, of = value[order], key[order], of[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
            value, key, of = value[new], key[new], of[new]
            first = np.ones(len(value), bool)
            first[1:] = value[1:] != value[:-1]
            centre = key[np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))]
            rows = end - row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[row:end], batch.column(2)[row:end], pa.array(size), pa.array(own),
                    _lists(value[first], of[first], rows), _lists(value[~first], of[~first], rows),
                    _lists(centre[~first], of[~first], rows),
                ],
                ["doc_id", "mark", "size", "cls", "entries", "near", "centre"],
            )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``value, cls, centre`` of values with several sets, from sorted rows."""
    last = None  # value, centre, latest set, whether the first row is out
    for batch in batches:
        if not batch.num_rows:
            continue
        value, key = (batch.column(i).to_numpy() for i in range(2))
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
        if last and value[0] == last[0] and key[0] == last[2]:
            fresh[0] = False
        value, key = value[fresh], key[fresh]
        if not len(value):
            continue
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        joined = last is not None and value[0] == last[0]
        if joined:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(value)), -1))
        centre = np.where(at >= 0, key[np.maximum(at, 0)], last[1] if joined else 0)
        several = ~new
        several[:-1] |= ~new[1:]
        out = [value[several], key[several], centre[several]]
        if joined and not last[3]:
            out = [np.concatenate([[a], b]) for a, b in zip((last[0], last[1], last[1]), out)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["value", "cls", "centre"])
        last = (value[-1], centre[-1], key[-1], bool(several[-1]))


def _gather(rows: DataFrame) -> DataFrame:
    """Stars of rows of ``value, cls``: one shuffle, streamed in order."""
    sorted_ = rows.repartition(F.col("value")).sortWithinPartitions("value", "cls")
    return sorted_.mapInArrow(_stars, "value long, cls long, centre long")


def _wanted_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], pa.RecordBatch]]:
    """Of rows of ``cls, text, ...`` runs of those whose set is the class's: classes, sets, rows."""
    for batch in batches:
        for row, end, data, offsets in W.chunks(batch.column(1)):
            grams, begins = W.Words(data, offsets, W.SPACES).shingles(n)
            grams, begins = W.distinct(grams, begins)
            own = set_hash(grams, begins)
            at = np.flatnonzero(own == batch.column(0)[row:end].to_numpy())
            yield own[at], [grams[begins[i] : begins[i + 1]] for i in at], batch.slice(row, end - row).take(pa.array(at))


def _described(batches: Iterator[pa.RecordBatch], bands: Bands, n: int) -> Iterator[pa.RecordBatch]:
    """Sizes and parity bits of sets, and one-deletion entries in place of their costly values."""
    for own, sets, rows in _wanted_sets(batches, n):
        size = np.array([len(x) for x in sets], np.int64)
        costly = [np.sort(np.array(c or [], np.int64).view(U64)) for c in rows.column(2).to_pylist()]
        have = np.array([i for i, c in enumerate(costly) if len(c)], np.int64)
        value, of = np.zeros(0, U64), np.zeros(0, np.int64)
        if len(have):
            begins = np.concatenate([[0], np.cumsum(size[have])])
            value, of, form = entries(np.concatenate([sets[i] for i in have]), begins, bands, [costly[i] for i in have])
            value, of = value[form], have[of[form]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own), pa.array(size), pa.array([_parity(x) for x in sets], pa.binary()),
                _lists(value.view(np.int64), of, len(sets)),
            ],
            ["cls", "size", "parity", "deleted"],
        )


def _grams(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for own, sets, _ in _wanted_sets(batches, n):
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "grams"])


def _parity(grams: np.ndarray) -> bytes:
    size = max(PARITY, 1 << (2 * len(grams) - 1).bit_length())
    bits = (W.mix(grams, 12) & U64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=size) & 1).tobytes()


def _folded(bits: list[bytes], length: int) -> np.ndarray:
    """Parity bits of one length, as rows of 64-bit words, folded to a shorter length."""
    return np.bitwise_xor.reduce(np.frombuffer(b"".join(bits), U64).reshape(len(bits), -1, length // 8), axis=1)


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many parity bits differ, pair by pair."""
    lengths = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)])
    apart = np.zeros(len(a), np.int64)
    for pair in np.unique(lengths, axis=0):
        at = np.flatnonzero((lengths == pair).all(1))
        one, other = (_folded([x[i] for i in at], int(pair.min())) for x in (a, b))
        apart[at] = np.bitwise_count(one ^ other).sum(1, dtype=np.int64)
    return apart


def _may_link(apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many elements or more may be similar."""
    return np.maximum(apart, abs(a - b)) * (100 + percent) <= (a + b) * (100 - percent)


def _near_centre(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``cls, centre`` whose parity bits let them be similar."""
    for batch in batches:
        if not batch.num_rows:
            continue
        apart = _apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
        good = pa.array(_may_link(apart, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["cls", "centre"])


def _active(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of two blocks of a star that may link with another component's."""
    for (centre, i, j), rows in _units(batches, 3):
        side, cls, comp, size = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        bits = [r[4] for r in rows]
        length = np.array([len(x) for x in bits])
        found = np.zeros(len(rows), bool)
        right = side == 1 if i != j else np.ones(len(rows), bool)
        for a, b in ((a, b) for a in np.unique(length) for b in np.unique(length)):
            left, others = np.flatnonzero((side == 0) & (length == a)), np.flatnonzero(right & (length == b))
            if not len(left) or not len(others):
                continue
            mine, theirs = (_folded([bits[k] for k in x], int(min(a, b))) for x in (left, others))
            for own, k in zip(mine, left):
                apart = np.bitwise_count(theirs ^ own).sum(1, dtype=np.int64)
                good = _may_link(apart, size[others], size[k], percent) & (comp[others] != comp[k])
                if good.any():
                    found[k] = True
                    found[others[good]] = True
        at = np.flatnonzero(found)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([centre] * len(at), pa.int64()), pa.array(cls[at])], ["centre", "cls"])


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Rows of each unit, from rows sorted by their first ``keys`` columns."""
    current, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[:keys] != current:
                if rows:
                    yield current, rows
                current, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield current, rows


def _similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def _with_centre(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of sets with the centre of their star; units hold it and a block."""
    for _, rows in _units(batches, 2):
        sets = {cls: grams for side, cls, grams in rows if side == 1}
        centre = [(cls, grams) for side, cls, grams in rows if side == 0]
        if not centre or not sets:
            continue
        middle = np.frombuffer(centre[0][1], U64)
        keys = list(sets)
        parts = [np.frombuffer(sets[k], U64) for k in keys]
        size = np.array([len(p) for p in parts], np.int64)
        grams = np.concatenate(parts)
        at = np.minimum(np.searchsorted(middle, grams), len(middle) - 1)
        shared = np.add.reduceat(middle[at] == grams, np.cumsum(size) - size).astype(np.int64)
        good = np.flatnonzero(_similar(shared, size, len(middle), percent))
        if len(good):
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in good], pa.int64()), pa.array([centre[0][0]] * len(good), pa.int64())], ["a", "b"]
            )


def _throughout(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between sets of two blocks of a star (or within one)."""
    for (_, i, j), rows in _units(batches, 3):
        sets = {(side, cls): (comp, grams) for side, cls, comp, grams in rows}
        keys = sorted(sets)
        parts = [np.frombuffer(sets[k][1], U64) for k in keys]
        size = np.array([len(p) for p in parts], np.int64)
        of = np.repeat(np.arange(len(keys)), size)
        _, number, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        common = count[number] > 1
        where = np.cumsum(count > 1) - 1
        number, of = where[number[common]], of[common]
        side = np.array([k[0] for k in keys])
        comp = np.array([sets[k][0] for k in keys])
        cls = np.array([k[1] for k in keys])
        shared = np.zeros((len(keys), len(keys)), np.float32)
        step = max(1, (32 << 20) // (4 * len(keys)))
        top = int((count > 1).sum())
        for start in range(0, top, step):
            held = (number >= start) & (number < start + step)
            dense = np.zeros((len(keys), min(step, top - start)), np.float32)
            dense[of[held], number[held] - start] = 1
            shared += dense @ dense.T
        good = _similar(shared.astype(np.int64), size[:, None], size[None, :], percent)
        good &= comp[:, None] != comp[None, :]
        good &= (side[:, None] < side[None, :]) if i != j else np.triu(np.ones_like(good), 1)
        joined = _joining(*np.nonzero(good), comp)
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(cls[list(x)]) for x in zip(*joined)], ["a", "b"])


def _joining(a: np.ndarray, b: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Of the links only those that join components which others have not."""
    root = {c: c for c in comp.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    made = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x != y:
            root[x] = y
            made.append((i, j))
    return made


def similar_groups(
    docs: DataFrame,
    n: int = 3,
    percent: int = 90,
    id_col: str = "doc_id",
    text_col: str = "text",
    spare: int = SPARE,
    block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    ASCII letters are lower-cased; words are parted by ASCII white space. A text
    of fewer than ``n`` words has all its words as one n-gram; null texts and
    texts without words have an empty set, which links with nothing, and are
    their own component. Two documents link if their sets' Jaccard similarity is
    ``percent`` / 100 or more; ``component_id`` is the smallest id that links lead
    to. Rows of equal text always link, whatever their ids; null ids take part
    and are never the smallest of several. An empty table gives no rows.
    Ids must be whole numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    bands = Bands(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    path = scratch_dir(spark, "sets")
    schema = "doc_id long, mark long, size long, cls long, entries array<long>, near array<long>, centre array<long>"
    rows.mapInArrow(lambda b: _indexed(b, bands, n), schema).write.parquet(path)
    indexed = spark.read.schema(schema).parquet(path)
    stars = _all_stars(indexed)
    some = F.size("entries") + F.size("near") > 0
    kept = stage(indexed.select("doc_id", "mark", "size", "cls", some.alias("indexed")), "classes")
    del indexed
    remove(spark, path)  # stars and classes hold all that is still needed
    release(spark)
    named = stage(_named(kept, stars), "named")
    shared = stage(stars.groupBy("cls", "centre").agg(F.count(F.lit(1)).alias("values")), "shared")
    costly = _costly(stars, shared, spare)
    wanted = named.join(costly.groupBy("cls").agg(F.collect_set("value").alias("costly")), "cls", "left")
    path = scratch_dir(spark, "texts")
    _texts(rows, named, wanted, "costly").write.parquet(path)
    texts = spark.read.schema("cls long, text string, costly array<long>").parquet(path)
    release(spark)
    sets = stage(
        texts.mapInArrow(lambda b: _described(b, bands, n), "cls long, size long, parity binary, deleted array<long>"),
        "members",
    )
    pairs = stage(_pairs(shared, costly, sets), "stars")
    release(spark)

    def grams(of: DataFrame) -> DataFrame:
        """``cls, grams`` of the classes that ``of`` holds."""
        some = stage(of.select("cls").distinct(), "some")
        found = _likely(texts.select("cls", "text"), some, "cls").join(some, "cls", "left_semi")
        return found.mapInArrow(lambda b: _grams(b, n), "cls long, grams binary")

    roots = _roots(pairs, sets, grams, percent, block_sets)
    remove(spark, path)  # links are staged
    found = kept.select("doc_id", "size", "cls").join(roots, F.col("cls") == F.col("node"), "left")
    found = found.withColumn("root", F.when(F.col("size") > 0, F.coalesce("root", "cls")))
    least = found.filter("size > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return found.join(least, "root", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def _all_stars(kept: DataFrame) -> DataFrame:
    """``value, cls, centre`` over all rows; sets that stayed near others get the
    centre of the whole star."""
    sent = kept.filter(F.size("entries") > 0).select(F.explode("entries").alias("value"), "cls")
    stars = stage(_gather(sent), "entries")
    near = kept.filter(F.size("near") > 0).select(
        F.explode(F.arrays_zip("near", "centre")).alias("x"), "cls"
    ).select(F.col("x.near").alias("value"), F.col("x.centre").alias("first"), "cls").distinct()
    wide = stars.select("value", "centre").distinct()
    late = near.join(wide, "value", "left").select("value", "cls", F.coalesce("centre", "first").alias("centre"))
    # a centre that was only named by sets near it has a row too
    alone = near.join(wide, "value", "left_anti").select("value", F.col("first").alias("cls"), F.col("first").alias("centre")).distinct()
    return stage(stars.unionByName(late).unionByName(alone), "entries-all")


def _named(kept: DataFrame, stars: DataFrame) -> DataFrame:
    """``cls`` of the sets in stars, and where the text of one document of each is found."""
    # null ids and ids that repeat find their own text by its hash
    first = kept.filter("indexed").select("cls", F.struct(*_place()).alias("key")).groupBy("cls").agg(F.min("key").alias("key"))
    return first.join(stars.select("cls").distinct(), "cls", "left_semi").select("key.*", "cls")


def _place() -> list[Column]:
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("mark")]


def _likely(rows: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """Rows that may have one of the (staged) keys: all that have one, and a few more.

    The others need not travel to a join. Each key sets one bit, by its hash.
    """
    bits = min(max(1 << BITMAP, 1 << (FILTER_BITS * keys.count()).bit_length()), MOST_FILTER_BITS)
    bit = F.pmod(F.xxhash64(*by), F.lit(bits))
    place = [F.shiftright(bit, BITMAP).alias("_map"), bit.bitwiseAND((1 << BITMAP) - 1).alias("_bit")]
    # dealt by map first: tasks would else make all the maps each
    maps = keys.select(*place).repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_set"))
    byte = F.conv(F.hex(F.substring("_set", (F.shiftright("_bit", 3) + 1).cast("int"), 1)), 16, 10).cast("int")
    found = rows.select("*", *place).join(F.broadcast(maps), "_map")
    return found.filter(F.getbit(byte, F.col("_bit").bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def _texts(rows: DataFrame, named: DataFrame, wanted: DataFrame, *more: str) -> DataFrame:
    """``cls, text`` of named sets, and further columns that ``wanted`` has of them."""
    texts = _likely(rows.select(*_place(), "text"), named, "id", "mark", "none").join(wanted, ["id", "mark", "none"])
    # repeated rows give their set once; grouped by the join's key, so nothing moves again
    return texts.groupBy("id", "mark", "none", "cls").agg(*(F.first(c).alias(c) for c in ("text", *more))).select("cls", "text", *more)


def _costly(stars: DataFrame, shared: DataFrame, spare: int) -> DataFrame:
    """Rows of ``stars`` whose entries' values are not to be used alone."""
    # comparisons among c sets that only this value brings together: c c / 2
    weighed = stars.join(shared, ["cls", "centre"]).groupBy("value").agg(F.sum(1 / F.col("values")).alias("w"))
    return stage(stars.join(weighed.filter(F.col("w") > 2 * spare).select("value"), "value", "left_semi"), "costly")


def _pairs(shared: DataFrame, costly: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct ``cls, centre``, with costly values in their one-deletion form.

    ``shared`` has the number of values of each pair; a pair whose values are all
    costly goes by these forms only.
    """
    gone = costly.groupBy("cls", "centre").agg(F.count(F.lit(1)).alias("gone"))
    rest = shared.filter("cls <> centre").join(gone, ["cls", "centre"], "left").filter("values > coalesce(gone, 0)").select("cls", "centre")
    more = sets.filter(F.size("deleted") > 0).select(F.explode("deleted").alias("value"), "cls")
    return rest.unionByName(_gather(more).filter("cls <> centre").select("cls", "centre")).distinct()


def _blocks(members: DataFrame, by: list[str], block_sets: int) -> DataFrame:
    """Members with a block number of about ``block_sets`` sets or fewer n-grams."""
    counts = members.groupBy(*by).agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("g"))
    blocks = F.greatest(F.ceil(F.col("c") / block_sets), F.ceil(F.col("g") / BLOCK_GRAMS))
    counts = counts.select(*by, blocks.alias("blocks"))
    return members.join(counts, by).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))


def _roots(
    pairs: DataFrame, sets: DataFrame, grams: Callable[[DataFrame], DataFrame], percent: int, block_sets: int
) -> DataFrame:
    middle = sets.select(F.col("cls").alias("centre"), F.col("size").alias("size_b"), F.col("parity").alias("parity_b"))
    near = stage(
        pairs.join(sets.select("cls", "size", "parity"), "cls").join(middle, "centre")
        .select("cls", "centre", "size", "size_b", "parity", "parity_b")
        .mapInArrow(lambda b: _near_centre(b, percent), "cls long, centre long"),
        "near-centre",
    )
    release(pairs.sparkSession)
    members = near.join(sets.select("cls", "size"), "cls")
    blocked = _blocks(members, ["centre"], block_sets).select("centre", "block", "cls")
    one = blocked.select("centre", "block", F.lit(1).alias("side"), "cls").unionByName(
        blocked.select("centre", "block", F.lit(0).alias("side"), F.col("centre").alias("cls")).distinct()
    )
    ends = near.select("cls").unionByName(near.select(F.col("centre").alias("cls")))
    units = one.join(grams(ends), "cls").select("centre", "block", "side", "cls", "grams")
    first = stage(
        units.repartition("centre", "block").sortWithinPartitions("centre", "block", "side", "cls")
        .mapInArrow(lambda b: _with_centre(b, percent), "a long, b long"),
        "first-links",
    )
    roots = components(first)
    del units, one
    release(pairs.sparkSession)

    # stars that still hold several components, centre included
    whole = pairs.unionByName(pairs.select(F.col("centre").alias("cls"), "centre").distinct())
    placed = whole.join(roots, F.col("cls") == F.col("node"), "left").select(
        "centre", "cls", F.coalesce("root", "cls").alias("comp")
    )
    mixed = placed.groupBy("centre").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c"))
    mixed = mixed.filter("low <> high and c > 2").select("centre")
    open_ = stage(placed.join(mixed, "centre", "left_semi").join(sets.select("cls", "size"), "cls"), "open")
    active = stage(
        _pairs_of_blocks(open_, sets.select("cls", "size", "parity"), ["size", "parity"], block_sets)
        .mapInArrow(lambda b: _active(b, percent), "centre long, cls long").distinct(),
        "active",
    )
    release(pairs.sparkSession)
    left = open_.join(active, ["centre", "cls"], "left_semi")
    second = stage(
        _pairs_of_blocks(left, grams(active), ["grams"], block_sets)
        .mapInArrow(lambda b: _throughout(b, percent), "a long, b long"),
        "second-links",
    )
    return roots if second.isEmpty() else joined(roots, second)


def _pairs_of_blocks(open_: DataFrame, data: DataFrame, columns: list[str], block_sets: int) -> DataFrame:
    """Units of two blocks of a star (or one): sorted rows of ``centre, hi, hj, side,
    cls, comp`` and the data's columns. Two blocks of one component are no unit."""
    # a component with many members in a star gets blocks of its own
    per = open_.groupBy("centre", "comp").agg(F.count(F.lit(1)).alias("n"))
    large = per.filter(F.col("n") >= block_sets // 4).select("centre", "comp", F.col("comp").alias("pure"))
    grouped = open_.join(large, ["centre", "comp"], "left").withColumn("pure", F.coalesce("pure", F.lit(0)))
    blocked = stage(
        _blocks(grouped, ["centre", "pure"], block_sets)
        .select("centre", F.struct("pure", "block").alias("block"), "pure", "cls", "comp"), "blocks"
    )
    known = blocked.select("centre", "block", "pure").distinct()
    left = known.select("centre", F.col("block").alias("i"), F.col("pure").alias("pi"))
    right = known.select("centre", F.col("block").alias("j"), F.col("pure").alias("pj"))
    both = left.join(right, "centre").filter("i <= j and not (pi = pj and pi <> 0)").select(
        "centre", F.xxhash64("i").alias("hi"), F.xxhash64("j").alias("hj"), "i", "j"
    )
    sides = both.select("centre", "hi", "hj", F.lit(0).alias("side"), F.col("i").alias("block")).unionByName(
        both.filter("i <> j").select("centre", "hi", "hj", F.lit(1).alias("side"), F.col("j").alias("block"))
    )
    units = sides.join(blocked, ["centre", "block"]).join(data, "cls").select(
        "centre", "hi", "hj", "side", "cls", "comp", *columns
    )
    return units.repartition("centre", "hi", "hj").sortWithinPartitions("centre", "hi", "hj", "side", "cls")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with the smallest id of their component, and rows with
    empty sets. Rows that share an id, or have none, stay together if one does."""
    groups = similar_groups(docs, n, percent, id_col, text_col)
    kept = groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept")).distinct()
    rows = packed(docs, id=F.col(id_col).cast("long"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept")), "left_semi").select("row.*")
