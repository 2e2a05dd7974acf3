"""Exact n-gram Jaccard join: which texts have word-shingle sets with similarity of at least t, and their groups.

Sets that are equal are one class from the start (a digest of the sorted shingles); all else works on
classes. The join never lists the pairs inside a group of near copies:

1. Sieve. Sets are blocked by size, and the shingles of a block's sets fall into parts by their place
   in digest space. Two linked sets differ in so few shingles that some part is the same in both, so
   sets whose parts are all their own go, which are most. What stays holds everything linked.
2. Index lists in blocks. The shingles of the sets that stay are counted in a sketch of fixed size, and
   each set is ordered from its rarest by it. Its first n - ceil(t n) + 1 shingles go into the index
   lists, in blocks by set size; a shingle's place in its set bounds the overlap that is still possible,
   so blocks and places that cannot reach t are skipped. Any one order of all shingles loses no link.
3. Anchors (answers from a similar set's answers). In each list every set is compared with one
   leader, the one with fewest shingles of its own. A linked set hangs on its leader, its distance known. Jaccard distance is a metric, so
   what lies far from a leader lies far from everything that hangs on it: two anchors' groups are
   looked into only if the anchors' distance is at most (1 - t) plus both radii, first member by
   anchor, then what is left member by member, and only where the groups are not connected yet.
   A member meets another anchor only if the shingles by which it differs from its own, of those that
   any anchor nearby differs by too, can bring it near enough.
4. Sketches. Every pair to be compared is first bounded by parities of the sets' shingles in a few
   bits a shingle; whole sets go to the pairs that are left.

No link is lost and none is made up: every link is confirmed on the full sets.

Defined results: null or empty text and white space have an empty set, linked with nothing; a text of
fewer words than a shingle is one shingle; copies are linked; rows with null doc_id are counted but
linked with nothing; rows that repeat a doc_id with another text are judged by their own text; an
empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import Words, mix, shingles, slices
from .common import free_name, stored, table
from .components import components
from .registry import query

FILTER_BITS = 27  # of the bitmap that says which documents' sets are wanted again: 16 MB
SLICE_TEXT = 1 << 20  # bytes of texts that are cut into shingles at a time
SLICE_KEYS = 1 << 18  # that are ordered at a time
SKETCH_CELLS, SKETCH_PARTS = 1 << 19, 64  # of shingle counts: 4 MB
BLOCK_RATIO = 1.5  # of the largest sizes of neighbouring blocks


@dataclass(frozen=True)
class Similarity:
    """Linked: 100 * intersection >= percent * union, over shingles of `words` words."""

    words: int = 3
    percent: int = 90

    def blocks(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each block of sizes: its largest size, by how much linked sets can differ, and the number of parts.

        A pair with a set of m shingles in the block and one of at most 100 m / percent differs in at
        most (100 - percent) m / percent. More parts than that leaves some the same in both; the rest
        are there for parts in which a set has nothing.
        """
        highs = [1]
        while highs[-1] < largest:
            highs.append(max(highs[-1] + 1, int(highs[-1] * BLOCK_RATIO)))
        high = np.array(highs, np.int64)
        differ = (100 - self.percent) * high // self.percent
        low = np.concatenate(([1], high[:-1] + 1))
        bare = (differ + 1) * np.exp(-low / (differ + 1))
        return high, differ, differ + 1 + np.ceil(bare + 4 * np.sqrt(bare)).astype(np.int64)

    def linked(self, shared: Column, a: Column, b: Column) -> Column:
        return 100 * shared >= self.percent * (a + b - shared)


def _edges(doc: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))


def _digests(value: np.ndarray, edges: np.ndarray) -> list[int]:
    at = edges.tolist()
    return [xxhash.xxh3_128_intdigest(value[a:b].tobytes()) for a, b in zip(at, at[1:])]


def _halves(digests: list[int]) -> list[pa.Array]:
    return [pa.array(np.array([d >> 64 for d in digests], np.uint64).view(np.int64)), pa.array(np.array([d & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64))]


def _heads(docs: DataFrame, how: Similarity) -> DataFrame:
    """One row a row: doc_id, n and the set's digest (d1, d2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_TEXT):
            doc, value = shingles(Words(part.column("text"), lower=True), how.words)
            edges = _edges(doc, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(edges)), *_halves(_digests(value, edges))], ["doc_id", "n", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def part_keys(doc: np.ndarray, value: np.ndarray, n: int, how: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(document number, list) for all lists the sets go into: one for each part that is not bare.

    A set with more bare parts than the block allows for might share nothing else, so it also goes
    into a list for each bare part.
    """
    sizes = np.bincount(doc, minlength=n)
    high, differ, parts = how.blocks(int(sizes.max(initial=1)))
    own = np.searchsorted(high, sizes)
    docs, keys = [], []
    for down in (0, 1):
        block = np.maximum(own - down, 0)
        joins = (sizes > 0) & (own >= down) & (differ[block] > 0)
        if down:
            joins &= how.percent * sizes <= 100 * high[block]
        count = np.where(joins, parts[block], 0)
        first = np.cumsum(count) - count
        mine = joins[doc]
        d, v = doc[mine], value[mine]
        slot = first[d] + (v % count[d].astype(np.uint64)).astype(np.int64)
        total, filled = np.zeros(int(count.sum()), np.uint64), np.zeros(int(count.sum()), bool)
        np.add.at(total, slot, mix(v))
        filled[slot] = True
        owner = np.repeat(np.arange(n), count)
        place = np.arange(len(total)) - first[owner]
        bare = np.bincount(owner, weights=~filled, minlength=n)
        listed = filled | (bare >= parts[block] - differ[block])[owner]
        salt = mix((block[owner].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64))
        docs.append(owner[listed])
        keys.append(mix(total + salt)[listed])
    return np.concatenate(docs), np.concatenate(keys)


def _listed(docs: DataFrame, how: Similarity) -> DataFrame:
    """(key, doc_id, n): the lists of all sets; of equal sets in one slice of a task only the first goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_TEXT):
            doc, value = shingles(Words(part.column("text"), lower=True), how.words)
            edges = _edges(doc, part.num_rows)
            ids = part.column("doc_id").to_pylist()
            first: dict[int, int] = {}
            for k, digest in enumerate(_digests(value, edges)):
                if ids[k] is not None and (digest not in first or ids[k] < ids[first[digest]]):
                    first[digest] = k
            keep = np.zeros(part.num_rows, bool)
            keep[list(first.values())] = True
            mine = keep[doc]
            who, key = part_keys(doc[mine], value[mine], part.num_rows, how)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.array([i or 0 for i in ids], np.int64)[who])], ["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their keys, those whose key comes twice or more; holds back one row only."""
    held, kept = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        twice = np.concatenate(([kept and held is not None], same)) | np.concatenate((same, [False]))
        held, kept = batch.slice(batch.num_rows - 1), bool(twice[-1])
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(twice[:-1]))
    if held is not None and kept:
        yield held


def _sets(docs: DataFrame, how: Similarity, bitmap, bits: int) -> DataFrame:
    """doc_id and whole set of the documents that have one and whose id may be wanted, by the bitmap of ids' low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_TEXT):
            known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            low = part.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy() & ((1 << bits) - 1)
            part = part.filter(pa.array(known & ((bitmap.value[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1)))
            if part.num_rows:
                doc, value = shingles(Words(part.column("text"), lower=True), how.words)
                lists = pa.ListArray.from_arrays(pa.array(_edges(doc, part.num_rows).astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists], ["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<long>").filter(F.size("keys") > 0)


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low bits of each id: a fixed size, however many ids there are."""
    low = ids.select((F.col("rep").bitwiseAND((1 << bits) - 1) + 1).alias("x"))  # Spark's bitmaps count from 1
    rows = low.groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        piece = np.frombuffer(r["m"], np.uint8)
        at = (r["k"] - 1) * 4096
        out[at : at + len(piece)] = piece[: len(out) - at]
    return out


def parities(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of sets of n shingles, one after the other: bytes, and where each set's begin and end.

    A bit says whether an odd number of the set's shingles fell on it. A shingle that only one of two sets
    has changes one bit, so sketches differ in no more bits than the sets in shingles. There are two to
    four bits a shingle, a power of two.
    """
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    first = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(n)), n)
    at = first[owner] + (mix(value) & (bits - 1).astype(np.uint64)[owner]).astype(np.int64)
    odd = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd), np.concatenate((first, [bits.sum()])) >> 3


def least_difference(x: bytes, y: bytes) -> int:
    """A number of shingles in which two sets differ at least, by their sketches; the longer one is folded."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(u) < len(v):
        u, v = v, u
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _sketches(sets: DataFrame) -> DataFrame:
    """rep, n and sketch of sets (rep, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_of(batches, "keys", SLICE_KEYS):
            n = pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False).astype(np.int64)
            data, edges = parities(pc.list_flatten(batch.column("keys")).to_numpy().view(np.uint64), n)
            sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(n), sketch], ["rep", "n", "sketch"])

    return sets.select("rep", "keys").mapInArrow(run, "rep long, n long, sketch binary")


def _near(pairs: DataFrame, sketches: DataFrame, how: Similarity) -> DataFrame:
    """Of pairs (a, b, slack), those (a, b) whose distance may be at most that of linked sets plus the slack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            differ = np.array([least_difference(x, y) for x, y in both], np.float64)
            size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            close = 2 * differ / np.maximum(size + differ, 1) <= 1 - how.percent / 100 + batch.column("slack").to_numpy() + 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(close))

    side = lambda x: sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "slack", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _asked_for(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets whose rep may be one of `ids` (rep), picked where they lie."""
    bitmap, last = sets.sparkSession.sparkContext.broadcast(_bitmap(ids, FILTER_BITS)), (1 << FILTER_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_of(batches, "keys", SLICE_KEYS):
            low = batch.column("rep").to_numpy() & last
            yield batch.filter(pa.array((bitmap.value[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1))

    return sets.select("rep", "keys").mapInArrow(run, "rep long, keys array<long>")


def _changes(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, x) -> (g, x, key): the shingles that only one of the two sets has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_of(batches, "kx", SLICE_KEYS):
            left, right = batch.column("kg"), batch.column("kx")
            found = [np.setxor1d(left[i].values.to_numpy(), right[i].values.to_numpy(), assume_unique=True) for i in range(batch.num_rows)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column("g").take(row), batch.column("x").take(row), pa.array(np.concatenate(found))], ["g", "x", "key"])

    few = _asked_for(sets, pairs.select(F.col("g").alias("rep")).union(pairs.select(F.col("x").alias("rep"))))
    left, right = few.select(F.col("rep").alias("g"), F.col("keys").alias("kg")), few.select(F.col("rep").alias("x"), F.col("keys").alias("kx"))
    return pairs.join(left, "g").join(right, "x").select("g", "x", "kg", "kx").mapInArrow(run, "g long, x long, key long")


def _similarities(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, how: Similarity) -> DataFrame:
    """(a, b, slack) -> (a, b, na, nb, shared), on the full sets, of the pairs that `_near` leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ka"), batch.column("kb")
            shared = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                if len(x) > len(y):
                    x, y = y, x
                x, y = x.view(np.uint64), y.view(np.uint64)
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                shared[i] = np.count_nonzero(y[at] == x) if len(y) else 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), left.value_lengths().cast(pa.int64()), right.value_lengths().cast(pa.int64()), pa.array(shared)], ["a", "b", "na", "nb", "shared"]
            )

    near = stored(_near(pairs, sketches, how), "near-pairs")
    few = _asked_for(sets, near.select(F.col("a").alias("rep")).union(near.select(F.col("b").alias("rep"))))
    left = few.select(F.col("rep").alias("a"), F.col("keys").alias("ka"))
    right = few.select(F.col("rep").alias("b"), F.col("keys").alias("kb"))
    return near.join(left, "a").join(right, "b").select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long, na long, nb long, shared long")


def _differ() -> Column:
    return F.col("na") + F.col("nb") - 2 * F.col("shared")


def _distance() -> Column:
    return 1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))


def _rows_of(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Row slices whose lists together have about `limit` entries; one longer list is a slice by itself."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles fall into each of a fixed number of cells: a sketch of their counts, added up from the tasks' own.

    It only chooses an order. Any one order of all shingles gives the same links; a truer one gives shorter lists.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_CELLS, np.uint32)
        for batch in _rows_of(batches, "keys", SLICE_KEYS):
            keys = pc.list_flatten(batch.column("keys")).to_numpy().view(np.uint64)
            total += np.bincount((keys % np.uint64(SKETCH_CELLS)).astype(np.int64), minlength=SKETCH_CELLS).astype(np.uint32)
        parts = total.reshape(SKETCH_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(cells, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "cells"])

    out = np.zeros((SKETCH_PARTS, SKETCH_CELLS // SKETCH_PARTS), np.uint64)
    for r in sets.select("keys").mapInArrow(counted, "part int, cells binary").repartition(SKETCH_PARTS, "part").mapInArrow(added, "part int, cells binary").collect():
        out[r["part"]] = np.frombuffer(r["cells"], np.uint64)
    return out.reshape(-1)


def _index(sets: DataFrame, how: Similarity) -> DataFrame:
    """Index lists: key, rep, n, alone (listed shingles of the set that no other set lists), place (from 0, in the set ordered from its rarest), block of sizes.

    Sets are ordered and cut where they lie, so only what goes into lists is shuffled; lists of one set are left out.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in _rows_of(batches, "keys", SLICE_KEYS):
            n = pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = pc.list_flatten(batch.column("keys")).to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((keys, rarity[(keys % np.uint64(SKETCH_CELLS)).astype(np.int64)], owner))
            place = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
            length = n + how.percent * n // -100 + 1
            listed = place < length[owner]
            owner, place = owner[listed], place[listed]
            block = np.floor(np.log(n) / math.log(100 / how.percent) + 1e-9).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[order][listed].view(np.int64)), batch.column("rep").take(pa.array(owner)), pa.array(n[owner]), pa.array(length[owner]), pa.array(place), pa.array(block[owner])],
                ["key", "rep", "n", "length", "place", "block"],
            )

    lists = sets.select("rep", "keys").mapInArrow(cut, "key long, rep long, n long, length long, place long, block int")
    several = lists.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select("key")
    common = stored(lists.join(stored(several, "several-sets"), "key", "left_semi"), "shared-lists")
    met = common.groupBy("rep").agg(F.count("*").alias("met"))
    return stored(common.join(met, "rep").select("key", "rep", "n", (F.col("length") - F.col("met")).alias("alone"), "place", "block"), "lists")


def links(sets: DataFrame, how: Similarity) -> DataFrame:
    """Enough confirmed links (a, b) to connect all that are linked, of sets (rep, keys), by the steps in the module text."""
    lists = _index(sets, how)
    sketches = stored(_sketches(sets), "sketches")
    one = 1 - how.percent / 100
    leaders = lists.groupBy("key", "block").agg(F.min_by("rep", F.struct("alone", "rep")).alias("b"))
    hung = lists.join(stored(leaders, "leaders"), ["key", "block"]).filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    tested = stored(_similarities(hung.withColumn("slack", F.lit(0.0)), sets, sketches, how), "leader-tests")
    good = tested.filter(how.linked(F.col("shared"), F.col("na"), F.col("nb")))
    own = F.struct("b", _distance().alias("d"), _differ().alias("own"), F.col("na").alias("n"))
    anchors = stored(good.groupBy("a").agg(F.min_by(own, F.struct(_distance(), "b")).alias("x")).select(F.col("a").alias("rep"), F.col("x.b").alias("anchor"), "x.d", "x.own", "x.n"), "anchors")
    radius = anchors.groupBy("anchor").agg(F.max("d").alias("r"))
    # of each block of a list, the anchors in it, with what bounds size and overlap for any set of an anchor's group
    placed = lists.join(anchors.select("rep", "anchor"), "rep", "left").withColumn("anchor", F.coalesce("anchor", "rep"))
    groups = stored(placed.groupBy("key", "block", "anchor").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("place")).alias("left")), "groups")
    several = groups.groupBy("key").agg(F.min("anchor").alias("x"), F.max("anchor").alias("y")).filter("x < y").select("key")
    entries = groups.join(stored(several, "several"), "key", "left_semi")
    x = entries.select("key", F.explode(F.array("block", F.col("block") + 1)).alias("at"), F.col("block").alias("xb"), F.col("anchor").alias("a"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"), F.col("left").alias("xleft"))
    y = entries.select("key", F.col("block").alias("at"), F.col("anchor").alias("b"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"), F.col("left").alias("yleft"))
    needed = F.ceil((F.col("xlo") + F.col("ylo")) * how.percent / (100 + how.percent) - 1e-9)
    fits = (100 * F.col("xhi") >= how.percent * F.col("ylo")) & (100 * F.col("yhi") >= how.percent * F.col("xlo")) & (F.least("xleft", "yleft") >= needed)
    apart_once = (F.col("a") != F.col("b")) & ((F.col("xb") < x["at"]) | (F.col("a") < F.col("b")))
    pairs = x.join(y, (x["key"] == y["key"]) & (x["at"] == y["at"]) & fits & apart_once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    r = lambda side: radius.select(F.col("anchor").alias(side), F.col("r").alias(f"r{side}"))
    pairs = pairs.join(r("a"), "a", "left").join(r("b"), "b", "left").fillna(0.0, ["ra", "rb"]).withColumn("slack", F.col("ra") + F.col("rb"))
    pairs = stored(pairs, "anchor-pairs")
    across = stored(_similarities(pairs.select("a", "b", "slack"), sets, sketches, how), "anchor-tests")
    links_now = good.select("a", "b").union(across.filter(how.linked(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b"))
    near = across.filter(~how.linked(F.col("shared"), F.col("na"), F.col("nb"))).withColumn("ab", _distance()).withColumn("apart", _differ()).join(pairs, ["a", "b"])
    open_pairs = stored(near.filter((F.col("slack") > 0) & (F.col("ab") <= one + F.col("slack") + 1e-9)).select("a", "b", "ab", "apart", "na", "nb", "ra", "rb"), "open-groups")
    if open_pairs.isEmpty():
        return links_now
    # member by anchor, both ways, then members that are still near; each time only between groups not connected yet
    links_now = stored(links_now, "links")
    open_pairs = stored(_apart(open_pairs, links_now), "open-apart")
    if open_pairs.isEmpty():
        return links_now
    side = lambda g, other: open_pairs.select(F.col(g).alias("g"), F.col(other).alias("other"), F.col(f"n{other}").alias("no"), F.col(f"r{other}").alias("r"), "ab", "apart")
    sides = stored(side("a", "b").union(side("b", "a")), "sides")
    member = stored(anchors.select(F.col("anchor").alias("g"), F.col("rep").alias("m"), "d", "own", "n").join(sides.select("g"), "g", "left_semi"), "members")
    # of the shingles by which a member differs from its anchor, how many any other anchor shares: those alone bring it nearer to that one
    others = _changes(sides.select("g", F.col("other").alias("x")), sets).select("g", "key").distinct()
    toward = _changes(member.select("g", F.col("m").alias("x")), sets).join(others, ["g", "key"], "left_semi").groupBy("g", F.col("x").alias("m")).agg(F.count("*").alias("toward"))
    member = member.join(toward, ["g", "m"], "left").fillna(0, ["toward"]).withColumnRenamed("g", "of")
    limit = one + F.col("r")
    reaches = F.col("ab") - F.col("d") <= limit + 1e-9
    turns = F.col("own") + F.col("apart") - 2 * F.least("toward", "apart") <= limit / (2 - limit) * (F.col("n") + F.col("no")) + 1e-6
    asked = stored(sides.join(member, (F.col("g") == F.col("of")) & reaches & turns).select(F.col("m").alias("a"), F.col("other").alias("b"), "g", "r"), "asked")
    tests = asked.groupBy("a", "b").agg(F.max("r").alias("slack"))
    known = stored(_similarities(tests, sets, sketches, how), "member-tests")
    linked = known.filter(how.linked(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b")
    links_now = stored(links_now.union(linked), "links")
    apart = _apart(open_pairs.select("a", "b"), links_now)
    apart = stored(apart.select(F.col("a").alias("g"), F.col("b").alias("other")).union(apart.select(F.col("b").alias("g"), F.col("a").alias("other"))), "apart")
    if apart.isEmpty():
        return links_now
    still = asked.join(known, ["a", "b"]).filter(~how.linked(F.col("shared"), F.col("na"), F.col("nb")) & (_distance() <= one + F.col("r") + 1e-9)).select(F.col("a").alias("m"), "g", F.col("b").alias("other"))
    still = still.join(apart, ["g", "other"], "left_semi")
    left = still.select(F.col("m").alias("a"), F.col("g").alias("ga"), F.col("other").alias("gb"))
    right = still.select(F.col("m").alias("b"), F.col("other").alias("ga"), F.col("g").alias("gb"))
    rest = left.join(right, ["ga", "gb"]).filter("a < b").select("a", "b").distinct().withColumn("slack", F.lit(0.0))
    more = _similarities(rest, sets, sketches, how).filter(how.linked(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b")
    return links_now.union(more)


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Of pairs (a, b, ...) those that `links` don't connect."""
    group_of = stored(components(links), "groups-so-far")
    of = lambda side: group_of.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _clash(heads: DataFrame) -> bool:
    """Whether some doc_id comes with several sets."""
    sets = heads.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y"))
    return not sets.filter("x <> y").isEmpty()


def _by_row(docs: DataFrame, how: Similarity) -> tuple[DataFrame, DataFrame, str]:
    """`docs` with a number for each row that has a doc_id; of each row number, doc_id, n_shingles and component (of numbers); and the number's name."""
    name = free_name(docs, "row")
    number = F.monotonically_increasing_id()
    # a partition's numbers start at a multiple of 2 ** 33; changed by the partition's own bits they stay apart, and low bits differ
    mixed = number.bitwiseXOR((F.shiftright(number, 33) * 38_953_801).bitwiseAND((1 << FILTER_BITS) - 1))
    numbered = stored(docs.withColumn(name, mixed).withColumn(name, F.when(F.col("doc_id").isNotNull(), F.col(name))), "numbered")
    rows = numbered.select(F.col(name).alias("doc_id"), "text")
    found = _grouped(rows, how, stored(_heads(rows, how), "heads")).withColumnRenamed("doc_id", "row")
    ids = numbered.select(F.col(name).alias("row"), "doc_id").filter("row IS NOT NULL")
    return numbered, stored(found.join(ids, "row", "left").select("row", "doc_id", "n_shingles", F.col("component_id").alias("component")), "by-row"), name


def grouped(docs: DataFrame, how: Similarity) -> DataFrame:
    """One row a row of `docs`: doc_id, n_shingles, component_id."""
    heads = stored(_heads(docs, how), "heads")
    if not _clash(heads):
        return _grouped(docs, how, heads)
    _, found, _ = _by_row(docs, how)
    least = found.filter("row IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left").select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, how: Similarity, heads: DataFrame) -> DataFrame:
    """As `grouped`, for tables where a doc_id has one set."""
    spark = docs.sparkSession
    classes = stored(heads.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows")), "classes")
    met = stored(_listed(docs, how).repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, doc_id long"), "met")
    # the class of each listed document
    meeting = met.select("doc_id").distinct()
    class_of = heads.filter("n > 0").join(meeting, "doc_id", "left_semi").join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    class_of = stored(class_of.groupBy("doc_id").agg(F.min(F.struct("rep", "n", "d1", "d2")).alias("x")).select("doc_id", "x.*"), "class-of")
    listed = met.join(class_of.select("doc_id", "rep"), "doc_id").select("key", "rep").distinct()
    several = listed.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select("key")
    likely = listed.join(stored(several, "several-classes"), "key", "left_semi").select("rep").distinct()
    likely = stored(likely, "likely")
    wanted = spark.sparkContext.broadcast(_bitmap(likely, FILTER_BITS))
    again = _sets(docs, how, wanted, FILTER_BITS).withColumnRenamed("doc_id", "rep")
    # a doc_id has one set, so its rows are equal, and one shuffle by it serves both steps
    sets = stored(again.join(likely, "rep", "left_semi").dropDuplicates(["rep"]).select("rep", "keys"), "sets")
    found = components(links(sets, how))
    labelled = classes.join(found, classes["rep"] == found["node"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    rows = heads.select("doc_id", "n", "d1", "d2")
    out = rows.join(stored(labelled, "labels"), ["d1", "d2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five words, 0.8 or more) the smallest doc_id stays, once."""
    how = Similarity(words=5, percent=80)
    heads = stored(_heads(docs, how), "heads")
    if _clash(heads):
        numbered, by_row, name = _by_row(docs, how)
        first = by_row.filter("row IS NOT NULL AND n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("x"))
        gone = by_row.filter("row IS NOT NULL AND n_shingles > 0").select("row").join(first.select(F.col("x.row").alias("row")), "row", "left_anti")
        return numbered.join(gone.withColumnRenamed("row", name), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    found = stored(_grouped(docs, how, heads), "near-copies")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = found.filter("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    others, twice = left.join(repeated, "doc_id", "left_anti"), left.join(repeated, "doc_id", "left_semi")
    return others.unionByName(twice.dropDuplicates(["doc_id", "text"])).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return grouped(table(spark, folder, "documents"), Similarity())
