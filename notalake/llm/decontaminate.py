"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are runs between white space and ASCII marks, lower-cased. The trigrams of the test items are
counted over all training documents. Of every few neighbouring trigrams of an item the rarest becomes
a seed, so seeds are rare and yet spread over the whole item. Where a document holds enough seeds of
an item, the item's words are aligned with the words around them; the score is the alignment's (match
2, mismatch and gap -1) as a share of the item's own. Edited and paraphrased copies keep a high share.

Test items are taken in blocks of at most `max_words` words, so what is sent to the executors has a
bound whatever the benchmark's size; each block meets all documents. Documents are never shuffled.

Defined results: null or empty documents hit nothing; of items of fewer than `min_words` words only whole
and unedited copies count, since edited ones cannot be told from chance; items of fewer words than a gram
are not searched (`unsearched` lists them); repeated items and rows are reported each; an empty
benchmark or table gives no pairs; other columns are not used, and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import IS_SPACE, Words, slices
from .common import table
from .registry import query

SEPARATORS = IS_SPACE.copy()
SEPARATORS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
MATCH, MISMATCH, GAP = 2, 1, 1


@dataclass(frozen=True)
class Search:
    gram: int = 3
    spread: int = 4  # neighbouring grams of which the rarest is a seed
    seed_share: float = 0.15  # of an item's seeds that a document must hold, two at least
    least: float = 0.6  # score that counts as a copy
    min_words: int = 8  # shorter items must be met word for word
    max_words: int = 2_000_000  # of test items in one block


def _words(texts: pa.Array) -> Words:
    """Lower-casing is by code point, so offsets stay."""
    return Words(pc.utf8_lower(texts), separators=SEPARATORS)


class Items:
    """The test items of one block: their words and grams."""

    def __init__(self, rows: list[tuple[int, str]], how: Search):
        words = _words(pa.array([t for _, t in rows], pa.string()))
        hashes = words.hashes()
        first = np.concatenate(([0], np.cumsum(words.counts)))
        self.ids, self.words, grams = [], [], []
        at, value = words.windows(hashes, how.gram)
        doc = words.doc[at]
        for k, (item, _) in enumerate(rows):
            if words.counts[k] >= how.gram:
                self.ids.append(item)
                self.words.append(hashes[first[k] : first[k + 1]])
                grams.append(value[np.searchsorted(doc, k) : np.searchsorted(doc, k, "right")])
        self.grams = grams
        self.whole = np.array([len(w) < how.min_words for w in self.words], bool)
        self.distinct = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)

    def seeded(self, counts: np.ndarray, how: Search) -> None:
        """Chooses seeds by the corpus counts of `distinct`, and builds their index."""
        rows = []
        self.n_seeds = np.zeros(len(self.ids), np.int64)
        for k, grams in enumerate(self.grams):
            count = counts[np.searchsorted(self.distinct, grams)]
            windows = range(max(1, len(grams) - how.spread + 1))
            chosen = sorted({min(range(a, min(a + how.spread, len(grams))), key=lambda i: (count[i], grams[i])) for a in windows})
            self.n_seeds[k] = len(chosen)
            rows += [(int(grams[i]), k, i) for i in chosen]
        rows.sort()
        value = np.array([r[0] for r in rows], np.uint64)
        self.seeds, self.heads = np.unique(value, return_index=True)
        self.heads = np.append(self.heads, len(rows))
        self.seed_item, self.seed_place = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        some = np.maximum(np.minimum(2, self.n_seeds), np.ceil(how.seed_share * self.n_seeds)).astype(np.int64)
        self.needed = np.where(self.whole, self.n_seeds, some)


def _found(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted ones, and where there."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    hit = np.flatnonzero(sorted_values[at] == values)
    return hit, at[hit]


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score as a share of the item's own, first and last word of it in `words`.

    Two rows of scores are held, and with each score the place where its alignment began.
    """
    m, n = len(item), len(words)
    places = np.arange(n + 1)
    step = GAP * places
    above, began = np.zeros(n + 1, np.int64), places.copy()
    best, first, last = 0, 0, -1
    for i in range(m):
        row = np.maximum(above - GAP, 0)
        start = np.where(row > 0, began, places)
        diagonal = above[:-1] + np.where(words == item[i], MATCH, -MISMATCH)
        better = (diagonal >= row[1:]) & (diagonal > 0)
        row[1:] = np.where(better, diagonal, row[1:])
        start[1:] = np.where(better, began[:-1], start[1:])
        shifted = row + step
        reach = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == reach, places, 0))  # where the gap of each cell begins
        row = reach - step
        above, began = row, np.where(row > 0, start[source], places)
        j = int(row.argmax())
        if row[j] > best:
            best, first, last = int(row[j]), int(began[j]), j - 1
    return best / (MATCH * m), first, last


def _windows(places: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of words around hits, those with most hits first; every hit lies in one."""
    left = np.sort(places)
    while len(left):
        end = np.searchsorted(left, left + length, "right")
        k = int(np.argmax(end - np.arange(len(left))))
        yield int(left[k]), int(left[end[k] - 1])
        left = np.concatenate((left[:k], left[end[k] :]))


def search_slice(texts: pa.Array, items: Items, how: Search) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item number, score, start, stop) of copies in one slice; offsets in code points."""
    words = _words(texts)
    hashes = words.hashes()
    first = np.concatenate(([0], np.cumsum(words.counts)))
    at, value = words.windows(hashes, how.gram)
    hit, seed = _found(items.seeds, value)
    if not len(hit):
        return
    times = items.heads[seed + 1] - items.heads[seed]
    entry = np.repeat(items.heads[seed] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    place = np.repeat(at[hit], times)
    item, offset, doc = items.seed_item[entry], items.seed_place[entry], words.doc[place]
    order = np.lexsort((place, item, doc))
    item, offset, doc, place = item[order], offset[order], doc[order], place[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True])))
    group = np.repeat(np.arange(len(new) - 1), np.diff(new))
    width = int(offset.max()) + 1
    distinct = np.bincount(np.unique(group * width + offset) // width, minlength=len(new) - 1)
    for g in np.flatnonzero(distinct >= items.needed[item[new[:-1]]]).tolist():
        a, b = int(new[g]), int(new[g + 1])
        k, row = int(item[a]), int(doc[a])
        own, low, high = items.words[k], int(first[row]), int(first[row + 1])
        best = (0.0, 0, 0)
        starts, counts = np.unique(place[a:b] - offset[a:b], return_counts=True)
        if items.whole[k]:
            starts = starts[(starts >= low) & (starts + len(own) <= high)]
            same = np.flatnonzero((hashes[starts[:, None] + np.arange(len(own))] == own).all(axis=1))
            if not len(same):
                continue
            counts = np.bincount(same[:1], minlength=len(starts))
        exact = int(starts[np.argmax(counts)])
        if exact >= low and exact + len(own) <= high and (hashes[exact : exact + len(own)] == own).all():
            best = (1.0, exact, exact + len(own) - 1)
        else:
            for x, y in _windows(place[a:b], len(own) + len(own) // 2):
                begin, end = max(low, x - len(own)), min(high, y + len(own) + how.gram)
                score, p, q = align(own, hashes[begin:end])
                best = max(best, (score, begin + p, begin + q))
                if score >= how.least:
                    break
        if best[0] >= how.least:
            span = words.code_points(np.array([words.starts[best[1]], words.ends[best[2]]]), np.array([row, row]))
            yield row, k, best[0], int(span[0]), int(span[1])


def unsearched(benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """item_id of the test items that have too few words to be searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            few = _words(part.column("text")).counts < how.gram
            yield pa.RecordBatch.from_arrays([part.column("item_id").cast(pa.int64()).filter(pa.array(few))], ["item_id"])

    return benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "item_id long")


def _blocks(benchmark: DataFrame, how: Search) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size; one job each, only that block's items come to the driver."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * how.max_words)))  # a word has two bytes at least, with its space
    for block in range(blocks):
        part = sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [tuple(r) for r in part.orderBy("item_id", "text").collect()]


def _counted(docs: DataFrame, items: Items, how: Search) -> np.ndarray:
    """In how many documents each distinct gram of the block occurs, over all documents."""
    known = docs.sparkSession.sparkContext.broadcast(items.distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known.value), np.int64)
        for part in slices(batches, "text"):
            words = _words(part.column("text"))
            at, value = words.windows(words.hashes(), how.gram)
            hit, gram = _found(known.value, value)
            pairs = np.unique(words.doc[at[hit]] * len(known.value) + gram)
            counts += np.bincount(pairs % len(known.value), minlength=len(known.value)) if len(pairs) else 0
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["gram", "n"])

    out = np.zeros(len(items.distinct), np.int64)
    if len(out):
        for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            out[r["gram"]] = r["n"]
    return out


def _prepared(docs: DataFrame, benchmark: DataFrame, how: Search) -> Iterator[object]:
    for rows in _blocks(benchmark, how):
        items = Items(rows, how)
        items.seeded(_counted(docs, items, how), how)
        yield docs.sparkSession.sparkContext.broadcast(items)


PAIR = "doc_id long, item_id long, score double, start int, stop int"


def copies(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """Pairs of documents and the test items they hold, with score and the copy's place in the text."""
    out = None
    for items in _prepared(docs, benchmark, how):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[r], items.value.ids[k], s, a, b) for r, k, s, a, b in search_slice(part.column("text"), items.value, how)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "score", "start", "stop"])

        found = docs.select("doc_id", "text").mapInArrow(run, PAIR)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """The documents that hold no copy of a test item."""
    out = docs
    for items in _prepared(docs, benchmark, how):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                held = {r for r, *_ in search_slice(part.column("text"), items.value, how)}
                yield part.filter(pa.array([r not in held for r in range(part.num_rows)]))

        out = out.mapInArrow(run, docs.schema)
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents with a test item in them go."""
    return clean(docs, table(spark, folder, "benchmark"))


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return copies(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
