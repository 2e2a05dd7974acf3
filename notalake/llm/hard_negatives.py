"""Hard negatives from an inverted multi-index.

Vectors are cut into halves and each half has its own codebook; a pair of centroids is a cell. A
query's inner product with any row of a cell is at most the sum over the halves of its product with
the centroid and its length times the centroid's radius (Cauchy and Schwarz). A heap over the two
sorted lists of half bounds visits cells by falling bound (multi-sequence order).

A search has two visits. The first takes cells from the heap until they hold enough rows, which gives
a floor for the scores still wanted; the second goes on in the same order until a cell's bound falls
below that floor. What was found by then is certified: no cell left can hold a better row. Positives
are searched first, then the windows below each of them. Rows of a cell lie in blocks of bounded
size, and a visit goes to each block, so a cell that holds a third of all rows is many tasks.

Where bounds are loose, most anchors visit most cells. So blocks are dealt to parts, and an anchor goes
to a part once, with a bit for each cell there that it visits, not once for each block. A part meets
at most `held` bytes of anchors at a time; nothing that grows with anchors or rows is broadcast.

The codebooks are fitted on at most `sample` rows; every row is indexed, and results do not depend on
the codebooks, only the number of cells visited does.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no
part; shorter vectors count as filled up with zeros; rows that repeat an id are rows of their own, and
a row is only never compared with itself; ties go to the smaller id; an anchor without positives, or a
window without rows, gives no rows; an empty table gives none; other columns are not used. Scores are
exact while the sum of products stays below 2 ** 53.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .registry import query

ROW = "rid long, vec_id long, label long, cell int, d1 double, d2 double, vector binary"


@dataclass(frozen=True)
class Mining:
    every: int = 100  # anchors: ids divisible by it
    positives: int = 5
    negatives: int = 5
    percent: int = 80  # of the positive's score that a negative must have
    sample: int = 20_000  # rows that the codebooks are fitted on, at most
    steps: int = 8  # of k-means
    most_centroids: int = 256  # of a half
    block: int = 2048  # rows
    queries: int = 256  # anchors that travel, and meet a block, together
    held: int = 1 << 25  # bytes of anchors that a task keeps, about
    part: int = 128  # blocks of a part, at least one part a core
    first: int = 2048  # rows that the first visit covers


def packed(matrix: np.ndarray) -> bytes:
    """Whole numbers, two bytes each where they fit."""
    small = not matrix.size or np.abs(matrix).max() < 1 << 15
    return (b"s" + matrix.astype(np.int16).tobytes()) if small else (b"d" + matrix.astype(np.float64).tobytes())


def unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if raw[:1] == b"s" else np.float64, offset=1).astype(np.float64).reshape(-1, width)


def _kmeans(rows: np.ndarray, k: int, steps: int) -> np.ndarray:
    rng = np.random.default_rng(0)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(steps):
        near = _nearest(rows, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)
    return near, np.sqrt(((rows - centres[near]) ** 2).sum(1))


@dataclass
class Index:
    """What all tasks know: codebooks, radii, and the number of rows and blocks of each cell."""

    width: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] = ()
    rows: np.ndarray | None = None
    first_block: np.ndarray | None = None

    @property
    def half(self) -> int:
        return self.books[0].shape[1]

    def bounds(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = vector[: self.half], vector[self.half :]
        return tuple(book @ p + np.sqrt(p @ p) * r for book, p, r in zip(self.books, parts, self.radii))

    def visits(self, vector: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) by falling bound, of cells with rows; the heap holds one candidate a started sequence."""
        u, v = self.bounds(vector)
        a, b = np.argsort(-u), np.argsort(-v)
        heap = [(-(u[a[0]] + v[b[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = int(a[i]) * len(v) + int(b[j])
            if self.rows[cell]:
                yield -bound + 1e-6 * (1 - bound if bound < 0 else 1 + bound), cell
            if j + 1 < len(b):
                heapq.heappush(heap, (-(u[a[i]] + v[b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(u[a[i + 1]] + v[b[0]]), i + 1, 0))


def _width(rows: DataFrame) -> int:
    return int(rows.agg(F.max(F.size("embedding")).alias("w")).first()["w"] or 0)


def clean(table: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding"
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component, filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(256 * pc.list_flatten(column).cast(pa.float64()).to_numpy())
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _books(rows: DataFrame, width: int, how: Mining) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    n = rows.count()
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * how.sample / max(n, 1)))
    column = rows.filter(share).limit(how.sample).select("embedding").toArrow()["embedding"].combine_chunks()
    fitted = _matrix(column, width) if len(column) else np.zeros((1, width))
    k = min(how.most_centroids, max(4, round(math.sqrt(n) / 16)))
    half = (width + 1) // 2
    return (_kmeans(fitted[:, :half], k, how.steps), _kmeans(fitted[:, half:], k, how.steps)), n


def _assigned(rows: DataFrame, index: Index) -> DataFrame:
    """Each row with its cell and its halves' distances to the centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("embedding"), index.width)
            i, d1 = _nearest(matrix[:, : index.half], index.books[0])
            j, d2 = _nearest(matrix[:, index.half :], index.books[1])
            cell = (i * len(index.books[1]) + j).astype(np.int32)
            vectors = pa.array([packed(v) for v in matrix], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("vec_id"), batch.column("label"), pa.array(cell), pa.array(d1), pa.array(d2), vectors], ["rid", "vec_id", "label", "cell", "d1", "d2", "vector"]
            )

    return rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, ROW)


def build(rows: DataFrame, how: Mining) -> tuple[Index, DataFrame, DataFrame]:
    """The index, its blocks (block, vec_ids, rids, labels, vectors; rows by id), and the assigned rows."""
    width = max(_width(rows), 1)
    books, _ = _books(rows, width, how)
    index = Index(width, books)
    assigned = stored(_assigned(rows, index), "cells")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    radii = np.zeros(len(books[0])), np.zeros(len(books[1]))
    # one row a cell, which is at most most_centroids ** 2
    for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect():
        i, j = divmod(r["cell"], len(books[1]))
        counts[r["cell"]] = r["n"]
        radii[0][i], radii[1][j] = max(radii[0][i], r["d1"]), max(radii[1][j], r["d2"])
    ways = -(-counts // how.block)
    index = Index(width, books, radii, counts, np.concatenate(([0], np.cumsum(ways))))
    shared = rows.sparkSession.sparkContext.broadcast((index.first_block, np.maximum(ways, 1)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, many = shared.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            block = first[cell] + (batch.column("rid").to_numpy() * 40503 >> 3) % many[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block), *[batch.column(c) for c in ("vec_id", "rid", "label", "vector")]], ["block", "vec_id", "rid", "label", "vector"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            matrix = np.concatenate([unpacked(v, width) for v in part["vector"].to_pylist()])
            columns = [pa.array([part[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("vec_id", "rid", "label")]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns, pa.array([packed(matrix)], pa.binary())], ["block", "vec_ids", "rids", "labels", "vectors"])

        number, held = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True]))).tolist() if len(blocks) else []
            for a, b in zip(edges, edges[1:]):
                if held and blocks[a] != number:
                    yield out()
                    held = []
                number = int(blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    each = assigned.mapInArrow(dealt, "block long, vec_id long, rid long, label long, vector binary")
    blocks = each.repartition("block").sortWithinPartitions("block", "vec_id", "rid").mapInArrow(gathered, "block long, vec_ids binary, rids binary, labels binary, vectors binary")
    return index, stored(blocks, "blocks"), assigned


ASKED = "rid long, vec_id long, label long, vector binary, floor double, after double, windows array<long>"
#: A part's rows: anchors first (rids, labels, tops, vectors, cells, a bit for each anchor and cell), then blocks (vec_ids, rids, labels, vectors).
PART = "part long, held long, kind int, block long, " + ", ".join(f"b{i} binary" for i in range(6))


def _grid(anchors: int, index: Index, cores: int, how: Mining) -> tuple[int, int]:
    """Parts that blocks are dealt to, and the number of groups of anchors that meet a part one after another."""
    each = 2 * index.width + 8 * (2 + how.positives)
    return max(2 * cores, -(-int(index.first_block[-1]) // how.part)), max(1, -(-anchors * each // how.held))


def _visiting(shared, how: Mining, parts: int, groups: int):
    """Anchors (ASKED) to the parts (PART) with blocks that they visit, `queries` at a time.

    `after` null: cells from the best one until they hold `first` rows. Else: the cells below those,
    down to the floor; `after` is the number of cells the first visit took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        group = TaskContext.get().partitionId() % groups
        for whole in batches:
            for at in range(0, whole.num_rows, how.queries):
                batch = whole.slice(at, how.queries)
                asked: dict[int, list[int]] = {}
                vectors = [unpacked(v, index.width)[0] for v in batch.column("vector").to_pylist()]
                for q, (vector, floor, after) in enumerate(zip(vectors, batch.column("floor").to_pylist(), batch.column("after").to_pylist())):
                    held = 0
                    for bound, cell in index.visits(vector):
                        if after is None:
                            if held >= how.first:
                                break
                            held += int(index.rows[cell])
                        elif floor is not None and bound < floor:
                            break
                        elif held < how.first:
                            held += int(index.rows[cell])  # the first visit has been here
                            continue
                        asked.setdefault(cell, []).append(q)
                tops = np.full((len(vectors), how.positives), np.iinfo(np.int64).min)
                for q, window in enumerate(batch.column("windows").to_pylist()):
                    tops[q, : len(window or [])] = window or []
                told = [batch.column(c).to_numpy().tobytes() for c in ("rid", "label")] + [tops.tobytes(), packed(np.array(vectors))]
                cells = np.array(sorted(asked), np.int64)
                bits = np.zeros((len(cells), how.queries), bool)
                for k, cell in enumerate(cells.tolist()):
                    bits[k, asked[cell]] = True
                bits = np.packbits(bits, axis=1)
                first, many = index.first_block[cells], index.first_block[cells + 1] - index.first_block[cells]
                for part in range(parts):
                    here = np.flatnonzero((part - first) % parts < many)  # a block goes to the part of its number's remainder
                    if len(here):
                        row = [[part], [group], [0], [0], *([x] for x in (*told, cells[here].tobytes(), bits[here].tobytes()))]
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "held", "kind", "block", *(f"b{i}" for i in range(6))])

    return run


def _best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best that fit of each row; equal ones by column."""
    masked = np.where(fits, scores, -np.inf)
    if masked.shape[1] > k:
        least = np.partition(masked, -k, axis=1)[:, -k]
        fits = fits & (masked >= least[:, None])
    row, column = np.nonzero(fits)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return row[rank < k], column[rank < k]


class _Held:
    """The anchors of one part and group, and which of them visit a cell."""

    def __init__(self, packs: list[list[bytes]], width: int, how: Mining):
        sizes = [len(p[0]) // 8 for p in packs]
        first = np.cumsum([0, *sizes])
        self.rid, self.label = (np.concatenate([np.frombuffer(p[k], np.int64) for p in packs]) for k in (0, 1))
        self.tops = np.concatenate([np.frombuffer(p[2], np.int64).reshape(-1, how.positives) for p in packs])
        small = all(p[3][:1] == b"s" for p in packs)
        self.vectors = np.concatenate([np.frombuffer(p[3], np.int16, offset=1).reshape(-1, width) if small else unpacked(p[3], width) for p in packs])
        cells = np.concatenate([np.frombuffer(p[4], np.int64) for p in packs])
        order = np.argsort(cells, kind="stable")
        self.cells = cells[order]
        self.first = np.repeat(first[:-1], [len(p[4]) // 8 for p in packs])[order]
        self.bits = np.concatenate([np.frombuffer(p[5], np.uint8).reshape(-1, -(-how.queries // 8)) for p in packs])[order]

    def visitors(self, cell: int) -> np.ndarray:
        a, b = np.searchsorted(self.cells, cell, "left"), np.searchsorted(self.cells, cell, "right")
        pack, bit = np.nonzero(np.unpackbits(self.bits[a:b], axis=1))
        return self.first[a:b][pack] + bit


def _scored(shared, how: Mining, negatives: bool):
    """Parts (PART, anchors first) to anchor, window (the positive's place), candidate and score, the best of each block."""

    def meeting(held: _Held, cell: int, vec: np.ndarray, rid: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        visitors = held.visitors(cell)
        for at in range(0, len(visitors), how.queries):
            some = visitors[at : at + how.queries]
            q_rid, tops = held.rid[some], held.tops[some]
            scores = held.vectors[some].astype(np.float64) @ vectors.T
            same = held.label[some][:, None] == label[None, :]
            if negatives:
                found = []
                for w in range(how.positives):
                    top = tops[:, w : w + 1]
                    used = top > np.iinfo(np.int64).min
                    high = np.where(used, top, 0)
                    found.append((w, *_best(scores, used & ~same & (scores <= high) & (100 * scores >= how.percent * high), how.negatives)))
            else:
                found = [(0, *_best(scores, same & (q_rid[:, None] != rid[None, :]), how.positives))]
            for w, row, column in found:
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_rid[row]), pa.array(np.full(len(row), w, np.int32)), pa.array(vec[column]), pa.array(rid[column]), pa.array(scores[row, column].astype(np.int64))],
                        ["anchor", "window", "vec_id", "rid", "score"],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        place, packs, held = None, [], None
        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in ("part", "held", "kind", "block"))))
            for r, (part, group, kind, block) in enumerate(at):
                if (part, group) != place:
                    place, packs, held = (part, group), [], None
                cells = [batch.column(f"b{i}")[r].as_buffer().to_pybytes() for i in range(4 if kind else 6)]
                if not kind:
                    packs.append(cells)
                    continue
                if packs:
                    packs, held = [], _Held(packs, index.width, how)
                if held is not None:
                    cell = int(np.searchsorted(index.first_block, block, "right")) - 1
                    yield from meeting(held, cell, *(np.frombuffer(c, np.int64) for c in cells[:3]), unpacked(cells[3], index.width))

    return run


def _visit(asked: DataFrame, blocks: DataFrame, shared, how: Mining, grid: tuple[int, int], negatives: bool) -> DataFrame:
    """anchor, window, vec_id, rid, score: the best rows of one visit."""
    parts, groups = grid
    queries = asked.mapInArrow(_visiting(shared, how, parts, groups), PART)
    group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    none = F.lit(None).cast("binary")
    dealt = blocks.select(F.pmod("block", F.lit(parts)).alias("part"), group.alias("held"), F.lit(1).alias("kind"), "block", *(F.col(c).alias(f"b{i}") for i, c in enumerate(("vec_ids", "rids", "labels", "vectors"))), none.alias("b4"), none.alias("b5"))
    met = queries.unionByName(dealt).repartition("part", "held").sortWithinPartitions("part", "held", "kind", "block")
    return _top(met.mapInArrow(_scored(shared, how, negatives), "anchor long, window int, vec_id long, rid long, score long"), how.negatives if negatives else how.positives)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, how: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from (vec_id, label, embedding) as `clean` gives them."""
    index, blocks, assigned = build(rows, how)
    shared = rows.sparkSession.sparkContext.broadcast(index)
    anchors = assigned.filter(F.col("vec_id") % how.every == 0).select("rid", "vec_id", "label", "vector")
    n = anchors.count()
    tasks = max(1, -(-n // (4 * how.queries)))
    grid = _grid(n, index, rows.sparkSession.sparkContext.defaultParallelism, how)
    anchors = stored(anchors.repartition(tasks, "rid"), "anchors")
    none = {t: F.lit(None).cast(t) for t in ("double", "array<long>")}
    asked = lambda df, floor, after, windows: df.select("rid", "vec_id", "label", "vector", floor.alias("floor"), after.alias("after"), windows.alias("windows"))
    dealt = lambda df: df.repartition(tasks, "rid")

    # positives: a first visit for the floor, then down to it
    start = stored(_visit(asked(anchors, none["double"], none["double"], none["array<long>"]), blocks, shared, how, grid, False), "first-positives")
    floors = start.filter(F.col("rank") == how.positives).select(F.col("anchor").alias("rid"), F.col("score").cast("double").alias("f"))
    rest = asked(dealt(anchors.hint("merge").join(floors, "rid", "left")), F.col("f"), F.lit(0.0), none["array<long>"])
    more = _visit(rest, blocks, shared, how, grid, False)
    positives = stored(_top(start.drop("rank").unionByName(more.drop("rank")), how.positives), "positives")

    # windows below the positives, the same way; a window's floor is its last row so far, or its own lower end
    windows = positives.groupBy(F.col("anchor").alias("rid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("w"))
    having = stored(anchors.hint("merge").join(windows, "rid"), "asked")
    start = stored(_visit(asked(dealt(having), none["double"], none["double"], F.col("w")), blocks, shared, how, grid, True), "first-negatives")
    full = start.filter(F.col("rank") == how.negatives).select("anchor", "window", F.col("score").alias("last"))
    each = having.select(F.col("rid").alias("anchor"), F.posexplode("w").alias("window", "score")).hint("merge").join(full, ["anchor", "window"], "left")
    # an upside-down window (a negative positive score) is empty and asks for nothing
    lower = F.when(F.col("score") >= 0, F.coalesce(F.col("last").cast("double"), how.percent * F.col("score") / 100))
    floors = each.groupBy(F.col("anchor").alias("rid")).agg(F.min(lower).alias("f"))
    rest = having.hint("merge").join(floors.filter("f IS NOT NULL"), "rid")
    more = _visit(asked(dealt(rest), F.col("f"), F.lit(0.0), F.col("w")), blocks, shared, how, grid, True)
    negatives = _top(start.drop("rank").unionByName(more.drop("rank")), how.negatives)

    named = positives.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("anchor", "window", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge").join(named, ["anchor", "window"])
    ids = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return out.hint("merge").join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP12_SQL = """
WITH base AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM base a JOIN base b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id
  WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(clean(table(spark, folder, "embeddings")).withColumn("label", moved))
