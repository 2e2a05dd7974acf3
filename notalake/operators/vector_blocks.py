"""Many queries against many vectors, block by block, and an inverted-file index over a large store.

Block join. Queries and store rows are packed into blocks of bounded size, each a matrix. Blocks are
dealt to a grid of `queries` rows by `store` columns: a query block goes to every column of its row, a
store block to every row of its column, so each pair of blocks meets once, in one cell, and a cell
is a task's work. The store is shuffled once for each grid row. A task keeps a running top-k for the
queries of a block and multiplies one pair of matrices at a time.

Inverted file. Vectors are assigned to the nearest of a bounded number of centroids and written in
one folder a cell. A search opens the folders of the `probes` cells nearest to each query and ranks
what is there exactly. With all cells probed it is exact; with fewer it can miss neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import PLACES, _key_type, _keys, _matrix, _unit

BLOCK = 4096  # rows of a block
QUERIES_PER_ROW = 16_384  # queries that meet a store row's copy together
MOST_CELLS = 65_536
HELD = 64  # query blocks a task keeps the best rows of at a time
SLICE = 256  # queries multiplied at a time

ARROW = {"bigint": pa.int64(), "string": pa.string()}


def _packed(df: DataFrame, key: str, vector: str, width: int, kind: str, block: int, by: str | None = None) -> DataFrame:
    """no, keys, matrix (unit vectors, eight bytes a number): blocks of the vectors of this width, in the order of their keys.

    With `by`, a block holds rows of one value of that column, which is a column of the result too.
    """
    columns = [key, vector] + ([by] if by else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = _matrix(batch.column(1), width)
            if not len(rows):
                continue
            matrix, keys = _unit(matrix), _keys(batch.column(0))[rows]
            group = batch.column(2).to_numpy()[rows] if by else np.zeros(len(rows), np.int64)
            order = np.lexsort((keys, group))
            group, keys, matrix = group[order], keys[order], matrix[order]
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))).tolist()
            spans = [(a, min(a + block, end)) for start, end in zip(edges, edges[1:]) for a in range(start, end, block)]
            names = pa.array([keys[a:b].tolist() for a, b in spans], pa.list_(ARROW[kind]))
            arrays = [names, pa.array([matrix[a:b].tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(group[[a for a, _ in spans]].astype(np.int32))] if by else []), ["keys", "matrix"] + ([by] if by else []))

    schema = f"keys array<{kind}>, matrix binary" + (f", {by} int" if by else "")
    return df.filter(F.col(key).isNotNull()).select(*columns).mapInArrow(run, schema)


def _best(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((key, -score, query))
    query, score, key = query[order], score[order], key[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
    return query[keep], score[keep], key[keep]


def _ranked(width: int, k: int, threshold: float, kinds: tuple[str, str]):
    """Pairs of blocks to the best k of each query in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}  # by a query block's keys: the keys, the best so far, and what is good enough

        def out() -> Iterator[pa.RecordBatch]:
            for q_keys, (query, score, key), _ in held.values():
                if len(query):
                    yield pa.RecordBatch.from_arrays([pa.array(q_keys[query].tolist(), ARROW[kinds[0]]), pa.array(key.tolist(), ARROW[kinds[1]]), pa.array(score)], ["query_id", "vec_id", "similarity"])
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                q_keys = _keys(batch.column("q_keys")[r].values).copy()  # held: a view would keep its whole batch
                s_keys = _keys(batch.column("keys")[r].values)
                asked, rows = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(-1, width) for c in ("q_matrix", "matrix"))
                name = q_keys.tobytes()
                if name not in held and len(held) == HELD:
                    yield from out()
                _, (query, score, key), floor = held.get(name, (None, (np.zeros(0, np.int64), np.zeros(0), s_keys[:0].copy()), np.full(len(q_keys), threshold)))
                queries, scores, keys = [query], [score], [key]
                for start in range(0, len(asked), SLICE):
                    found = asked[start : start + SLICE] @ rows.T
                    np.round(found, PLACES, out=found)
                    # only what is at least as good as the k-th, here and so far
                    least = floor[start : start + SLICE]
                    if found.shape[1] > k:
                        least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
                    at, column = np.nonzero(found >= least[:, None])
                    queries.append(at + start)
                    scores.append(found[at, column])
                    keys.append(s_keys[column])
                merged = _best(np.concatenate(queries), np.concatenate(scores), np.concatenate(keys), k)
                full = np.bincount(merged[0], minlength=len(q_keys)) == k
                floor = np.full(len(q_keys), threshold)
                floor[full] = merged[1][np.searchsorted(merged[0], np.flatnonzero(full), "right") - 1]  # the k-th row's
                held[name] = (q_keys, merged, floor)
        yield from out()

    return run, f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_blocks(store: DataFrame, queries: DataFrame, k: int, threshold: float, width: int) -> DataFrame:
    """As `vectors.nearest`, for any number of queries: a join of blocks, nothing on the driver but two counts of the grid."""
    kinds = _key_type(queries, "query_id"), _key_type(store, "vec_id")
    spark = store.sparkSession
    rows = max(1, -(-queries.count() // QUERIES_PER_ROW))
    columns = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // rows)
    asked = _packed(queries.select(F.col("query_id").cast(kinds[0]).alias("query_id"), "vector"), "query_id", "vector", width, kinds[0], BLOCK // 4)
    blocks = _packed(store.select(F.col("vec_id").cast(kinds[1]).alias("vec_id"), "embedding"), "vec_id", "embedding", width, kinds[1], BLOCK)
    # a block's place follows from its keys, so a task that runs again deals it out alike
    place = lambda n: F.pmod(F.xxhash64("keys"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("keys").alias("q_keys"), F.col("matrix").alias("q_matrix"), place(rows).alias("r"), every(columns).alias("c"))
    right = blocks.select("keys", "matrix", place(columns).alias("c"), every(rows).alias("r"))
    pairs = left.join(right, ["r", "c"]).select("q_keys", "q_matrix", "keys", "matrix")
    return _top(pairs.mapInArrow(*_ranked(width, k, threshold, kinds)), k)


def fit_cells(store: DataFrame, cells: int, width: int, sample: int = 65_536, steps: int = 10) -> np.ndarray:
    """Centroids (unit vectors) by k-means on at most `sample` rows, chosen by a digest of their keys."""
    cells = min(cells, MOST_CELLS)
    fits = store.filter((F.size("embedding") == width) & F.col("vec_id").isNotNull())
    share = min(1.0, 0.9 * sample / max(fits.count(), 1))
    chosen = fits.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample).select("embedding").toArrow()
    _, matrix = _matrix(chosen["embedding"], width)
    matrix = _unit(matrix)
    if not len(matrix):
        return np.zeros((1, width))
    centres = matrix[np.random.default_rng(0).choice(len(matrix), min(cells, len(matrix)), replace=False)]
    for _ in range(steps):
        near = (matrix @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, matrix)
        used = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(used[:, None], _unit(sums), centres)
    return centres


def write_index(store: DataFrame, path: str, cells: int, width: int, rows_per_file: int = 1_000_000) -> None:
    """Every vector of the width in the folder of its cell; a cell of many rows is several files.

    `path`/vectors has the store's columns and `cell`; `path`/cells has the centroids and counts.
    """
    spark = store.sparkSession
    centres = fit_cells(store, cells, width)
    shared = spark.sparkContext.broadcast(centres)
    where = F.col("vec_id").isNotNull() & (F.size("embedding") == width)

    @F.pandas_udf("int")
    def nearest_cell(embedding: pd.Series) -> pd.Series:
        return pd.Series((_unit(np.stack(embedding).astype(np.float64)) @ shared.value.T).argmax(1).astype(np.int32))

    assigned = store.filter(where).withColumn("cell", nearest_cell("embedding"))
    slot = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(len(centres), 1))))
    dealt = assigned.repartition(F.col("cell"), slot).sortWithinPartitions("cell")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("cell").parquet(f"{path}/vectors")
    counts = spark.read.schema(assigned.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n_rows"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    named.join(counts, "cell", "left").fillna(0, ["n_rows"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, threshold: float = -1.0) -> DataFrame:
    """query_id, vec_id, similarity, rank out of the `probes` cells nearest to each query; their rows are compared exactly."""
    cells = spark.read.parquet(f"{path}/cells").filter("n_rows > 0").orderBy("cell").toArrow()  # at most MOST_CELLS rows
    numbers = cells["cell"].to_numpy()
    centres = np.stack(cells["centre"].to_numpy()) if len(cells) else np.zeros((0, 1))
    width = centres.shape[1]
    vectors = spark.read.parquet(f"{path}/vectors") if len(cells) else spark.createDataFrame([], "vec_id bigint, embedding array<double>, cell int")
    kinds = _key_type(queries, "query_id"), _key_type(vectors, "vec_id")
    shared = spark.sparkContext.broadcast((numbers, centres))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centres = shared.value
        n = min(probes, len(numbers))
        for batch in batches:
            rows, matrix = _matrix(batch.column(1), width)
            if not len(rows) or not n:
                continue
            near = np.argsort(-(_unit(matrix) @ centres.T), axis=1, kind="stable")[:, :n]
            at = pa.array(np.repeat(rows, n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers[near.reshape(-1)])], ["query_id", "vector", "cell"])

    asked = queries.filter(F.col("query_id").isNotNull()).select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    visits = asked.mapInArrow(probe, f"query_id {kinds[0]}, vector array<double>, cell int")
    wanted = visits.repartition("cell").sortWithinPartitions("cell", "query_id")
    left = _packed(wanted, "query_id", "vector", width, kinds[0], BLOCK // 4, by="cell")
    # only the folders of probed cells are opened; there are at most MOST_CELLS of them
    opened = vectors.join(F.broadcast(visits.select("cell").distinct()), "cell", "left_semi")
    right = _packed(opened.select(F.col("vec_id").cast(kinds[1]).alias("vec_id"), "embedding", "cell"), "vec_id", "embedding", width, kinds[1], BLOCK, by="cell")
    pairs = left.select(F.col("keys").alias("q_keys"), F.col("matrix").alias("q_matrix"), "cell").join(right, "cell").select("q_keys", "q_matrix", "keys", "matrix")
    return _top(pairs.mapInArrow(*_ranked(width, k, threshold, kinds)), k)
