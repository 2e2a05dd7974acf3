"""Exact vector retrieval.

Each task multiplies its Arrow batches of vectors with the matrix of query vectors and keeps, per
query, its own best k rows. What is shuffled is at most k rows per query and task, whatever the size
of the store, and no pair of vectors is ever written out. The queries travel in the task closure,
so their number is checked; more queries than that are joined in blocks (`vector_blocks`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions import scores
from ..session import bounded_rows

# 2048 vectors of 768 doubles are 12 MB.
MAX_CLOSURE_QUERIES = 2048
# Similarities are compared at this many places, so equal vectors tie and ids decide.
PLACES = 9


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors that are present and have the right width."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    good = np.nonzero(lengths == width)[0]
    if len(good) == 0:
        return good, np.zeros((0, width))
    flat = array.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return good, flat.reshape(-1, width)


def _key_type(df: DataFrame, column: str) -> str:
    """Keys are whole numbers or text (UUIDs); anything else is taken as text."""
    return "bigint" if df.select(column).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint") else "string"


def _keys(column: pa.Array) -> np.ndarray:
    """Keys in an order-preserving numpy type."""
    values = column.to_numpy(zero_copy_only=False)
    return values if values.dtype.kind in "iu" else values.astype(str)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _scan(store: DataFrame, ids: list, queries: np.ndarray, k: int, threshold: float, types: tuple[str, str], carry: tuple[str, str] | None) -> DataFrame:
    """Best k store rows per query and task, at or above the threshold; the store's third column comes along as `carry` (name, type)."""
    directions, width = _unit(queries), queries.shape[1]
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    empty = np.zeros(0, np.int64 if types[1] == "bigint" else "U1")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_ids = [empty for _ in ids]
        kept_scores = [np.zeros(0) for _ in ids]
        kept_more: list[list] = [[] for _ in ids]
        for batch in batches:
            rows, matrix = _matrix(batch.column(1), width)
            if len(rows) == 0:
                continue
            keys = _keys(batch.column(0))[rows]
            found = np.round(_unit(matrix) @ directions.T, PLACES)
            # A full list only admits what is at least as good as its last entry.
            floors = np.array([x[-1] if len(x) == k else threshold for x in kept_scores])
            admitted = found >= floors
            for j in np.nonzero(admitted.any(axis=0))[0]:
                hits = np.nonzero(admitted[:, j])[0]
                all_ids = np.concatenate([kept_ids[j], keys[hits]])
                all_scores = np.concatenate([kept_scores[j], found[hits, j]])
                order = np.lexsort((all_ids, -all_scores))[:k]
                if carry:
                    more = kept_more[j] + batch.column(2).take(pa.array(rows[hits])).to_pylist()
                    kept_more[j] = [more[i] for i in order.tolist()]
                kept_ids[j], kept_scores[j] = all_ids[order], all_scores[order]
        counts = [len(x) for x in kept_ids]
        if sum(counts):
            columns = [
                pa.array(ids, arrow[types[0]]).take(pa.array(np.repeat(np.arange(len(ids)), counts))),
                pa.array(np.concatenate(kept_ids).tolist(), arrow[types[1]]),
                pa.array(np.concatenate(kept_scores), pa.float64()),
            ]
            if carry:
                columns.append(pa.array([x for more in kept_more for x in more], arrow[carry[1]]))
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "similarity", *([carry[0]] if carry else [])])

    schema = f"query_id {types[0]}, vec_id {types[1]}, similarity double" + (f", `{carry[0]}` {carry[1]}" if carry else "")
    return store.mapInArrow(best, schema)


def nearest(store: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0, carry: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k nearest store vectors of every query, exactly.

    `store` has vec_id and embedding, `queries` query_id and vector. Vectors that are missing or of
    another width are left out, zero vectors have similarity 0, ties go to the smaller id. `carry`
    names a key column of the store that the result shall have as well.
    """
    from . import vector_blocks

    types = (_key_type(queries, "query_id"), _key_type(store, "vec_id"))
    more = (carry, _key_type(store, carry)) if carry else None
    store = store.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast(types[1]), "embedding", *([F.col(carry).cast(more[1])] if carry else []))
    queries = queries.withColumn("query_id", F.col("query_id").cast(types[0]))
    rows = bounded_rows(queries.select("query_id", "vector"), MAX_CLOSURE_QUERIES)
    if rows is None:
        width = int(queries.agg(F.mode(F.size("vector"), True).alias("w")).first()["w"])
        found = vector_blocks.nearest_blocks(store, queries, k, threshold, width)
        return found.join(store.select("vec_id", carry), "vec_id") if carry else found
    if not rows:
        schema = f"query_id {types[0]}, vec_id {types[1]}, similarity double, " + (f"`{carry}` {more[1]}, " if carry else "") + "rank int"
        return store.sparkSession.createDataFrame([], schema)
    found = _scan(store, [r["query_id"] for r in rows], np.array([r["vector"] for r in rows], dtype=np.float64), k, threshold, types, more)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def other_widths(store: DataFrame, width: int) -> DataFrame:
    """width, n: vectors that `centroids` leaves out, counted."""
    return store.filter(F.size("embedding") != width).groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))


def common_width(store: DataFrame) -> int:
    """The width most vectors have, the larger of equals; 0 for an empty store. One small aggregation."""
    sizes = store.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("w")).count()
    best = sizes.agg(F.max_by("w", F.struct("count", "w")).alias("w")).first()["w"]
    return int(best or 0)


def centroids(store: DataFrame, group: str, width: int) -> DataFrame:
    """Mean vector per group, of the vectors of this width. Each task sends one partial sum per group it saw, not its vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            rows, matrix = _matrix(batch.column(1), width)
            keys = _keys(batch.column(0))[rows]
            for key in np.unique(keys).tolist():
                part = matrix[keys == key]
                total, n = sums.get(key, (0.0, 0))
                sums[key] = (total + part.sum(axis=0), n + len(part))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int64() if kind == "bigint" else pa.string()),
                    pa.array([n for _, n in sums.values()], pa.int64()),
                    pa.array([v.tolist() for v, _ in sums.values()], pa.list_(pa.float64())),
                ],
                names=["key", "n", "sums"],
            )

    kind = _key_type(store, group)
    grouped = store.filter(F.col(group).isNotNull()).select(F.col(group).cast(kind), "embedding")
    parts = grouped.mapInArrow(partial, f"key {kind}, n bigint, sums array<double>")
    cells = parts.select("key", "n", F.posexplode("sums").alias("pos", "part"))
    means = cells.groupBy("key", "pos").agg((F.sum("part") / F.sum("n")).alias("mean"))
    # One array per group of as many entries as a vector is wide.
    ordered = means.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("cells"))
    return ordered.select(F.col("key").alias("query_id"), F.transform("cells", lambda c: c["mean"]).alias("vector"))


def search(store: DataFrame, queries: DataFrame, documents: DataFrame, k: int, threshold: float, allowed: DataFrame | None = None) -> DataFrame:
    """Filtered search: chunks of allowed documents only, the best k, with the columns of their document."""
    eligible = store if allowed is None else store.join(allowed.select("document_id"), "document_id", "left_semi")
    return nearest(eligible, queries, k, threshold, carry="document_id").join(documents, "document_id")


def document_context(hits: DataFrame, documents: DataFrame, as_of: datetime, per_document: int = 2, max_documents: int = 3) -> DataFrame:
    """Documents behind the hits, ranked by similarity, value and recency.

    hits: query_id, document_id, vec_id, similarity, content. At most `per_document` chunks of a
    document are kept before anything is gathered.
    """
    order = Window.partitionBy("query_id", "document_id").orderBy(F.desc("similarity"), "vec_id")
    top = hits.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_document)
    gathered = top.groupBy("query_id", "document_id").agg(
        F.count("*").alias("chunks_count"),
        F.avg("similarity").alias("total_similarity"),
        F.array_sort(F.collect_list(F.struct("_r", "content"))).alias("_parts"),
    )
    text = F.array_join(F.transform("_parts", lambda p: p["content"]), "\n\n")
    joined = gathered.withColumn("chunks_content", text).drop("_parts").join(documents, "document_id")
    scored = joined.withColumns(
        {"value_score": scores.value_score(F.col("document_value")), "recency_score": scores.recency_score(F.col("created_at"), as_of)}
    ).withColumn("hybrid_score", scores.hybrid_score(F.col("total_similarity"), F.col("value_score"), F.col("recency_score")))
    best = Window.partitionBy("query_id").orderBy(F.round("hybrid_score", PLACES).desc(), "document_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_documents)


def context_text(context: DataFrame, hits: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """One block of text per query out of its few ranked documents.

    `hits` (query_id, vec_id, similarity, content) adds the chunks beyond as many as there are documents,
    200 characters each; `queries` (query_id) adds the ones nothing was found for.
    """
    block = F.concat(
        F.lit("\nDOCUMENTO "), F.col("rank").cast("string"), F.lit(":\n- Tipo: "), F.coalesce("document_type", F.lit("Não informado")),
        F.lit("\n- CNPJ Emissor: "), F.coalesce("issuer_cnpj", F.lit("Não informado")),
        F.lit("\n- Similaridade: "), F.format_number("total_similarity", 3),
        F.lit("\n- Conteúdo Relevante: "), F.left("chunks_content", F.lit(500)), F.lit("...\n"), F.lit("-" * 30),
    )
    gathered = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"), F.count("*").alias("n_documents"))
    heading = "DOCUMENTOS RELEVANTES ENCONTRADOS:\n" + "=" * 50 + "\n"
    text = F.concat(F.lit(heading), F.array_join(F.transform("blocks", lambda x: x["b"]), "\n"))
    out = gathered.select("query_id", text.alias("context"), "n_documents")
    if hits is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        line = F.concat(F.lit("- "), F.left(F.coalesce("content", F.lit("")), F.lit(200)), F.lit("..."))
        placed = hits.select("query_id", F.row_number().over(order).alias("place"), line.alias("line"))
        further = placed.join(out.select("query_id", "n_documents"), "query_id", "left").filter(F.col("place") > F.coalesce("n_documents", F.lit(0)))
        lines = further.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
        told = F.concat(F.lit("\nTRECHOS ADICIONAIS ("), F.size("l").cast("string"), F.lit("):\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
        out = out.join(lines.select("query_id", told.alias("more")), "query_id", "full").withColumn("context", F.concat_ws("\n", "context", "more"))
    if queries is not None:
        out = queries.select("query_id").distinct().join(out, "query_id", "left")
    return out.select("query_id", F.coalesce("context", F.lit("Nenhum documento relevante encontrado.")).alias("context"))


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the distinct words of the query that the content has: the default second-stage score."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+", -1), lambda w: F.length(w) > 0))
    asked = words(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(content))) / F.size(asked)).otherwise(F.lit(0.0))


def two_stage(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Candidates re-ordered by a second score."""
    scored = hits.withColumn("second_score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc("second_score"), F.desc("similarity"), "vec_id")
    return scored.withColumn("second_rank", F.row_number().over(order)).filter(F.col("second_rank") <= k)


def answer_status(queries: DataFrame, hits: DataFrame, store: DataFrame) -> DataFrame:
    """success / no_matches / no_documents per query."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    stored = store.filter("embedding IS NOT NULL").limit(1).agg(F.count("*").alias("n")).scalar()
    status = F.when(F.col("n_hits") > 0, "success").when(stored == 0, "no_documents").otherwise("no_matches")
    return queries.select("query_id").join(counts, "query_id", "left").select(
        "query_id", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"), status.alias("status")
    )


def neighbour_consistency(hits: DataFrame, own: DataFrame) -> DataFrame:
    """Share of a query's nearest documents that have its own type; no neighbour gives 0.

    hits: query_id, document_id, document_type; own: query_id, own_type.
    """
    near = hits.select("query_id", "document_id", "document_type").dropDuplicates(["query_id", "document_id"])
    joined = own.join(near, "query_id", "left")
    grouped = joined.groupBy("query_id").agg(
        F.count("document_id").alias("n_similar"),
        F.coalesce(F.avg(F.when(F.col("document_id").isNotNull(), (F.col("document_type") == F.col("own_type")).cast("double"))), F.lit(0.0)).alias("confidence"),
    )
    finding = (
        F.when(F.col("n_similar") == 0, "none")
        .when(F.col("confidence") > 0.8, "consistent")
        .when(F.col("confidence") > 0.5, "partial")
        .otherwise("divergent")
    )
    return grouped.withColumns({"finding": finding, "kept_as_insight": F.col("confidence") > 0.5})


def with_embedding(chunks: DataFrame, embed, text: str = "content_text") -> DataFrame:
    """Chunks with the vector of a caller-supplied pandas UDF; chunks it fails on (NULL) are dropped."""
    return chunks.withColumn("embedding", embed(F.col(text))).filter("embedding IS NOT NULL")


def unit_length(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


THRESHOLDS = {"search": ref.THRESHOLD_SEARCH, "answer": ref.THRESHOLD_ANSWER, "context": ref.THRESHOLD_CONTEXT}
