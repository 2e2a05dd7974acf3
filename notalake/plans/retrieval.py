"""Chunking and vector retrieval over whole tables."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import reference_data as ref
from ..functions import text as t
from ..operators import chunking, embedding, vectors
from ..operators.stages import spread
from ..session import fresh_folder
from ..sources.tables import table
from .registry import register

AS_OF = datetime(2024, 1, 31, 12, 0, 0)
WIDTH = 64  # of the vectors in the embeddings table
TRIM = r"regexp_replace({}, '^[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g')".format


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


@register(
    "fixed_chunks", "CHK6",
    sql=rf"""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT), 0) + 1)) AS i FROM documents),
c AS (SELECT doc_id, i, {TRIM("substr(text, i * 1000 + 1, 1200)")} AS content FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_number, md5(content) AS content_md5, length(content) AS chunk_size FROM c WHERE content <> ''""",
)
def fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunking.chunk_table(_docs(spark, folder), "doc_id", t.fixed_chunks(F.col("text")))
    return rows.select(
        "doc_id", F.col("chunk_number").cast("bigint").alias("chunk_number"), F.md5("content_text").alias("content_md5"), F.col("chunk_size").cast("bigint").alias("chunk_size")
    )


@register("split_chunks", "CHK4", "WIN11")
def split_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sequential merge of pieces: checked against brute force on fixtures, not by SQL."""
    return chunking.chunk_table(_docs(spark, folder), "doc_id", t.split_chunks(F.col("text"), 1000, 200))


@register("sentence_chunks", "CHK5", "WIN11")
def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Window starts depend on the previous end: checked against brute force on fixtures, not by SQL."""
    return chunking.chunk_table(_docs(spark, folder), "doc_id", t.sentence_chunks(F.col("text")))


WS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{3000}]+"


def _term(sql: str, pattern: str, replacement: str) -> str:
    body = pattern.removeprefix(r"\b(").removesuffix(r")\b")
    one = lambda s: rf"regexp_replace({s}, '(?i)(^|[^\p{{L}}\p{{N}}_])({body})($|[^\p{{L}}\p{{N}}_])', '\1{replacement}\3', 'g')"
    return one(one(sql))


CLEAN = rf"lower(regexp_replace(regexp_replace({TRIM('text')}, '{WS}', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s\-.,;:()/%R$@+*<>_=\[\]]', '', 'g'))"
for _pattern, _replacement in ref.CLEAN_TERMS:
    CLEAN = _term(CLEAN, _pattern, _replacement)
NARROW = rf"regexp_replace(regexp_replace({TRIM('text')}, '{WS}', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s\-.,;:()/%R$]', '', 'g')"
for _old, _new in ref.CLEAN_REPLACEMENTS:
    NARROW = f"replace({NARROW}, '{_old}', '{_new}')"


@register("clean_text", "CHK2", sql=f"SELECT doc_id, md5(trim({CLEAN})) AS cleaned_md5, length(trim({CLEAN})) AS n_chars FROM documents")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = _docs(spark, folder).select("doc_id", t.clean_wide(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("bigint").alias("n_chars"))


@register("clean_text_narrow", "CHK3", sql=f"SELECT doc_id, md5(trim({NARROW})) AS cleaned_md5, length(trim({NARROW})) AS n_chars FROM documents")
def clean_text_narrow(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = _docs(spark, folder).select("doc_id", t.clean_narrow(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("bigint").alias("n_chars"))


@register(
    "assembled_texts", "CHK1",
    sql="""SELECT doc_id, md5(concat_ws(' ', 'Tipo: ' || lang, 'Número: ' || doc_id, 'CNPJ Emissor: ' || source, CASE WHEN n_chars % 2 = 0 THEN 'n_chars: ' || n_chars END, nullif(text, ''))) AS text_md5 FROM documents""",
)
def assembled_texts(spark: SparkSession, folder: str) -> DataFrame:
    even = F.when(F.col("n_chars") % 2 == 0, F.col("n_chars"))
    whole = chunking.assembled_text(F.col("lang"), F.col("doc_id"), F.col("source"), [("n_chars", even)], F.col("text"))
    return _docs(spark, folder).select("doc_id", F.md5(whole).alias("text_md5"))


@register(
    "chunk_metadata", "CHK7", "WIN11",
    sql=rf"""WITH w AS (SELECT doc_id, lang, source, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT), 0) + 1)) AS i FROM documents),
c AS (SELECT *, {TRIM("substr(text, i * 1000 + 1, 1200)")} AS content FROM w)
SELECT doc_id, count(*) AS total_chunks, CAST(sum(length('[Tipo de Documento: ' || lang || ', CNPJ Emissor: ' || source || ']' || chr(10) || content)) AS BIGINT) AS all_chars FROM c WHERE content <> '' GROUP BY 1""",
)
def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    header = chunking.metadata_header(F.col("lang"), F.col("source"))
    rows = chunking.chunk_table(_docs(spark, folder), "doc_id", t.fixed_chunks(F.col("text")), header)
    return rows.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.sum("chunk_size").alias("all_chars"))


@register(
    "chunk_status", "CHK8",
    sql=rf"""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT), 0) + 1)) AS i FROM documents),
c AS (SELECT doc_id, {TRIM("substr(text, i * 1000 + 1, 1200)")} AS content FROM w), k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(content) >= 400) AS e FROM c WHERE content <> '' GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_chunks, coalesce(e, 0) AS n_embedded, CASE WHEN coalesce(e, 0) = 0 THEN 'failed' WHEN e < n THEN 'processing' ELSE 'completed' END AS embedding_status FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""",
)
def chunk_status(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in model that fails on short chunks."""
    rows = chunking.chunk_table(_docs(spark, folder), "doc_id", t.fixed_chunks(F.col("text")))
    return chunking.embedding_status(_docs(spark, folder), rows, "doc_id", F.col("chunk_size") >= 400)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def length_and_vowels(texts: pd.Series) -> pd.Series:
    """Stand-in for an embedding model: two numbers per text, nothing for a short one."""
    return texts.map(lambda s: [float(len(s)), float(s.count("e"))] if len(s) >= 400 else None)


@register(
    "embedded_chunks", "UDF1", "CHK8",
    sql=rf"""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT), 0) + 1)) AS i FROM documents),
c AS (SELECT doc_id, i, {TRIM("substr(text, i * 1000 + 1, 1200)")} AS content FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, length(content)::DOUBLE AS a, (length(content) - length(replace(content, 'e', '')))::DOUBLE AS b FROM c WHERE content <> '')
SELECT doc_id, n AS chunk_number, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM k WHERE a >= 400""",
)
def embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The hook for a caller's model: Arrow batches in, unit vectors out, failed chunks dropped."""
    rows = chunking.chunk_table(_docs(spark, folder), "doc_id", t.fixed_chunks(F.col("text")))
    made = vectors.with_embedding(rows, length_and_vowels)
    norm = F.sqrt(F.col("embedding")[0] * F.col("embedding")[0] + F.col("embedding")[1] * F.col("embedding")[1])
    return made.select(
        "doc_id",
        F.col("chunk_number").cast("bigint").alias("chunk_number"),
        F.round(F.col("embedding")[0] / norm, 6).alias("x"),
        F.round(F.col("embedding")[1] / norm, 6).alias("y"),
    )


def counting_model():
    """A stand-in model, opened once a worker: length and number of e, nothing for a short text."""
    return lambda texts: [[float(len(t)), float(t.count("e"))] if len(t) >= 400 else None for t in texts]


@register(
    "embedded_once", "UDF1", "WRT11", "FN12",
    sql=rf"""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT), 0) + 1)) AS i FROM documents),
c AS (SELECT doc_id, i, {TRIM("substr(text, i * 1000 + 1, 1200)")} AS content FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, length(content)::DOUBLE AS a, (length(content) - length(replace(content, 'e', '')))::DOUBLE AS b FROM c WHERE content <> ''),
s AS (SELECT count(DISTINCT content) AS n FROM k)
SELECT doc_id, k.n AS chunk_number, CASE WHEN a >= 400 THEN round(CAST(CAST(a / sqrt(a * a + b * b) AS FLOAT) AS DOUBLE), 4) END AS x, CASE WHEN a >= 400 THEN round(CAST(CAST(b / sqrt(a * a + b * b) AS FLOAT) AS DOUBLE), 4) END AS y, CAST(s.n AS BIGINT) AS texts_embedded FROM k, s""",
)
def embedded_once(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with vectors out of a written cache: the model sees a text once, whichever document and run it comes in."""
    rows = chunking.chunk_table(_docs(spark, folder), "doc_id", t.fixed_chunks(F.col("text")))
    cache = fresh_folder(spark, "vectors")
    embedding.embedded(rows.filter("doc_id % 2 = 0"), "content_text", counting_model, cache, "even")
    made = embedding.embedded(rows, "content_text", counting_model, cache, "all")
    entries = spark.read.schema(embedding.CACHE).parquet(cache).agg(F.count("*").alias("n")).scalar()
    part = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 4)
    return made.select("doc_id", F.col("chunk_number").cast("bigint").alias("chunk_number"), part(0).alias("x"), part(1).alias("y"), entries.alias("texts_embedded"))


# ---------------------------------------------------------------- vectors
# The mean vector of each label stands for a question about that document type.


def _store(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


DOCUMENTS_OF_CHUNKS = 5
PROTO = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e), mean AS (SELECT label, p, avg(x) AS m FROM u GROUP BY 1, 2),
qv AS (SELECT label AS query_id, list(m ORDER BY p) AS qvec FROM mean GROUP BY 1),
s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(qvec, v), 9) AS sim FROM qv, e)"""


@register(
    "type_prototypes", "VEC7", "AGG5",
    sql=f"WITH {PROTO} SELECT label AS query_id, CAST(p - 1 AS INTEGER) AS pos, round(m, 9) AS mean FROM mean",
)
def type_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    q = vectors.centroids(_store(spark, folder), "label", WIDTH)
    return q.select(F.col("query_id").cast("int").alias("query_id"), F.posexplode("vector").alias("pos", "m")).select("query_id", "pos", F.round("m", 9).alias("mean"))


@register(
    "knn_topk", "VEC7", "JOIN8", "FN16", "WIN1",
    sql=f"WITH {PROTO} SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, sim AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 20",
)
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, folder)
    found = vectors.nearest(store, vectors.centroids(store, "label", WIDTH), 20)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


CHUNKS = "CAST(vec_id // 5 AS BIGINT)"


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Five chunks to a document; the document's type is the label of its first chunk."""
    return _store(spark, folder).withColumn("document_id", F.floor(F.col("vec_id") / DOCUMENTS_OF_CHUNKS))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("document_id"),
        F.col("o_orderpriority").alias("document_type"),
        F.col("o_totalprice").alias("document_value"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("issuer"),
    )


@register(
    "filtered_knn", "VEC1", "JOIN1", "JOIN2", "FLT8",
    sql=f"""WITH {PROTO}, d AS (SELECT o_orderkey AS document_id, o_orderpriority AS document_type FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1994-01-01')
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, d.document_id, d.document_type, sim AS similarity FROM s JOIN d ON d.document_id = {CHUNKS} WHERE sim >= 0.1
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10""",
)
def filtered_knn(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    allowed = docs.filter("document_type IN ('1-URGENT', '2-HIGH') AND created_at >= TIMESTAMP_NTZ '1994-01-01'")
    chunks = _chunks(spark, folder)
    found = vectors.search(chunks, vectors.centroids(chunks, "label", WIDTH), docs.select("document_id", "document_type"), 10, 0.1, allowed)
    return found.select("query_id", "vec_id", "document_id", "document_type", "similarity")


@register(
    "memory_search", "VEC2", "FLT8",
    sql=f"WITH {PROTO} SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, sim AS similarity FROM s WHERE label = 3 AND sim >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5",
)
def memory_search(spark: SparkSession, folder: str) -> DataFrame:
    """Chat chunks of one session; labels stand for sessions."""
    store = _store(spark, folder)
    chat = store.withColumnRenamed("label", "session_id").filter("session_id = 3")
    return vectors.nearest(chat, vectors.centroids(store, "label", WIDTH), 5, 0.05).drop("rank")


CONTEXT = f"""{PROTO}, hits AS (SELECT *, {CHUNKS} AS document_id FROM s WHERE sim >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY sim DESC, vec_id) AS k FROM hits),
g AS (SELECT query_id, document_id, count(*) AS chunks_count, avg(sim) AS total_similarity, string_agg('chunk ' || vec_id, chr(10) || chr(10) ORDER BY k) AS chunks_content FROM r WHERE k <= 2 GROUP BY 1, 2),
sc AS (SELECT g.*, o_orderpriority AS document_type, CASE WHEN o_totalprice > 0 THEN least(1.0, log10(o_totalprice + 1) / 6.0) ELSE 0.0 END AS vs,
  exp(-greatest(0.0, (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(o_orderdate)) / 1e6 / 86400.0) / 30.0) AS rs FROM g JOIN orders ON o_orderkey = document_id),
hy AS (SELECT *, total_similarity * 0.6 + vs * 0.25 + rs * 0.15 AS hs FROM sc), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hs, 9) DESC, document_id) AS rank FROM hy QUALIFY rank <= 3)"""


def _named_hits(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    hits = vectors.nearest(chunks, vectors.centroids(chunks, "label", WIDTH), 20, 0.1).drop("rank")
    return hits.withColumns(
        {"document_id": F.floor(F.col("vec_id") / DOCUMENTS_OF_CHUNKS), "content": F.concat(F.lit("chunk "), F.col("vec_id").cast("string"))}
    )


def _context(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.document_context(_named_hits(spark, folder), _documents(spark, folder), AS_OF)


@register(
    "doc_context_hybrid", "VEC3", "AGG7", "WIN1", "WIN3", "FN15",
    sql=f"""WITH {CONTEXT} SELECT CAST(query_id AS BIGINT) AS query_id, document_id, rank, chunks_count, round(total_similarity, 7) AS total_similarity, round(vs, 7) AS value_score, round(hs, 7) AS hybrid_score, chunks_content FROM ranked""",
)
def doc_context_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _context(spark, folder).select(
        "query_id",
        "document_id",
        F.col("rank").cast("bigint").alias("rank"),
        "chunks_count",
        F.round("total_similarity", 7).alias("total_similarity"),
        F.round("value_score", 7).alias("value_score"),
        F.round("hybrid_score", 7).alias("hybrid_score"),
        "chunks_content",
    )


@register(
    "context_text", "VEC4",
    sql=f"""WITH {CONTEXT}, blocks AS (SELECT query_id, count(*) AS n, 'DOCUMENTOS RELEVANTES ENCONTRADOS:' || chr(10) || repeat('=', 50) || chr(10) ||
  string_agg(chr(10) || 'DOCUMENTO ' || rank || ':' || chr(10) || '- Tipo: ' || document_type || chr(10) || '- CNPJ Emissor: ' || 'C' || (document_id % 7) || chr(10)
  || '- Similaridade: ' || printf('%.3f', total_similarity) || chr(10)
  || '- Conteúdo Relevante: ' || left(chunks_content, 500) || '...' || chr(10) || repeat('-', 30), chr(10) ORDER BY rank) AS context FROM ranked GROUP BY 1),
placed AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM hits),
more AS (SELECT p.query_id, chr(10) || 'TRECHOS ADICIONAIS (' || count(*) || '):' || chr(10) || string_agg('- chunk ' || vec_id || '...', chr(10) ORDER BY place) AS more
  FROM placed p LEFT JOIN blocks b ON b.query_id = p.query_id WHERE place > coalesce(n, 0) GROUP BY 1)
SELECT CAST(coalesce(b.query_id, m.query_id) AS BIGINT) AS query_id, concat_ws(chr(10), context, more) AS context FROM blocks b FULL JOIN more m ON m.query_id = b.query_id
UNION ALL SELECT -1, 'Nenhum documento relevante encontrado.'""",
)
def context_text(spark: SparkSession, folder: str) -> DataFrame:
    """Context of every prototype, with further chunks; and what is said where nothing was found."""
    hits = _named_hits(spark, folder)
    asked = hits.select("query_id").distinct().union(spark.sql("SELECT -1L AS query_id"))
    context = _context(spark, folder).withColumn("issuer_cnpj", F.concat(F.lit("C"), (F.col("document_id") % 7).cast("string")))
    return vectors.context_text(context, hits, asked)


@register(
    "two_stage_rank", "VEC5",
    sql=f"""WITH {PROTO}, c AS (SELECT query_id, vec_id, sim FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 20),
tq AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0)) AS w FROM benchmark),
td AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0)) AS w FROM documents),
j AS (SELECT query_id, vec_id, sim, CASE WHEN len(tq.w) > 0 THEN len(list_intersect(tq.w, td.w)) / len(tq.w)::DOUBLE ELSE 0.0 END AS sc FROM c JOIN tq ON item_id = query_id JOIN td ON doc_id = vec_id)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(sc, 9) AS second_score, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, sim DESC, vec_id) AS second_rank FROM j QUALIFY second_rank <= 10""",
)
def two_stage_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Vector candidates re-scored by word overlap between the question and the candidate's text."""
    store = _store(spark, folder)
    hits = vectors.nearest(store, vectors.centroids(store, "label", WIDTH), 20).drop("rank")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    content = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    joined = hits.join(asked, "query_id").join(content, "vec_id")
    ranked = vectors.two_stage(joined, vectors.overlap_score(F.col("question"), F.col("text")), 10)
    return ranked.select("query_id", "vec_id", F.round("second_score", 9).alias("second_score"), F.col("second_rank").cast("bigint").alias("second_rank"))


@register(
    "answer_status", "VEC6",
    sql=f"""WITH {PROTO}, hits AS (SELECT query_id, count(*) AS n FROM (SELECT * FROM s WHERE sim >= 0.65 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10) GROUP BY 1)
SELECT CAST(q.query_id AS BIGINT) AS query_id, coalesce(n, 0) AS n_hits, CASE WHEN n > 0 THEN 'success' ELSE 'no_matches' END AS status FROM qv q LEFT JOIN hits h ON h.query_id = q.query_id""",
)
def answer_status(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, folder)
    asked = vectors.centroids(store, "label", WIDTH)
    return vectors.answer_status(asked, vectors.nearest(store, asked, 10, ref.THRESHOLD_ANSWER), store)


@register(
    "neighbour_consistency", "VAL15", "VEC3",
    sql=f"""WITH {PROTO}, hits AS (SELECT query_id, vec_id, label FROM s WHERE sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5),
g AS (SELECT q.query_id, count(h.vec_id) AS n_similar, coalesce(avg(CASE WHEN h.vec_id IS NOT NULL THEN CASE WHEN h.label = q.query_id THEN 1.0 ELSE 0.0 END END), 0.0) AS confidence FROM qv q LEFT JOIN hits h ON h.query_id = q.query_id GROUP BY 1)
SELECT CAST(query_id AS BIGINT) AS query_id, n_similar, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN n_similar = 0 THEN 'none' WHEN confidence > 0.8 THEN 'consistent' WHEN confidence > 0.5 THEN 'partial' ELSE 'divergent' END AS finding, confidence > 0.5 AS kept_as_insight FROM g""",
)
def neighbour_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """For the prototype of every type: do the nearest documents have that type?"""
    store = _store(spark, folder)
    asked = vectors.centroids(store, "label", WIDTH)
    hits = vectors.nearest(store, asked, 5, ref.THRESHOLD_CONTEXT).join(store.select("vec_id", "label"), "vec_id")
    near = hits.select("query_id", F.col("vec_id").alias("document_id"), F.col("label").cast("bigint").alias("document_type"))
    return vectors.neighbour_consistency(near, asked.select("query_id", F.col("query_id").alias("own_type")))
