"""Indexes over the tables: vectors in cells, posting lists, buckets, pages by rank; and streams in event time."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bucket_store, gram_index, vector_blocks, vectors
from ..session import fresh_folder
from ..sources.tables import table
from ..streaming import jobs, timed
from .listing import FIELDS, LIST, listing
from .registry import register
from .retrieval import PROTO, WIDTH, _store

# ---------------------------------------------------------------- vectors


@register(
    "knn_all_rows", "JOIN8", "VEC7", "WIN1",
    sql="""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS sim FROM e AS q, e)
SELECT query_id, vec_id, sim AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
)
def knn_all_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector asks for its five nearest: a join of blocks, no queries on the driver."""
    store = _store(spark, folder)
    asked = store.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_blocks.nearest_blocks(store, asked, 5, -1.0, WIDTH)


CELLS = 32
PROBES = 20  # the vectors of this table hardly form clusters: recall at 10 is 0.92 with 20 cells, 0.64 with 8


def _indexed(spark: SparkSession, folder: str) -> str:
    path = fresh_folder(spark, "cells")
    vector_blocks.write_index(_store(spark, folder), path, CELLS, WIDTH)
    return path


@register(
    "ivf_topk_all_cells", "VEC7", "VEC1",
    sql=f"WITH {PROTO} SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, sim AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20",
)
def ivf_topk_all_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The inverted file with every cell opened is exact: no vector is missing from it."""
    asked = vectors.centroids(_store(spark, folder), "label", WIDTH)
    return vector_blocks.search_index(spark, _indexed(spark, folder), asked, 20, CELLS)


@register("ivf_topk", "VEC7", "VEC1")
def ivf_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The inverted file as it is meant, with a part of the cells opened; its recall is measured by the tests."""
    asked = vectors.centroids(_store(spark, folder), "label", WIDTH)
    return vector_blocks.search_index(spark, _indexed(spark, folder), asked, 20, PROBES)


# ---------------------------------------------------------------- text

JSON_SQL = """'{"numero":"' || coalesce(document_number, '') || '","emitente":"' || coalesce(issuer_name, '') || '","valor":"' || coalesce(printf('%.2f', total_value), '') || '"}'"""
SEARCHES_SQL = """searches AS (SELECT n_nationkey AS search_id, CASE n_nationkey % 5 WHEN 0 THEN 'EMITENTE 1' || n_nationkey WHEN 1 THEN '"valor":"' || n_nationkey WHEN 2 THEN n_nationkey || '4.xml' WHEN 3 THEN 'x' || n_nationkey ELSE n_name END AS query FROM nation)"""
SEARCHED = [*FIELDS, "extracted"]


def _searched(spark: SparkSession, folder: str) -> DataFrame:
    """The document list with the whole extracted record as JSON text, the last of the searched fields."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    money = F.when(F.col("total_value").isNotNull(), F.format_string("%.2f", "total_value"))
    text = F.to_json(F.struct(blank(F.col("document_number")).alias("numero"), blank(F.col("issuer_name")).alias("emitente"), blank(money).alias("valor")))
    return listing(spark, folder).withColumn("extracted", text)


@register(
    "gram_search", "FLT4", "FLT5",
    sql=f"""{LIST}, t AS (SELECT id, lower(concat_ws(chr(0), issuer_name, issuer_cnpj, recipient_name, recipient_cnpj, file_name, document_number, {JSON_SQL})) AS text FROM d),
{SEARCHES_SQL} SELECT search_id, id FROM searches JOIN t ON contains(text, lower(query))""",
)
def gram_search(spark: SparkSession, folder: str) -> DataFrame:
    """A table of searches over seven fields, the whole JSON among them, answered by posting lists."""
    docs = _searched(spark, folder)
    path = fresh_folder(spark, "grams")
    gram_index.build(docs, "id", SEARCHED, path)
    n = F.col("n_nationkey").cast("string")
    words = [F.concat(F.lit("EMITENTE 1"), n), F.concat(F.lit('"valor":"'), n), F.concat(n, F.lit("4.xml")), F.concat(F.lit("x"), n), F.col("n_name")]
    searches = table(spark, folder, "nation").select(F.col("n_nationkey").alias("search_id"), F.element_at(F.array(*words), F.col("n_nationkey") % 5 + 1).alias("query"))
    return gram_index.search(spark, path, docs, "id", SEARCHED, searches)


# ---------------------------------------------------------------- keyed tables


@register(
    "bucketed_upserts", "WRT1", "WRT2",
    sql="""WITH c AS (SELECT *, event_id % 3 AS wave FROM events) SELECT user_id, event_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def bucketed_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """The newest event of every user after three batches, the second of them run twice; each rewrites its buckets only."""
    events = table(spark, folder, "events")
    path = fresh_folder(spark, "buckets")
    bucket_store.create(spark, path, events.schema, ["user_id"], 16)
    order = [F.desc("ts"), F.desc("event_id")]
    for batch, wave in enumerate((0, 1, 1, 2)):
        bucket_store.upsert(events.filter(F.col("event_id") % 3 == wave), path, order, batch if batch < 2 else batch - 1)
    return bucket_store.current(spark, path).select("user_id", "event_id", "event_type")


# ---------------------------------------------------------------- event time

LATENESS = datetime.timedelta(days=10)
LIFE = datetime.timedelta(days=7)


@register(
    "timed_dedupe_stream", "STR3", "FLT10",
    sql="""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_id % 2 AS wave FROM events WHERE user_id IS NOT NULL),
w AS (SELECT date_trunc('milliseconds', max(ts) FILTER (wave = 0)) - INTERVAL 10 DAY AS w1, date_trunc('milliseconds', max(ts)) - INTERVAL 10 DAY AS w2 FROM e),
late AS (SELECT count(*) AS n FROM e, w WHERE wave = 1 AND ts <= w1),
o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e, w
  WHERE (wave = 0 OR ts > w1) AND date_trunc('milliseconds', ts) + INTERVAL 1 MILLISECOND < w2),
passed AS (SELECT user_id, event_id, ts, n, ts AS last, true AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ts, o.n, CASE WHEN o.ts >= p.last + INTERVAL 7 DAY THEN o.ts ELSE p.last END, o.ts >= p.last + INTERVAL 7 DAY
  FROM passed p JOIN o ON o.user_id = p.user_id AND o.n = p.n + 1)
SELECT user_id, event_id, late.n AS n_late FROM passed, late WHERE kept""",
)
def timed_dedupe_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events arrive in two waves, odd ones second; what comes over ten days late is dropped and counted, the rest is taken in event time."""
    base = fresh_folder(spark, "timed")
    events = table(spark, folder, "events").filter("user_id IS NOT NULL")
    dropped = 0
    for wave in (0, 1):
        events.filter(F.col("event_id") % 2 == wave).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 100_000).parquet(f"{base}/in")
        instant = arriving.withColumn("ts", jobs.instant(F.col("ts")))
        run = timed.run_to_files(timed.first_in_order(instant, "user_id", LIFE, LATENESS), f"{base}/out", f"{base}/ckpt")
        dropped += timed.dropped_late(run)
    out = spark.read.schema("user_id bigint, event_id bigint, late boolean").parquet(f"{base}/out")
    late = out.agg((F.count_if("late") + dropped).alias("n")).scalar()
    return out.filter("NOT late").select("user_id", "event_id", late.alias("n_late"))
