"""Summaries, joins, conversations and table upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import content_key
from ..operators import classify, conversations as chat, extract_xml, relate, summary, validate
from ..session import fresh_folder
from ..sources import fiscal_view as fv, xml_text as xt
from ..sources.tables import table
from . import sqlviews as q
from .listing import H
from .registry import register
from .values import CATEGORY_SQL, MESSY_SQL, messy_documents

# ---------------------------------------------------------------- summaries


@register(
    "portfolio_summary", "AGG1", "CLS4",
    sql=f"""WITH {MESSY_SQL}, c AS (SELECT {CATEGORY_SQL} AS category, CASE WHEN id % 10 = 0 THEN NULL ELSE 'E' || id % 37 END AS issuer, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM m)
SELECT 'category' AS dimension, category AS key, count(*) AS n_documents, CAST(sum(v) AS BIGINT) AS total_value FROM c GROUP BY 2
UNION ALL SELECT 'issuer', issuer, count(*), CAST(sum(v) AS BIGINT) FROM c GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*), CAST(sum(v) AS BIGINT) FROM c""",
)
def portfolio_summary(spark: SparkSession, folder: str) -> DataFrame:
    m = messy_documents(spark, folder)
    kind = classify.category(F.col("document_type"), F.col("subtype"), F.col("model"), F.col("file_name"))
    issuer = F.when(F.col("id") % 10 != 0, F.concat(F.lit("E"), (F.col("id") % 37).cast("string")))
    return summary.portfolio(m, kind, issuer, F.round(F.col("o_totalprice") * 100).cast("bigint"))


TAXES = {"ICMS": "icms_cents", "IPI": "ipi_cents", "PIS": "pis_cents", "COFINS": "cofins_cents"}


@register(
    "financial_impact", "AGG2",
    sql=f"""{H} SELECT coalesce(document_type, 'Unknown') AS document_type, count(*) AS n_documents, CAST(sum(coalesce(total_cents, 0)) AS BIGINT) AS total_cents,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {n.lower()}' for n, c in TAXES.items())} FROM h GROUP BY 1""",
)
def financial_impact(spark: SparkSession, folder: str) -> DataFrame:
    return fv.headers(spark, folder).groupBy(F.coalesce("document_type", F.lit("Unknown")).alias("document_type")).agg(
        F.count("*").alias("n_documents"),
        F.sum(F.coalesce("total_cents", F.lit(0))).alias("total_cents"),
        *[F.sum(c).alias(n.lower()) for n, c in TAXES.items()],
    )


@register(
    "top_issuers", "AGG2", "WIN2",
    sql=f"{H} SELECT coalesce(emitente_cnpj, 'Unknown') AS issuer, count(*) AS n_documents FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def top_issuers(spark: SparkSession, folder: str) -> DataFrame:
    named = fv.headers(spark, folder).select(F.coalesce("emitente_cnpj", F.lit("Unknown")).alias("issuer"))
    return summary.top_by_count(named, "issuer", 5)


@register(
    "tax_totals", "AGG3",
    sql=f"{H} " + " UNION ALL ".join(f"SELECT '{n}' AS tax, CAST(sum({c}) AS BIGINT) AS amount FROM h" for n, c in TAXES.items()),
)
def tax_totals(spark: SparkSession, folder: str) -> DataFrame:
    return summary.tax_totals(fv.headers(spark, folder), TAXES)


INSIGHTS = f"""{H}, a AS (SELECT 0 AS part, count(*) AS n, 'Total de documentos analisados: ' || count(*) AS line FROM h),
b AS (SELECT 1, count(*), '  - ' || coalesce(document_type, 'Unknown') || ': ' || count(*) || ' documentos' FROM h GROUP BY document_type)"""


@register("financial_insights", "AGG3", sql=f"{INSIGHTS} SELECT CAST(part AS BIGINT) AS part, n, line FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def financial_insights(spark: SparkSession, folder: str) -> DataFrame:
    """Report lines; both kinds come from one aggregation by type."""
    h = fv.headers(spark, folder).select("document_type")
    sets = h.groupingSets([["document_type"], []], "document_type").agg(F.count("*").alias("n"), F.grouping("document_type").alias("g"))
    line = F.when(F.col("g") == 1, F.concat(F.lit("Total de documentos analisados: "), F.col("n").cast("string"))).otherwise(
        F.concat(F.lit("  - "), F.coalesce("document_type", F.lit("Unknown")), F.lit(": "), F.col("n").cast("string"), F.lit(" documentos"))
    )
    return sets.select((1 - F.col("g")).cast("bigint").alias("part"), "n", line.alias("line"))


STATUS = "CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' END"


@register(
    "status_distribution", "AGG4", "AGG6",
    sql=f"""WITH s AS (SELECT coalesce({STATUS}, 'not_started') AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT status, count(*) AS n_documents, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM s), 4) AS percent FROM s GROUP BY 1""",
)
def status_distribution(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("not_started")
    joined = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return summary.status_shares(joined, status)


@register(
    "vector_store_stats", "AGG4", "AGG5",
    sql="""SELECT count(*) AS n_chunks, count(embedding) AS n_vectors, CAST(max(len(embedding)) AS BIGINT) AS dimension, count(DISTINCT label) AS n_documents,
  count(*) FILTER (len(embedding) <> 64) AS wrong_width FROM embeddings""",
)
def vector_store_stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").agg(
        F.count("*").alias("n_chunks"),
        F.count("embedding").alias("n_vectors"),
        F.max(F.size("embedding")).cast("bigint").alias("dimension"),
        F.count_distinct("label").alias("n_documents"),
        F.count_if(F.size("embedding") != 64).alias("wrong_width"),
    )


@register(
    "import_report", "SNK4", "AGG10",
    sql=f"""WITH {q.HEADERS} SELECT count(*) AS total, count(*) FILTER (id % 50 < 46) AS succeeded, count(*) FILTER (id % 50 >= 46) AS failed,
  round(count(*) FILTER (id % 50 < 46) * 100.0::DOUBLE / count(*), 4) AS succeeded_percent, round(count(*) FILTER (id % 50 >= 46) * 100.0::DOUBLE / count(*), 4) AS failed_percent FROM h""",
)
def import_report(spark: SparkSession, folder: str) -> DataFrame:
    """What an import of all XML documents comes to: parsed, typed, or sent to quarantine."""
    done = extract_xml.parsed(xt.order_documents(spark, folder).select("id", "xml")).select("id", "error")
    return summary.outcome_report(done, F.col("error").isNull())


# ---------------------------------------------------------------- joins
# Chunks: one per item of a document, some of whose documents are missing.


@register(
    "chunks_with_documents", "JOIN1",
    sql="SELECT l_orderkey AS document_id, l_linenumber AS chunk_number, l_partkey AS content, o_orderpriority AS document_type FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)
def chunks_with_documents(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_number"), F.col("l_partkey").alias("content"))
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("document_type"))
    return chunks.join(docs, "document_id")


@register(
    "issuer_semi_join", "JOIN2",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderpriority = '2-HIGH'
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31')""",
)
def issuer_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "orders").filter(
        "o_orderpriority = '2-HIGH' AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate <= TIMESTAMP_NTZ '1998-12-31'"
    )
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return l.join(wanted, l["l_orderkey"] == wanted["o_orderkey"], "left_semi")


@register(
    "orphan_chunks", "JOIN3",
    sql="SELECT lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS kept, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS quarantined FROM documents GROUP BY 1",
)
def orphan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    kept, lost = relate.keep_known(table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels"), "doc_id")
    both = kept.select("lang", F.lit(1).alias("k")).union(lost.select("lang", F.lit(0)))
    return both.groupBy("lang").agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("quarantined"))


@register(
    "documents_with_insights", "JOIN4",
    sql="""SELECT d.doc_id, l.quality AS summary_quality, e.event_id AS insight_id, e.event_type AS insight_type FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN events e ON e.user_id = d.doc_id""",
)
def documents_with_insights(spark: SparkSession, folder: str) -> DataFrame:
    """Summary and insights beside each document; insights stay rows, since a document may have very many."""
    d = table(spark, folder, "documents").select("doc_id")
    s = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("summary_quality"))
    e = table(spark, folder, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("insight_id"), F.col("event_type").alias("insight_type"))
    return d.join(s, "doc_id", "left").join(e, "doc_id", "left")


@register(
    "documents_with_hot_insights", "JOIN4",
    sql="""WITH e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 3 ELSE user_id END AS doc_id, event_id AS insight_id, event_type AS insight_type FROM events)
SELECT d.doc_id, insight_id, insight_type FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""",
)
def documents_with_hot_insights(spark: SparkSession, folder: str) -> DataFrame:
    """One document has half of all insights: their rows are split, its own row is repeated."""
    key = F.when(F.col("event_id") % 2 == 0, F.lit(3).cast("bigint")).otherwise(F.col("user_id"))
    e = table(spark, folder, "events").select(key.alias("doc_id"), F.col("event_id").alias("insight_id"), F.col("event_type").alias("insight_type"))
    return relate.left_join_split(table(spark, folder, "documents").select("doc_id"), e, "doc_id", ["insight_id"], least=1000)


@register("id_list_lookup", "JOIN7", "SET2", sql="SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey IN (SELECT user_id FROM events)")
def id_list_lookup(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "events").select(F.col("user_id").alias("id"))
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return docs.join(ids, "id", "left_semi")


@register(
    "analysis_bundle", "AGG12",
    sql=f"{H} SELECT count(*) AS n_documents, array_to_string(list_sort(list(DISTINCT coalesce(document_type, 'Unknown'))), ',') AS document_types FROM h",
)
def analysis_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The set holds document types, of which there are a handful."""
    kind = F.coalesce("document_type", F.lit("Unknown"))
    per_type = fv.headers(spark, folder).groupBy(kind.alias("t")).agg(F.count("*").alias("n"))
    return per_type.agg(F.sum("n").alias("n_documents"), F.array_join(F.array_sort(F.collect_set("t")), ",").alias("document_types"))


# ---------------------------------------------------------------- conversations


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("message_id"),
        F.col("turn").alias("created_at"),
        F.col("role").alias("message_type"),
        F.col("text").alias("content"),
    )


def cited(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the documents cited in a session (user); assistant or user messages."""
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        key.alias("message_id"),
        F.col("ts").alias("created_at"),
        F.when(key % 3 == 0, "user").otherwise("assistant").alias("message_type"),
        F.when(key % 7 != 0, (key % 5 + 10000000000000).cast("string")).alias("issuer_cnpj"),
        F.when(key % 4 != 0, F.concat(F.lit("F"), (key % 5).cast("string"))).alias("issuer_name"),
        F.col("event_type").alias("document_type"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("validation_status"),
    )


CITED = """c AS (SELECT user_id AS session_id, event_id AS message_id, ts, CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS message_type,
  CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 5 + 10000000000000 AS VARCHAR) END AS issuer_cnpj, CASE WHEN event_id % 4 <> 0 THEN 'F' || event_id % 5 END AS issuer_name,
  event_type AS document_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS validation_status FROM events)"""


@register(
    "sessions_with_counts", "JOIN5",
    sql="""WITH m AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT conv_id AS session_id, coalesce(max(n), 0) AS message_count FROM conversations LEFT JOIN m ON user_id = conv_id GROUP BY 1""",
)
def sessions_with_counts(spark: SparkSession, folder: str) -> DataFrame:
    sessions = table(spark, folder, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return chat.with_counts(sessions, cited(spark, folder)).drop("last_at")


@register(
    "session_messages", "WIN7",
    sql="SELECT session_id, message_id, CAST(position AS BIGINT) AS position FROM (SELECT user_id AS session_id, event_id AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events) WHERE position <= 50",
)
def session_messages(spark: SparkSession, folder: str) -> DataFrame:
    head = chat.first_messages(cited(spark, folder), 50)
    return head.select("session_id", "message_id", F.col("position").cast("bigint").alias("position"))


@register(
    "context_window", "WIN8",
    sql=r"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS r FROM h WHERE p <= 50)
SELECT conv_id AS session_id, count(*) AS n_shown, string_agg('[' || CASE WHEN role = 'user' THEN 'Usuário' ELSE 'Assistente' END || ']: ' || regexp_replace(coalesce(text, ''), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), chr(10) ORDER BY p) AS context FROM k WHERE r <= 10 GROUP BY 1""",
)
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    return chat.context_window(messages(spark, folder))


@register(
    "context_newest_first", "WIN8",
    sql="SELECT conv_id AS session_id, turn AS message_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations QUALIFY place <= 3",
)
def context_newest_first(spark: SparkSession, folder: str) -> DataFrame:
    """The older form of the context: the last messages, newest first."""
    return chat.newest_first(messages(spark, folder), 3).select("session_id", "message_id", F.col("place").cast("bigint").alias("place"))


@register(
    "session_mentions", "AGG8",
    sql=f"""WITH {CITED} SELECT DISTINCT session_id, kind, value FROM (SELECT session_id, 'supplier' AS kind, issuer_name AS value FROM c UNION ALL SELECT session_id, 'cnpj', issuer_cnpj FROM c
  UNION ALL SELECT session_id, 'type', document_type FROM c) WHERE value <> ''""",
)
def session_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return chat.mentions(cited(spark, folder))


@register(
    "session_facts", "AGG8",
    sql=f"""WITH {CITED}, m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE text <> ''),
e AS (SELECT session_id, count(*) FILTER (validation_status = 'error') AS n FROM c GROUP BY 1)
SELECT conv_id AS session_id, coalesce(max(n), 0) AS n_errors, string_agg(left(text, 80), ', ' ORDER BY turn) AS topics FROM m LEFT JOIN e ON session_id = conv_id WHERE r <= 3 GROUP BY 1""",
)
def session_facts(spark: SparkSession, folder: str) -> DataFrame:
    return chat.session_facts(cited(spark, folder), messages(spark, folder))


@register(
    "recurring_errors", "AGG9",
    sql=f"WITH {CITED} SELECT session_id, issuer_cnpj, count(*) AS n_errors FROM c WHERE validation_status = 'error' AND issuer_cnpj IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
)
def recurring_errors(spark: SparkSession, folder: str) -> DataFrame:
    return chat.recurring_errors(cited(spark, folder))


@register(
    "last_cited_documents", "WIN9",
    sql=f"""WITH {CITED} SELECT session_id, message_id, document_type FROM c WHERE message_type = 'assistant' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, message_id DESC) = 1""",
)
def last_cited_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chat.last_cited(cited(spark, folder)).select("session_id", "message_id", "document_type")


# ---------------------------------------------------------------- history and upkeep


@register(
    "history_timeline", "WIN6", "WIN10", "WRT4",
    sql="SELECT user_id AS document_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
)
def history_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Events numbered per document; days are the buckets, so a document with very many events is split."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("document_id"), "event_id", "event_type", "ts")
    return relate.numbered(e, ["document_id"], ["ts", "event_id"], F.col("ts").cast("date")).drop("ts")


@register(
    "analysis_sequence", "WRT4",
    sql="""WITH mx AS (SELECT user_id, max(event_id % 1000) AS m FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT e.user_id AS document_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) + coalesce(m, 0) AS analysis_id FROM events e LEFT JOIN mx ON mx.user_id = e.user_id WHERE event_type <> 'view'""",
)
def analysis_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """New analyses continue after the largest number of the stored ones, whose numbers have gaps."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("document_id"), "event_id", "event_type", "ts")
    analyses = e.filter("event_type = 'view'").select("document_id", (F.col("event_id") % 1000).alias("analysis_id"))
    stored = analyses.groupBy("document_id").agg(F.max("analysis_id").alias("_max"))
    fresh = relate.numbered(e.filter("event_type <> 'view'"), ["document_id"], ["ts", "event_id"], F.col("ts").cast("date"))
    return fresh.join(stored, "document_id", "left").select(
        "document_id", "event_id", (F.col("seq") + F.coalesce("_max", F.lit(0))).alias("analysis_id")
    )


@register(
    "insights_by_confidence", "WIN10", "WRT7",
    sql="SELECT user_id, event_id, CAST(greatest(0.0, least(1.0, value / 100.0)) AS DECIMAL(3,2))::DOUBLE AS confidence FROM events WHERE event_type = 'click' ORDER BY 3 DESC",
)
def insights_by_confidence(spark: SparkSession, folder: str) -> DataFrame:
    confidence = relate.clamped_confidence(F.round(F.col("value") / 100.0, 4))
    e = table(spark, folder, "events").filter("event_type = 'click'")
    return e.select("user_id", "event_id", confidence.cast("double").alias("confidence")).orderBy(F.desc("confidence"))


@register(
    "upsert_latest", "WRT1", "WRT2",
    sql="""WITH u AS (SELECT user_id AS id, event_type AS status, ts, event_id FROM events UNION ALL SELECT user_id, 'rewritten', ts + INTERVAL 1 HOUR, event_id FROM events WHERE event_id % 3 = 0)
SELECT id, status, event_id FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1""",
)
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "ts", "event_id")
    changes = e.filter("event_id % 3 = 0").withColumns({"status": F.lit("rewritten"), "ts": F.col("ts") + F.expr("INTERVAL 1 HOUR")})
    return relate.upsert(e, changes, ["id"], "ts", "event_id").select("id", "status", "event_id")


@register(
    "history_append", "WRT3",
    sql="SELECT coalesce(user_id, 0) AS fiscal_document_id, event_type, count(*) AS n_events FROM (SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS fiscal_document_id, CASE WHEN event_id % 8 = 4 THEN NULL ELSE user_id END AS user_id, event_type FROM events) WHERE coalesce(fiscal_document_id, user_id) IS NOT NULL GROUP BY 1, 2",
)
def history_append(spark: SparkSession, folder: str) -> DataFrame:
    """Events may name their document under an older column; those with neither are refused."""
    key = F.col("event_id")
    e = table(spark, folder, "events").select(
        F.when(key % 4 != 0, F.col("user_id")).alias("fiscal_document_id"), F.when(key % 8 != 4, F.col("user_id")).alias("document_id"), "event_type"
    )
    named = e.withColumn("fiscal_document_id", F.coalesce("fiscal_document_id", "document_id")).filter("fiscal_document_id IS NOT NULL")
    path = fresh_folder(spark, "history-table")
    relate.append(named.filter("event_type = 'view'"), path)
    stored = relate.append(named.filter("event_type <> 'view'"), path)
    return stored.groupBy("fiscal_document_id", "event_type").agg(F.count("*").alias("n_events"))


@register(
    "cascade_delete", "WRT5",
    sql="""WITH gone AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT 'events' AS child, user_id AS doc_id, count(*) AS n_rows FROM events WHERE user_id NOT IN (FROM gone) GROUP BY ALL
UNION ALL SELECT 'conversations', conv_id, count(*) FROM conversations WHERE conv_id NOT IN (FROM gone) GROUP BY ALL
UNION ALL SELECT 'embeddings', vec_id, count(*) FROM embeddings WHERE vec_id NOT IN (FROM gone) GROUP BY ALL""",
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected documents take the rows of all their child tables with them."""
    gone = table(spark, folder, "labels").filter("quality = 0").select("doc_id")
    children = {n: (table(spark, folder, n), key) for n, key in (("events", "user_id"), ("conversations", "conv_id"), ("embeddings", "vec_id"))}
    left = relate.cascade_delete_all(children, gone, "doc_id")
    counted = [df.groupBy(F.lit(n).alias("child"), F.col(children[n][1]).alias("doc_id")).agg(F.count("*").alias("n_rows")) for n, df in left.items()]
    return reduce(DataFrame.union, counted)


@register(
    "cascade_levels", "WRT5",
    sql="""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
SELECT 'customer' AS level, c_custkey AS key, count(*) AS n_rows FROM customer WHERE c_nationkey NOT IN (FROM n) GROUP BY ALL
UNION ALL SELECT 'orders', o_orderkey, count(*) FROM orders WHERE o_custkey NOT IN (FROM c) GROUP BY ALL
UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM o) GROUP BY ALL""",
)
def cascade_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The nations of a region go, and with them their customers, those customers' orders and their lines."""
    gone = table(spark, folder, "nation").filter("n_regionkey = 2").select("n_nationkey")
    keys = {"customer": ("c_custkey", "c_nationkey"), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_orderkey")}
    left = relate.cascade_levels([(n, table(spark, folder, n), own, above) for n, (own, above) in keys.items()], gone, "n_nationkey")
    counted = [df.groupBy(F.lit(n).alias("level"), F.col(keys[n][0]).alias("key")).agg(F.count("*").alias("n_rows")) for n, df in left.items()]
    return reduce(DataFrame.union, counted)


@register(
    "status_update", "WRT6",
    sql="SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' END, 'pending') AS embedding_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def status_update(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.lit("pending").alias("embedding_status"))
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed")
    return relate.update_status(d, table(spark, folder, "labels").select("doc_id", status.alias("embedding_status")), "doc_id", "embedding_status")


@register("duplicate_chunks", "WRT8", sql="SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return relate.duplicated(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@register(
    "constraint_quarantine", "WRT9",
    sql="SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'message_type' WHEN length(text) < 40 THEN 'content' END AS violated FROM conversations WHERE role NOT IN ('user', 'assistant') OR length(text) < 40",
)
def constraint_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    violated = F.when(~F.col("role").isin("user", "assistant"), "message_type").when(F.length("text") < 40, "content")
    return table(spark, folder, "conversations").select("conv_id", "turn", violated.alias("violated")).filter("violated IS NOT NULL")


@register(
    "purge_expired", "WRT10",
    sql="SELECT event_id, event_type FROM events WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-15'",
)
def purge_expired(spark: SparkSession, folder: str) -> DataFrame:
    """The table written anew without the rows whose time is over, and read back."""
    alive = F.col("ts") + F.expr("INTERVAL 30 DAYS") > F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")
    return relate.rewritten(table(spark, folder, "events"), alive, fresh_folder(spark, "purged")).select("event_id", "event_type")


@register(
    "cached_results", "WRT11", "FN12",
    sql="SELECT DISTINCT sha256(text) AS digest, sha256(text) IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id) AS cached FROM documents",
)
def cached_results(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct text once: served from the results of labelled documents, or still to be done."""
    d = table(spark, folder, "documents").select("doc_id", content_key(F.col("text")).alias("digest"))
    return relate.with_cached(d, d.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi"), "digest")


@register(
    "cached_answers", "WRT11", "FN12",
    sql="""WITH c AS (SELECT sha256(d.text) AS digest, min({'q': quality, 't': toxic}) AS r FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
SELECT DISTINCT sha256(text) AS digest, r IS NOT NULL AS cached, r.q AS quality, r.t AS toxic FROM documents LEFT JOIN c ON c.digest = sha256(text)""",
)
def cached_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct text once, with the stored result of a labelled document of the same content where there is one."""
    d = table(spark, folder, "documents").select("doc_id", content_key(F.col("text")).alias("digest"))
    return relate.with_cached(d, d.join(table(spark, folder, "labels"), "doc_id"), "digest", "quality", "toxic")


@register(
    "unseen_only", "WRT11", "FN12",
    sql="SELECT DISTINCT sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id)",
)
def unseen_only(spark: SparkSession, folder: str) -> DataFrame:
    """Texts still to be embedded: no labelled document has the same content."""
    d = table(spark, folder, "documents").select("doc_id", content_key(F.col("text")).alias("digest"))
    cached = d.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return relate.unseen(d, cached, "digest").select("digest")


@register(
    "merged_matches", "SET1",
    sql="""WITH a AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error'), b AS (SELECT doc_id AS id FROM labels)
SELECT id, 'history' AS found_by FROM a UNION ALL SELECT id, 'labels' FROM b WHERE id NOT IN (SELECT id FROM a)""",
)
def merged_matches(spark: SparkSession, folder: str) -> DataFrame:
    by_history = table(spark, folder, "events").filter("event_type = 'error'").select(F.col("user_id").alias("id"), F.lit("history").alias("found_by"))
    by_label = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.lit("labels").alias("found_by"))
    return relate.first_source_wins([by_history, by_label], "id")


@register("distinct_ids", "SET2", sql="SELECT DISTINCT user_id AS id FROM events UNION SELECT doc_id FROM documents")
def distinct_ids(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "events").select(F.col("user_id").alias("id"))
    return a.union(table(spark, folder, "documents").select("doc_id")).distinct()


@register(
    "json_props_rollup", "JSN1",
    sql="SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n_events FROM events GROUP BY 1, 2",
)
def json_props_rollup(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, folder, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n_events"))
