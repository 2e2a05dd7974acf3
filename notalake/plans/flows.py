"""Streams, file routes and exports, each read back as a table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder
from ..sources import exports, files, fiscal_view as fv, xml_text as xt
from ..sources.tables import table
from ..streaming import jobs
from . import sqlviews as q
from .listing import LIST, listing
from .registry import register


@register(
    "history_stream", "STR2", "WRT3",
    sql="""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total_value FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2""",
)
def history_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of a stream that ran until it had caught up; days still open are not emitted."""
    out = fresh_folder(spark, "history")
    jobs.run_to_files(jobs.history_counts(jobs.event_stream(spark, folder)), out, out + "-ckpt")
    result = spark.read.schema("window_start timestamp, event_type string, n_events bigint, total_value double").parquet(out)
    return result.select(F.date_format(jobs.wall_clock(F.col("window_start")), "yyyy-MM-dd").alias("window_start"), "event_type", "n_events", F.round("total_value", 4).alias("total_value"))


@register(
    "expiring_dedupe_stream", "STR3", "FLT10",
    sql="""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
passed AS (SELECT user_id, event_id, ts, n, ts AS last, true AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ts, o.n, CASE WHEN o.ts >= p.last + INTERVAL 7 DAY THEN o.ts ELSE p.last END, o.ts >= p.last + INTERVAL 7 DAY
  FROM passed p JOIN o ON o.user_id = p.user_id AND o.n = p.n + 1)
SELECT user_id, event_id FROM passed WHERE kept""",
)
def expiring_dedupe_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user that find no entry of the user's: an entry lives for a week. The folder is a backlog, so nothing in it is too late."""
    out = fresh_folder(spark, "first")
    passed = jobs.first_within(jobs.event_stream(spark, folder), "user_id", datetime.timedelta(days=7), lateness=datetime.timedelta(days=36_500))
    jobs.run_to_files(passed, out, out + "-ckpt")
    return spark.read.schema("event_id bigint, user_id bigint").parquet(out).select("user_id", "event_id")


@register(
    "xml_ingest_stream", "STR1", "WRT1", "SRC1",
    sql=f"""WITH {q.HEADERS} SELECT 'doc_' || id || '.xml' AS file_name, coalesce(document_type, 'NFe') AS tipo_documento, numero FROM h WHERE id % 50 < 46""",
)
def xml_ingest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """XML texts arrive as a stream, every batch rewrites the buckets it touches, the newest version of each is read."""
    return jobs.current_documents(spark, f"{_ingested(spark, folder)}/documents").select("file_name", "tipo_documento", "numero")


def _ingested(spark: SparkSession, folder: str) -> str:
    """Where the documents, links and rejects of a stream over all XML documents are."""
    base = fresh_folder(spark, "ingest")
    name = F.concat(F.lit("doc_"), F.col("id").cast("string"), F.lit(".xml"))
    # Every batch rewrites its buckets, so the inbox has no more files than cores; a batch splits them as it reads.
    xt.order_documents(spark, folder, task_rows=None).select(name.alias("file_name"), "xml").write.parquet(f"{base}/inbox")
    arriving = spark.readStream.schema("file_name string, xml string").option("maxFilesPerTrigger", 64).parquet(f"{base}/inbox")
    jobs.ingest_xml(arriving, f"{base}/documents", f"{base}/rejected", f"{base}/ckpt", f"{base}/links")
    return base


@register(
    "ingested_links", "STR1", "XML6", "JOIN9",
    sql=f"""WITH {q.HEADERS}, g AS (SELECT id, coalesce(document_type, 'NFe') AS tipo FROM h WHERE id % 50 < 46), m AS (SELECT id AS manifest_id, id + unnest([1, 2, 7]) AS linked_id FROM g WHERE tipo = 'MDFe')
SELECT 'doc_' || manifest_id || '.xml' AS file_name, lpad(CAST(linked_id AS VARCHAR), 44, '0') AS chave, '5.00' AS valor, n.id IS NOT NULL AS is_stored
FROM m LEFT JOIN (SELECT id FROM g WHERE tipo IN ('NFe', 'NFCe')) n ON n.id = linked_id""",
)
def ingested_links(spark: SparkSession, folder: str) -> DataFrame:
    """What the manifests of the stream carry, and whether the note behind each key was ingested as well."""
    base = _ingested(spark, folder)
    links = spark.read.schema("file_name string, chave string, valor string").parquet(f"{base}/links")
    notes = jobs.current_documents(spark, f"{base}/documents").filter(F.col("tipo_documento").isin("NFe", "NFCe"))
    known = notes.select(F.col("chave_id").alias("chave"), F.lit(True).alias("known")).dropDuplicates(["chave"])
    return links.join(known, "chave", "left").select("file_name", "chave", "valor", F.coalesce("known", F.lit(False)).alias("is_stored"))


@register(
    "file_routes", "SRC2",
    sql="""WITH f AS (SELECT page_id, url, lower(regexp_extract(split_part(url, '/', -1) || ['.xml', '.PDF', '.jpeg', '.docx', ''][page_id % 5 + 1], '\\.([^./]+)$', 1)) AS e FROM pages)
SELECT page_id, e AS extension, CASE WHEN e = 'xml' THEN 'xml' WHEN e IN ('pdf', 'png', 'jpg', 'jpeg') THEN 'text' ELSE 'none' END AS route, e IN ('xml', 'pdf', 'png', 'jpg', 'jpeg') AS supported,
  CASE WHEN e NOT IN ('xml', 'pdf', 'png', 'jpg', 'jpeg') THEN 'unsupported_file_type' END AS error_code FROM f""",
)
def file_routes(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array(*[F.lit(e) for e in (".xml", ".PDF", ".jpeg", ".docx", "")])
    name = F.concat(F.substring_index("url", "/", -1), F.element_at(kinds, (F.col("page_id") % 5).cast("int") + 1))
    named = table(spark, folder, "pages").select("page_id", name.alias("file_name"))
    return files.routed(named).drop("file_name")


@register(
    "csv_with_bad_rows", "SRC4", "SRC3",
    sql="""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN ', Ltda' ELSE '' END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 4 <> 1""",
)
def csv_with_bad_rows(spark: SparkSession, folder: str) -> DataFrame:
    """CSV lines, quoted, some names with a comma; every fourth line has a field too many and is dropped."""
    quote = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit(", Ltda")).otherwise(""))
    extra = F.when(F.col("c_custkey") % 4 == 1, F.lit(",x")).otherwise("")
    lines = table(spark, folder, "customer").select(
        F.concat(F.concat_ws(",", quote(F.col("c_custkey")), quote(name), quote(F.col("c_mktsegment"))), extra).alias("value")
    )
    return files.csv_text(lines, ["id", "name", "segment"])


@register(
    "csv_inferred", "SRC3",
    sql="SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, CAST(max(c_custkey) AS BIGINT) AS last_key FROM customer GROUP BY 1",
)
def csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as CSV and read back with inferred types."""
    path = fresh_folder(spark, "csv")
    table(spark, folder, "customer").write.option("header", True).csv(path)
    read = files.csv_table(spark, path)
    return read.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_custkey").cast("bigint").alias("last_key")
    )


@register(
    "listing_csv_export", "SNK1",
    sql=f"""{LIST} SELECT CAST(id AS VARCHAR) AS id, coalesce(document_type, '') AS document_type, coalesce(replace(printf('%.2f', total_value), '.', ','), '') AS total_value FROM d""",
)
def listing_csv_export(spark: SparkSession, folder: str) -> DataFrame:
    """The semicolon export, read back as text."""
    path = fresh_folder(spark, "export")
    exports.write_csv(listing(spark, folder).select("id", "document_type", "total_value"), path, mark=False)
    read = spark.read.option("sep", ";").option("header", True).schema("id string, document_type string, total_value string").csv(path)
    return read.na.fill("")


@register("listing_json_export", "SNK2", sql=f"{LIST} SELECT id, document_type, issuer_name, total_value FROM d")
def listing_json_export(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "json")
    exports.write_json(listing(spark, folder).select("id", "document_type", "issuer_name", "total_value"), path)
    return spark.read.schema("id bigint, document_type string, issuer_name string, total_value double").json(path)


MONEY = "'R$ ' || replace(replace(replace(format('{{:,.2f}}', {0} / 100.0), ',', 'X'), '.', ','), 'X', '.')".format


@register(
    "items_export", "SNK3", "PRJ4",
    sql=f"""WITH {q.ITEMS} SELECT document_id, item_no AS "Item", coalesce(descricao, 'N/A') AS "Descricao", CAST(quantidade AS VARCHAR) AS "Quantidade", {MONEY('unit_cents')} AS "Valor_Unitario",
  {MONEY('total_cents')} AS "Valor_Total", coalesce(ncm, 'N/A') AS "NCM", cfop AS "CFOP" FROM i""",
)
def items_export(spark: SparkSession, folder: str) -> DataFrame:
    return exports.item_listing(fv.items(spark, folder), "document_id")


@register(
    "item_table", "PRJ4", "ARR1",
    sql=f"""WITH {q.ITEMS} SELECT document_id, count(*) AS n_items, CAST(sum(total_cents) AS BIGINT) AS total_cents, count(*) FILTER (trim(coalesce(ncm, '')) = '') > 0 AS any_without_ncm, count(*) FILTER (quantidade <= 0) = 0 AS all_with_quantity FROM i GROUP BY 1""",
)
def item_table(spark: SparkSession, folder: str) -> DataFrame:
    """Item lists summarised by ordinary aggregates instead of being gathered into arrays."""
    without = F.coalesce(F.trim("ncm"), F.lit("")) == ""
    return fv.items(spark, folder).groupBy("document_id").agg(
        F.count("*").alias("n_items"),
        F.sum("total_cents").alias("total_cents"),
        F.bool_or(without).alias("any_without_ncm"),
        F.bool_and(F.col("quantidade") > 0).alias("all_with_quantity"),
    )


