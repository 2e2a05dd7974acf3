"""Filters, search, paging and record shapes over the document list."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import records, search, validate
from ..session import fresh_folder
from ..sources import fiscal_view as fv
from ..sources.tables import table, target_columns
from . import sqlviews as q
from .registry import register
from .validation import VERDICT_SQL

H = f"WITH {q.HEADERS}"
TOTAL = "CAST(total_cents AS DOUBLE) / 100"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under the column names of the store."""
    kind = F.coalesce(F.lower("document_type"), F.lit("scan"))
    return fv.headers(spark, folder).select(
        "id",
        "document_type",
        F.col("numero").alias("document_number"),
        F.col("emitente_cnpj").alias("issuer_cnpj"),
        F.col("emitente_razao_social").alias("issuer_name"),
        F.col("destinatario_doc").alias("recipient_cnpj"),
        F.col("destinatario_razao_social").alias("recipient_name"),
        (F.col("total_cents").cast("double") / 100).alias("total_value"),
        F.concat(kind, F.lit("_"), F.col("id").cast("string"), F.lit(".xml")).alias("file_name"),
        "created_at",
    )


LIST = f"""{H}, d AS (SELECT id, document_type, numero AS document_number, emitente_cnpj AS issuer_cnpj, emitente_razao_social AS issuer_name,
  destinatario_doc AS recipient_cnpj, destinatario_razao_social AS recipient_name, {TOTAL} AS total_value,
  coalesce(lower(document_type), 'scan') || '_' || id || '.xml' AS file_name, created_at FROM h)"""
FACETS = dict(document_type="nf", issuer_cnpj="11.22", issuer_name="", created_after=datetime(1996, 1, 1), created_before=datetime(2000, 1, 1))
FACET_SQL = """document_type ILIKE '%nf%' AND replace(issuer_cnpj, '.', '') ILIKE '%1122%'
  AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-01-01'"""


@register(
    "facet_filter", "FLT1",
    sql=f"{LIST} SELECT id, document_type, issuer_cnpj, strftime(created_at, '%Y-%m-%d') AS created_on FROM d WHERE {FACET_SQL}",
)
def facet_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = search.facet_filter(listing(spark, folder), **FACETS)
    return found.select("id", "document_type", "issuer_cnpj", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@register(
    "facet_filter_page", "FLT1", "WIN4", "WIN5",
    sql=f"{LIST} SELECT id, document_type, issuer_cnpj, total_value FROM d WHERE {FACET_SQL} ORDER BY total_value DESC NULLS FIRST, id LIMIT 25 OFFSET 25",
)
def facet_filter_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of 25, largest totals first; documents without a total lead."""
    found = search.facet_filter(listing(spark, folder), **FACETS)
    return search.page(found, 2, 25, "total_value", "desc").select("id", "document_type", "issuer_cnpj", "total_value")


@register(
    "deep_page", "WIN4", "WIN5",
    sql=f"""{LIST} SELECT id, strftime(created_at, '%Y-%m-%d') AS created_on FROM d
ORDER BY created_at DESC NULLS FIRST, id LIMIT 100 OFFSET 12000""",
)
def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page far down the list: only the ranges that hold it are opened."""
    path = fresh_folder(spark, "pages")
    search.rank_index(listing(spark, folder), path, "created_at", "desc")
    found = search.ranked_page(spark, path, 121, 100, "created_at", "desc")
    return found.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@register(
    "deep_page_by_type", "WIN4", "WIN5",
    sql=f"""{LIST} SELECT id, document_type FROM d ORDER BY document_type NULLS LAST, id LIMIT 50 OFFSET 11000""",
)
def deep_page_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """A deep page under a sort key of a handful of values: the tie-break spreads their rows over ranges."""
    path = fresh_folder(spark, "pages")
    search.rank_index(listing(spark, folder), path, "document_type", "asc", ranges=16)
    return search.ranked_page(spark, path, 221, 50, "document_type", "asc").select("id", "document_type")


@register(
    "next_page", "WIN5",
    sql=f"""{LIST}, p AS (SELECT id, total_value, row_number() OVER (ORDER BY total_value DESC NULLS FIRST, id) AS n FROM d) SELECT id, total_value FROM p WHERE n > 40 AND n <= 70""",
)
def next_page(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty rows after the second page of twenty, from that page's last row."""
    docs = listing(spark, folder)
    last = search.page(docs, 2, 20, "total_value").select("total_value", "id").tail(1)[0]
    return search.page_after(docs, last["total_value"], last["id"], 30, "total_value").select("id", "total_value")


@register(
    "facet_page_totals", "AGG11",
    sql=f"{LIST} SELECT count(*) AS total, CAST(2 AS BIGINT) AS page, CAST(25 AS BIGINT) AS page_size, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages FROM d WHERE {FACET_SQL}",
)
def facet_page_totals(spark: SparkSession, folder: str) -> DataFrame:
    return search.page_totals(search.facet_filter(listing(spark, folder), **FACETS), 2, 25)


@register(
    "exact_filter", "FLT2",
    sql=f"{LIST} SELECT id, document_type, issuer_name FROM d WHERE document_type = 'NFe' AND issuer_name = 'Emitente 7'",
)
def exact_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = search.exact_filter(listing(spark, folder), document_type="NFe", issuer_name="Emitente 7", no_such_column="x")
    return found.select("id", "document_type", "issuer_name")


@register(
    "criteria_search", "FLT3", "WIN2",
    sql=f"""{LIST} SELECT id, document_type, strftime(created_at, '%Y-%m-%d') AS created_on FROM d WHERE document_type = 'CTe'
  AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-06-30' ORDER BY created_at DESC, id LIMIT 10""",
)
def criteria_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.criteria_search(listing(spark, folder), document_type="CTe", date_from="1996-01-01 00:00:00", date_to="1999-06-30 00:00:00")
    return found.select("id", "document_type", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


FIELDS = ("issuer_name", "issuer_cnpj", "recipient_name", "recipient_cnpj", "file_name", "document_number")


@register(
    "multi_field_search", "FLT4", "FLT5",
    sql=f"""{LIST} SELECT id, file_name, issuer_name FROM d WHERE contains(lower(concat_ws('|', issuer_name, issuer_cnpj, recipient_name, recipient_cnpj, file_name, document_number)), 'emitente 12')""",
)
def multi_field_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every match; nothing is cut off before the text is looked at."""
    return search.contains_text(listing(spark, folder), "EMITENTE 12", *FIELDS).select("id", "file_name", "issuer_name")


@register(
    "multi_field_search_top", "FLT4", "WIN2",
    sql=f"""{LIST} SELECT id, file_name FROM d WHERE contains(lower(concat_ws('|', issuer_name, issuer_cnpj, recipient_name, recipient_cnpj, file_name, document_number)), 'emitente 12')
ORDER BY created_at DESC NULLS FIRST, id LIMIT 20""",
)
def multi_field_search_top(spark: SparkSession, folder: str) -> DataFrame:
    found = search.contains_text(listing(spark, folder), "EMITENTE 12", *FIELDS)
    return search.page(found, 1, 20).select("id", "file_name")


@register(
    "reference_match", "FLT6",
    sql=f"""{LIST}, f AS (SELECT id, unnest([file_name, document_number, CAST(id AS VARCHAR), issuer_cnpj, issuer_name, recipient_cnpj, recipient_name]) AS v FROM d)
SELECT DISTINCT id FROM f WHERE contains(lower(v), 'nfe_12') OR contains(regexp_replace(lower(v), '[^0-9]', '', 'g'), '12') AND regexp_replace(lower(v), '[^0-9]', '', 'g') <> ''""",
)
def reference_match(spark: SparkSession, folder: str) -> DataFrame:
    """Documents meant by `NFe_12`: by text or by its digits alone."""
    fields = ("file_name", "document_number", "id", "issuer_cnpj", "issuer_name", "recipient_cnpj", "recipient_name")
    return listing(spark, folder).filter(search.matches_reference("NFe_12", *fields)).select("id")


@register(
    "required_fields_gate", "FLT7",
    sql=f"""WITH {q.HEADERS}, {q.ITEMS}, n AS (SELECT DISTINCT document_id FROM i),
m AS (SELECT h.id, concat_ws(', ', CASE WHEN emitente_cnpj IS NULL AND emitente_razao_social IS NULL THEN 'emitente' END,
  CASE WHEN n.document_id IS NULL THEN 'itens' END, CASE WHEN total_cents IS NULL THEN 'total' END) AS missing FROM h LEFT JOIN n ON n.document_id = h.id)
SELECT id, missing FROM m WHERE missing <> ''""",
)
def required_fields_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that may not be imported, with what they lack."""
    h, totals = fv.headers(spark, folder), validate.item_totals(fv.items(spark, folder))
    joined = h.join(totals, h["id"] == totals["document_id"], "left")
    lacking = search.missing_required(F.coalesce("emitente_cnpj", "emitente_razao_social"), F.col("n_items"), F.col("total_cents"))
    return joined.select("id", lacking.alias("missing")).filter("missing <> ''")


@register(
    "unprocessed_documents", "FLT9",
    sql="""SELECT d.doc_id, CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' END AS embedding_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE coalesce(quality, 0) <> 1""",
)
def unprocessed_documents(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed")
    d = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return search.unprocessed(d.select("doc_id", status.alias("embedding_status")))


@register(
    "unexpired_entries", "FLT10",
    sql="SELECT event_id, strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS expires_at FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'",
)
def unexpired_entries(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    live = search.unexpired(e, "2024-01-20 00:00:00")
    return live.select("event_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@register(
    "recent_by_phrase", "FN10",
    sql="SELECT event_type, count(*) AS n_events FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1",
)
def recent_by_phrase(spark: SparkSession, folder: str) -> DataFrame:
    since = dates.lower_bound("últimos 10 dias", datetime(2024, 1, 30, 12, 0, 0))
    recent = table(spark, folder, "events").filter(F.col("ts") >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n_events"))


@register(
    "listing_rows", "PRJ2",
    sql=f"""WITH vv AS ({VERDICT_SQL}), hh AS (WITH {q.HEADERS} SELECT * FROM h)
SELECT hh.id, coalesce(document_type, 'Desconhecido') AS tipo, coalesce(numero, 'N/A') AS numero, coalesce(emitente_razao_social, 'N/A') AS emitente,
  coalesce(emitente_cnpj, 'N/A') AS cnpj_emitente, coalesce(destinatario_razao_social, 'N/A') AS destinatario,
  'R$ ' || replace(replace(replace(format('{{:,.2f}}', CASE WHEN coalesce(total_cents, 0) <> 0 THEN total_cents / 100.0 ELSE custkey / 1.0 END), ',', 'X'), '.', ','), 'X', '.') AS valor_total,
  n_items AS itens, n_errors AS erros, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS processado FROM hh JOIN vv ON vv.id = hh.id""",
)
def listing_rows(spark: SparkSession, folder: str) -> DataFrame:
    h = fv.headers(spark, folder)
    joined = h.join(validate.verdicts(h, fv.items(spark, folder)).drop("calculated_cents"), "id")
    shaped = joined.withColumns(
        {
            "total": F.col("total_cents").cast("double") / 100,
            "valor_servico": F.col("custkey").cast("double"),
            "total_value": F.lit(0.0),
        }
    )
    return records.listing_row(shaped)


@register(
    "storage_records", "PRJ1",
    sql=f"""WITH vv AS ({VERDICT_SQL}), hh AS (WITH {q.HEADERS} SELECT * FROM h), f AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'cte_' ELSE 'doc_' END || id || '.pdf' AS file_name FROM hh)
SELECT f.id, file_name, coalesce(document_type, CASE WHEN id % 4 = 0 THEN 'CTe' ELSE 'NFe' END) AS document_type, coalesce(numero, 'SEM_NUMERO') AS document_number,
  coalesce(emitente_cnpj, '00000000000000') AS issuer_cnpj, coalesce(emitente_razao_social, 'Emitente não identificado') AS issuer_name,
  destinatario_doc AS recipient_cnpj, destinatario_razao_social AS recipient_name,
  CASE id % 7 WHEN 1 THEN strftime(created_at, '%Y-%m-%dT00:00:00Z') WHEN 2 THEN strftime(created_at, '%Y-%m-%d') WHEN 3 THEN strftime(created_at, '%Y-%m-%dT00:00:00Z') WHEN 4 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') END AS issue_date,
  coalesce({TOTAL}, 0.0) AS total_value, cfop, status AS validation_status, n_errors > 0 AS has_issues, n_warnings > 0 AS has_warnings, n_items AS item_count
FROM f JOIN vv USING (id)""",
)
def storage_records(spark: SparkSession, folder: str) -> DataFrame:
    h = fv.headers(spark, folder)
    lead = F.when(F.col("id") % 4 == 0, F.lit("cte_")).otherwise("doc_")
    named = h.withColumns(
        {
            "file_name": F.concat(lead, F.col("id").cast("string"), F.lit(".pdf")),
            "issue_date": dates.iso_date(F.col("data_emissao")),
            "total_value": F.col("total_cents").cast("double") / 100,
        }
    )
    return records.storage_record(named.join(validate.verdicts(h, fv.items(spark, folder)), "id"))


@register(
    "target_columns", "PRJ3", "SRC6",
    sql=f"{LIST} SELECT id, document_type, issuer_cnpj FROM d",
)
def target_columns_query(spark: SparkSession, folder: str) -> DataFrame:
    """Only what the target knows survives; the scan reads no other column."""
    return target_columns(listing(spark, folder), ["id", "document_type", "issuer_cnpj", "column_of_a_newer_release"])


@register(
    "taxes_long", "PRJ4",
    sql=f"""{H} SELECT id, 'ICMS' AS tax_type, icms_cents AS amount FROM h WHERE icms_cents IS NOT NULL UNION ALL SELECT id, 'IPI', ipi_cents FROM h WHERE ipi_cents IS NOT NULL
UNION ALL SELECT id, 'PIS', pis_cents FROM h WHERE pis_cents IS NOT NULL UNION ALL SELECT id, 'COFINS', cofins_cents FROM h WHERE cofins_cents IS NOT NULL""",
)
def taxes_long(spark: SparkSession, folder: str) -> DataFrame:
    return records.taxes_long(fv.headers(spark, folder), "id", {t: f"{t}_cents" for t in ("icms", "ipi", "pis", "cofins")})


@register(
    "metadata_json", "PRJ5",
    sql=f"""{LIST} SELECT id, '{{"id":"' || id || '","file_name":"' || file_name || '"' || coalesce(',"document_number":"' || document_number || '"', '')
  || coalesce(',"document_type":"' || document_type || '"', '') || coalesce(',"issuer_cnpj":"' || coalesce(issuer_cnpj, recipient_cnpj) || '"', '')
  || coalesce(',"issuer_name":"' || coalesce(issuer_name, recipient_name) || '"', '') || '}}' AS metadata FROM d""",
)
def metadata_json(spark: SparkSession, folder: str) -> DataFrame:
    """Missing issuer data falls back to the extracted party; empty entries vanish."""
    fields = {
        "id": F.col("id"),
        "file_name": F.col("file_name"),
        "document_number": F.col("document_number"),
        "document_type": F.col("document_type"),
        "issuer_cnpj": F.coalesce("issuer_cnpj", "recipient_cnpj"),
        "issuer_name": F.coalesce("issuer_name", "recipient_name"),
    }
    return listing(spark, folder).select("id", records.metadata_json(fields).alias("metadata"))


@register(
    "codes_to_validate", "PRJ6",
    sql=f"{H} SELECT id, cfop AS code, 'cfop' AS code_type FROM h WHERE cfop IS NOT NULL UNION ALL SELECT id, icms_cst, 'cst_icms' FROM h WHERE icms_cst IS NOT NULL UNION ALL SELECT id, ipi_cst, 'cst_ipi' FROM h WHERE ipi_cst IS NOT NULL",
)
def codes_to_validate(spark: SparkSession, folder: str) -> DataFrame:
    checks = validate.code_checks(fv.headers(spark, folder))
    return checks.filter("code_type IS NOT NULL").select("id", "code", "code_type")


@register(
    "json_or_text", "PRJ7", "JSN1",
    sql="""WITH p AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'livre ' || event_id WHEN event_id % 6 = 1 THEN NULL ELSE props END AS props FROM events)
SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN NOT json_valid(props) THEN props END AS kept_text FROM p""",
)
def json_or_text(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    text = F.when(key % 6 == 0, F.concat(F.lit("livre "), key.cast("string"))).when(key % 6 != 1, F.col("props"))
    value, kept = records.json_or_text(F.col("props"))
    e = table(spark, folder, "events").select("event_id", text.alias("props"))
    return e.select("event_id", F.try_variant_get(value, "$.k", "bigint").alias("k"), kept.alias("kept_text"))


@register(
    "raw_text_backfill", "PRJ8",
    sql="""SELECT doc_id, md5(text) AS raw_text_md5, CASE WHEN doc_id % 3 = 0 THEN '{"lang":"' || lang || '"}' END AS moved_document, CASE WHEN doc_id % 3 <> 0 THEN '{"lang":"' || lang || '"}' END AS untouched FROM documents""",
)
def raw_text_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the texts still sit inside the extracted JSON."""
    moved = F.col("doc_id") % 3 == 0
    d = table(spark, folder, "documents").select(
        "doc_id",
        F.when(~moved, F.col("text")).alias("raw_text"),
        F.to_json(F.struct(F.when(moved, F.col("text")).alias("raw_text"), "lang")).alias("extracted_data"),
    )
    filled = records.backfilled(d, "raw_text", "extracted_data", "raw_text")
    return filled.select(
        "doc_id",
        F.md5("raw_text").alias("raw_text_md5"),
        F.when(moved, F.col("extracted_data")).alias("moved_document"),
        F.when(~moved, F.col("extracted_data")).alias("untouched"),
    )


@register(
    "vector_text_audit", "PRJ9",
    sql="""SELECT count(*) AS total, count(*) FILTER (vec_id % 7 <> 0) AS with_source, count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 11 <> 0) AS converted,
  count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 11 = 0) AS failed FROM embeddings""",
)
def vector_text_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors stored as text; some are absent, some are cut off."""
    key = F.col("vec_id")
    text = F.to_json("embedding")
    stored = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.left(text, F.lit(50))).otherwise(text)
    return records.vector_audit(table(spark, folder, "embeddings").select(stored.alias("source")), "source", 64)
