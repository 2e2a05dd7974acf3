"""Reports: financial lines, portfolio values out of mixed records, store totals, chunk records, previews, references, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking, extract_xml, profile, search, summary
from ..operators.stages import computed_once, spread
from ..session import fresh_folder
from ..sources import files, fiscal_view as fv, variant_store
from ..sources.tables import table
from .listing import H, LIST, listing
from .registry import register
from .relations import TAXES
from .retrieval import TRIM, _docs

STATUS = "CASE id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'unknown' END"
EURO = "format('{{:,.2f}}', {0})".format


@register(
    "financial_report", "AGG3",
    sql=f"""{H}, b AS (SELECT *, coalesce(document_type, 'Unknown') AS type, {STATUS} AS status, CAST(total_cents AS DOUBLE) / 100 AS total FROM h),
w AS (SELECT count(*) AS n, sum(total) AS total, {', '.join(f'sum({c} / 100.0) AS {n}' for n, c in TAXES.items())} FROM b),
l AS (SELECT 0 AS part, 0.0 AS weight, 'Total de documentos analisados: ' || n AS line FROM w
  UNION ALL SELECT 1, 0, 'Valor total dos documentos: R$ ' || {EURO('total')} FROM w
  UNION ALL SELECT 2, 0, 'Distribuição por tipo de documento:' UNION ALL SELECT 3, -count(*), '  - ' || type || ': ' || count(*) || ' documentos' FROM b GROUP BY type
  UNION ALL SELECT 4, 0, 'Resumo de impostos:' {' '.join(f"UNION ALL SELECT 5, -{n}, '  - {n}: R$ ' || printf('%.2f', {n}) FROM w WHERE {n} <> 0" for n in TAXES)}
  UNION ALL SELECT 6, 0, 'Status de validação:' UNION ALL SELECT 7, 0, '  - ' || status || ': ' || count(*) || ' documentos' FROM b GROUP BY status)
SELECT CAST(part AS INTEGER) AS part, CAST(row_number() OVER (PARTITION BY part ORDER BY weight, line) AS INTEGER) AS position, line FROM l""",
)
def financial_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, value, types by falling count, taxes by falling amount, and verdicts, as lines."""
    h = fv.headers(spark, folder)
    status = F.when(F.col("id") % 3 == 0, "success").when(F.col("id") % 3 == 1, "error").otherwise("unknown")
    return summary.financial_lines(h, F.coalesce("document_type", F.lit("Unknown")), F.col("total_cents") / 100, {n: F.col(c) / 100 for n, c in TAXES.items()}, status)


def _extracted() -> Column:
    """The value of a document under one of the names it may have, or under the first of them as null."""
    value = F.when(F.col("total_value").isNotNull(), F.format_string("%.2f", "total_value")).otherwise(F.lit("null"))
    kind = F.col("id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit('{"total":'), value, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"valor_total":"'), value, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"value":'), value, F.lit(',"other":1}')))
        .when(kind == 3, F.concat(F.lit('{"total":null,"value":'), value, F.lit("}")))
        .otherwise(F.lit('{"total":"R$ 10"}'))
    )
    return F.parse_json(text)


@register(
    "portfolio_since", "AGG1",
    sql=f"""{LIST}, r AS (SELECT coalesce(document_type, 'Outros') AS type, coalesce(issuer_cnpj, 'Desconhecido') AS issuer, CASE WHEN id % 5 < 3 THEN CAST(printf('%.2f', total_value) AS DOUBLE) END AS v FROM d WHERE created_at >= TIMESTAMP '1995-06-01')
SELECT 'category' AS dimension, type AS key, count(*) AS n_documents, round(sum(v), 2) AS total_value FROM r GROUP BY type
UNION ALL SELECT 'issuer', issuer, count(*), round(sum(v), 2) FROM r GROUP BY issuer UNION ALL SELECT 'all', NULL, count(*), round(sum(v), 2) FROM r""",
)
def portfolio_since(spark: SparkSession, folder: str) -> DataFrame:
    """Types and issuers of documents since a date; their value is under `total`, `valor_total` or `value`, or is no number."""
    docs = listing(spark, folder).withColumn("extracted", _extracted())
    recent = search.facet_filter(docs, created_after="1995-06-01 00:00:00")
    found = summary.portfolio(recent, F.coalesce("document_type", F.lit("Outros")), F.coalesce("issuer_cnpj", F.lit("Desconhecido")), summary.document_value(F.col("extracted")))
    return found.withColumn("total_value", F.round("total_value", 2))


@register(
    "store_totals", "AGG4", "AGG5",
    sql="""WITH s AS (SELECT CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'documents' AS measure, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM s UNION ALL SELECT 'documents_by_status', status, count(*) FROM s GROUP BY status
UNION ALL SELECT 'chunks', NULL, count(*) FROM embeddings UNION ALL SELECT 'vectors', NULL, count(embedding) FROM embeddings
UNION ALL SELECT 'vector_bytes', NULL, CAST(sum(len(embedding) * 4) AS BIGINT) FROM embeddings UNION ALL SELECT 'insights', NULL, count(*) FROM events""",
)
def store_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and their status, chunks, vectors and their size, insights (the events)."""
    docs = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return summary.store_totals(docs, table(spark, folder, "embeddings"), table(spark, folder, "events"), status)


@register(
    "analysis_bundle_lines", "AGG12",
    sql=f"""{H}, b AS (SELECT coalesce(document_type, 'Unknown') AS type FROM h)
SELECT 'n_documents' AS part, CAST(count(*) AS VARCHAR) AS value FROM b UNION ALL SELECT DISTINCT 'document_type', type FROM b
UNION ALL SELECT 'insight', 'Total de documentos analisados: ' || count(*) FROM b UNION ALL SELECT 'insight', '  - ' || type || ': ' || count(*) || ' documentos' FROM b GROUP BY type""",
)
def analysis_bundle_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What an analysis returns: how many documents, their types, and the insights on both, out of one report."""
    h = fv.headers(spark, folder)
    kind = F.coalesce("document_type", F.lit("Unknown"))
    report = summary.financial_lines(h, kind, F.lit(0.0), {}, F.lit("unknown")).filter("part IN (0, 3)")
    parts = F.array(
        F.struct(F.lit("insight").alias("part"), F.col("line").alias("value")),
        F.when(F.col("part") == 0, F.struct(F.lit("n_documents").alias("part"), F.regexp_extract("line", r"(\d+)$", 1).alias("value"))),
        F.when(F.col("part") == 3, F.struct(F.lit("document_type").alias("part"), F.regexp_extract("line", r"^  - (.*): \d+ documentos$", 1).alias("value"))),
    )
    return report.select(F.explode(F.array_compact(parts)).alias("p")).select("p.*")


@register(
    "chunk_records", "CHK7", "WIN11",
    sql=rf"""WITH w AS (SELECT doc_id, lang, source, text, unnest(range(0, greatest(CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT), 0) + 1)) AS i FROM documents),
c AS (SELECT *, {TRIM("substr(text, i * 1000 + 1, 1200)")} AS part FROM w), k AS (SELECT *, '[Tipo de Documento: ' || coalesce(lang, '') || ', CNPJ Emissor: ' || coalesce(source, '') || ']' || chr(10) || part AS content FROM c WHERE part <> '')
SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(lang, '') AS document_type, 'doc_' || doc_id || '.txt' AS file_name, coalesce(source, '') AS issuer_cnpj, CASE WHEN doc_id % 3 = 0 THEN 'N' || doc_id ELSE '' END AS document_number,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_number, count(*) OVER (PARTITION BY doc_id) AS total_chunks, md5(content) AS content_md5, length(content) AS chunk_size, CAST(1200 AS BIGINT) AS configured_size FROM k""",
)
def chunk_records(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with everything they are stored with."""
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("N"), F.col("doc_id").cast("string")))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    fields = {"document_id": F.col("doc_id"), "document_type": F.col("lang"), "file_name": name, "issuer_cnpj": F.col("source"), "document_number": number}
    rows = chunking.chunk_records(_docs(spark, folder), t.fixed_chunks(F.col("text")), fields, 1200)
    whole = [F.col(c).cast("bigint").alias(c) for c in ("chunk_number", "total_chunks", "chunk_size", "configured_size")]
    return rows.select(*fields, *whole, F.md5("content_text").alias("content_md5"))


PREVIEWED = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@register(
    "table_preview", "EDA10",
    sql=f"""WITH f AS (SELECT {', '.join(PREVIEWED)}, row_number() OVER (ORDER BY c_custkey) AS position FROM customer QUALIFY position <= 5)
{' UNION ALL '.join(f'SELECT CAST(position AS INTEGER) AS position, {chr(39)}{c}{chr(39)} AS "column", CAST({c} AS VARCHAR) AS value FROM f' for c in PREVIEWED)}""",
)
def table_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The rows an overview shows of a table."""
    return profile.preview(table(spark, folder, "customer").select(*PREVIEWED), "c_custkey")


REFERENCE_SQL = """unnest([file_name, document_number, document_key, CAST(id AS VARCHAR), issuer_cnpj, issuer_name, issuer_cnpj, issuer_name, 'Nome E' || id, recipient_cnpj, recipient_name, 'Nome D' || (id + 7)])"""


@register(
    "reference_match_all", "FLT6", "JSN1",
    sql=f"""{LIST}, k AS (SELECT *, lpad(CAST(id AS VARCHAR), 44, '0') AS document_key FROM d), f AS (SELECT id, {REFERENCE_SQL} AS v FROM k)
SELECT DISTINCT id FROM f WHERE contains(lower(v), 'nome d15') OR contains(regexp_replace(lower(v), '[^0-9]', '', 'g'), '15') AND regexp_replace(lower(v), '[^0-9]', '', 'g') <> ''""",
)
def reference_match_all(spark: SparkSession, folder: str) -> DataFrame:
    """A reference looked for in all twelve places, six of them inside the extracted record."""
    party = lambda number, name, label, n: F.struct(F.col(number).alias("cnpj"), F.col(name).alias("razao_social"), F.concat(F.lit(label), n.cast("string")).alias("nome"))
    record = F.to_json(F.struct(party("issuer_cnpj", "issuer_name", "Nome E", F.col("id")).alias("emitente"), party("recipient_cnpj", "recipient_name", "Nome D", F.col("id") + 7).alias("destinatario")))
    keyed = listing(spark, folder).withColumn("document_key", F.lpad(F.col("id").cast("string"), 44, "0"))
    # The filter below would be pushed under these and parse the record again for every field of it.
    docs = computed_once(keyed, "extracted", F.parse_json(record))
    inside = {f"{p}_{n}": variant_store.field("extracted", f"{p}.{n}", "string") for p in ("emitente", "destinatario") for n in ("cnpj", "razao_social", "nome")}
    fields = ("file_name", "document_number", "document_key", "id", "issuer_cnpj", "issuer_name", *inside)
    read = computed_once(docs, "_inside", F.struct(*[c.alias(name) for name, c in inside.items()])).select("*", "_inside.*")
    return read.filter(search.matches_reference("Nome D15", *fields)).select("id")


@register(
    "xml_folder_scan", "SRC1", "XML3",
    sql="SELECT s_suppkey AS numero, 'Fornecedor ' || s_nationkey AS emitente, 'NFe' AS tipo_documento FROM supplier",
)
def xml_folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A folder tree of XML files, one document each, beside other files that are no XML."""
    path = fresh_folder(spark, "inbox")
    suppliers = spread(table(spark, folder, "supplier"), 10_000)  # a file a row: costly to write
    issuer = F.concat(F.lit("Fornecedor "), F.col("s_nationkey").cast("string"))
    note = F.struct(F.struct(F.col("s_suppkey").alias("nNF")).alias("ide"), F.struct(issuer.alias("xNome")).alias("emit")).alias("infNFe")
    written = suppliers.select(note, (F.col("s_suppkey") % 7).alias("day"))
    written.write.option("rootTag", "nfeProc").option("rowTag", "NFe").option("maxRecordsPerFile", 1).partitionBy("day").format("xml").save(path)
    suppliers.select("s_name").write.mode("append").text(f"{path}/notes")
    docs = extract_xml.documents(files.xml_folder(spark, path), "file_name", "size")
    return docs.filter("size > 0").select(F.col("numero").cast("bigint").alias("numero"), F.col("emitente.razao_social").alias("emitente"), "tipo_documento")
