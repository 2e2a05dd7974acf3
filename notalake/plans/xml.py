"""XML round trips: rows -> XML text -> the XML job -> rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract_xml as x, xml_records
from ..session import fresh_folder
from ..sources import xml_text as xt
from . import sqlviews as q
from .registry import register

H = f"WITH {q.HEADERS}, g AS (SELECT *, coalesce(document_type, 'NFe') AS tipo FROM h WHERE id % 50 < 46)"
M = "CAST({} AS DOUBLE) / 100".format


@register(
    "xml_roundtrip_items", "XML3", "XML7", "SRC1",
    sql=f"""WITH {q.ITEMS} SELECT document_id, item_no, 1 AS numero_item, codigo, coalesce(descricao, 'Produto não especificado') AS descricao, coalesce(ncm, '') AS ncm, cfop,
  CASE WHEN item_no % 2 = 0 THEN 'CX' ELSE 'UN' END AS unidade, CAST(quantidade AS DOUBLE) AS quantidade, {M('unit_cents')} AS valor_unitario, {M('total_cents')} AS valor_total, '00' AS cst FROM i
UNION ALL SELECT document_id, item_no, 2, 'F', 'Produto não especificado', '', '', 'UN', 0.0, 0.0, 10.5, NULL FROM i WHERE item_no = 7""",
)
def xml_roundtrip_items(spark: SparkSession, folder: str) -> DataFrame:
    docs = x.documents(xt.item_documents(spark, folder).select("document_id", "item_no", "xml"), "document_id", "item_no")
    return x.items(docs, "document_id", "item_no")


@register(
    "xml_document_types", "XML1", "XML2",
    sql=f"""WITH {q.HEADERS} SELECT id, CASE WHEN id % 50 < 46 THEN coalesce(document_type, 'NFe') END AS tipo_documento,
  CASE id % 50 WHEN 49 THEN 'xml_parse_error' WHEN 48 THEN 'invalid_xml' WHEN 47 THEN 'invalid_input' WHEN 46 THEN 'unknown_document_type' END AS error FROM h""",
)
def xml_document_types(spark: SparkSession, folder: str) -> DataFrame:
    return x.parsed(xt.order_documents(spark, folder).select("id", "xml")).select("id", "tipo_documento", "error")


@register(
    "xml_quarantine", "XML1", "SNK4",
    sql=f"""WITH {q.HEADERS} SELECT CASE id % 50 WHEN 49 THEN 'xml_parse_error' WHEN 48 THEN 'invalid_xml' WHEN 47 THEN 'invalid_input' ELSE 'unknown_document_type' END AS error,
  count(*) AS n_documents FROM h WHERE id % 50 >= 46 GROUP BY 1""",
)
def xml_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    found = x.quarantine(xt.order_documents(spark, folder).select("id", "xml"), "id")
    return found.groupBy("error").agg(F.count("*").alias("n_documents"))


@register(
    "xml_headers", "XML3", "XML4", "XML5", "XML6",
    sql=f"""{H} SELECT id, tipo AS tipo_documento, numero, serie, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS data_emissao,
  CASE tipo WHEN 'NFe' THEN '55' WHEN 'NFCe' THEN '65' WHEN 'MDFe' THEN '58' END AS modelo,
  CASE WHEN tipo = 'CTe' THEN coalesce(emitente_cnpj, destinatario_doc) ELSE emitente_cnpj END AS emitente_cnpj,
  CASE WHEN tipo = 'CTe' THEN coalesce(emitente_razao_social, destinatario_razao_social) ELSE emitente_razao_social END AS emitente_nome,
  CAST(id + 1000 AS VARCHAR) AS emitente_ie, 'Rua A & B' AS emitente_rua,
  CASE WHEN tipo <> 'MDFe' THEN destinatario_doc END AS destinatario_cnpj, CASE WHEN tipo <> 'MDFe' THEN destinatario_razao_social END AS destinatario_nome,
  CASE WHEN tipo IN ('NFe', 'NFCe') THEN CASE WHEN id % 5 <> 0 THEN coalesce({M('total_cents')}, 0.0) WHEN tipo = 'NFCe' THEN 15.0 ELSE 0.0 END ELSE coalesce({M('total_cents')}, 0.0) END AS total,
  CASE WHEN tipo IN ('NFe', 'NFCe') THEN lpad(CAST(id AS VARCHAR), 44, '0') END AS chave_id, CASE WHEN tipo = 'CTe' THEN lpad(CAST(id AS VARCHAR), 44, '0') END AS chave,
  CASE WHEN tipo = 'CTe' THEN CAST(id + 135200000000000 AS VARCHAR) END AS protocolo, CASE tipo WHEN 'CTe' THEN 'RJ' WHEN 'MDFe' THEN 'MG' END AS uf_fim,
  CASE WHEN tipo = 'MDFe' THEN 'Sem observações' END AS informacoes FROM g""",
)
def xml_headers(spark: SparkSession, folder: str) -> DataFrame:
    docs = x.documents(xt.order_documents(spark, folder).select("id", "xml"), "id")
    return docs.select(
        "id",
        "tipo_documento",
        "numero",
        "serie",
        "data_emissao",
        "modelo",
        F.col("emitente.cnpj").alias("emitente_cnpj"),
        F.col("emitente.razao_social").alias("emitente_nome"),
        F.col("emitente.ie").alias("emitente_ie"),
        F.col("emitente.endereco.logradouro").alias("emitente_rua"),
        F.col("destinatario.cnpj").alias("destinatario_cnpj"),
        F.col("destinatario.razao_social").alias("destinatario_nome"),
        "total",
        F.nullif("chave_id", F.lit("")).alias("chave_id"),
        "chave",
        F.col("protocolo_autorizacao").alias("protocolo"),
        "uf_fim",
        F.col("informacoes_adicionais").alias("informacoes"),
    )


@register(
    "xml_taxes", "XML9",
    sql=f"""{H} SELECT id, CASE WHEN tipo <> 'MDFe' THEN coalesce({M('icms_cents')}, 0.0) END AS icms_valor, CASE WHEN tipo IN ('NFe', 'NFCe') THEN coalesce({M('ipi_cents')}, 0.0) END AS ipi_valor,
  CASE WHEN tipo IN ('NFe', 'NFCe') THEN coalesce({M('pis_cents')}, 0.0) END AS pis_valor, CASE WHEN tipo IN ('NFe', 'NFCe') THEN coalesce({M('cofins_cents')}, 0.0) END AS cofins_valor,
  CASE WHEN tipo IN ('NFe', 'NFCe') THEN cfop END AS cfop FROM g""",
)
def xml_taxes(spark: SparkSession, folder: str) -> DataFrame:
    docs = x.documents(xt.order_documents(spark, folder).select("id", "xml"), "id")
    return docs.select("id", "icms_valor", "ipi_valor", "pis_valor", "cofins_valor", "cfop")


@register(
    "xml_consumer_notes", "XML4",
    sql=f"""{H} SELECT id, CASE WHEN length(destinatario_doc) <= 11 THEN destinatario_doc END AS cpf, CASE WHEN has_recipient THEN 'c' || custkey || '@example.org' END AS email,
  '01' AS meio_pagamento, coalesce({M('total_cents')}, 0.0) AS pago, 0.5::DOUBLE AS troco FROM g WHERE tipo = 'NFCe'""",
)
def xml_consumer_notes(spark: SparkSession, folder: str) -> DataFrame:
    docs = x.documents(xt.order_documents(spark, folder).select("id", "xml"), "id").filter("tipo_documento = 'NFCe'")
    return docs.select(
        "id",
        F.col("destinatario.cpf").alias("cpf"),
        F.col("destinatario_email").alias("email"),
        F.col("pagamento.meio_pagamento").alias("meio_pagamento"),
        F.col("pagamento.valor").alias("pago"),
        F.col("pagamento.troco").alias("troco"),
    )


@register(
    "manifest_links", "XML6", "JOIN9",
    sql=f"""{H}, m AS (SELECT id AS manifest_id, id + unnest([1, 2, 7]) AS linked_id FROM g WHERE tipo = 'MDFe')
SELECT manifest_id, lpad(CAST(linked_id AS VARCHAR), 44, '0') AS chave, '5.00' AS valor, n.id AS document_id FROM m LEFT JOIN (SELECT id FROM g WHERE tipo IN ('NFe', 'NFCe')) n ON n.id = linked_id""",
)
def manifest_links(spark: SparkSession, folder: str) -> DataFrame:
    """What each manifest carries, and the stored note behind each key where there is one."""
    docs = x.documents(xt.order_documents(spark, folder).select("id", "xml"), "id")
    linked = x.linked_documents(docs.filter("tipo_documento = 'MDFe'"), "id")
    notes = docs.filter(F.col("tipo_documento").isin("NFe", "NFCe")).select(F.col("id").alias("document_id"), "chave_id")
    joined = linked.join(notes, linked["chave"] == notes["chave_id"], "left")
    return joined.select(F.col("id").alias("manifest_id"), "chave", "valor", "document_id")


@register(
    "xml_minimum_structure", "XML8",
    sql=f"""{H} SELECT tipo AS document_type, count(*) AS n_documents, CAST(sum(CASE WHEN tipo IN ('NFe', 'NFCe') THEN 2 ELSE 0 END) AS BIGINT) AS n_items,
  count(*) FILTER (emitente_cnpj IS NOT NULL OR emitente_razao_social IS NOT NULL OR (tipo = 'CTe' AND coalesce(destinatario_doc, destinatario_razao_social) IS NOT NULL)) AS with_issuer FROM g GROUP BY 1""",
)
def xml_minimum_structure(spark: SparkSession, folder: str) -> DataFrame:
    docs = x.with_minimum_structure(x.documents(xt.order_documents(spark, folder).select("id", "xml"), "id"))
    return docs.groupBy("document_type").agg(
        F.count("*").alias("n_documents"), F.sum(F.size("itens")).alias("n_items"), F.count_if("has_emitente").alias("with_issuer")
    )


@register(
    "xml_verdicts", "XML3", "VAL2", "VAL6", "VAL12", "PRJ1",
    sql="""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_quantity AS DECIMAL(10, 4)) + l_linenumber * CAST(0.0625 AS DECIMAL(5, 4)) AS q, l_linenumber * CAST(1.2345 AS DECIMAL(5, 4)) AS u FROM lineitem),
t AS (SELECT *, CAST(round(CAST(q AS DECIMAL(14, 4)) * CAST(u AS DECIMAL(14, 4)), 2) AS DECIMAL(18, 2)) + CASE WHEN n = 3 THEN 0.05 ELSE 0.00 END AS t FROM l),
s AS (SELECT id, count(*) AS n_items, sum(t) AS total, count(*) FILTER (n = 3) AS off FROM t GROUP BY id),
o AS (SELECT o_orderkey AS id, coalesce(n_items, 0) AS n_items, coalesce(total, 0) AS total, coalesce(off, 0) + CASE WHEN o_orderkey % 10 = 0 AND n_items > 0 THEN 1 ELSE 0 END
    + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN n_items IS NULL THEN 1 ELSE 0 END AS n_errors,
  CASE WHEN n_items IS NULL THEN 1 ELSE n_items END + 3 AS n_warnings, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders LEFT JOIN s ON s.id = o_orderkey)
SELECT id, 'nota_' || id || '.xml' AS file_name, 'NFe' AS document_type, CAST(id AS VARCHAR) AS document_number, round(CAST(total + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS DOUBLE), 2) AS total_value,
  CAST(CASE WHEN n_items > 0 THEN total * 100 ELSE 0 END AS BIGINT) AS calculated_cents, CAST(n_errors AS BIGINT) AS n_errors, CAST(n_warnings AS BIGINT) AS n_warnings, CAST(n_items AS BIGINT) AS item_count,
  CASE WHEN n_errors > 0 THEN 'error' ELSE 'warning' END AS validation_status, n_errors > 0 AS has_issues FROM o""",
)
def xml_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """XML notes of several items and fractional quantities, parsed once, stored, judged, and shaped into records."""
    path = fresh_folder(spark, "notes")
    x.documents(xt.order_notes(spark, folder), "id", "file_name").drop("_unloading").write.parquet(path)
    found = xml_records.stored_records(spark.read.parquet(path), "id", "file_name")
    return found.select(
        "id", "file_name", "document_type", "document_number", F.round("total_value", 2).alias("total_value"), "calculated_cents",
        F.col("n_errors").cast("bigint").alias("n_errors"), F.col("n_warnings").cast("bigint").alias("n_warnings"), "item_count", "validation_status", "has_issues",
    )
