"""From parsed XML documents to rule-book input, verdicts and stored records, in decimals throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..functions.numbers import money2
from . import records, validate


def cents(amount: Column) -> Column:
    """Whole cents of an amount, half to even; NULL stays NULL."""
    return (money2(amount) * 100).cast("bigint")


def headers(docs: DataFrame, key: str) -> DataFrame:
    """One row a document of `extract_xml.documents`, under the names of the rule book.

    XML states its taxes as groups of amounts, without the codes that the rule book judges; the access key and
    the other type field serve where the type is missing.
    """
    form = lambda tax: F.when(F.col(f"{tax}_valor").isNotNull(), F.lit("group"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    zero = lambda *names: [F.lit(0).cast("bigint").alias(n) for n in names]
    taxes = ("icms", "ipi", "pis", "cofins")
    return docs.select(
        F.col(key).alias("id"),
        F.col("tipo_documento").alias("document_type"),
        validate.resolved_type(F.lit(None).cast("string"), F.col("tipo_documento"), F.lit(None).cast("string"), F.col("chave")).alias("resolved_type"),
        "numero",
        "serie",
        "data_emissao",
        cents(F.col("total")).alias("total_cents"),
        F.col("emitente.cnpj").alias("emitente_cnpj"),
        F.col("emitente.razao_social").alias("emitente_razao_social"),
        F.col("destinatario").isNotNull().alias("has_recipient"),
        F.coalesce("destinatario.cnpj", "destinatario.cpf").alias("destinatario_doc"),
        F.col("destinatario.razao_social").alias("destinatario_razao_social"),
        "cfop",
        F.lit(True).alias("has_taxes"),
        *[cents(F.col(f"{t}_valor")).alias(f"{t}_cents") for t in taxes],
        *[form(t).alias(f"{t}_form") for t in taxes],
        *none("icms_cst", "icms_csosn", "ipi_cst", "pis_cst", "cofins_cst"),
        cents(F.col("icms_st_valor")).alias("st_cents"),
        *zero("st_mva", "st_rate", "ipi_rate", "pis_rate", "cofins_rate"),
    )


def items(docs: DataFrame, key: str) -> DataFrame:
    """One row an item: quantities and unit prices with four decimals, totals in whole cents."""
    rows = docs.select(F.col(key).alias("document_id"), F.posexplode("itens").alias("at", "i"))
    four = lambda c: F.bround(c.cast("decimal(28,10)"), 4).cast("decimal(18,4)")
    return rows.select(
        "document_id",
        (F.col("at") + 1).alias("item_no"),
        "i.codigo",
        "i.descricao",
        "i.ncm",
        "i.cfop",
        four(F.col("i.quantidade")).alias("quantidade"),
        (four(F.col("i.valor_unitario")) * 100).cast("decimal(18,2)").alias("unit_cents"),
        cents(F.col("i.valor_total")).alias("total_cents"),
    )


def stored_records(docs: DataFrame, key: str, file_name: str) -> DataFrame:
    """Parsed documents to rows of the document table, judged: `records.storage_record` and the counts behind its verdict.

    `docs` is read three times, so it should be a table, as ingest leaves it.
    """
    found = validate.verdicts(headers(docs, key), items(docs, key))
    named = docs.select(
        F.col(key).alias("id"),
        F.col(file_name).alias("file_name"),
        F.col("tipo_documento").alias("document_type"),
        "numero",
        F.col("emitente.cnpj").alias("emitente_cnpj"),
        F.col("emitente.razao_social").alias("emitente_razao_social"),
        F.coalesce("destinatario.cnpj", "destinatario.cpf").alias("destinatario_doc"),
        F.col("destinatario.razao_social").alias("destinatario_razao_social"),
        iso_date(F.col("data_emissao")).alias("issue_date"),
        money2(F.coalesce("total", F.lit(0.0))).alias("total_value"),
        "cfop",
    )
    # Of a wide table Spark takes a few columns for next to nothing, and would broadcast one row a document.
    judged = named.hint("merge").join(found.hint("merge"), "id")
    counts = judged.select("id", "n_errors", "n_warnings", "calculated_cents")
    return records.storage_record(judged).hint("merge").join(counts.hint("merge"), "id")
