"""Shaping of records: storage rows, listing rows, items and taxes in long form, JSON with missing parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions.numbers import currency_text


def present(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def storage_record(df: DataFrame) -> DataFrame:
    """Parsed document with its verdict -> row of the document table, with the defaults of the store."""
    file_name = F.col("file_name")
    guessed = F.when(F.lower(file_name).contains("cte"), F.lit("CTe")).otherwise("NFe")
    return df.select(
        "id",
        "file_name",
        F.coalesce(F.nullif(F.coalesce(F.col("document_type"), guessed), F.lit("")), F.lit(ref.DEFAULT_TYPE)).alias("document_type"),
        F.coalesce(present(F.col("numero")), F.lit(ref.DEFAULT_NUMBER)).alias("document_number"),
        F.coalesce(present(F.col("emitente_cnpj")), F.lit(ref.DEFAULT_CNPJ)).alias("issuer_cnpj"),
        F.coalesce(present(F.col("emitente_razao_social")), F.lit(ref.DEFAULT_ISSUER)).alias("issuer_name"),
        present(F.col("destinatario_doc")).alias("recipient_cnpj"),
        present(F.col("destinatario_razao_social")).alias("recipient_name"),
        F.col("issue_date"),
        F.coalesce(F.col("total_value"), F.lit(0.0)).alias("total_value"),
        F.col("cfop"),
        F.coalesce(F.col("status"), F.lit("pending")).alias("validation_status"),
        (F.coalesce(F.col("n_errors"), F.lit(0)) > 0).alias("has_issues"),
        (F.coalesce(F.col("n_warnings"), F.lit(0)) > 0).alias("has_warnings"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("bigint").alias("item_count"),
    )


def listing_row(df: DataFrame) -> DataFrame:
    """Row of the document list; a total of 0 falls back to the service value, then to the stored value."""
    total = F.coalesce(F.col("total"), F.lit(0.0))
    shown = F.when(total != 0, total).otherwise(F.coalesce(F.col("valor_servico"), F.col("total_value"), F.lit(0.0)))
    return df.select(
        "id",
        F.coalesce("document_type", F.lit("Desconhecido")).alias("tipo"),
        F.coalesce(present(F.col("numero")), F.lit("N/A")).alias("numero"),
        F.coalesce("emitente_razao_social", F.lit("N/A")).alias("emitente"),
        F.coalesce("emitente_cnpj", F.lit("N/A")).alias("cnpj_emitente"),
        F.coalesce("destinatario_razao_social", F.lit("N/A")).alias("destinatario"),
        currency_text(shown).alias("valor_total"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("itens"),
        F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("erros"),
        F.coalesce(F.substring(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), 1, 19), F.lit("N/A")).alias("processado"),
    )


def taxes_long(df: DataFrame, key: str, taxes: dict[str, str]) -> DataFrame:
    """(key, tax_type, amount) for every tax present."""
    long = df.unpivot([key], list(taxes.values()), "source", "amount")
    names = F.coalesce(*[F.when(F.col("source") == column, F.lit(name.upper())) for name, column in taxes.items()])
    return long.filter(F.col("amount").isNotNull()).select(key, names.alias("tax_type"), "amount")


def metadata_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields that carry something."""
    kept = [F.nullif(c.cast("string"), F.lit("")).alias(name) for name, c in fields.items()]
    return F.to_json(F.struct(*kept))


def json_or_text(text: Column) -> tuple[Column, Column]:
    """The parsed value when the text is JSON, and the untouched text when it is not."""
    value = F.try_parse_json(text)
    return value, F.when(value.isNull(), text)


def backfilled(df: DataFrame, target: str, document: str, key: str) -> DataFrame:
    """Moves `key` out of a JSON document into its own column where that column is still NULL."""
    members = F.from_json(F.col(document), "map<string,string>")
    moved = F.col(target).isNull() & F.map_contains_key(members, key)
    rest = F.to_json(F.map_filter(members, lambda k, _v: k != key))
    return df.withColumns(
        {
            target: F.coalesce(F.col(target), F.get_json_object(F.col(document), f"$.{key}")),
            document: F.when(moved, rest).otherwise(F.col(document)),
        }
    )


def vector_audit(df: DataFrame, source: str, width: int) -> DataFrame:
    """Text -> vector conversion, counted: rows, rows with text, converted, failed."""
    vector = F.from_json(F.col(source), "array<float>")
    good = vector.isNotNull() & (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())
    counted = df.select(F.col(source).isNotNull().alias("has"), F.coalesce(good, F.lit(False)).alias("good"))
    return counted.agg(
        F.count("*").alias("total"),
        F.count_if("has").alias("with_source"),
        F.count_if(F.col("has") & F.col("good")).alias("converted"),
        F.count_if(F.col("has") & ~F.col("good")).alias("failed"),
    )
