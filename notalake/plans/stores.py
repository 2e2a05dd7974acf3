"""JSON document stores of mixed records, and the findings in their validation details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import details, validate as v
from ..session import fresh_folder
from ..sources import fiscal_view as fv, variant_store
from . import sqlviews as q
from .listing import LIST, listing
from .registry import register
from .validation import HEADER_ISSUES


def _json(name: str, value: Column) -> Column:
    """A member of a JSON object; NULL where there is no value."""
    return F.concat(F.lit(f'"{name}":'), value)


def _text(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON records that differ in shape: numbers as texts, missing fields, an extra object."""
    d = listing(spark, folder)
    key = F.col("id").cast("string")
    emitente = _object(_json("razao_social", _text(F.col("issuer_name"))), _json("cnpj", _text(F.col("issuer_cnpj"))))
    total = F.format_string("%.2f", "total_value")
    record = _object(
        _json("id", F.when(F.col("id") % 3 == 0, _text(key)).otherwise(key)),
        _json("document_type", _text(F.col("document_type"))),
        _json("emitente", F.when(F.col("id") % 4 != 0, emitente)),
        _json("total", F.when(F.col("total_value").isNotNull(), F.when(F.col("id") % 5 == 0, _text(total)).otherwise(total))),
        _json("itens", F.when(F.col("id") % 6 == 0, F.lit("[1, 2]"))),
    )
    return d.select("id", record.alias("record"))


def _store(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "store")
    variant_store.write_store(_records(spark, folder), path)
    return variant_store.read_store(spark, path)


@register(
    "json_store_variant", "SRC5", "JSN1", "PRJ5",
    sql=f"""{LIST} SELECT id, document_type, CASE WHEN id % 4 <> 0 THEN issuer_name END AS issuer_name, CASE WHEN id % 4 <> 0 THEN issuer_cnpj END AS issuer_cnpj,
  CAST(printf('%.2f', total_value) AS DOUBLE) AS total_value, CASE WHEN id % 6 = 0 THEN CAST(2 AS INTEGER) END AS second_item FROM d""",
)
def json_store_variant(spark: SparkSession, folder: str) -> DataFrame:
    """Store files written, scanned and flattened; numbers held as texts are read as numbers."""
    fields = {
        "id": ("id", "bigint"),
        "document_type": ("document_type", "string"),
        "issuer_name": ("emitente.razao_social", "string"),
        "issuer_cnpj": ("emitente.cnpj", "string"),
        "total_value": ("total", "double"),
        "second_item": ("itens[1]", "int"),
    }
    return variant_store.flattened(_store(spark, folder), fields).drop("file_name", "position")


@register(
    "json_store_schema", "SRC5", "JSN1",
    sql="""SELECT 'OBJECT<document_type: STRING, emitente: OBJECT<cnpj: STRING, razao_social: STRING>, id: VARIANT, itens: ARRAY<BIGINT>, total: VARIANT>' AS schema""",
)
def json_store_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The schema all records of the store fit: fields that are number here and text there are VARIANT."""
    return variant_store.schema_of_store(_store(spark, folder))


VALIDATIONS_SQL = """'{"cfop_valido":false,"chave":' || CASE WHEN id % 10 = 0 THEN 'null' ELSE '"x"' END || ',"cnpj":' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"itens":{"is_valid":' || CASE WHEN id % 7 <> 0 THEN 'true' ELSE 'false' END || '},"ncm":' || (id % 9) || ',"serie":' || CASE WHEN id % 11 = 0 THEN '""' ELSE '"1"' END
  || ',"total":{"details":"d' || id || '","message":"Soma errada","valido":' || CASE WHEN id % 3 <> 0 THEN 'true' ELSE 'false' END || '}}'"""
DETAILS_SQL = f"""d AS (SELECT id, id IN (SELECT id FROM ({HEADER_ISSUES})) AS known, {VALIDATIONS_SQL} AS validations FROM h),
found AS (
  SELECT id, 1000000 AS seq, 'Total divergente' AS message, 'Erro' AS category, '' AS details FROM d WHERE id % 5 = 0
  UNION ALL SELECT id, 1000001, '7', 'Erro', '' FROM d WHERE id % 5 = 0
  UNION ALL SELECT id, 2000000, 'CFOP incomum', 'Aviso', '' FROM d WHERE id % 6 = 0
  UNION ALL SELECT id, 3000000, CASE WHEN id % 8 = 0 THEN 'Falha' ELSE 'Erro na validação' END, 'Status', '{{' || CASE WHEN id % 8 = 0 THEN '"message":"Falha",' ELSE '' END || '"status":"error","validations":' || validations || '}}'
    FROM d WHERE id % 4 = 0 AND id % 5 <> 0 AND id % 6 <> 0 AND NOT known
  UNION ALL SELECT id, 4000001, 'Erro na validação de chave', 'chave', 'Valor inválido: None' FROM d WHERE id % 10 = 0
  UNION ALL SELECT id, 4000002, 'Erro na validação de cnpj', 'cnpj', 'A validação retornou falso' FROM d WHERE id % 2 = 1
  UNION ALL SELECT id, 4000003, 'Erro na validação de itens', 'itens', '' FROM d WHERE id % 7 = 0
  UNION ALL SELECT id, 4000004, 'Erro na validação de ncm', 'ncm', 'Valor inválido: 0' FROM d WHERE id % 9 = 0
  UNION ALL SELECT id, 4000005, 'Erro na validação de serie', 'serie', 'Valor inválido: ' FROM d WHERE id % 11 = 0
  UNION ALL SELECT id, 4000006, 'Soma errada', 'total', 'd' || id FROM d WHERE id % 3 = 0)"""


def _details(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their validation details as a service would send them: id, details (VARIANT), and the rule book's findings."""
    headers = fv.headers(spark, folder, costly=True)
    i = F.col("id")
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    validations = _object(
        _json("total", _object(_json("valido", flag(i % 3 != 0)), _json("message", F.lit('"Soma errada"')), _json("details", _text(F.concat(F.lit("d"), i.cast("string")))))),
        _json("cnpj", flag(i % 2 == 0)),
        _json("cfop_valido", F.lit("false")),
        _json("itens", _object(_json("is_valid", flag(i % 7 != 0)))),
        _json("ncm", (i % 9).cast("string")),
        _json("chave", F.when(i % 10 == 0, F.lit("null")).otherwise(F.lit('"x"'))),
        _json("serie", F.when(i % 11 == 0, F.lit('""')).otherwise(F.lit('"1"'))),
    )
    text = _object(
        _json("status", F.when(i % 4 == 0, F.lit('"error"')).otherwise(F.lit('"ok"'))),
        _json("message", F.when((i % 4 == 0) & (i % 8 == 0), F.lit('"Falha"'))),
        _json("issues", F.when(i % 5 == 0, F.lit('["Total divergente", 7]'))),
        _json("warnings", F.when(i % 6 == 0, F.lit('["CFOP incomum"]'))),
        _json("validations", validations),
    )
    rules = v.header_rules()
    fired = v.count_fired(rules, "error") + v.count_fired(rules, "warning")
    return headers.select("id", F.parse_json(text).alias("details"), (fired > 0).alias("has_errors"))


@register(
    "detail_findings", "VAL14", "JSN1",
    sql=f"WITH {q.HEADERS}, {DETAILS_SQL} SELECT id, CAST(seq AS INTEGER) AS seq, message, category, details FROM found",
)
def detail_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Every branch of what details can hold: listed issues, warnings, a bare status, and flags, numbers, texts and objects by field."""
    return details.detail_findings(_details(spark, folder), "id", "details", "has_errors")
