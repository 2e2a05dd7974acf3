"""Exports of listings and items. Written by all tasks in parallel; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import currency_text, decimal_comma

BYTE_ORDER_MARK = "\ufeff"
_FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def _spreadsheet(df: DataFrame, mark: bool) -> DataFrame:
    """Fractions with a decimal comma; the byte-order mark leads the first header of every file."""
    shown: list[Column] = []
    for i, field in enumerate(df.schema.fields):
        value = decimal_comma(F.col(field.name)) if isinstance(field.dataType, _FRACTIONAL) else F.col(field.name)
        shown.append(value.alias((BYTE_ORDER_MARK if mark and i == 0 else "") + field.name))
    return df.select(*shown)


def write_csv(df: DataFrame, path: str, mark: bool = True, mode: str = "errorifexists") -> None:
    """Semicolon CSV for spreadsheets with a comma locale."""
    _spreadsheet(df, mark).write.mode(mode).option("sep", ";").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def item_listing(items: DataFrame, key: str) -> DataFrame:
    """Items under the headings of the export."""
    missing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    return items.select(
        key,
        F.col("item_no").alias("Item"),
        missing("descricao").alias("Descricao"),
        missing("quantidade").alias("Quantidade"),
        currency_text(F.col("unit_cents") / 100).alias("Valor_Unitario"),
        currency_text(F.col("total_cents") / 100).alias("Valor_Total"),
        missing("ncm").alias("NCM"),
        missing("cfop").alias("CFOP"),
    )
