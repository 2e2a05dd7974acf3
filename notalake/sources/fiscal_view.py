"""Fiscal documents seen through the order tables.

Headers come from `orders` alone and items from `lineitem` alone: both are narrow projections
that stay partitioned as the files are, so no view adds a shuffle. Every derived value is an
arithmetic function of stored columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..operators.stages import spread
from .tables import table

TYPE_BY_PRIORITY = {"1-URGENT": "NFe", "2-HIGH": "NFCe", "3-MEDIUM": "CTe", "5-LOW": "MDFe"}
TASK_ROWS = 200_000  # of a task that writes and parses a document a row


def cnpj_of(number: Column) -> Column:
    """A registration with right check digits: 1122nnnn0001dd for a number below 10000.

    Only four digits vary, so the sums are a constant plus four terms. Filters on the column are pushed
    below the projection and repeat the expression, which therefore has to stay small.
    """
    place = lambda k: F.call_function("div", number, F.lit(k)) % 10
    thousands, hundreds, tens, ones = place(1000), place(100), place(10), number % 10
    digit = lambda total: (11 - total % 11) % 11 % 10
    first = digit(thousands * 9 + hundreds * 8 + tens * 7 + ones * 6 + 21)
    second = digit(thousands * 2 + hundreds * 9 + tens * 8 + ones * 7 + first * 2 + 28)
    base = (number + 11220000) * 10000 + 1
    return (base * 100 + first * 10 + second).cast("string")


def dotted(cnpj: Column) -> Column:
    part = lambda a, n: F.substring(cnpj, a, n)
    return F.concat(
        part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("/"), part(9, 4), F.lit("-"), part(13, 2)
    )


def headers(spark: SparkSession, folder: str, costly: bool = False, task_rows: int | None = TASK_ROWS) -> DataFrame:
    """One row per document: identification, parties, total, operation code and taxes.

    `costly` says that much work per row follows, so the rows are dealt out first, `task_rows` to a task
    at most, or to one task a core without.
    """
    orders = table(spark, folder, "orders")
    # The registrations are used in several branches below: a projection of their own computes them once.
    o = (spread(orders, task_rows) if costly else orders).withColumns(
        {"issuer_full": cnpj_of(F.col("o_custkey") % 997), "recipient_full": cnpj_of(F.col("o_custkey") % 9973)}
    )
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    issuer = cust % 997
    full = F.col("issuer_full")
    wrong_digit = F.concat(F.substring(full, 1, 13), ((F.substring(full, 14, 1).cast("int") + 1) % 10).cast("string"))
    recipient = F.col("recipient_full")
    wrong_recipient = F.concat(
        F.substring(recipient, 1, 13), ((F.substring(recipient, 14, 1).cast("int") + 1) % 10).cast("string")
    )
    day = F.col("o_orderdate")
    kind = F.lit(None).cast("string")
    for priority, name in TYPE_BY_PRIORITY.items():
        kind = F.when(F.col("o_orderpriority") == priority, F.lit(name)).otherwise(kind)
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        key.alias("id"),
        kind.alias("document_type"),
        F.when(key % 41 != 0, key.cast("string")).alias("numero"),
        F.when(key % 3 != 0, (key % 9 + 1).cast("string")).alias("serie"),
        F.when(key % 7 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 7 == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 7 == 3, F.date_format(day, "dd/MM/yy"))
        .when(key % 7 == 4, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(key % 7 == 5, F.lit("30/02/2025"))
        .when(key % 7 == 6, F.date_format(day, "dd-MM-yyyy"))
        .alias("data_emissao"),
        day.alias("created_at"),
        F.when(key % 53 == 0, F.lit(None)).when(key % 59 == 0, F.lit(0)).otherwise(cents).cast("bigint").alias("total_cents"),
        issuer.alias("issuer_id"),
        F.when(key % 11 == 0, F.lit(None))
        .when(key % 11 == 1, wrong_digit)
        .when(key % 11 == 2, dotted(full))
        .when(key % 11 == 3, F.lit("123"))
        .when(key % 11 == 4, F.lit("11111111111111"))
        .otherwise(full)
        .alias("emitente_cnpj"),
        F.when(key % 13 != 0, F.concat(F.lit("Emitente "), issuer.cast("string"))).alias("emitente_razao_social"),
        (key % 17 != 1).alias("has_recipient"),
        F.when(key % 17 < 2, F.lit(None))
        .when(key % 17 == 2, F.lpad(cust.cast("string"), 11, "0"))
        .when(key % 4 == 0, wrong_recipient)
        .otherwise(recipient)
        .alias("destinatario_doc"),
        F.when(key % 17 != 1, F.format_string("Customer#%09d", cust)).alias("destinatario_razao_social"),
        cust.alias("custkey"),
        F.when(key % 19 == 0, F.lit(None))
        .when(key % 23 == 0, F.lit("9.999"))
        .when(F.col("o_orderstatus") == "F", F.lit("5102"))
        .when(F.col("o_orderstatus") == "O", F.lit("1102"))
        .otherwise(F.lit("5405"))
        .alias("cfop"),
        F.when(key % 8 == 0, F.lit(None))
        .when(key % 8 == 1, F.lit("40"))
        .when(key % 8 == 2, F.lit("99"))
        .when(key % 8 < 6, F.lit("0"))
        .alias("icms_cst"),
        F.when(key % 8 == 6, F.lit("101")).when(key % 8 == 7, F.lit("77")).alias("icms_csosn"),
        F.when(key % 5 == 0, F.lit(0)).otherwise(F.floor(cents * 18 / 100)).cast("bigint").alias("icms_cents"),
        F.when(key % 6 == 0, F.lit(None)).when(key % 6 == 1, F.lit("88")).when(key % 6 == 2, F.lit("01")).otherwise("99").alias("ipi_cst"),
        F.when(key % 4 == 1, F.lit(0)).otherwise(F.floor(cents * 5 / 100)).cast("bigint").alias("ipi_cents"),
        F.when(key % 9 == 0, F.lit(None)).when(key % 2 == 0, F.lit("1")).otherwise(F.lit("06")).alias("pis_cst"),
        F.when(key % 10 < 3, F.lit(0)).otherwise(F.floor(cents * 2 / 100)).cast("bigint").alias("pis_cents"),
        F.when(key % 14 == 0, F.lit(None)).when(key % 3 == 0, F.lit("02")).otherwise(F.lit("08")).alias("cofins_cst"),
        F.when(key % 12 < 4, F.lit(0)).otherwise(F.floor(cents * 7 / 100)).cast("bigint").alias("cofins_cents"),
        F.when(key % 15 == 0, F.floor(cents * 3 / 100)).otherwise(0).cast("bigint").alias("st_cents"),
        F.when(key % 30 == 0, F.lit(0)).otherwise(F.lit(40)).alias("st_mva"),
        F.when(key % 45 == 0, F.lit(0)).otherwise(F.lit(18)).alias("st_rate"),
        F.when(key % 4 == 1, key % 3).otherwise(F.lit(5)).cast("bigint").alias("ipi_rate"),
        F.when(key % 7 == 0, F.lit(0)).otherwise(F.lit(2)).alias("pis_rate"),
        F.when(key % 5 == 1, F.lit(0)).otherwise(F.lit(7)).alias("cofins_rate"),
        (key % 37 != 5).alias("has_taxes"),
    )


def items(spark: SparkSession, folder: str, costly: bool = False) -> DataFrame:
    """One row per document item; money in whole cents."""
    l = table(spark, folder, "lineitem")
    l = spread(l, TASK_ROWS) if costly else l
    part = F.col("l_partkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    unit = F.floor(cents / F.col("l_quantity")).cast("bigint")
    codes = F.array(*[F.lit(c) for c in ref.NCM_DESCRIPTIONS])
    pair = F.concat("l_returnflag", "l_linestatus")
    return l.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("item_no"),
        part.cast("string").alias("codigo"),
        F.when(part % 29 != 0, F.concat(F.lit("Produto "), part.cast("string"))).alias("descricao"),
        F.when(part % 20 < 15, F.element_at(codes, (part % 20).cast("int") + 1))
        .when(part % 20 == 15, F.lit(""))
        .when(part % 20 > 16, F.lit("84713012"))
        .alias("ncm"),
        F.when(F.col("l_suppkey") % 43 == 0, F.lit(""))
        .when(part % 50 == 7, F.lit("9999"))
        .when(pair == "AF", F.lit("5102"))
        .when(pair == "AO", F.lit("6102"))
        .when(pair == "NF", F.lit("1102"))
        .when(pair == "NO", F.lit("2403"))
        .when(pair == "RF", F.lit("1202"))
        .otherwise(F.lit("5.405"))
        .alias("cfop"),
        F.when(F.col("l_suppkey") % 31 == 0, 0).otherwise(F.col("l_quantity")).cast("bigint").alias("quantidade"),
        F.when(part % 97 == 0, -unit).otherwise(unit).alias("unit_cents"),
        F.when(part % 3 == 0, unit * F.col("l_quantity").cast("bigint"))
        .when(part % 101 == 0, -cents)
        .otherwise(cents)
        .alias("total_cents"),
    )


def money(cents: Column) -> Column:
    return (cents * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
