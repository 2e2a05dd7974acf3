import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notalake.functions import codes, dates, numbers, scores
from notalake.operators import classify


def test_import_dates(value):
    got = value(
        dates.iso_date, "28/08/2025", "31/12/99", "2023-01-01 10:40:00", " 28/08/2025 ", "13/45/2025", "30/02/2025", "28-08-2025", "invalid", "", None, "1/2/70", "1/2/69", "2023-01-01T10:40:00Z"
    )
    assert got == [
        "2025-08-28T00:00:00Z", "1999-12-31T00:00:00Z", "2023-01-01T10:40:00", "2025-08-28T00:00:00Z", None, None, None, None, None, None,
        "1970-02-01T00:00:00Z", "2069-02-01T00:00:00Z", "2023-01-01T10:40:00Z",
    ]


def test_storage_dates(value):
    got = value(dates.storage_date, "28/08/2025", "28/08/25", "1/8/25", "30/02/2025", "2025-08-28", None)
    assert got == ["2025-08-28T00:00:00Z", "28/08/25", "2025-08-01T00:00:00Z", "30/02/2025", "2025-08-28", None]


def test_recognised_dates(value):
    got = value(dates.recognised_date, "1/2/2025", "01/02/2025 10:40", "01/02/2025 10:40:05", "x", None)
    assert got == ["2025-02-01 00:00:00", "2025-02-01 10:40:00", "2025-02-01 10:40:05", None, None]


def test_lower_bound():
    now = datetime(2024, 5, 10, 15, 30)
    assert dates.lower_bound("documentos de hoje", now) == datetime(2024, 5, 10)
    assert dates.lower_bound("ontem", now) == datetime(2024, 5, 9)
    assert dates.lower_bound("últimos 7 dias", now) == datetime(2024, 5, 3, 15, 30)
    assert dates.lower_bound("sempre", now) is None and dates.lower_bound(None, now) is None


NUMBERS = ["R$ 1.234,56", "1234,56", "1234.56", "1,234.56", "abc", "", None, "1d", "-5", "100.50", "1e3"]


@pytest.mark.parametrize(
    "reader, expected",
    [
        (numbers.rule_number, [1234.56, 1234.56, 1234.56, 1.23456, 0, 0, 0, 0, -5, 100.5, 1000]),
        (numbers.display_number, [1234.56, 1234.56, 1234.56, 1.23456, 0, 0, 0, 0, -5, 100.5, 1000]),
        (numbers.store_number, [1234.56, 1234.56, 123456, 1.23456, None, None, None, None, -5, 10050, 1000]),
        (numbers.coerced_amount, [1234.56, 1234.56, 1234.56, 1.23456, 0, 0, None, 0, -5, 100.5, 1000]),
        (numbers.xml_number, [1234.56, 1234.56, 1234.56, 1.23456, 0, 0, 0, 1, -5, 100.5, 1000]),
    ],
)
def test_number_readers(value, reader, expected):
    assert value(reader, *NUMBERS) == expected


def test_xml_number_strict(value):
    got = value(lambda c: numbers.xml_number(c, strict_reference=True), "1.234,56", "1,234.56", "1.2.3", "12,5")
    assert got == [1.23456, 1.23456, 1.23, 12.5]


def test_money_rounds_half_even(spark):
    row = spark.sql("SELECT 2.675BD AS a, 2.665BD AS b").select(numbers.money2(F.col("a")), numbers.money2(F.col("b"))).first()
    assert [str(x) for x in row] == ["2.68", "2.66"]


def test_currency(spark):
    row = spark.range(1).select(numbers.currency_text(F.lit(1234567.891)), numbers.decimal_comma(F.lit(1234.5))).first()
    assert list(row) == ["R$ 1.234.567,89", "1234,50"]


def test_cnpj_golden(value):
    got = value(codes.cnpj_is_valid, "33.453.678/0001-00", "33.453.678/0001-01", "123", None, "", "11111111111111", "12345678000195", "06.117.473/0001-50", "11222333000181")
    assert got == [True, False, False, False, False, False, False, True, True]


def test_cnpj_random(value):
    rng = random.Random(5)
    right, wrong = [], []
    for _ in range(200):
        base = [rng.randrange(10) for _ in range(12)]
        full = list(base)
        for weights in ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]):
            rest = sum(a * b for a, b in zip(full, weights)) % 11
            full.append(0 if rest < 2 else 11 - rest)
        right.append("".join(map(str, full)))
        full[12] = (full[12] + 1) % 10
        wrong.append("".join(map(str, full)))
    assert all(value(codes.cnpj_is_valid, *right)) and not any(value(codes.cnpj_is_valid, *wrong))


def test_cfop_operation(value):
    got = value(codes.cfop_operation, "5102", "6102", "1102", "2102", "3202", "4202", "", None, "5.405", "6403", "101")
    assert got == ["venda", "venda", "compra", "compra", "devolucao", "other", "unknown", "unknown", "devolucao", "devolucao", "other"]


def test_request_key_ignores_order(spark):
    a = codes.request_key(F.lit("q"), {"x": F.lit(1), "y": F.lit("b")})
    b = codes.request_key(F.lit("q"), {"y": F.lit("b"), "x": F.lit(1)})
    row = spark.range(1).select(a, b).first()
    assert row[0] == row[1] and len(row[0]) == 64


def test_scores(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01' AS d, CAST(NULL AS TIMESTAMP_NTZ) AS n").select(
        scores.value_score(F.lit(999999.0)), scores.value_score(F.lit(-1.0)), scores.value_score(F.lit(None).cast("double")),
        scores.recency_score(F.col("d"), datetime(2024, 1, 31)), scores.recency_score(F.col("d"), datetime(2023, 1, 1)), scores.recency_score(F.col("n"), datetime(2024, 1, 1)),
        scores.hybrid_score(F.lit(1.0), F.lit(1.0), F.lit(1.0)),
        scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
    ).first()
    assert [round(x, 6) for x in row] == [1.0, 0.0, 0.0, round(2.718281828459045**-1, 6), 1.0, 0.0, 1.0, 0.707107, 0.0]


def test_question_routes(value):
    got = value(classify.question_route, "Mostre a nota 5", "planilha de vendas", "qual o imposto?", "há algum problema", "bom dia")
    assert got == ["document_analysis", "csv_analysis", "financial_analysis", "validation_analysis", "general"]
    assert value(classify.question_intent, "como corrigir a validação", "status da validação", "oi") == ["howto", "validation", None]


def test_categories(spark):
    rows = [("NFCE", None, None, "x"), ("nf-e", None, None, "x"), ("", "tipo 65", None, "x"), ("N/A", None, "57", "x"), (None, None, None, "manifesto_1.xml"), (None, None, None, "a.xml")]
    df = spark.createDataFrame(rows, "t string, s string, m string, f string")
    got = [r[0] for r in df.select(classify.category(F.col("t"), F.col("s"), F.col("m"), F.col("f"))).collect()]
    assert got == ["NFCE", "NF-e", "NFC-e", "CT-e", "MDF-e", "Desconhecido"]


def test_document_class(spark):
    df = spark.createDataFrame([("MDFe", "5102", None), ("CTE", None, None), ("NFe", "5102", "1102"), ("NFe", None, "1102"), ("NFe", None, None)], "t string, c string, i string")
    got = [r[0] for r in df.select(classify.document_class(F.col("t"), F.col("c"), F.col("i"))).collect()]
    assert got == ["mdfe", "cte", "venda", "compra", "unknown"]
