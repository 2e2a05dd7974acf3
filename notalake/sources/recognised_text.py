"""Recognised (OCR-like) texts written from stored rows: one text per row, so nothing is grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import currency_text
from . import fiscal_view as fv
from .tables import table


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """id, raw_text: printed documents whose fields carry labels; some labels are missing."""
    h = fv.headers(spark, folder, costly=True)
    key = F.col("id")
    text = key.cast("string")
    amount = lambda cents: F.replace(currency_text(F.coalesce(cents, F.lit(0)) / 100), F.lit("R$ "), F.lit(""))
    title = (
        F.when(key % 4 == 0, F.lit("NOTA FISCAL ELETRÔNICA"))
        .when(key % 4 == 1, _line("Conhecimento de Transporte Eletrônico CT-e Nº: ", text))
        .when(key % 4 == 2, F.lit("Manifesto de Documentos Fiscais"))
        .otherwise("Comprovante")
    )
    raw = F.concat_ws(
        "\n",
        title,
        F.when(key % 3 != 0, _line("Nota Nº ", text)),
        _line("CNPJ: ", F.col("emitente_cnpj")),
        F.when(key % 5 == 0, _line("CPF ", F.concat(F.lit("123.456.789-0"), (key % 10).cast("string")))),
        F.when(key % 2 == 0, _line("Inscrição Estadual: ", (key + 100000).cast("string"))),
        F.when(key % 6 == 0, _line("Data de Emissão: ", F.date_format("created_at", "dd/MM/yyyy HH:mm")))
        .when(key % 6 < 4, _line("Emissão ", F.date_format("created_at", "d/M/yyyy"))),
        _line("Razão Social: ", F.col("emitente_razao_social")),
        _line("Destinatário: ", F.col("destinatario_razao_social")),
        F.when(key % 4 == 1, F.lit("Série: 3\nModal: Rodoviário\nTipo de Serviço: Normal\nUF Início: sp\nUF Fim: RJ")),
        F.lit("UF do Emitente: mg"),
        F.when(key % 4 == 1, _line("Valor da Prestação: R$ ", amount(F.col("total_cents")))).otherwise(
            _line("Valor Total R$ ", amount(F.col("total_cents")))
        ),
        F.when(key % 2 == 1, _line("ICMS: R$ ", amount(F.col("icms_cents")))),
        _line("PIS ", amount(F.col("pis_cents"))),
        _line("Valor COFINS: ", amount(F.col("cofins_cents"))),
        F.when(key % 7 == 0, F.lpad((key * 104729 + 5500000000).cast("string"), 44, "35")),
        F.when(key % 8 == 0, _line("Protocolo: ", (key + 135200000000000).cast("string"))),
    )
    return h.select("id", raw.alias("raw_text"))


def item_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One printed item table per stored item."""
    i = fv.items(spark, folder, costly=True)
    amount = lambda cents: F.replace(currency_text(F.abs(cents) / 100), F.lit("R$ "), F.lit(""))
    row = F.concat_ws(
        " ",
        "codigo",
        F.coalesce("descricao", F.lit("Item sem nome")),
        F.concat(F.col("quantidade").cast("string"), F.when(F.col("item_no") % 2 == 0, F.lit(",5")).otherwise("")),
        F.when(F.col("item_no") % 3 == 0, F.lit("CX")).otherwise("UN"),
        amount(F.col("unit_cents")),
        amount(F.col("total_cents")),
    )
    second = F.when(F.col("item_no") > 4, F.concat(F.lit("77 Frete, seguro 1 UN 10,00 1.010,00\n"))).otherwise("")
    heading = F.when(F.col("item_no") % 4 == 0, F.lit("Produtos e Serviços\n")).when(F.col("item_no") == 7, F.lit("Lista\n")).otherwise("ITENS DA NOTA\n")
    raw = F.concat(heading, row, F.lit("\n"), second, F.lit("Total R$ 9,99\n88 Depois 1 UN 1,00 1,00"))
    return i.select("document_id", "item_no", "codigo", "quantidade", "unit_cents", "total_cents", raw.alias("raw_text"))


def loose_texts(spark: SparkSession, folder: str) -> DataFrame:
    """id, raw_text: unlabelled lines as a scanner delivers them, in three orders."""
    h = fv.headers(spark, folder, costly=True)
    key = F.col("id")
    text = key.cast("string")
    amount = lambda cents: F.replace(currency_text(F.coalesce(cents, F.lit(0)) / 100), F.lit("R$ "), F.lit(""))
    kind = (
        F.when(key % 5 < 3, F.lit("NOTA FISCAL")).when(key % 5 == 3, F.lit("CONHECIMENTO de carga")).otherwise("MANIFESTO")
    )
    issuer = _line("Emitente ", F.col("emitente_cnpj"))
    recipient = F.when(F.length("destinatario_doc") == 14, _line("Dest ", fv.dotted(F.col("destinatario_doc")))).otherwise(
        F.lit("Dest 123.456.789-09")
    )
    number = F.when(key % 4 == 0, _line("N° ", text)).when(key % 4 == 1, _line("Numero: ", text)).when(key % 4 == 2, text)
    day = F.when(key % 7 != 0, _line("em ", F.date_format("created_at", "dd/MM/yyyy")))
    rows = F.concat_ws(
        "\n",
        F.concat(F.lit("Parafuso aço 2 "), amount(F.col("icms_cents"))),
        F.when(key % 2 == 0, F.lit("  Porca sextavada 3,5 4,00  ")),
        F.when(key % 3 == 0, F.lit("Linha sem valor")),
    )
    total = F.concat(F.lit("Subtotal 1,00\nValor Total "), amount(F.col("total_cents")))
    a, b, c = (
        F.concat_ws("\n", kind, issuer, recipient, number, day, rows, total),
        F.concat_ws("\n", kind, recipient, day, rows, issuer, total, number),
        F.concat_ws("\r\n", kind, total, number, rows, F.lit(""), day, issuer, recipient),
    )
    return h.select("id", F.when(key % 3 == 0, a).when(key % 3 == 1, b).otherwise(c).alias("raw_text"))


# Texts whose type shows in different ways.
TYPED_LEADS = [
    "<NFCe><infNFe/>", "<nfeProc>", '<NFe mod="65">', "<cteProc>", "<mdfeProc>", "Nota Fiscal Eletrônica ", "cupom NFC-e ",
    "modelo 55 ", "CT-e ", "conhecimento transporte ", "Manifesto de Documentos Fiscais ", "chave ", "recibo ",
]


def typed_texts(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    leads = F.array(*[F.lit(t) for t in TYPED_LEADS])
    models = F.array(*[F.lit(m) for m in ("57", "67", "55", "65", "99")])
    digits = F.concat(F.element_at(models, (key % 5).cast("int") + 1), F.lpad(key.cast("string"), 42, "0"))
    text = F.concat(F.element_at(leads, (key % 13).cast("int") + 1), F.when(key % 13 == 11, digits).otherwise(key.cast("string")))
    return table(spark, folder, "orders").select(key.alias("id"), text.alias("raw_text"))
