"""XML documents written from stored rows, one per row: the inverse of the XML job, for round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import computed_once
from . import fiscal_view as fv


def tag(name: str, value: Column) -> Column:
    """<name>value</name>, or nothing when the value is NULL."""
    text = F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.coalesce(F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>")), F.lit(""))


def group(name: str, *parts: Column, attributes: Column | None = None) -> Column:
    opening = F.lit(f"<{name}>") if attributes is None else F.concat(F.lit(f"<{name} "), attributes, F.lit(">"))
    return F.concat(opening, *parts, F.lit(f"</{name}>"))


def access_key(number: Column) -> Column:
    return F.lpad(number.cast("string"), 44, "0")


def item_documents(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, item_no, xml: a goods document with the stored item and, on some, a freight item."""
    i = fv.items(spark, folder, costly=True)
    product = group(
        "prod",
        tag("cProd", F.col("codigo")),
        tag("xProd", F.col("descricao")),
        tag("NCM", F.col("ncm")),
        tag("CFOP", F.col("cfop")),
        F.when(F.col("item_no") % 2 == 0, tag("uCom", F.lit("CX"))).otherwise(""),
        tag("qCom", F.concat(F.col("quantidade").cast("string"), F.lit(".0000"))),
        tag("vUnCom", fv.money(F.col("unit_cents"))),
        tag("vProd", fv.money(F.col("total_cents"))),
    )
    tax = group("imposto", group("ICMS", group("ICMS00", tag("CST", F.lit("00")), tag("vICMS", F.lit("1.00")))))
    numbered = F.concat(F.lit('nItem="'), F.col("item_no").cast("string"), F.lit('"'))
    freight = F.when(
        F.col("item_no") == 7, F.lit('<det nItem="8"><prod><cProd>F</cProd><vProd>10.5</vProd></prod></det>')
    ).otherwise("")
    body = group(
        "infNFe",
        group("ide", tag("mod", F.lit("55")), tag("nNF", F.col("document_id"))),
        group("det", product, tax, attributes=numbered),
        freight,
        attributes=F.concat(F.lit('Id="NFe'), access_key(F.col("document_id")), F.lit('"')),
    )
    note = group("NFe", body)
    wrapped = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><nfeProc xmlns="http://www.portalfiscal.inf.br/nfe" versao="4.00">'),
        note,
        F.lit("</nfeProc>"),
    )
    return computed_once(i, "xml", F.when(F.col("item_no") % 3 == 0, note).otherwise(wrapped))


def order_documents(spark: SparkSession, folder: str, task_rows: int | None = fv.TASK_ROWS) -> DataFrame:
    """id, xml: each order as the document type it has; a few are broken, foreign or missing."""
    h = fv.headers(spark, folder, costly=True, task_rows=task_rows)
    key = F.col("id")
    total = fv.money(F.coalesce(F.col("total_cents"), F.lit(0)))
    cents = lambda c: fv.money(F.coalesce(F.col(c), F.lit(0)))
    moment = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    issuer = group(
        "emit",
        tag("CNPJ", F.col("emitente_cnpj")),
        tag("xNome", F.col("emitente_razao_social")),
        group("enderEmit", tag("xLgr", F.lit("Rua A & B")), tag("xMun", F.lit("SAO PAULO")), tag("UF", F.lit("SP"))),
        tag("IE", key + 1000),
    )
    is_company = F.length("destinatario_doc") > 11
    recipient = F.when(
        F.col("has_recipient"),
        group(
            "dest",
            F.when(is_company, tag("CNPJ", F.col("destinatario_doc"))).otherwise(tag("CPF", F.col("destinatario_doc"))),
            tag("xNome", F.col("destinatario_razao_social")),
            tag("email", F.concat(F.lit("c"), F.col("custkey").cast("string"), F.lit("@example.org"))),
        ),
    ).otherwise("")
    totals = group(
        "total",
        group(
            "ICMSTot",
            tag("vICMS", cents("icms_cents")),
            tag("vProd", total),
            tag("vFrete", F.lit("1.00")),
            tag("vIPI", cents("ipi_cents")),
            tag("vPIS", cents("pis_cents")),
            tag("vCOFINS", cents("cofins_cents")),
            F.when(key % 5 != 0, tag("vNF", total)).otherwise(""),
        ),
    )
    # Parts that several shapes share are written once per row.
    shared = {"issuer": issuer, "recipient": recipient, "totals": totals, "total": total, "moment": moment, "icms": cents("icms_cents")}
    h = computed_once(h, "_part", F.struct(*[c.alias(n) for n, c in shared.items()]))
    issuer, recipient, totals, total, moment, icms = (F.col("_part")[n] for n in shared)
    identity = lambda number_tag, model: group(
        "ide", tag("mod", F.lit(model)), tag("serie", F.col("serie")), tag(number_tag, F.col("numero")), tag("dhEmi", moment), tag("tpNF", F.lit("1"))
    )
    line = lambda c: F.concat(
        F.lit("<det><prod><cProd>X</cProd>"), tag("CFOP", F.col("cfop")), tag("vProd", fv.money(F.lit(c))), F.lit("</prod></det>")
    )
    payment = group("pag", group("detPag", tag("tPag", F.lit("01")), tag("vPag", total)), tag("vTroco", F.lit("0.50")))
    ident = F.concat(F.lit('Id="NFe'), access_key(key), F.lit('"'))
    nfe = group("nfeProc", group("NFe", group("infNFe", identity("nNF", "55"), issuer, recipient, line(1250), line(250), totals, attributes=ident)))
    nfce = group("NFe", group("infNFe", identity("nNF", "65"), issuer, recipient, line(1250), line(250), totals, payment, attributes=ident))
    cte = group(
        "cteProc",
        group(
            "CTe",
            group(
                "infCte",
                group(
                    "ide",
                    tag("serie", F.col("serie")),
                    tag("nCT", F.col("numero")),
                    tag("dhEmi", moment),
                    tag("modal", F.lit("01")),
                    tag("tpServ", F.lit("0")),
                    tag("UFIni", F.lit("SP")),
                    tag("UFFim", F.lit("RJ")),
                    group("toma03", tag("toma", F.lit("0")), tag("CNPJ", F.col("destinatario_doc")), tag("xNome", F.col("destinatario_razao_social"))),
                ),
                issuer,
                group("vPrest", tag("vTPrest", total)),
                group("imp", group("ICMS", group("ICMS00", tag("CST", F.lit("00")), tag("vICMS", cents("icms_cents"))))),
            ),
        ),
        group("protCTe", group("infProt", tag("chCTe", access_key(key)), tag("nProt", key + 135200000000000))),
    )
    linked = lambda n: group("infNFe", tag("chNFe", access_key(n)), tag("vBC", F.lit("5.00")))
    mdfe = group(
        "mdfeProc",
        group(
            "MDFe",
            group(
                "infMDFe",
                group(
                    "ide", tag("serie", F.col("serie")), tag("nMDF", F.col("numero")), tag("dhEmi", moment), tag("UFIni", F.lit("SP")), tag("UFFim", F.lit("MG"))
                ),
                issuer,
                group("infDoc", group("infMunDescarga", linked(key + 1), linked(key + 2)), group("infMunDescarga", linked(key + 7))),
                group("tot", tag("qNFe", F.lit("3")), tag("vCarga", total), tag("qCarga", F.lit("12.5000"))),
                group("infAdic", tag("infCpl", F.lit("Sem observações"))),
            ),
        ),
    )
    good = (
        F.when(F.col("document_type") == "NFCe", nfce)
        .when(F.col("document_type") == "CTe", cte)
        .when(F.col("document_type") == "MDFe", mdfe)
        .otherwise(nfe)
    )
    xml = (
        F.when(key % 50 == 49, F.substr(good, F.lit(1), F.length(good) - 9))
        .when(key % 50 == 48, F.lit("sem xml"))
        .when(key % 50 == 46, F.lit("<pedido><item>1</item></pedido>"))
        .when(key % 50 != 47, good)
    )
    return computed_once(h, "xml", xml).drop("_part")


def order_notes(spark: SparkSession, folder: str) -> DataFrame:
    """id, file_name, xml: each order as a note with all its items; quantities with fractions, the third line's total five cents off.

    Every tenth note states a total that is one real too high, every fifth no taxes.
    """
    h = fv.headers(spark, folder, costly=True).select("id", "created_at", fv.cnpj_of(F.col("issuer_id")).alias("issuer_cnpj"))
    n = F.col("l_linenumber").cast("decimal(4,0)")
    quantity = (F.col("l_quantity").cast("decimal(10,4)") + n * F.lit("0.0625").cast("decimal(5,4)")).cast("decimal(14,4)")
    price = (n * F.lit("1.2345").cast("decimal(5,4)")).cast("decimal(14,4)")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), "l_linenumber", quantity.alias("q"), price.alias("u"))
    off = F.when(F.col("l_linenumber") == 3, F.lit("0.05")).otherwise(F.lit("0.00")).cast("decimal(4,2)")
    lines = lines.withColumn("t", (F.round(F.col("q") * F.col("u"), 2) + off).cast("decimal(18,2)"))
    item = group(
        "det",
        group(
            "prod",
            tag("cProd", F.col("l_linenumber")),
            tag("xProd", F.lit("Produto")),
            tag("NCM", F.lit("84713012")),
            tag("CFOP", F.lit("5102")),
            tag("qCom", F.col("q")),
            tag("vUnCom", F.col("u")),
            tag("vProd", F.col("t")),
        ),
    )
    # an order has a handful of lines
    held = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "t", item.alias("det")))).alias("dets"), F.sum("t").alias("sum"))
    both = h.join(held, "id", "left")
    key = F.col("id")
    total = F.coalesce("sum", F.lit(0)) + F.when(key % 10 == 0, F.lit(1)).otherwise(F.lit(0))
    moment = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    body = group(
        "infNFe",
        group("ide", tag("mod", F.lit("55")), tag("serie", F.lit("1")), tag("nNF", key), tag("dhEmi", moment)),
        group("emit", tag("CNPJ", F.col("issuer_cnpj")), tag("xNome", F.lit("Emitente"))),
        F.coalesce(F.array_join(F.transform("dets", lambda d: d["det"]), ""), F.lit("")),
        group("total", group("ICMSTot", F.when(key % 5 != 0, tag("vICMS", F.lit("18.00"))).otherwise(""), tag("vNF", total.cast("decimal(18,2)")))),
        attributes=F.concat(F.lit('Id="NFe'), access_key(key), F.lit('"')),
    )
    name = F.concat(F.lit("nota_"), key.cast("string"), F.lit(".xml"))
    return both.select("id", name.alias("file_name"), group("NFe", body).alias("xml"))
