"""XML documents -> header, item and link tables. One parse per document serves all four shapes.

Input: any columns plus `xml`. The parser is permissive: text that is not well formed ends up in the
corrupt-record field and from there in quarantine, so one bad file never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions.numbers import xml_number
from .stages import computed_once

_ADDRESS = "struct<xLgr:string,nro:string,xCpl:string,xBairro:string,cMun:string,xMun:string,UF:string,CEP:string,xPais:string,fone:string>"
_ISSUER = f"struct<CNPJ:string,CPF:string,xNome:string,xFant:string,IE:string,enderEmit:{_ADDRESS}>"
_RECIPIENT = f"struct<CNPJ:string,CPF:string,xNome:string,xFant:string,IE:string,email:string,enderDest:{_ADDRESS},enderToma:{_ADDRESS}>"
# The tax groups an item or a freight may carry.
ICMS_GROUPS = ["ICMS00", "ICMS10", "ICMS20", "ICMS30", "ICMS40", "ICMS45", "ICMS51", "ICMS60", "ICMS70", "ICMS90", "ICMSOutraUF"]
SIMPLES_GROUPS = ["ICMSSN101", "ICMSSN102", "ICMSSN201", "ICMSSN202", "ICMSSN500", "ICMSSN900", "ICMSSN"]
_ICMS = "struct<" + ",".join(f"{g}:struct<CST:string,CSOSN:string,vICMS:string>" for g in ICMS_GROUPS + SIMPLES_GROUPS) + ">"
_PRODUCT = "struct<cProd:string,xProd:string,NCM:string,CFOP:string,uCom:string,qCom:string,vUnCom:string,vProd:string>"
_IDENTITY = (
    "struct<mod:string,serie:string,nNF:string,nCT:string,nMDF:string,dhEmi:string,dEmi:string,tpNF:string,tpEmis:string,"
    "modal:string,tpServ:string,UFIni:string,UFFim:string,xMunIni:string,xMunFim:string,CFOP:string,"
    f"toma03:{_RECIPIENT},toma:{_RECIPIENT}>"
)
_TOTALS = (
    "struct<ICMSTot:struct<vNF:string,vProd:string,vFrete:string,vSeg:string,vDesc:string,vIPI:string,vICMS:string,"
    "vPIS:string,vCOFINS:string,vST:string,vICMSST:string>>"
)
_PAYMENT = "struct<tIntegra:string,tPag:string,vPag:string,vTroco:string,detPag:array<struct<tPag:string,vPag:string>>>"
_GOODS = (
    f"struct<_Id:string,Id:string,chNFe:string,ide:{_IDENTITY},emit:{_ISSUER},dest:{_RECIPIENT},"
    f"det:array<struct<_nItem:string,prod:{_PRODUCT},imposto:struct<ICMS:{_ICMS}>>>,total:{_TOTALS},pag:{_PAYMENT},"
    "infAdic:struct<infCpl:string>>"
)
_FREIGHT = (
    f"struct<_Id:string,ide:{_IDENTITY},emit:{_ISSUER},vPrest:struct<vTPrest:string>,imp:struct<ICMS:{_ICMS}>,"
    "infCteComp:struct<chCTe:string>,compl:struct<infCpl:string>>"
)
_MANIFEST = (
    f"struct<_Id:string,Id:string,chMDFe:string,ide:{_IDENTITY},emit:{_ISSUER},dest:{_RECIPIENT},"
    "infDoc:struct<infMunDescarga:array<struct<infNFe:array<struct<chNFe:string,vBC:string>>,infCTe:array<struct<chCTe:string>>>>>,"
    "tot:struct<qCTe:string,qNFe:string,vCarga:string,qCarga:string>,infAdic:struct<infCpl:string>>"
)
_PROTOCOL = "struct<infProt:struct<chNFe:string,chCTe:string,chMDFe:string,nProt:string>>"
# A wrapped document nests its body one level deeper than a bare one; the schema has room for both.
SCHEMA = (
    f"NFe struct<infNFe:{_GOODS}>, infNFe {_GOODS}, CTe struct<infCte:{_FREIGHT}>, infCte {_FREIGHT}, "
    f"MDFe struct<infMDFe:{_MANIFEST}>, infMDFe {_MANIFEST}, "
    f"protNFe {_PROTOCOL}, protCTe {_PROTOCOL}, protMDFe {_PROTOCOL}, _corrupt_record string"
)
OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}
ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w.\-]+:)?([\w.\-]+)"


def _contains_element(xml: Column, part: str) -> Column:
    return xml.rlike(rf"<(?:[\w.\-]+:)?[\w.\-]*{part}")


def _detected_type(xml: Column, model: Column) -> Column:
    """Root name first, then any element name, then the bare text; model 65 turns a note into a consumer note."""
    root = F.lower(F.regexp_extract(xml, ROOT, 1))
    text = F.lower(xml)
    consumer = (
        F.coalesce(model == "65", F.lit(False)) | xml.contains("<mod>65<") | xml.contains('mod="65"') | xml.contains("mod=65")
    )
    note = F.when(consumer, F.lit("NFCe")).otherwise("NFe")
    return (
        F.when(root.contains("mdfe"), F.lit("MDFe"))
        .when(root.contains("cte"), F.lit("CTe"))
        .when(root.contains("nfe"), note)
        .when(_contains_element(xml, "MDFe"), F.lit("MDFe"))
        .when(_contains_element(xml, "CTe"), F.lit("CTe"))
        .when(_contains_element(xml, "NFe"), note)
        .when(text.contains("nfce"), F.lit("NFCe"))
        .when(text.contains("nfe"), note)
        .when(text.contains("cte"), F.lit("CTe"))
        .when(text.contains("mdfe"), F.lit("MDFe"))
    )


def parsed(df: DataFrame) -> DataFrame:
    """Adds the parse result, `tipo_documento` (NULL if unusable) and `error` (NULL if usable)."""
    p = computed_once(df, "_p", F.from_xml("xml", SCHEMA, OPTIONS))
    p = p.withColumns(
        {
            "_nf": F.coalesce("_p.NFe.infNFe", "_p.infNFe"),
            "_ct": F.coalesce("_p.CTe.infCte", "_p.infCte"),
            "_md": F.coalesce("_p.MDFe.infMDFe", "_p.infMDFe"),
        }
    )
    kind = _detected_type(F.col("xml"), F.col("_nf.ide.mod"))
    gate = (
        F.when(F.col("xml").isNull(), F.lit("invalid_input"))
        .when(~F.ltrim("xml").startswith("<"), F.lit("invalid_xml"))
        .when(F.col("_p._corrupt_record").isNotNull(), F.lit("xml_parse_error"))
        .when(kind.isNull(), F.lit("unknown_document_type"))
    )
    outcome = F.struct(gate.alias("error"), F.when(gate.isNull(), kind).alias("kind"))
    return computed_once(p, "_outcome", outcome).select(
        *p.columns, F.col("_outcome.error").alias("error"), F.col("_outcome.kind").alias("tipo_documento")
    )


def quarantine(df: DataFrame, *keys: str) -> DataFrame:
    return rejects_of(parsed(df), *keys)


def rejects_of(parsed_rows: DataFrame, *keys: str) -> DataFrame:
    return parsed_rows.filter(F.col("error").isNotNull()).select(*keys, "error", F.col("xml").alias("raw_text"))


def _any_group(groups: Column, field: str) -> Column:
    return F.coalesce(*[groups[g][field] for g in ICMS_GROUPS + SIMPLES_GROUPS])


def _goods_items(nf: Column) -> Column:
    text = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    def item(det: Column) -> Column:
        prod = det["prod"]
        return F.struct(
            text(prod["cProd"], "").alias("codigo"),
            text(prod["xProd"], ref.DEFAULT_ITEM_DESCRIPTION).alias("descricao"),
            text(prod["NCM"], "").alias("ncm"),
            text(prod["CFOP"], "").alias("cfop"),
            text(prod["uCom"], ref.DEFAULT_UNIT).alias("unidade"),
            xml_number(prod["qCom"]).alias("quantidade"),
            xml_number(prod["vUnCom"]).alias("valor_unitario"),
            xml_number(prod["vProd"]).alias("valor_total"),
            _any_group(det["imposto"]["ICMS"], "CST").alias("cst"),
        )

    none = F.array().cast(
        "array<struct<codigo:string,descricao:string,ncm:string,cfop:string,unidade:string,"
        "quantidade:double,valor_unitario:double,valor_total:double,cst:string>>"
    )
    with_product = F.filter(nf["det"], lambda d: d["prod"].isNotNull())
    return F.coalesce(F.transform(with_product, item), none)


def documents(df: DataFrame, *keys: str) -> DataFrame:
    """One row per usable document: header, parties, items, taxes, totals. Parts a type lacks are empty.

    Item lists stay inside their row; `items` unfolds them.
    """
    return documents_of(parsed(df), *keys)


def documents_of(parsed_rows: DataFrame, *keys: str) -> DataFrame:
    """`documents` out of rows that are parsed already."""
    return _shaped(parsed_rows.filter(F.col("error").isNull()), *keys)


def outcomes_of(parsed_rows: DataFrame, *keys: str) -> DataFrame:
    """All parsed rows in one table: `error` is NULL for documents, which have the columns of `documents`; rejects have `raw_text`."""
    text = F.when(F.col("error").isNotNull(), F.col("xml"))
    return _shaped(parsed_rows.withColumn("raw_text", text), *keys, "error", "raw_text")


def _shaped(parsed_rows: DataFrame, *keys: str) -> DataFrame:
    p = computed_once(parsed_rows, "itens", _goods_items(F.col("_nf")))
    nf, ct, md = F.col("_nf"), F.col("_ct"), F.col("_md")
    kind = F.col("tipo_documento")
    is_note = kind.isin("NFe", "NFCe")
    ident = F.coalesce(nf["ide"], ct["ide"], md["ide"])
    issuer = F.coalesce(nf["emit"], ct["emit"], md["emit"])
    payer = F.coalesce(ct["ide"]["toma03"], ct["ide"]["toma"])
    # A freight document without issuer data falls back to the first name in the document, its payer's.
    fallback = lambda own, other: F.coalesce(own, F.when(kind == "CTe", other))
    receiver = F.coalesce(nf["dest"], payer, md["dest"])
    address = F.coalesce(receiver["enderDest"], receiver["enderToma"])
    totals = nf["total"]["ICMSTot"]
    item_sum = F.aggregate("itens", F.lit(0.0), lambda s, it: s + it["valor_total"])
    note_total = F.when(totals["vNF"].isNotNull(), xml_number(totals["vNF"])).otherwise(
        F.when(kind == "NFCe", item_sum).otherwise(F.lit(0.0))
    )
    total = (
        F.when(is_note, note_total)
        .when(kind == "CTe", F.when(ct["vPrest"]["vTPrest"].isNotNull(), xml_number(ct["vPrest"]["vTPrest"])))
        .otherwise(xml_number(md["tot"]["vCarga"]))
    )
    amount = lambda c: F.when(c.isNotNull(), xml_number(c))
    payment = nf["pag"]
    first_payment = F.get(payment["detPag"], 0)
    party = lambda c, number, where, prefix: F.struct(
        c["xNome"].alias("razao_social"),
        c["xFant"].alias("nome_fantasia"),
        number.alias("cnpj"),
        c["CPF"].alias("cpf"),
        c["IE"].alias("ie"),
        F.struct(
            where["xLgr"].alias("logradouro"),
            where["nro"].alias("numero"),
            where["xCpl"].alias("complemento"),
            where["xBairro"].alias("bairro"),
            where["cMun"].alias("codigo_municipio"),
            where["xMun"].alias("municipio"),
            where["UF"].alias("uf"),
            where["CEP"].alias("cep"),
            where["xPais"].alias("pais"),
            where["fone"].alias("telefone"),
        ).alias("endereco"),
    )
    issuer_party = party(issuer, fallback(issuer["CNPJ"], payer["CNPJ"]), issuer["enderEmit"], "emit").withField(
        "razao_social", fallback(issuer["xNome"], payer["xNome"])
    ).withField("ie", fallback(issuer["IE"], payer["IE"]))
    receiver_party = party(receiver, F.coalesce(receiver["CNPJ"], F.when(is_note, receiver["CPF"])), address, "dest")
    return p.select(
        *keys,
        "tipo_documento",
        F.coalesce(nf["chNFe"], nf["Id"], ct["infCteComp"]["chCTe"], F.col("_p.protCTe.infProt.chCTe"), md["chMDFe"], md["Id"]).alias("chave"),
        F.regexp_extract(F.coalesce(nf["_Id"], ct["_Id"], md["_Id"]), r"(\d{44})", 1).alias("chave_id"),
        F.col("_p.protCTe.infProt.nProt").alias("protocolo_autorizacao"),
        F.coalesce(ident["nNF"], ident["nCT"], ident["nMDF"]).alias("numero"),
        ident["serie"].alias("serie"),
        F.coalesce(ident["dhEmi"], ident["dEmi"]).alias("data_emissao"),
        F.coalesce(ident["mod"], F.when(kind == "MDFe", F.lit("58"))).alias("modelo"),
        ident["tpNF"].alias("tipo_operacao"),
        ident["tpEmis"].alias("tipo_emissao"),
        ident["modal"].alias("modal"),
        ident["tpServ"].alias("tipo_servico"),
        ident["UFIni"].alias("uf_inicio"),
        ident["UFFim"].alias("uf_fim"),
        ident["xMunIni"].alias("municipio_inicio"),
        ident["xMunFim"].alias("municipio_fim"),
        issuer_party.alias("emitente"),
        F.when(receiver.isNotNull(), receiver_party).alias("destinatario"),
        receiver["email"].alias("destinatario_email"),
        "itens",
        F.coalesce(F.get(F.filter("itens", lambda it: it["cfop"] != ""), 0)["cfop"], ident["CFOP"]).alias("cfop"),
        total.alias("total"),
        xml_number(totals["vProd"]).alias("valor_produtos"),
        xml_number(totals["vFrete"]).alias("valor_frete"),
        xml_number(totals["vSeg"]).alias("valor_seguro"),
        xml_number(totals["vDesc"]).alias("desconto"),
        amount(F.coalesce(totals["vICMS"], _any_group(ct["imp"]["ICMS"], "vICMS"))).alias("icms_valor"),
        amount(totals["vIPI"]).alias("ipi_valor"),
        amount(totals["vPIS"]).alias("pis_valor"),
        amount(totals["vCOFINS"]).alias("cofins_valor"),
        amount(F.coalesce(totals["vICMSST"], totals["vST"])).alias("icms_st_valor"),
        F.when(
            payment.isNotNull() & (kind == "NFCe"),
            F.struct(
                F.coalesce(payment["tIntegra"], F.lit("")).alias("tipo_integracao"),
                F.coalesce(payment["tPag"], first_payment["tPag"], F.lit("")).alias("meio_pagamento"),
                xml_number(F.coalesce(payment["vPag"], first_payment["vPag"])).alias("valor"),
                xml_number(payment["vTroco"]).alias("troco"),
            ),
        ).alias("pagamento"),
        md["infDoc"]["infMunDescarga"].alias("_unloading"),
        md["tot"].alias("carga"),
        F.coalesce(nf["infAdic"]["infCpl"], md["infAdic"]["infCpl"], ct["compl"]["infCpl"]).alias("informacoes_adicionais"),
    )


def items(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per item, numbered within its document."""
    rows = docs.select(*keys, F.posexplode("itens").alias("_pos", "_item"))
    return rows.select(*keys, (F.col("_pos") + 1).alias("numero_item"), "_item.*")


def linked_documents(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per document a manifest carries: kind, key, value."""
    places = docs.select(*keys, F.explode("_unloading").alias("place"))
    notes = F.transform(
        "place.infNFe", lambda n: F.struct(F.lit("NFe").alias("tipo"), n["chNFe"].alias("chave"), n["vBC"].alias("valor"))
    )
    freights = F.transform(
        "place.infCTe", lambda c: F.struct(F.lit("CTe").alias("tipo"), c["chCTe"].alias("chave"), F.lit(None).cast("string").alias("valor"))
    )
    none = F.array().cast("array<struct<tipo:string,chave:string,valor:string>>")
    both = F.concat(F.coalesce(notes, none), F.coalesce(freights, none))
    return places.select(*keys, F.explode(both).alias("linked")).select(*keys, "linked.*")


def with_minimum_structure(docs: DataFrame) -> DataFrame:
    """Parts a consumer counts on are never NULL, and `document_type` always says something."""
    empty_items = F.filter("itens", lambda _i: F.lit(False))
    return docs.withColumns(
        {
            "document_type": F.coalesce("tipo_documento", F.lit("unknown")),
            "itens": F.coalesce("itens", empty_items),
            "has_emitente": F.coalesce(F.col("emitente.cnpj"), F.col("emitente.razao_social")).isNotNull(),
            "has_destinatario": F.col("destinatario").isNotNull(),
        }
    )
