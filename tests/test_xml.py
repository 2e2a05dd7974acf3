from pyspark.sql import functions as F

from notalake.operators import extract_xml as x
from notalake.operators import xml_records
from notalake.operators.stages import spread
from notalake.sources.files import routed, xml_folder

NFE = """<?xml version="1.0" encoding="UTF-8"?>
<!-- nota --><nfeProc xmlns="http://www.portalfiscal.inf.br/nfe"><NFe><infNFe Id="NFe41230655443322000188650070000345671098765432">
<ide><mod>55</mod><serie>3</serie><nNF>81</nNF><dhEmi>2023-03-04T09:08:07-03:00</dhEmi></ide>
<emit><CNPJ>44555666000177</CNPJ><xNome>Ferragens Aroeira</xNome><enderEmit><xMun>BELO HORIZONTE</xMun><UF>MG</UF><CEP>30123000</CEP></enderEmit><IE>1</IE></emit>
<dest><CPF>98765432100</CPF><xNome>Oficina do Vale</xNome></dest>
<det nItem="1"><prod><cProd>R-7</cProd><xProd>Rosca</xProd><NCM>73181500</NCM><CFOP>5102</CFOP><qCom>4.0000</qCom><vUnCom>27.50</vUnCom><vProd>110,00</vProd></prod><imposto><ICMS><ICMSSN101><CSOSN>101</CSOSN></ICMSSN101></ICMS></imposto></det>
<det nItem="2"><prod><cProd>R-8</cProd><vProd>5</vProd></prod><imposto><ICMS><ICMS40><CST>40</CST></ICMS40></ICMS></imposto></det><det nItem="3"/>
<total><ICMSTot><vICMS>21.30</vICMS><vPIS>2.45</vPIS><vNF>115.00</vNF></ICMSTot></total></infNFe></NFe><protNFe><infProt><chNFe>1</chNFe></infProt></protNFe></nfeProc>"""
PREFIXED = '<n:NFe xmlns:n="u"><n:infNFe><n:ide><n:mod>65</n:mod><n:nNF>7</n:nNF></n:ide><n:det><n:prod><n:vProd>3.5</n:vProd></n:prod></n:det></n:infNFe></n:NFe>'
MDFE = "<mdfeProc><MDFe><infMDFe><ide><nMDF>1</nMDF></ide><infDoc><infMunDescarga><infCTe><chCTe>9</chCTe></infCTe></infMunDescarga></infDoc><tot><vCarga>750.00</vCarga><qCarga>8.25</qCarga></tot></infMDFe></MDFe></mdfeProc>"
CTE = "<CTe><infCte><ide><nCT>4</nCT><toma03><toma>0</toma><CNPJ>99888777000166</CNPJ><xNome>Transportes Ipê</xNome></toma03></ide><vPrest><vTPrest>640.00</vTPrest></vPrest><imp><ICMS><ICMS20><vICMS>76.80</vICMS></ICMS20></ICMS></imp></infCte></CTe>"
BROKEN = "<NFe><infNFe></NFe>"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, xml string")


def test_types_and_quarantine(spark):
    df = frame(spark, NFE, PREFIXED, CTE, MDFE, BROKEN, "texto", "", None, "<pedido/>", "<lote><NFe/></lote>", "<x>cte</x>")
    got = [(r["tipo_documento"], r["error"]) for r in x.parsed(df).orderBy("id").collect()]
    assert got == [
        ("NFe", None), ("NFCe", None), ("CTe", None), ("MDFe", None), (None, "xml_parse_error"), (None, "invalid_xml"), (None, "invalid_xml"), (None, "invalid_input"),
        (None, "unknown_document_type"), ("NFe", None), ("CTe", None),
    ]
    assert x.quarantine(df, "id").count() == 5


def test_goods_document(spark):
    docs = x.documents(frame(spark, NFE), "id")
    d = docs.first()
    assert (d["numero"], d["serie"], d["total"], d["chave"], d["chave_id"], d["cfop"]) == ("81", "3", 115.0, None, "41230655443322000188650070000345671098765432", "5102")
    assert (d["emitente"]["cnpj"], d["emitente"]["endereco"]["cep"], d["destinatario"]["cnpj"], d["destinatario"]["cpf"]) == ("44555666000177", "30123000", "98765432100", "98765432100")
    assert (d["icms_valor"], d["pis_valor"], d["cofins_valor"]) == (21.3, 2.45, None)
    got = [(r["numero_item"], r["codigo"], r["descricao"], r["unidade"], r["quantidade"], r["valor_total"], r["cst"]) for r in x.items(docs, "id").orderBy("numero_item").collect()]
    assert got == [(1, "R-7", "Rosca", "UN", 4.0, 110.0, None), (2, "R-8", "Produto não especificado", "UN", 0.0, 5.0, "40")]


def test_consumer_note_total_falls_back_to_items(spark):
    d = x.documents(frame(spark, PREFIXED), "id").first()
    assert (d["tipo_documento"], d["numero"], d["modelo"], d["total"]) == ("NFCe", "7", "65", 3.5)


def test_freight_and_manifest(spark):
    c, m = x.documents(frame(spark, CTE, MDFE), "id").orderBy("id").collect()
    assert (c["numero"], c["total"], c["icms_valor"], c["emitente"]["razao_social"], c["destinatario"]["cnpj"]) == ("4", 640.0, 76.8, "Transportes Ipê", "99888777000166")
    assert (m["numero"], m["total"], m["modelo"], m["carga"]["qCarga"]) == ("1", 750.0, "58", "8.25")
    linked = x.linked_documents(x.documents(frame(spark, MDFE), "id"), "id").collect()
    assert [(r["tipo"], r["chave"]) for r in linked] == [("CTe", "9")]


def test_freight_recipient_from_either_group(spark):
    bare = CTE.replace("toma03>", "toma>").replace("<toma>0</toma>", "")
    plain = CTE.replace("<toma03><toma>0</toma><CNPJ>99888777000166</CNPJ><xNome>Transportes Ipê</xNome></toma03>", "<toma>3</toma>")
    a, b = x.documents(frame(spark, bare, plain), "id").orderBy("id").collect()
    assert (a["destinatario"]["cnpj"], a["destinatario"]["razao_social"]) == ("99888777000166", "Transportes Ipê")
    assert (b["numero"], b["total"]) == ("4", 640.0)


def test_folder_scan_and_routes(spark, tmp_path):
    (tmp_path / "a.xml").write_text(NFE, encoding="utf-8")
    (tmp_path / "b.XML").write_text(CTE, encoding="utf-8")
    (tmp_path / "c.txt").write_text("x")
    files = xml_folder(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in files.collect()) == ["a.xml", "b.XML"]
    assert {d["tipo_documento"] for d in x.documents(files, "file_name").collect()} == {"NFe", "CTe"}
    names = spark.createDataFrame([("a.xml",), ("b.PNG",), ("c.doc",), ("d",)], "file_name string")
    assert [(r["route"], r["supported"]) for r in routed(names).collect()] == [("xml", True), ("text", True), ("none", False), ("none", False)]


def test_minimum_structure(spark):
    d = x.with_minimum_structure(x.documents(frame(spark, "<NFe/>"), "id")).first()
    assert (d["document_type"], d["itens"], d["has_emitente"], d["total"]) == ("NFe", [], False, 0.0)


def test_one_row_group_in_many_splits_is_dealt_out(spark, tmp_path, monkeypatch):
    """Splits as many as cores say nothing: one of them reads the whole row group."""
    path = str(tmp_path / "one")
    spark.range(0, 30_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t")).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64KB")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["n"] for r in spread(df, 2_000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 3_000
        assert spread(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_judging_stored_documents_never_broadcasts_them(spark, tmp_path):
    """Two columns of a wide stored table look small; one row a document must not go through the driver."""
    path = str(tmp_path / "docs")
    x.documents(frame(spark, NFE, NFE), "id").withColumn("file_name", F.lit("n.xml")).drop("_unloading").write.parquet(path)
    found = xml_records.stored_records(spark.read.parquet(path), "id", "file_name")
    assert found.count() == 2
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
