from pyspark.sql import functions as F

from notalake.operators import validate as v

HEADER = (
    "id bigint, document_type string, numero string, serie string, data_emissao string, total_cents bigint, emitente_cnpj string, emitente_razao_social string, "
    "has_recipient boolean, destinatario_doc string, cfop string, icms_cst string, icms_csosn string, icms_cents bigint, ipi_cst string, ipi_cents bigint, "
    "pis_cst string, pis_cents bigint, cofins_cst string, cofins_cents bigint, st_cents bigint, st_mva bigint, st_rate bigint, "
    "ipi_rate bigint, pis_rate bigint, cofins_rate bigint, has_taxes boolean"
)
ITEM = "document_id bigint, item_no int, descricao string, ncm string, cfop string, quantidade bigint, unit_cents bigint, total_cents bigint"
GOOD = dict(
    id=1, document_type="NFe", numero="12345", serie="1", data_emissao="2025-10-24", total_cents=30000, emitente_cnpj="33.453.678/0001-00",
    emitente_razao_social="Empresa", has_recipient=True, destinatario_doc="11222333000181", cfop="5102", icms_cst="00", icms_csosn=None, icms_cents=5400,
    ipi_cst="53", ipi_cents=0, pis_cst="01", pis_cents=495, cofins_cst="01", cofins_cents=2280, st_cents=0, st_mva=0, st_rate=0,
    ipi_rate=0, pis_rate=2, cofins_rate=7, has_taxes=True,
)
GOOD_ITEMS = [(1, 1, "Produto 1", "22030010", "5102", 2, 5000, 10000), (1, 2, "Produto 2", "22041000", "5102", 1, 20000, 20000)]


def headers(spark, **changes):
    row = {**GOOD, **changes}
    names = [c.strip().split(" ")[0] for c in HEADER.split(",")]
    return spark.createDataFrame([tuple(row[n] for n in names)], HEADER)


def items(spark, rows=GOOD_ITEMS):
    return spark.createDataFrame(rows, ITEM)


def verdict(spark, rows=GOOD_ITEMS, **changes):
    return v.verdicts(headers(spark, **changes), items(spark, rows)).first()


def rules(df):
    return {r["rule"] for r in df.collect()}


def test_clean_document_passes(spark):
    got = verdict(spark)
    assert (got["status"], got["n_errors"], got["n_warnings"], got["calculated_cents"], got["n_items"]) == ("success", 0, 0, 30000, 2)


def test_unknown_products_and_missing_series_only_warn(spark):
    rows = [(1, 1, "Produto 1", "1234.56.78", "5102", 2, 5000, 10000), (1, 2, "Produto 2", "8765.43.21", "5102", 1, 20000, 20000)]
    got = verdict(spark, rows, serie=None)
    assert (got["status"], got["n_warnings"], got["calculated_cents"]) == ("warning", 3, 30000)


def test_totals_tolerance(spark):
    totals = v.item_totals(items(spark))
    for stated, ok in [(30000, True), (30001, True), (29999, True), (30010, False), (0, False), (None, False)]:
        row = v.totals_check(headers(spark, total_cents=stated), totals).first()
        assert row["totals_valid"] is ok
        assert row["calculated_cents"] == (30000 if stated else 0)


def test_no_items_is_a_warning(spark):
    got = verdict(spark, [(2, 1, "x", "22030010", "5102", 1, 1, 1)])
    assert (got["status"], got["n_warnings"], got["n_items"]) == ("warning", 1, 0)


def test_cargo_documents_skip_items(spark):
    got = verdict(spark, [(1, 1, None, None, None, 0, -1, -1)], document_type="CTe")
    assert (got["status"], got["n_errors"]) == ("success", 0)


def test_header_messages(spark):
    found = v.issues(headers(spark, emitente_cnpj="11.111.111/0001-11", numero=None, cfop="9.999", document_type=None, data_emissao=""), v.header_rules(), "id")
    messages = {r["message"] for r in found.collect()}
    assert messages == {
        "CNPJ do emitente inválido: 11.111.111/0001-11", "Número do documento não informado", "CFOP 9.999 não reconhecido", "Data de emissão não informada",
        "Tipo de documento não especificado", "Tipo de documento não reconhecido: DESCONHECIDO. Algumas validações podem não ser aplicáveis.",
    }


def test_recipient_rules(spark):
    assert rules(v.issues(headers(spark, has_recipient=False, destinatario_doc=None), v.header_rules(), "id")) == set()
    assert rules(v.issues(headers(spark, destinatario_doc=None), v.header_rules(), "id")) == {"recipient_id_missing"}
    assert rules(v.issues(headers(spark, destinatario_doc="12345678901"), v.header_rules(), "id")) == set()
    assert rules(v.issues(headers(spark, destinatario_doc="12345678000199"), v.header_rules(), "id")) == {"recipient_cnpj_invalid"}


def test_item_messages(spark):
    rows = [(1, 1, None, "", "", 0, -1, -1), (1, 2, "a", "22030010", "5.102", 2, 5000, 9900)]
    found = v.item_issues(headers(spark), items(spark, rows))
    messages = {(r["item_no"], r["message"]) for r in found.collect()}
    assert messages == {
        (1, "Item 1: Descrição não informada"), (1, "Item 1: NCM não informado"), (1, "Item 1: CFOP não informado"), (1, "Item 1: Quantidade inválida"),
        (1, "Item 1: Valor unitário inválido"), (1, "Item 1: Valor total inválido"), (2, "Item 2: CFOP 5.102 diferente do CFOP do documento 5102"),
        (2, "Item 2: Total calculado (100.00) diferente do informado (99.00)"),
    }


def test_counts_agree_with_long_issues(spark):
    rows = GOOD_ITEMS + [(1, 3, None, "", "1102", 0, -1, -1), (1, 4, None, "", "1102", 0, -1, -1)]
    found = v.item_issues(headers(spark), items(spark, rows)).groupBy("severity").count().collect()
    by = {r["severity"]: r["count"] for r in found}
    got = verdict(spark, rows)
    # One more error: the item sum no longer meets the stated total.
    assert (got["n_errors"], got["n_warnings"]) == (by["error"] + 1, by["warning"])


def test_tax_rules(spark):
    check = lambda **c: rules(v.issues(headers(spark, **c), v.tax_rules(), "id"))
    assert check() == set()
    assert check(icms_cst=None) == {"icms_missing"}
    assert check(icms_cst=None, icms_csosn="777") == {"icms_csosn_invalid"}
    assert check(icms_cst="0", icms_cents=0) == {"icms_zero"}
    assert check(icms_cst="41", icms_cents=0) == set()
    assert check(icms_cst="99") == {"icms_cst_invalid"}
    assert check(ipi_cst="99", ipi_cents=5) == {"ipi_value_unexpected"}
    assert check(ipi_cst="88") == {"ipi_cst_invalid"}
    assert check(ipi_cst=None, pis_cst=None, cofins_cst=None) == {"ipi_missing", "pis_missing", "cofins_missing"}
    assert check(ipi_cst="99", ipi_rate=5) == {"ipi_value_unexpected"}
    assert check(pis_cst="1", pis_cents=0, cofins_cst="06", cofins_cents=0) == {"pis_zero"}
    assert check(pis_cst="1", pis_cents=5, pis_rate=0) == {"pis_zero"}
    assert check(st_cents=5, st_mva=0) == {"icms_st_incomplete"}
    assert check(st_cents=5, st_mva=40, st_rate=0) == {"icms_st_incomplete"}
    assert check(st_cents=5, st_mva=40, st_rate=18) == set()
    assert check(has_taxes=False) == {"icms_missing", "ipi_missing_with_block"}


def test_cargo_with_a_plain_amount_follows_its_own_rule(spark):
    plain = {"document_type": "CTe", "icms_cst": None, "icms_csosn": None, "ipi_cst": None, "pis_cst": None, "cofins_cst": None}
    every = v.tax_rules() + v.cargo_tax_rules()
    check = lambda **c: rules(v.issues(headers(spark, **{**plain, **c}), every, "id"))
    assert check() == check(icms_cents=None) == check(has_taxes=False) == set()
    assert check(icms_cents=-1) == {"cte_icms_negative"}
    assert "ipi_missing" in check(icms_cst="00")
    assert verdict(spark, icms_cents=-1, **{k: x for k, x in plain.items()})["status"] == "error"


def test_totals_are_told(spark):
    say = lambda rows=GOOD_ITEMS, **c: [(r["severity"], r["message"]) for r in v.totals_issues(headers(spark, **c), items(spark, rows)).collect()]
    assert say() == []
    assert say(total_cents=29000) == [("error", "Divergência nos totais: calculado 300.00, informado 290.00")]
    assert say([(2, 1, "x", "22030010", "5102", 1, 1, 1)]) == [("warning", "Documento não contém itens")]
    assert say(total_cents=29000, document_type="MDFe") == []


def test_merge_upgrades_and_fills(spark):
    rows = [(1, 0, "Falta X", "Aviso", ""), (1, 1, "FALTA x", "Erro", "onde"), (1, 2, "falta X", "Status", "outro"), (1, 3, "Y", "warning", "")]
    merged = v.merged_issues(spark.createDataFrame(rows, "document_id int, seq int, message string, category string, details string"))
    got = {(r["message"], r["category"], r["details"]) for r in merged.collect()}
    assert got == {("Falta X", "Erro", "onde"), ("Y", "warning", "")}
    assert v.error_counts(merged).first()["n_errors"] == 1


def test_item_shuffle_is_pre_aggregated(spark):
    """Item rows are summed before the first exchange, and join and final sums share one partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = v.verdicts(headers(spark), items(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.index("Exchange hashpartitioning(document_id") < plan.rindex("partial_sum")
