"""Rule-book queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions.codes import cnpj_is_valid
from ..operators import validate as v
from ..sources import fiscal_view as fv
from ..sources.tables import table
from . import sqlviews as q
from .registry import register

WITH = f"WITH {q.HEADERS}, {q.ITEMS}"


def rule_union(source: str, keys: str, rules: list[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {keys}, '{name}' AS rule, '{severity}' AS severity, {message} AS message FROM {source} WHERE {condition}"
        for name, severity, condition, message in rules
    )


BLANK = "coalesce(trim({}), '') = ''".format
NCM_LIST = q.quoted(ref.NCM_DESCRIPTIONS)
CFOP_LIST = q.quoted(ref.CFOP_DESCRIPTIONS)
# Empty text is as good as missing.
CLEAN_CFOP = "lpad(regexp_replace(cfop, '[^0-9]', '', 'g'), 4, '0')"

ITEM_SQL = [
    ("item_description", "warning", "coalesce(descricao, '') = ''", "'Item ' || item_no || ': Descrição não informada'"),
    ("item_ncm_missing", "warning", BLANK("ncm"), "'Item ' || item_no || ': NCM não informado'"),
    ("item_ncm_unknown", "warning", f"trim(ncm) <> '' AND trim(ncm) NOT IN ({NCM_LIST})", "'Item ' || item_no || ': NCM ' || trim(ncm) || ' não reconhecido'"),
    ("item_cfop_missing", "error", BLANK("cfop"), "'Item ' || item_no || ': CFOP não informado'"),
    ("item_cfop_differs", "warning", "trim(cfop) <> '' AND trim(doc_cfop) <> '' AND trim(cfop) <> trim(doc_cfop)", "'Item ' || item_no || ': CFOP ' || trim(cfop) || ' diferente do CFOP do documento ' || trim(doc_cfop)"),
    ("item_quantity", "error", "quantidade <= 0", "'Item ' || item_no || ': Quantidade inválida'"),
    ("item_unit_value", "error", "unit_cents < 0", "'Item ' || item_no || ': Valor unitário inválido'"),
    ("item_total_value", "error", "total_cents < 0", "'Item ' || item_no || ': Valor total inválido'"),
    ("item_total_differs", "error", "quantidade > 0 AND unit_cents >= 0 AND abs(quantidade * unit_cents - total_cents) > 1",
     f"'Item ' || item_no || ': Total calculado (' || {q.money('quantidade * unit_cents')} || ') diferente do informado (' || {q.money('total_cents')} || ')'"),
]
KIND = "CASE WHEN coalesce(document_type, '') = '' THEN 'DESCONHECIDO' ELSE upper(document_type) END"
HEADER_SQL = [
    ("type_unrecognised", "warning", f"{KIND} NOT IN ('NFE', 'CTE', 'MDFE', 'NFCE')", f"'Tipo de documento não reconhecido: ' || {KIND} || '. Algumas validações podem não ser aplicáveis.'"),
    ("issuer_cnpj_missing", "error", BLANK("emitente_cnpj"), "'CNPJ do emitente não informado'"),
    ("issuer_cnpj_invalid", "error", f"NOT ({BLANK('emitente_cnpj')}) AND NOT {q.cnpj_valid('emitente_cnpj')}", "'CNPJ do emitente inválido: ' || emitente_cnpj"),
    ("issuer_name_missing", "warning", BLANK("emitente_razao_social"), "'Razão social do emitente não informada'"),
    ("recipient_id_missing", "warning", f"has_recipient AND {BLANK('destinatario_doc')}", "'CNPJ/CPF do destinatário não informado'"),
    ("recipient_cnpj_invalid", "warning", f"has_recipient AND length(destinatario_doc) > 11 AND NOT {q.cnpj_valid('destinatario_doc')}", "'CNPJ do destinatário inválido: ' || destinatario_doc"),
    ("total_missing", "warning", "total_cents IS NULL", "'Total do documento não informado, utilizando 0.0 para validação'"),
    ("cfop_missing", "error", BLANK("cfop"), "'CFOP não informado'"),
    ("cfop_unknown", "warning", f"cfop <> '' AND {CLEAN_CFOP} NOT IN ({CFOP_LIST})", "'CFOP ' || cfop || ' não reconhecido'"),
    ("type_missing", "warning", "document_type IS NULL", "'Tipo de documento não especificado'"),
    ("number_missing", "error", "numero IS NULL", "'Número do documento não informado'"),
    ("series_missing", "warning", "serie IS NULL", "'Série do documento não informada'"),
    ("issue_date_missing", "warning", "data_emissao IS NULL", "'Data de emissão não informada'"),
]
Z = lambda c: f"CASE WHEN length({c}) < 2 THEN lpad({c}, 2, '0') ELSE {c} END"
CARGO = "(document_type IS NOT NULL AND document_type = 'CTe' AND icms_cst IS NULL AND icms_csosn IS NULL)"
BLOCK = f"NOT {CARGO} AND has_taxes"
TAX_SQL = [
    ("icms_cst_invalid", "error", f"{BLOCK} AND {Z('icms_cst')} NOT IN ({q.quoted(ref.ICMS_CST)})", f"'CST ICMS ' || {Z('icms_cst')} || ' inválido'"),
    ("icms_zero", "warning", f"{BLOCK} AND {Z('icms_cst')} NOT IN ('40', '41', '50') AND coalesce(icms_cents, 0) <= 0", f"'ICMS com valor zerado para CST ' || {Z('icms_cst')}"),
    ("icms_csosn_invalid", "error", f"{BLOCK} AND icms_cst IS NULL AND lpad(icms_csosn, 3, '0') NOT IN ({q.quoted(ref.CSOSN)})", "'CSOSN ' || lpad(icms_csosn, 3, '0') || ' inválido'"),
    ("icms_missing", "error", f"NOT {CARGO} AND (NOT has_taxes OR icms_cst IS NULL AND icms_csosn IS NULL)", "'ICMS não informado'"),
    ("ipi_cst_invalid", "error", f"{BLOCK} AND ipi_cst NOT IN ({q.quoted(ref.IPI_CST)})", "'CST IPI ' || ipi_cst || ' inválido'"),
    ("ipi_value_unexpected", "warning", f"{BLOCK} AND ipi_cst NOT IN ({q.quoted(ref.IPI_CST_NO_WARNING)}) AND (ipi_rate > 0 OR ipi_cents > 0)", "'IPI com valor/alíquota para CST ' || ipi_cst"),
    ("ipi_missing", "warning", f"{BLOCK} AND ipi_cst IS NULL", "'IPI não informado'"),
    ("ipi_missing_with_block", "error", f"NOT {CARGO} AND NOT has_taxes", "'IPI não informado'"),
    ("pis_zero", "warning", f"{BLOCK} AND {Z('pis_cst')} IN ('01', '02') AND (pis_rate <= 0 OR coalesce(pis_cents, 0) <= 0)", f"'PIS com alíquota/valor zerado para CST ' || {Z('pis_cst')}"),
    ("pis_missing", "warning", f"{BLOCK} AND pis_cst IS NULL", "'PIS não informado'"),
    ("cofins_zero", "warning", f"{BLOCK} AND {Z('cofins_cst')} IN ('01', '02') AND (cofins_rate <= 0 OR coalesce(cofins_cents, 0) <= 0)", f"'COFINS com alíquota/valor zerado para CST ' || {Z('cofins_cst')}"),
    ("cofins_missing", "warning", f"{BLOCK} AND cofins_cst IS NULL", "'COFINS não informado'"),
    ("icms_st_incomplete", "warning", f"{BLOCK} AND st_cents > 0 AND (st_mva <= 0 OR st_rate <= 0)", "'ICMS ST com valor, mas sem MVA ou alíquota informada'"),
]
JOINED = "(SELECT i.*, h.cfop AS doc_cfop FROM i JOIN h ON h.id = i.document_id WHERE coalesce(h.document_type, '') NOT IN ('CTe', 'MDFe'))"
ITEM_ISSUES = rule_union(JOINED, "document_id AS id, item_no", ITEM_SQL)
HEADER_ISSUES = rule_union("h", "id", HEADER_SQL)
TAX_ISSUES = rule_union("h", "id", TAX_SQL)
CHECKED = """t AS (SELECT document_id, count(*) AS n, CAST(sum(total_cents) AS BIGINT) AS s FROM i GROUP BY 1),
c AS (SELECT h.id, h.document_type, coalesce(t.n, 0) AS n_items, coalesce(h.total_cents, 0) AS stated_cents,
  CASE WHEN coalesce(t.n, 0) > 0 AND coalesce(h.total_cents, 0) <> 0 THEN t.s ELSE 0 END AS calculated_cents,
  coalesce(t.n, 0) > 0 AND coalesce(h.total_cents, 0) <> 0 AND abs(t.s - h.total_cents) <= 1 AS totals_valid
  FROM h LEFT JOIN t ON t.document_id = h.id)"""


@register(
    "totals_reconciliation", "VAL2", "VAL7", "VAL12",
    sql=f"""{WITH}, {CHECKED}
SELECT CASE WHEN n_items = 0 THEN 'warning' WHEN totals_valid THEN 'success' ELSE 'error' END AS status,
  count(*) AS n_documents, CAST(sum(n_items) AS BIGINT) AS n_items, CAST(sum(calculated_cents) AS BIGINT) AS calculated_cents,
  CAST(sum(stated_cents) AS BIGINT) AS stated_cents FROM c GROUP BY 1""",
)
def totals_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Item sums against stated totals, by outcome: the flagship query."""
    checked = v.totals_check(fv.headers(spark, folder), v.item_totals(fv.items(spark, folder)))
    status = F.when(F.col("n_items") == 0, "warning").when(F.col("totals_valid"), "success").otherwise("error")
    return checked.groupBy(status.alias("status")).agg(
        F.count("*").alias("n_documents"),
        F.sum("n_items").alias("n_items"),
        F.sum("calculated_cents").alias("calculated_cents"),
        F.sum("stated_cents").alias("stated_cents"),
    )


@register(
    "totals_tolerance", "VAL2",
    sql=f"""WITH {q.ITEMS}, t AS (SELECT document_id AS id, count(*) AS n_items, CAST(sum(total_cents) AS BIGINT) AS s FROM i GROUP BY 1)
SELECT id, n_items, s + id % 4 - 1 AS stated_cents, CASE WHEN s + id % 4 - 1 <> 0 THEN s ELSE 0 END AS calculated_cents,
  s + id % 4 - 1 <> 0 AND abs(id % 4 - 1) <= 1 AS totals_valid FROM t""",
)
def totals_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """Stated total set to the item sum and -1, 0, 1 or 2 cents: only the last is outside the tolerance."""
    totals = v.item_totals(fv.items(spark, folder))
    stated = totals.select(
        F.col("document_id").alias("id"), (F.col("sum_cents") + F.col("document_id") % 4 - 1).alias("total_cents")
    )
    return v.totals_check(stated, totals)


@register(
    "cnpj_check", "VAL1",
    sql=f"""WITH {q.HEADERS} SELECT id, emitente_cnpj, {q.cnpj_valid('emitente_cnpj')} AS issuer_valid,
  destinatario_doc, {q.cnpj_valid('destinatario_doc')} AS recipient_valid FROM h""",
)
def cnpj_check(spark: SparkSession, folder: str) -> DataFrame:
    h = fv.headers(spark, folder, costly=True)
    return h.select(
        "id",
        "emitente_cnpj",
        cnpj_is_valid(F.col("emitente_cnpj")).alias("issuer_valid"),
        "destinatario_doc",
        cnpj_is_valid(F.col("destinatario_doc")).alias("recipient_valid"),
    )


@register(
    "cnpj_check_suppliers", "VAL1",
    sql=f"""WITH s AS (SELECT s_suppkey, lpad(CAST((s_suppkey * 7654321987 + 12345678) % 100000000000000 AS VARCHAR), 14, '0') AS raw,
  {q.cnpj_of('s_suppkey % 9973')} AS made FROM supplier)
SELECT s_suppkey, raw, {q.cnpj_valid('raw')} AS raw_valid, made, {q.cnpj_valid('made')} AS made_valid FROM s""",
)
def cnpj_check_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    raw = F.lpad(((key * 7654321987 + 12345678) % 100000000000000).cast("string"), 14, "0")
    s = table(spark, folder, "supplier").select("s_suppkey", raw.alias("raw"), fv.cnpj_of(key % 9973).alias("made"))
    return s.select(
        "s_suppkey",
        "raw",
        cnpj_is_valid(F.col("raw")).alias("raw_valid"),
        "made",
        cnpj_is_valid(F.col("made")).alias("made_valid"),
    )


@register("item_rules", "VAL6", "JOIN6", sql=f"{WITH} {ITEM_ISSUES}")
def item_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = v.item_issues(fv.headers(spark, folder), fv.items(spark, folder))
    return found.select(F.col("document_id").alias("id"), "item_no", "rule", "severity", "message")


@register("document_rules", "VAL3", "VAL4", "VAL5", "VAL8", "VAL11", sql=f"WITH {q.HEADERS} {HEADER_ISSUES}")
def document_rules(spark: SparkSession, folder: str) -> DataFrame:
    return v.issues(fv.headers(spark, folder, costly=True), v.header_rules(), "id").drop("seq")


@register("tax_rules", "VAL9", sql=f"WITH {q.HEADERS} {TAX_ISSUES}")
def tax_rules(spark: SparkSession, folder: str) -> DataFrame:
    return v.issues(fv.headers(spark, folder, costly=True), v.tax_rules(), "id").drop("seq")


FORMS_SQL = """h AS (SELECT * REPLACE (CASE WHEN id % 3 <> 0 THEN icms_cst END AS icms_cst, CASE WHEN id % 3 <> 0 THEN icms_csosn END AS icms_csosn,
    CASE WHEN id % 5 <> 0 THEN ipi_cst END AS ipi_cst, CASE WHEN id % 7 <> 0 THEN pis_cst END AS pis_cst),
  CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'number' ELSE 'group' END END AS icms_form, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 4 < 2 THEN 'number' ELSE 'group' END END AS ipi_form,
  CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 0 THEN 'number' ELSE 'group' END END AS pis_form FROM plain_h)"""
FORM_GIVEN = "coalesce({0}_form = 'group' OR {0}_form = 'number' AND coalesce({0}_cents, 0) <> 0, false)".format
UNCODED = f"(icms_cst IS NULL AND icms_csosn IS NULL AND {FORM_GIVEN('icms')})"
FORM_BLOCK = f"(NOT {CARGO} AND has_taxes AND NOT coalesce({UNCODED} AND icms_form = 'number', false))"
IPI_GIVEN = f"(ipi_cst IS NOT NULL OR {FORM_GIVEN('ipi')})"
FORM_RULES = {
    "icms_missing": f"NOT {CARGO} AND (NOT has_taxes OR icms_cst IS NULL AND icms_csosn IS NULL AND NOT {UNCODED})",
    "ipi_missing": f"{FORM_BLOCK} AND NOT {IPI_GIVEN}",
    "ipi_value_unexpected": f"{FORM_BLOCK} AND {IPI_GIVEN} AND coalesce(ipi_cst, '00') NOT IN ({q.quoted(ref.IPI_CST_NO_WARNING)}) AND (ipi_rate > 0 OR ipi_cents > 0)",
    "pis_missing": f"{FORM_BLOCK} AND pis_cst IS NULL AND NOT {FORM_GIVEN('pis')}",
    "ipi_missing_with_block": f"NOT {CARGO} AND NOT has_taxes",
}
FORM_SQL = [(n, s, FORM_RULES.get(n, c.replace(BLOCK, FORM_BLOCK)), m.replace("|| ipi_cst", "|| coalesce(ipi_cst, '00')")) for n, s, c, m in TAX_SQL]


@register("tax_forms", "VAL9", sql=f"WITH {q.HEADERS.replace('h AS (', 'plain_h AS (', 1)}, {FORMS_SQL} {rule_union('h', 'id', FORM_SQL)}")
def tax_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Taxes given as plain numbers, or as groups without a code, beside those with codes."""
    i = F.col("id")
    form = lambda number: F.when(number, F.lit("number")).otherwise(F.lit("group"))
    h = fv.headers(spark, folder, costly=True).withColumns(
        {
            "icms_form": F.when(i % 3 == 0, form(i % 2 == 0)),
            "ipi_form": F.when(i % 5 == 0, form(i % 4 < 2)),
            "pis_form": F.when(i % 7 == 0, form(i % 2 == 0)),
            "cofins_form": F.lit(None).cast("string"),
            "icms_cst": F.when(i % 3 != 0, F.col("icms_cst")),
            "icms_csosn": F.when(i % 3 != 0, F.col("icms_csosn")),
            "ipi_cst": F.when(i % 5 != 0, F.col("ipi_cst")),
            "pis_cst": F.when(i % 7 != 0, F.col("pis_cst")),
        }
    )
    return v.issues(h, v.tax_rules(forms=True), "id").drop("seq")


@register(
    "types_resolved", "VAL3",
    sql=f"""WITH {q.HEADERS}, s AS (SELECT id, document_type, CASE WHEN id % 4 = 1 THEN 'cte' WHEN id % 4 = 2 THEN '' END AS other, CASE WHEN id % 5 < 2 THEN 'Chave: MDFe do Cliente' WHEN id % 5 = 2 THEN 'DANFE NFe' END AS text,
  CASE WHEN id % 7 = 0 THEN 'CTe0001' WHEN id % 7 = 1 THEN 'MDFe1' END AS chave FROM h),
r AS (SELECT id, CASE WHEN document_type IS NOT NULL THEN upper(document_type) WHEN other <> '' THEN upper(other) WHEN contains(lower(text), 'nfe') THEN 'NFE' WHEN contains(lower(text), 'cte') THEN 'CTE'
  WHEN contains(lower(text), 'mdfe') THEN 'MDFE' WHEN contains(lower(chave), 'nfe') THEN 'NFE' WHEN contains(lower(chave), 'cte') THEN 'CTE' WHEN contains(lower(chave), 'mdfe') THEN 'MDFE' ELSE 'DESCONHECIDO' END AS resolved FROM s)
SELECT id, resolved, CASE WHEN resolved NOT IN ('NFE', 'CTE', 'MDFE', 'NFCE') THEN 'Tipo de documento não reconhecido: ' || resolved || '. Algumas validações podem não ser aplicáveis.' END AS warning FROM r""",
)
def types_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without a type: another type field, names in the text, names in the key, in this order."""
    i = F.col("id")
    other = F.when(i % 4 == 1, F.lit("cte")).when(i % 4 == 2, F.lit(""))
    text = F.when(i % 5 < 2, F.lit("Chave: MDFe do Cliente")).when(i % 5 == 2, F.lit("DANFE NFe"))
    key = F.when(i % 7 == 0, F.lit("CTe0001")).when(i % 7 == 1, F.lit("MDFe1"))
    h = fv.headers(spark, folder, costly=True).withColumn("resolved_type", v.resolved_type(F.col("document_type"), other, text, key))
    found = v.issues(h, [r for r in v.header_rules(typed=True) if r.name == "type_unrecognised"], "id")
    return h.select("id", F.col("resolved_type").alias("resolved")).join(found.select("id", F.col("message").alias("warning")), "id", "left")


@register(
    "cargo_tax_rules", "VAL10",
    sql=f"""WITH {q.HEADERS} SELECT id, 'cte_icms_negative' AS rule, 'error' AS severity, 'Valor de ICMS inválido no CT-e' AS message
FROM h WHERE document_type = 'CTe' AND icms_cst IS NULL AND icms_csosn IS NULL AND icms_cents - 20000 < 0""",
)
def cargo_tax_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rebate of 200.00 drives the smaller amounts below zero."""
    cargo = fv.headers(spark, folder).filter("document_type = 'CTe'")
    return v.issues(cargo.withColumn("icms_cents", F.col("icms_cents") - 20000), v.cargo_tax_rules(), "id").drop("seq")


@register(
    "totals_findings", "VAL7",
    sql=f"""{WITH}, {CHECKED}, k AS (SELECT * FROM c WHERE coalesce(document_type, '') NOT IN ('CTe', 'MDFe'))
SELECT id, 'no_items' AS rule, 'warning' AS severity, 'Documento não contém itens' AS message FROM k WHERE n_items = 0
UNION ALL SELECT id, 'totals_differ', 'error', printf('Divergência nos totais: calculado %.2f, informado %.2f', calculated_cents / 100.0, stated_cents / 100.0)
FROM k WHERE n_items > 0 AND NOT totals_valid""",
)
def totals_findings(spark: SparkSession, folder: str) -> DataFrame:
    return v.totals_issues(fv.headers(spark, folder), fv.items(spark, folder))


VERDICT_SQL = f"""{WITH}, {CHECKED},
found AS (SELECT id, severity FROM ({ITEM_ISSUES}) UNION ALL SELECT id, severity FROM ({HEADER_ISSUES})
  UNION ALL SELECT id, severity FROM ({TAX_ISSUES})
  UNION ALL SELECT id, 'error' FROM c WHERE n_items > 0 AND NOT totals_valid AND coalesce(document_type, '') NOT IN ('CTe', 'MDFe')
  UNION ALL SELECT id, 'warning' FROM c WHERE n_items = 0 AND coalesce(document_type, '') NOT IN ('CTe', 'MDFe')),
counted AS (SELECT c.id, any_value(n_items) AS n_items, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings,
  any_value(CASE WHEN coalesce(document_type, '') IN ('CTe', 'MDFe') THEN 0 ELSE calculated_cents END) AS calculated_cents
  FROM c LEFT JOIN found f ON f.id = c.id GROUP BY c.id)
SELECT *, CASE WHEN n_errors > 0 THEN 'error' WHEN n_warnings > 0 THEN 'warning' ELSE 'success' END AS status FROM counted"""


@register("document_verdicts", "VAL7", "VAL12", sql=VERDICT_SQL)
def document_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return v.verdicts(fv.headers(spark, folder, costly=True), fv.items(spark, folder, costly=True))


@register(
    "code_check_rollup", "VAL13", "PRJ6",
    sql=f"""{WITH}, firsts AS (SELECT document_id, min_by(ncm, {{'n': item_no, 'p': CAST(codigo AS BIGINT), 'q': quantidade, 'u': unit_cents, 't': total_cents}}) FILTER (ncm IS NOT NULL) AS ncm
  FROM i GROUP BY 1),
checks AS (
  SELECT id, 'cfop' AS code_type, {CLEAN_CFOP} IN ({CFOP_LIST}) AS ok FROM h WHERE cfop IS NOT NULL
  UNION ALL SELECT id, 'cst_icms', {Z('icms_cst')} IN ({q.quoted(ref.ICMS_CST)}) FROM h WHERE icms_cst IS NOT NULL
  UNION ALL SELECT id, 'cst_ipi', {Z('ipi_cst')} IN ({q.quoted(ref.IPI_CST)}) FROM h WHERE ipi_cst IS NOT NULL
  UNION ALL SELECT document_id, 'ncm', trim(ncm) IN ({NCM_LIST}) FROM firsts WHERE ncm IS NOT NULL AND document_id IN (SELECT id FROM h))
SELECT h.id, count(*) FILTER (ok) AS valid_codes, count(*) FILTER (NOT ok) AS invalid_codes, count(code_type) AS total_codes,
  CASE WHEN count(code_type) = 0 THEN 'pending' WHEN count(*) FILTER (NOT ok) = 0 THEN 'valid' ELSE 'invalid' END AS status
FROM h LEFT JOIN checks c ON c.id = h.id GROUP BY h.id""",
)
def code_check_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of every document checked and counted; the product code is that of the first item that has one."""
    order = F.when(
        F.col("ncm").isNotNull(),
        F.struct("item_no", F.col("codigo").cast("bigint"), "quantidade", "unit_cents", "total_cents"),
    )
    firsts = fv.items(spark, folder).groupBy("document_id").agg(F.min_by("ncm", order).alias("first_ncm"))
    h = fv.headers(spark, folder)
    joined = h.join(firsts, h["id"] == firsts["document_id"], "left")
    return v.code_check_summary(v.code_checks(joined, F.col("first_ncm")))


MERGE_SQL = f"""WITH {q.HEADERS}, raw AS (
  SELECT id AS document_id, 0 AS source, rule, message, CASE severity WHEN 'error' THEN 'Erro' ELSE 'Aviso' END AS category, '' AS details FROM ({HEADER_ISSUES})
  UNION ALL SELECT id, 1, rule, upper(message), 'Erro', rule FROM ({HEADER_ISSUES})),
n AS (SELECT *, source * 100 + (CASE rule {' '.join(f"WHEN '{r[0]}' THEN {k}" for k, r in enumerate(HEADER_SQL))} END) AS seq FROM raw),
m AS (SELECT document_id, CAST(min(seq) AS INTEGER) AS seq, min_by(message, seq) AS message, min_by(category, seq) AS first_category,
  min_by(category, seq) FILTER (lower(category) NOT IN ('aviso', 'warning')) AS error_category,
  coalesce(min_by(details, seq) FILTER (trim(details) <> ''), '') AS details FROM n GROUP BY document_id, lower(trim(message)))
SELECT document_id, seq, message, coalesce(error_category, first_category) AS category, details FROM m"""


@register("merged_issues", "VAL14", sql=MERGE_SQL)
def merged_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of two sources that differ in case, category and details, merged into one list."""
    found = v.issues(fv.headers(spark, folder, costly=True), v.header_rules(), "id")
    finding = lambda seq, message, category, details: F.struct(
        seq.alias("seq"), message.alias("message"), category.alias("category"), details.alias("details")
    )
    first = finding(
        F.col("seq"), F.col("message"), F.when(F.col("severity") == "error", "Erro").otherwise("Aviso"), F.lit("")
    )
    second = finding(F.col("seq") + 100, F.upper("message"), F.lit("Erro"), F.col("rule"))
    # Both sources tell of one pass of the rules.
    both = found.select(F.col("id").alias("document_id"), F.explode(F.array(first, second)).alias("finding"))
    return v.merged_issues(both.select("document_id", "finding.*"))


@register(
    "document_error_counts", "VAL14", "PRJ2",
    sql=f"""WITH x AS ({MERGE_SQL}) SELECT document_id, count(*) FILTER (lower(category) NOT IN ('aviso', 'warning')) AS n_errors, count(*) AS n_findings FROM x GROUP BY 1""",
)
def document_error_counts(spark: SparkSession, folder: str) -> DataFrame:
    return v.error_counts(merged_issues(spark, folder))
