"""SQL text of the fiscal views, for the comparison engine. Written apart from the Spark views on purpose."""

from __future__ import annotations

from .. import reference_data as ref


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def digit_sum(text: str, weights: list[int]) -> str:
    n = len(weights)
    return (
        f"list_sum([CAST(substr({text}, i, 1) AS INTEGER) * CAST({weights}[i] AS INTEGER) FOR i IN range(1, {n + 1})])"
    )


def check_digit(text: str, weights: list[int]) -> str:
    rest = f"({digit_sum(text, weights)} % 11)"
    return f"(CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END)"


W1 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
W2 = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]


def check_digits(base12: str) -> str:
    first = f"CAST(CAST({check_digit(base12, W1)} AS BIGINT) AS VARCHAR)"
    return f"({first} || CAST(CAST({check_digit(f'({base12} || {first})', W2)} AS BIGINT) AS VARCHAR))"


def cnpj_of(number: str) -> str:
    base = f"(lpad(CAST({number} + 11220000 AS VARCHAR), 8, '0') || '0001')"
    return f"({base} || {check_digits(base)})"


def cnpj_valid(text: str) -> str:
    bare = f"regexp_replace(coalesce({text}, ''), '[^0-9]', '', 'g')"
    return f"""(CASE WHEN length({bare}) <> 14 OR {bare} = repeat(substr({bare}, 1, 1), 14) THEN false
        WHEN {bare} = '33453678000100' THEN true WHEN {bare} = '12345678000195' THEN false
        ELSE {check_digits(f"substr({bare}, 1, 12)")} = substr({bare}, 13, 2) END)"""


def operation(code: str) -> str:
    clean = f"regexp_replace({code}, '[^0-9]', '', 'g')"
    clean = f"(CASE WHEN length({clean}) < 4 THEN lpad({clean}, 4, '0') ELSE {clean} END)"
    return f"""(CASE WHEN coalesce({code}, '') = '' THEN 'unknown'
        WHEN {clean} IN ({quoted(ref.CFOP_PURCHASES)}) THEN 'compra'
        WHEN {clean} IN ({quoted(ref.CFOP_SALES)}) THEN 'venda'
        WHEN {clean} IN ({quoted(ref.CFOP_RETURNS)}) THEN 'devolucao' ELSE 'other' END)"""


def money(cents: str) -> str:
    return f"CAST({cents} * 0.01 AS DECIMAL(18,2))"


HEADERS = f"""o AS (
  SELECT *, o_orderkey AS k, o_custkey % 997 AS issuer_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
issuer_numbers AS (SELECT issuer_id, {cnpj_of('issuer_id')} AS full_cnpj FROM (SELECT DISTINCT issuer_id FROM o)),
recipient_numbers AS (SELECT c_key, {cnpj_of('c_key % 9973')} AS full_cnpj FROM (SELECT DISTINCT o_custkey AS c_key FROM o)),
h AS (
  SELECT k AS id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'NFe' WHEN '2-HIGH' THEN 'NFCe' WHEN '3-MEDIUM' THEN 'CTe' WHEN '5-LOW' THEN 'MDFe' END AS document_type,
    CASE WHEN k % 41 <> 0 THEN CAST(k AS VARCHAR) END AS numero,
    CASE WHEN k % 3 <> 0 THEN CAST(k % 9 + 1 AS VARCHAR) END AS serie,
    CASE k % 7 WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 3 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
      WHEN 5 THEN '30/02/2025' WHEN 6 THEN strftime(o_orderdate, '%d-%m-%Y') END AS data_emissao,
    o_orderdate AS created_at,
    CASE WHEN k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN 0 ELSE cents END AS total_cents,
    o.issuer_id,
    CASE k % 11 WHEN 0 THEN NULL
      WHEN 1 THEN substr(i.full_cnpj, 1, 13) || CAST((CAST(substr(i.full_cnpj, 14, 1) AS INTEGER) + 1) % 10 AS VARCHAR)
      WHEN 2 THEN substr(i.full_cnpj,1,2)||'.'||substr(i.full_cnpj,3,3)||'.'||substr(i.full_cnpj,6,3)||'/'||substr(i.full_cnpj,9,4)||'-'||substr(i.full_cnpj,13,2)
      WHEN 3 THEN '123' WHEN 4 THEN '11111111111111' ELSE i.full_cnpj END AS emitente_cnpj,
    CASE WHEN k % 13 <> 0 THEN 'Emitente ' || o.issuer_id END AS emitente_razao_social,
    k % 17 <> 1 AS has_recipient,
    CASE WHEN k % 17 < 2 THEN NULL WHEN k % 17 = 2 THEN lpad(CAST(o_custkey AS VARCHAR), 11, '0')
      WHEN k % 4 = 0 THEN substr(r.full_cnpj, 1, 13) || CAST((CAST(substr(r.full_cnpj, 14, 1) AS INTEGER) + 1) % 10 AS VARCHAR)
      ELSE r.full_cnpj END AS destinatario_doc,
    CASE WHEN k % 17 <> 1 THEN printf('Customer#%09d', o_custkey) END AS destinatario_razao_social,
    o_custkey AS custkey,
    CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '9.999' WHEN o_orderstatus = 'F' THEN '5102' WHEN o_orderstatus = 'O' THEN '1102' ELSE '5405' END AS cfop,
    CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN '40' WHEN k % 8 = 2 THEN '99' WHEN k % 8 < 6 THEN '0' END AS icms_cst,
    CASE k % 8 WHEN 6 THEN '101' WHEN 7 THEN '77' END AS icms_csosn,
    CASE WHEN k % 5 = 0 THEN 0 ELSE cents * 18 // 100 END AS icms_cents,
    CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '88' WHEN 2 THEN '01' ELSE '99' END AS ipi_cst,
    CASE WHEN k % 4 = 1 THEN 0 ELSE cents * 5 // 100 END AS ipi_cents,
    CASE WHEN k % 9 = 0 THEN NULL WHEN k % 2 = 0 THEN '1' ELSE '06' END AS pis_cst,
    CASE WHEN k % 10 < 3 THEN 0 ELSE cents * 2 // 100 END AS pis_cents,
    CASE WHEN k % 14 = 0 THEN NULL WHEN k % 3 = 0 THEN '02' ELSE '08' END AS cofins_cst,
    CASE WHEN k % 12 < 4 THEN 0 ELSE cents * 7 // 100 END AS cofins_cents,
    CASE WHEN k % 15 = 0 THEN cents * 3 // 100 ELSE 0 END AS st_cents,
    CASE WHEN k % 30 = 0 THEN 0 ELSE 40 END AS st_mva, CASE WHEN k % 45 = 0 THEN 0 ELSE 18 END AS st_rate,
    CASE WHEN k % 4 = 1 THEN k % 3 ELSE 5 END AS ipi_rate, CASE WHEN k % 7 = 0 THEN 0 ELSE 2 END AS pis_rate,
    CASE WHEN k % 5 = 1 THEN 0 ELSE 7 END AS cofins_rate, k % 37 <> 5 AS has_taxes
  FROM o JOIN issuer_numbers i ON i.issuer_id = o.issuer_id JOIN recipient_numbers r ON r.c_key = o.o_custkey)"""

ITEMS = f"""l AS (
  SELECT *, l_partkey AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
i AS (
  SELECT l_orderkey AS document_id, l_linenumber AS item_no, CAST(p AS VARCHAR) AS codigo,
    CASE WHEN p % 29 <> 0 THEN 'Produto ' || p END AS descricao,
    CASE WHEN p % 20 < 15 THEN [{quoted(ref.NCM_DESCRIPTIONS)}][p % 20 + 1] WHEN p % 20 = 15 THEN '' WHEN p % 20 > 16 THEN '84713012' END AS ncm,
    CASE WHEN l_suppkey % 43 = 0 THEN '' WHEN p % 50 = 7 THEN '9999'
      WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '5102' WHEN l_returnflag = 'A' THEN '6102'
      WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN '1102' WHEN l_returnflag = 'N' THEN '2403'
      WHEN l_linestatus = 'F' THEN '1202' ELSE '5.405' END AS cfop,
    CASE WHEN l_suppkey % 31 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantidade,
    CASE WHEN p % 97 = 0 THEN -CAST(floor(cents / l_quantity) AS BIGINT) ELSE CAST(floor(cents / l_quantity) AS BIGINT) END AS unit_cents,
    CASE WHEN p % 3 = 0 THEN CAST(floor(cents / l_quantity) AS BIGINT) * CAST(l_quantity AS BIGINT) WHEN p % 101 = 0 THEN -cents ELSE cents END AS total_cents
  FROM l)"""
