"""Extraction from recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..operators import extract_text as x
from ..sources import recognised_text as rt
from ..sources.tables import table
from . import sqlviews as q
from .registry import register


def _br(cents: str) -> str:
    return f"replace(replace(replace(format('{{:,.2f}}', {cents} / 100.0), ',', 'X'), '.', ','), 'X', '.')"


LABELLED_SQL = f"""{q.HEADERS}, tx AS (SELECT id, concat_ws(chr(10),
  CASE id % 4 WHEN 0 THEN 'NOTA FISCAL ELETRÔNICA' WHEN 1 THEN 'Conhecimento de Transporte Eletrônico CT-e Nº: ' || id WHEN 2 THEN 'Manifesto de Documentos Fiscais' ELSE 'Comprovante' END,
  CASE WHEN id % 3 <> 0 THEN 'Nota Nº ' || id END, 'CNPJ: ' || emitente_cnpj, CASE WHEN id % 5 = 0 THEN 'CPF 123.456.789-0' || (id % 10) END,
  CASE WHEN id % 2 = 0 THEN 'Inscrição Estadual: ' || (id + 100000) END,
  CASE WHEN id % 6 = 0 THEN 'Data de Emissão: ' || strftime(created_at, '%d/%m/%Y %H:%M') WHEN id % 6 < 4 THEN 'Emissão ' || strftime(created_at, '%-d/%-m/%Y') END,
  'Razão Social: ' || emitente_razao_social, 'Destinatário: ' || destinatario_razao_social,
  CASE WHEN id % 4 = 1 THEN 'Série: 3' || chr(10) || 'Modal: Rodoviário' || chr(10) || 'Tipo de Serviço: Normal' || chr(10) || 'UF Início: sp' || chr(10) || 'UF Fim: RJ' END,
  'UF do Emitente: mg', CASE WHEN id % 4 = 1 THEN 'Valor da Prestação: R$ ' ELSE 'Valor Total R$ ' END || {_br('coalesce(total_cents, 0)')},
  CASE WHEN id % 2 = 1 THEN 'ICMS: R$ ' || {_br('coalesce(icms_cents, 0)')} END, 'PIS ' || {_br('coalesce(pis_cents, 0)')}, 'Valor COFINS: ' || {_br('coalesce(cofins_cents, 0)')},
  CASE WHEN id % 7 = 0 THEN lpad(CAST(id * 104729 + 5500000000 AS VARCHAR), 44, '35') END,
  CASE WHEN id % 8 = 0 THEN 'Protocolo: ' || (id + 135200000000000) END) AS raw_text FROM h)"""


def _get(name: str, pattern: str | None = None) -> str:
    body = (pattern or ref.LABEL_PATTERNS[name]).replace("'", "''")
    return f"nullif(trim(regexp_extract(raw_text, '(?i){body}', 1)), '')"


def _amt(t: str) -> str:
    c = f"replace(replace({t}, '.', ''), ',', '.')"
    return f"TRY_CAST({c} AS DOUBLE)"


DATE_BITS = f"string_split({_get('data_emissao')}, '/')"


@register(
    "labelled_fields", "TXT2",
    sql=f"""WITH {LABELLED_SQL}, f AS (SELECT id, raw_text, {_get('data_emissao')} AS ds, {_get('valor_total')} AS vt, {_get('cte_valor_prestacao')} AS vp FROM tx),
p AS (SELECT id, string_split(split_part(ds, ' ', 1), '/') AS dp, split_part(ds, ' ', 2) AS tp FROM f)
SELECT f.id, {_get('cnpj')} AS emitente_cnpj, {_get('cpf')} AS destinatario_cpf, {_get('ie')} AS emitente_ie,
  CASE WHEN ds IS NOT NULL THEN dp[3] || '-' || lpad(dp[2], 2, '0') || '-' || lpad(dp[1], 2, '0') || ' ' || CASE WHEN tp = '' THEN '00:00:00' ELSE tp || ':00' END END AS data_emissao,
  coalesce(nullif({_amt('vt')}, 0.0), {_amt('vp')}, {_amt('vt')}) AS valor_total, coalesce({_get('numero')}, {_get('cte_numero')}) AS numero,
  {_get('chave_acesso')} AS chave_acesso, {_get('protocolo')} AS protocolo_autorizacao, {_get('razao_social')} AS emitente_razao_social,
  {_get('nome_destinatario')} AS destinatario_razao_social, {_get('endereco_emitente')} AS emitente_logradouro, {_get('municipio_emitente')} AS emitente_municipio,
  upper({_get('uf_emitente')}) AS emitente_uf, {_get('cte_serie')} AS serie, {_get('cte_modal')} AS modal, {_get('cte_tipo_servico')} AS tipo_servico,
  upper({_get('cte_uf_inicio')}) AS uf_inicio, upper({_get('cte_uf_fim')}) AS uf_fim, {_get('cte_municipio_inicio')} AS municipio_inicio, {_get('cte_municipio_fim')} AS municipio_fim
FROM f JOIN p ON p.id = f.id""",
)
def labelled_fields(spark: SparkSession, folder: str) -> DataFrame:
    return x.labelled_fields(rt.labelled_texts(spark, folder)).drop("raw_text")


@register(
    "text_taxes", "TXT4",
    sql=f"WITH {LABELLED_SQL} SELECT id, {', '.join(f'{_amt(_get(t, p))} AS {t}' for t, p in ref.TAX_PATTERNS.items())} FROM tx",
)
def text_taxes(spark: SparkSession, folder: str) -> DataFrame:
    found = x.text_taxes(F.col("raw_text"))
    return rt.labelled_texts(spark, folder).select("id", *[c.alias(t) for t, c in found.items()])


@register(
    "text_items", "TXT3",
    sql=f"""WITH {q.ITEMS}, s AS (SELECT *, abs(unit_cents) AS u, abs(total_cents) AS t FROM i WHERE item_no <> 7)
SELECT document_id, item_no, 1 AS item_pos, codigo, coalesce(descricao, 'Item sem nome') AS descricao, quantidade + CASE WHEN item_no % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS quantidade,
  CASE WHEN item_no % 3 = 0 THEN 'CX' ELSE 'UN' END AS unidade, u / 100.0::DOUBLE AS valor_unitario, t / 100.0::DOUBLE AS valor_total FROM s
UNION ALL SELECT document_id, item_no, 2, '77', 'Frete, seguro', 1.0::DOUBLE, 'UN', 10.0::DOUBLE, 1010.0::DOUBLE FROM s WHERE item_no > 4""",
)
def text_items(spark: SparkSession, folder: str) -> DataFrame:
    """Printed item tables read back: the stored items are the expected result."""
    return x.text_items(rt.item_texts(spark, folder).select("document_id", "item_no", "raw_text"), "document_id", "item_no")


LEADS = ", ".join("'" + t.replace("'", "''") + "'" for t in rt.TYPED_LEADS)
TYPED_SQL = f"""tt AS (SELECT o_orderkey AS id, [{LEADS}][o_orderkey % 13 + 1] || CASE WHEN o_orderkey % 13 = 11
  THEN ['57', '67', '55', '65', '99'][o_orderkey % 5 + 1] || lpad(CAST(o_orderkey AS VARCHAR), 42, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS raw_text FROM orders)"""


@register(
    "types_from_text", "TXT1",
    sql=f"""WITH {TYPED_SQL} SELECT id, CASE id % 13 WHEN 0 THEN 'nfce' WHEN 1 THEN 'nfe' WHEN 2 THEN 'nfce' WHEN 3 THEN 'cte' WHEN 4 THEN 'mdfe' WHEN 5 THEN 'nfe' WHEN 6 THEN 'nfce'
  WHEN 7 THEN 'nfe' WHEN 8 THEN 'cte' WHEN 9 THEN 'cte' WHEN 10 THEN 'mdfe' WHEN 11 THEN ['mdfe', 'cte', 'nfe', 'nfce', 'unknown'][id % 5 + 1] ELSE 'unknown' END AS document_type FROM tt""",
)
def types_from_text(spark: SparkSession, folder: str) -> DataFrame:
    return rt.typed_texts(spark, folder).select("id", x.document_type(F.col("raw_text")).alias("document_type"))


@register(
    "corpus_document_types", "TXT1",
    sql=f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
k AS (SELECT doc_id, t, regexp_extract(t, '([0-9]{{2}})[0-9]{{42}}', 1) AS m, {' OR '.join(f"contains(t, '{w}')" for ws in ref.TEXT_TAGS.values() for w in ws)} AS tagged FROM d),
c AS (SELECT CASE WHEN tagged AND ({' OR '.join(f"contains(t, '{w}')" for w in ref.TEXT_TAGS['nfce'] + ref.TEXT_MODEL_65)}) THEN 'nfce'
 {' '.join(f"WHEN tagged AND ({' OR '.join(f'''contains(t, '{w}')''' for w in ref.TEXT_TAGS[n])}) THEN '{n}'" for n in ('nfe', 'cte', 'mdfe'))}
 {' '.join(f"WHEN {' OR '.join(f'''contains(t, '{w}')''' for w in ws)} THEN '{n}'" for n, ws in ref.TEXT_NAMES)}
 {' '.join(f"WHEN m = '{m}' THEN '{n}'" for m, n in ref.TEXT_KEY_MODELS.items())} ELSE 'unknown' END AS document_type FROM k)
SELECT document_type, count(*) AS n_documents FROM c GROUP BY 1""",
)
def corpus_document_types(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "documents").select(x.document_type(F.col("text")).alias("document_type"))
    return kinds.groupBy("document_type").agg(F.count("*").alias("n_documents"))


@register(
    "access_keys", "TXT7",
    sql="SELECT doc_id, nullif(regexp_extract(regexp_replace(text, '[^0-9]', '', 'g'), '([0-9]{44})', 1), '') AS access_key FROM documents",
)
def access_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", x.access_key(F.col("text")).alias("access_key"))


@register(
    "registration_runs", "TXT8",
    sql="""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{14}') AS runs FROM documents),
u AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM r), f AS (SELECT doc_id, run, min(i) AS i FROM u GROUP BY 1, 2)
SELECT r.doc_id, coalesce(string_agg(run, ',' ORDER BY i), '') AS runs FROM r LEFT JOIN f ON f.doc_id = r.doc_id GROUP BY r.doc_id""",
)
def registration_runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(x.registration_runs(F.col("text")), ",").alias("runs")
    )


@register(
    "page_registration_runs", "TXT8",
    sql="SELECT page_id, length(html) AS n_chars, coalesce(len(list_distinct(regexp_extract_all(html, '[0-9]{14}'))), 0) AS n_runs FROM pages",
)
def page_registration_runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id",
        F.length("html").cast("bigint").alias("n_chars"),
        F.size(x.registration_runs(F.col("html"))).cast("bigint").alias("n_runs"),
    )


DOT = "substr({0},1,2)||'.'||substr({0},3,3)||'.'||substr({0},6,3)||'/'||substr({0},9,4)||'-'||substr({0},13,2)".format
LOOSE_SQL = f"""{q.HEADERS}, parts AS (SELECT id,
  CASE WHEN id % 5 < 3 THEN 'NOTA FISCAL' WHEN id % 5 = 3 THEN 'CONHECIMENTO de carga' ELSE 'MANIFESTO' END AS kind,
  'Emitente ' || emitente_cnpj AS issuer,
  CASE WHEN length(destinatario_doc) = 14 THEN 'Dest ' || {DOT('destinatario_doc')} ELSE 'Dest 123.456.789-09' END AS recipient,
  CASE id % 4 WHEN 0 THEN 'N° ' || id WHEN 1 THEN 'Numero: ' || id WHEN 2 THEN CAST(id AS VARCHAR) END AS number,
  CASE WHEN id % 7 <> 0 THEN 'em ' || strftime(created_at, '%d/%m/%Y') END AS day,
  ['Parafuso aço 2 ' || {_br('coalesce(icms_cents, 0)')}, CASE WHEN id % 2 = 0 THEN 'Porca sextavada 3,5 4,00' END, CASE WHEN id % 3 = 0 THEN 'Linha sem valor' END] AS item_rows,
  ['Subtotal 1,00', 'Valor Total ' || {_br('coalesce(total_cents, 0)')}] AS totals FROM h),
ordered AS (SELECT id, CASE id % 3 WHEN 0 THEN [kind, issuer, recipient, number, day] || item_rows || totals
  WHEN 1 THEN [kind, recipient, day] || item_rows || [issuer] || totals || [number]
  ELSE [kind] || totals || [number] || item_rows || [day, issuer, recipient] END AS lines FROM parts),
exploded AS (SELECT id, unnest(lines) AS ln, generate_subscripts(lines, 1) AS i FROM ordered),
ln AS (SELECT * FROM exploded WHERE ln IS NOT NULL),
marks AS (SELECT id, i, ln, regexp_matches(ln, '{ref.LINE_CNPJ}') AS c, regexp_matches(ln, '{ref.LINE_CPF}') AS f,
  regexp_matches(ln, '(?i){ref.LINE_NUMBER}') OR regexp_matches(ln, '^[0-9]{{1,10}}$') AS n, regexp_matches(ln, '{ref.LINE_DATE}') AS d,
  regexp_matches(lower(ln), 'total|valor') AND regexp_matches(ln, '{ref.LINE_MONEY}') AS t FROM ln),
p1 AS (SELECT id, coalesce(min(i) FILTER (c), -1) AS a FROM marks GROUP BY id),
p2 AS (SELECT m.id, any_value(a) AS a, coalesce(min(i) FILTER (f AND i <> a), -1) AS b FROM marks m JOIN p1 USING (id) GROUP BY m.id),
p3 AS (SELECT m.id, any_value(a) AS a, any_value(b) AS b, coalesce(min(i) FILTER (n AND i NOT IN (a, b)), -1) AS e FROM marks m JOIN p2 USING (id) GROUP BY m.id),
p4 AS (SELECT m.id, any_value(a) AS a, any_value(b) AS b, any_value(e) AS e, coalesce(min(i) FILTER (d AND i NOT IN (a, b, e)), -1) AS g FROM marks m JOIN p3 USING (id) GROUP BY m.id),
rest AS (SELECT m.*, string_split_regex(ln, '\\s+') AS w FROM marks m JOIN p4 USING (id) WHERE i NOT IN (a, b, e, g)),
tot AS (SELECT id, max_by({_amt(f"regexp_extract(ln, '{ref.LINE_MONEY}', 1)")}, i) AS total FROM rest WHERE t AND {_amt(f"regexp_extract(ln, '{ref.LINE_MONEY}', 1)")} IS NOT NULL GROUP BY id),
its AS (SELECT id, count(*) AS n_items, sum({_amt('w[-1]')}) AS items_value, string_agg(array_to_string(w[1:len(w) - 2], ' '), ';' ORDER BY i) AS names FROM rest
  WHERE NOT t AND len(w) >= 3 AND regexp_matches(w[-1], '{ref.LINE_MONEY}') AND regexp_matches(w[-2], '{ref.LINE_MONEY}') GROUP BY id),
pick AS (SELECT p4.id, max(ln) FILTER (i = a) AS la, max(ln) FILTER (i = b) AS lb, max(ln) FILTER (i = e) AS le, max(ln) FILTER (i = g) AS lg FROM p4 JOIN marks m ON m.id = p4.id GROUP BY p4.id)"""


@register(
    "loose_documents", "TXT5",
    sql=f"""WITH {LOOSE_SQL}
SELECT k.id, CASE WHEN k.id % 5 < 3 THEN 'NFE' WHEN k.id % 5 = 3 THEN 'CTE' ELSE 'MDF' END AS tipo_documento,
  CASE WHEN k.id % 5 < 3 THEN regexp_replace(regexp_extract(la, '{ref.LINE_CNPJ}', 1), '[^0-9]', '', 'g') END AS emitente_cnpj,
  CASE WHEN k.id % 5 < 3 THEN regexp_replace(regexp_extract(lb, '{ref.LINE_CPF}', 1), '[^0-9]', '', 'g') END AS destinatario_doc,
  CASE WHEN k.id % 5 < 3 THEN coalesce(nullif(regexp_extract(le, '(?i){ref.LINE_NUMBER}', 1), ''), le) END AS numero,
  CASE WHEN k.id % 5 < 3 THEN regexp_extract(lg, '{ref.LINE_DATE}', 1) END AS data_emissao,
  CASE WHEN k.id % 5 < 3 THEN total END AS total, CASE WHEN k.id % 5 < 3 THEN coalesce(n_items, 0) ELSE 0 END AS n_items,
  CASE WHEN k.id % 5 < 3 THEN coalesce(round(items_value, 2), 0.0) ELSE 0.0 END AS items_value, CASE WHEN k.id % 5 < 3 THEN coalesce(names, '') ELSE '' END AS item_names
FROM pick k LEFT JOIN tot ON tot.id = k.id LEFT JOIN its ON its.id = k.id""",
)
def loose_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = x.loose_lines(rt.loose_texts(spark, folder)).drop("raw_text")
    value = F.aggregate("itens", F.lit(0.0), lambda s, it: s + F.coalesce(it["valor_total"], F.lit(0.0)))
    return found.withColumns(
        {
            "n_items": F.size("itens").cast("bigint"),
            "items_value": F.round(value, 2),
            "item_names": F.array_join(F.transform("itens", lambda it: it["descricao"]), ";"),
        }
    ).drop("itens")


@register(
    "short_mapping", "TXT6",
    sql=f"""WITH {LOOSE_SQL}, s2 AS (SELECT m.id, any_value(a) AS a, coalesce(min(i) FILTER (d AND i <> a), -1) AS g FROM marks m JOIN p1 USING (id) GROUP BY m.id),
st AS (SELECT m.id, max_by({_amt(f"regexp_extract(ln, '{ref.LINE_MONEY}', 1)")}, i) AS total FROM marks m JOIN s2 USING (id)
  WHERE t AND i NOT IN (a, g) AND {_amt(f"regexp_extract(ln, '{ref.LINE_MONEY}', 1)")} IS NOT NULL GROUP BY m.id),
sp AS (SELECT s2.id, max(ln) FILTER (i = a) AS la, max(ln) FILTER (i = g) AS lg FROM s2 JOIN marks m ON m.id = s2.id GROUP BY s2.id)
SELECT sp.id, regexp_replace(regexp_extract(la, '{ref.LINE_CNPJ}', 1), '[^0-9]', '', 'g') AS emitente_cnpj, regexp_extract(lg, '{ref.LINE_DATE}', 1) AS data_emissao, total
FROM sp LEFT JOIN st ON st.id = sp.id""",
)
def short_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return x.small_fields(rt.loose_texts(spark, folder)).drop("raw_text")
