"""Scalar readers and classification, each over a whole table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions import codes, dates, numbers, scores, text
from ..operators import classify
from ..operators.stages import spread
from ..sources import fiscal_view as fv
from ..sources.tables import table
from . import sqlviews as q
from .registry import register

AS_OF = datetime(2024, 1, 31, 12, 0, 0)

# Amounts of the item table in ten spellings.
SPELL_SQL = """n AS (SELECT l_orderkey, l_linenumber, l_partkey, c // 100 AS r, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS f FROM (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)),
g AS (SELECT *, CASE WHEN r >= 1000 THEN (r // 1000) || '.' || lpad(CAST(r % 1000 AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS dots FROM n),
w AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 10 WHEN 0 THEN dots || ',' || f WHEN 1 THEN r || ',' || f WHEN 2 THEN r || '.' || f
  WHEN 3 THEN 'R$ ' || dots || ',' || f WHEN 4 THEN replace(dots, '.', ',') || '.' || f WHEN 5 THEN 'abc' WHEN 6 THEN ''
  WHEN 8 THEN (r % 9 + 1) || '.5E' || (r % 4) WHEN 9 THEN ' -' || r || ' ' END AS spelt FROM g)"""


def spelt_amounts(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    l = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.floor(cents / 100).cast("bigint").alias("r"),
        F.lpad((cents % 100).cast("string"), 2, "0").alias("f"),
    )
    whole = F.col("r").cast("string")
    dots = F.when(
        F.col("r") >= 1000,
        F.concat(F.floor(F.col("r") / 1000).cast("string"), F.lit("."), F.lpad((F.col("r") % 1000).cast("string"), 3, "0")),
    ).otherwise(whole)
    form = F.col("l_partkey") % 10
    spelt = (
        F.when(form == 0, F.concat(dots, F.lit(","), "f"))
        .when(form == 1, F.concat(whole, F.lit(","), "f"))
        .when(form == 2, F.concat(whole, F.lit("."), "f"))
        .when(form == 3, F.concat(F.lit("R$ "), dots, F.lit(","), "f"))
        .when(form == 4, F.concat(F.replace(dots, F.lit("."), F.lit(",")), F.lit("."), "f"))
        .when(form == 5, F.lit("abc"))
        .when(form == 6, F.lit(""))
        .when(form == 8, F.concat((F.col("r") % 9 + 1).cast("string"), F.lit(".5E"), (F.col("r") % 4).cast("string")))
        .when(form == 9, F.concat(F.lit(" -"), whole, F.lit(" ")))
    )
    return l.select("l_orderkey", "l_linenumber", "l_partkey", spelt.alias("spelt"))


def _comma(t: str) -> str:
    return f"(CASE WHEN contains({t}, ',') AND contains({t}, '.') THEN replace(replace({t}, '.', ''), ',', '.') WHEN contains({t}, ',') THEN replace({t}, ',', '.') ELSE {t} END)"


NUMERIC = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _number(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, {NUMERIC}) THEN TRY_CAST({t} AS DOUBLE) END"


RULE = _comma(r"regexp_replace(trim(spelt), '[R$\s]', '', 'g')")
SHOW = _comma("replace(replace(trim(spelt), 'R$', ''), ' ', '')")
STORE = "replace(replace(replace(replace(trim(spelt), 'R$', ''), ' ', ''), '.', ''), ',', '.')"
KEPT = r"regexp_replace(spelt, '[^0-9.,+\-eE]', '', 'g')"
ODD = f"""(CASE WHEN contains({KEPT}, ',') AND contains({KEPT}, '.') THEN
   CASE WHEN strpos({KEPT}, ',') > strpos({KEPT}, '.') THEN replace({KEPT}, ',', '') ELSE replace(replace({KEPT}, '.', ''), ',', '.') END
   ELSE replace({KEPT}, ',', '.') END)"""


@register(
    "number_readers", "FN2", "FN3", "FN4", "FN5", "FN6",
    sql=f"""WITH {SPELL_SQL} SELECT l_orderkey, l_linenumber, l_partkey, spelt, coalesce({_number(RULE)}, 0.0) AS by_rules,
  coalesce({_number(SHOW)}, 0.0) AS by_screens, {_number(STORE)} AS by_ranking, CASE WHEN spelt IS NOT NULL THEN coalesce({_number(RULE)}, 0.0) END AS by_storage,
  coalesce({_number(_comma(KEPT))}, 0.0) AS by_xml, coalesce({_number(ODD)}, 0.0) AS by_xml_strict FROM w""",
)
def number_readers(spark: SparkSession, folder: str) -> DataFrame:
    spelt = F.col("spelt")
    return spelt_amounts(spark, folder).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "spelt",
        numbers.rule_number(spelt).alias("by_rules"),
        numbers.display_number(spelt).alias("by_screens"),
        numbers.store_number(spelt).alias("by_ranking"),
        numbers.coerced_amount(spelt).alias("by_storage"),
        numbers.xml_number(spelt).alias("by_xml"),
        numbers.xml_number(spelt, strict_reference=True).alias("by_xml_strict"),
    )


@register(
    "digits_only", "FN1",
    sql=f"WITH {q.HEADERS} SELECT id, regexp_replace(coalesce(emitente_cnpj, ''), '[^0-9]', '', 'g') AS digits, length(regexp_replace(coalesce(emitente_cnpj, ''), '[^0-9]', '', 'g')) AS n_digits FROM h",
)
def digits_only(spark: SparkSession, folder: str) -> DataFrame:
    digits = codes.digits_only(F.col("emitente_cnpj"))
    return fv.headers(spark, folder).select("id", digits.alias("digits"), F.length(digits).cast("bigint").alias("n_digits"))


DAY_SQL = """d AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%y')
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 4 THEN ' ' || strftime(o_orderdate, '%d/%m/%Y') || ' '
  WHEN 5 THEN '30/02/2025' WHEN 6 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 7 THEN strftime(o_orderdate, '%d/%m/%Y') || ' 10:4' || (o_orderkey % 10) END AS spelt,
  strftime(o_orderdate, '%Y-%m-%d') AS iso, year(o_orderdate) AS y, strftime(o_orderdate, '%m-%d') AS md FROM orders)"""


@register(
    "date_readers", "FN7", "FN8", "FN9",
    sql=f"""WITH {DAY_SQL} SELECT id, spelt,
  CASE id % 9 WHEN 0 THEN iso || 'T00:00:00Z' WHEN 1 THEN iso || 'T00:00:00Z' WHEN 2 THEN iso WHEN 3 THEN iso || 'T00:00:00' WHEN 4 THEN iso || 'T00:00:00Z' END AS by_import,
  CASE id % 9 WHEN 0 THEN iso || 'T00:00:00Z' ELSE spelt END AS by_storage,
  CASE id % 9 WHEN 0 THEN iso || ' 00:00:00' WHEN 1 THEN substr(CAST(y AS VARCHAR), 3, 2) || '-' || md || ' 00:00:00' WHEN 4 THEN iso || ' 00:00:00' WHEN 5 THEN '2025-02-30 00:00:00'
    WHEN 7 THEN iso || ' 10:4' || (id % 10) || ':00' END AS by_recognition FROM d""",
)
def date_readers(spark: SparkSession, folder: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    form = key % 9
    spelt = (
        F.when(form == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(form == 1, F.date_format(day, "dd/MM/yy"))
        .when(form == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 3, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 4, F.concat(F.lit(" "), F.date_format(day, "dd/MM/yyyy"), F.lit(" ")))
        .when(form == 5, F.lit("30/02/2025"))
        .when(form == 6, F.date_format(day, "dd-MM-yyyy"))
        .when(form == 7, F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" 10:4"), (key % 10).cast("string")))
    )
    o = table(spark, folder, "orders").select(key.alias("id"), spelt.alias("spelt"))
    return o.select(
        "id",
        "spelt",
        dates.iso_date(F.col("spelt")).alias("by_import"),
        dates.storage_date(F.col("spelt")).alias("by_storage"),
        dates.recognised_date(F.col("spelt")).alias("by_recognition"),
    )


@register(
    "currency_text", "FN11",
    sql="""SELECT o_orderkey AS id, 'R$ ' || replace(replace(replace(format('{:,.2f}', o_totalprice), ',', 'X'), '.', ','), 'X', '.') AS shown,
  replace(printf('%.2f', o_totalprice), '.', ',') AS exported FROM orders""",
)
def currency_text(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        numbers.currency_text(amount).alias("shown"),
        numbers.decimal_comma(amount).alias("exported"),
    )


@register(
    "content_keys", "FN12",
    sql="""SELECT doc_id, sha256(text) AS content_key, sha256('resumo|{"lang":"' || lang || '","source":"' || source || '"}') AS request_key,
  md5('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS record_key FROM documents""",
)
def content_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        codes.content_key(F.col("text")).alias("content_key"),
        codes.request_key(F.lit("resumo"), {"source": F.col("source"), "lang": F.col("lang")}).alias("request_key"),
        codes.record_key({"lang": F.col("lang"), "doc_id": F.col("doc_id")}).alias("record_key"),
    )


@register(
    "hybrid_scores", "FN13", "FN14", "FN15",
    sql="""WITH s AS (SELECT event_id, value, CASE WHEN value > 0 THEN least(1.0, log10(value + 1) / 6.0) ELSE 0.0 END AS vs,
  exp(-greatest(0.0, (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(ts)) / 1e6 / 86400.0) / 30.0) AS rs FROM events)
SELECT event_id, CAST(round(vs, 8) AS DOUBLE) AS value_score, CAST(round(rs, 8) AS DOUBLE) AS recency_score,
  CAST(round(0.5 * 0.6 + vs * 0.25 + rs * 0.15, 8) AS DOUBLE) AS hybrid_score FROM s""",
)
def hybrid_scores(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(
        "event_id",
        scores.value_score(F.col("value")).alias("vs"),
        scores.recency_score(F.col("ts"), AS_OF).alias("rs"),
    )
    return e.select(
        "event_id",
        F.round("vs", 8).alias("value_score"),
        F.round("rs", 8).alias("recency_score"),
        F.round(scores.hybrid_score(F.lit(0.5), F.col("vs"), F.col("rs")), 8).alias("hybrid_score"),
    )


@register(
    "document_values", "FN17",
    sql="""WITH j AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN printf('%.2f', o_totalprice) WHEN 1 THEN replace(printf('%.2f', o_totalprice), '.', ',') END AS total,
  CASE WHEN o_orderkey % 5 = 2 THEN printf('R$ %.0f', floor(o_totalprice)) WHEN o_orderkey % 5 = 3 THEN 'n/d' END AS valor_total,
  CASE WHEN o_orderkey % 5 >= 3 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS value FROM orders),
n AS (SELECT id, replace(replace(total, '.', ''), ',', '.') AS t, replace(replace(replace(valor_total, 'R$', ''), ' ', ''), '.', '') AS v, value AS x FROM j)
SELECT id, coalesce(TRY_CAST(t AS DOUBLE), TRY_CAST(v AS DOUBLE), TRY_CAST(x AS DOUBLE)) AS document_value FROM n""",
)
def document_values(spark: SparkSession, folder: str) -> DataFrame:
    """First readable amount among three keys of the extracted JSON."""
    key, amount = F.col("o_orderkey"), F.col("o_totalprice")
    two = F.replace(F.format_number(amount, 2), F.lit(","), F.lit(""))
    whole = F.floor(amount).cast("bigint").cast("string")
    form = key % 5
    extracted = F.to_json(
        F.struct(
            F.when(form == 0, two).when(form == 1, F.replace(two, F.lit("."), F.lit(","))).alias("total"),
            F.when(form == 2, F.concat(F.lit("R$ "), whole)).when(form == 3, F.lit("n/d")).alias("valor_total"),
            F.when(form >= 3, whole).alias("value"),
        )
    )
    o = table(spark, folder, "orders").select(key.alias("id"), extracted.alias("extracted"))
    read = lambda name: numbers.store_number(F.get_json_object("extracted", f"$.{name}"))
    return o.select("id", F.coalesce(read("total"), read("valor_total"), read("value")).alias("document_value"))


@register(
    "sentence_cut", "FN18",
    sql=r"""WITH s AS (SELECT doc_id, text, regexp_split_to_array(text, '[.!?]+') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM s WHERE length(text) > 1000),
c AS (SELECT *, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS upto FROM u),
b AS (SELECT doc_id, min(i) AS stop FROM c WHERE upto > 1000 GROUP BY 1),
k AS (SELECT c.doc_id, string_agg(p || '.', '' ORDER BY i) AS cut FROM c LEFT JOIN b USING (doc_id) WHERE i < coalesce(stop, 1000000000) GROUP BY 1)
SELECT s.doc_id, CASE WHEN length(s.text) <= 1000 THEN s.text ELSE regexp_replace(coalesce(k.cut, ''), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g') END AS cut
FROM s LEFT JOIN k ON k.doc_id = s.doc_id""",
)
def sentence_cut(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.cut_at_sentence(F.col("text"), 1000).alias("cut"))


@register(
    "query_prefix", "FN19",
    sql="""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Nota ' WHEN 1 THEN 'qual fatura ' ELSE '' END || text AS question FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(question), 'documento|nota|fatura|comprovante') THEN 'contexto fiscal: ' || question ELSE question END AS question FROM t""",
)
def query_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Questions, some of them worded as document searches."""
    lead = F.when(F.col("turn") % 4 == 0, "Nota ").when(F.col("turn") % 4 == 1, "qual fatura ").otherwise("")
    c = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("question"))
    return c.select("conv_id", "turn", text.prefixed_query(F.col("question")).alias("question"))


@register(
    "json_values", "FN20",
    sql="""SELECT event_id, '{"value":' || printf('%.2f', value) || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}' AS document FROM events""",
)
def json_values(spark: SparkSession, folder: str) -> DataFrame:
    """Decimals and timestamps as plain JSON numbers and ISO text."""
    body = F.struct(F.col("value").cast("decimal(18,2)").alias("value"), F.col("ts").alias("ts"))
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return table(spark, folder, "events").select("event_id", F.to_json(body, options).alias("document"))


@register(
    "cfop_operation_mix", "CLS1", "AGG2",
    sql=f"""WITH {q.ITEMS} SELECT {q.operation('cfop')} AS operation, count(*) AS n_items, count(DISTINCT document_id) AS n_documents,
  CAST(sum(total_cents) AS BIGINT) AS total_cents FROM i GROUP BY 1""",
)
def cfop_operation_mix(spark: SparkSession, folder: str) -> DataFrame:
    kind = codes.cfop_operation(F.col("cfop")).alias("operation")
    # One row per (operation, document) first: the distinct count then needs no second pass over items.
    per_document = fv.items(spark, folder).groupBy(kind, "document_id").agg(
        F.count("*").alias("n"), F.sum("total_cents").alias("cents")
    )
    return per_document.groupBy("operation").agg(
        F.sum("n").alias("n_items"), F.count("*").alias("n_documents"), F.sum("cents").alias("total_cents")
    )


@register(
    "cfop_descriptions", "JOIN6", "VAL8",
    sql=f"""WITH {q.ITEMS}, names(code, description) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in ref.CFOP_DESCRIPTIONS.items())}),
c AS (SELECT lpad(regexp_replace(cfop, '[^0-9]', '', 'g'), 4, '0') AS code, total_cents FROM i)
SELECT c.code, coalesce(n.description, 'CFOP não reconhecido') AS description, count(*) AS n_items, CAST(sum(total_cents) AS BIGINT) AS total_cents
FROM c LEFT JOIN names n ON n.code = c.code GROUP BY 1, 2""",
)
def cfop_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """Sums per code first, so the look-up joins one row per code and not one per item."""
    names = spark.createDataFrame(list(ref.CFOP_DESCRIPTIONS.items()), "code string, description string")
    sums = fv.items(spark, folder).groupBy(codes.normal_cfop(F.col("cfop")).alias("code")).agg(
        F.count("*").alias("n_items"), F.sum("total_cents").alias("total_cents")
    )
    # The code table has 23 rows by definition.
    joined = sums.join(F.broadcast(names), "code", "left")
    return joined.select("code", F.coalesce("description", F.lit(ref.CFOP_UNKNOWN)).alias("description"), "n_items", "total_cents")


@register(
    "document_classes", "CLS2", "CLS3", "ARR1",
    sql=f"""WITH {q.HEADERS}, {q.ITEMS}, f AS (SELECT document_id, min_by(cfop, {{'n': item_no, 'p': CAST(codigo AS BIGINT), 'q': quantidade, 'u': unit_cents, 't': total_cents, 'c': cfop}}) AS first_cfop FROM i GROUP BY 1)
SELECT h.id, CASE WHEN document_type = 'MDFe' THEN 'mdfe' WHEN document_type = 'CTe' THEN 'cte'
    ELSE {q.operation('(CASE WHEN h.cfop IS NULL THEN f.first_cfop ELSE h.cfop END)')} END AS tipo,
  CASE WHEN emitente_cnpj IS NULL THEN 'cliente' ELSE 'fornecedor' END AS perfil_emitente,
  CASE WHEN total_cents > 1000000 THEN 'industria' WHEN total_cents > 0 THEN 'comercio' ELSE 'servicos' END AS setor
FROM h LEFT JOIN f ON f.document_id = h.id""",
)
def document_classes(spark: SparkSession, folder: str) -> DataFrame:
    order = F.struct("item_no", F.col("codigo").cast("bigint"), "quantidade", "unit_cents", "total_cents", "cfop")
    firsts = fv.items(spark, folder).groupBy("document_id").agg(F.min_by("cfop", order).alias("first_cfop"))
    h = fv.headers(spark, folder)
    return h.join(firsts, h["id"] == firsts["document_id"], "left").select(
        "id",
        classify.document_class(F.col("document_type"), F.col("cfop"), F.col("first_cfop")).alias("tipo"),
        classify.issuer_profile(F.col("emitente_cnpj")).alias("perfil_emitente"),
        classify.sector(F.col("total_cents") / 100).alias("setor"),
    )


MESSY_SQL = """m AS (SELECT o_orderkey AS id,
  CASE o_orderkey % 12 WHEN 0 THEN 'NFe' WHEN 1 THEN 'nf-e' WHEN 2 THEN 'NFC' WHEN 3 THEN 'ct_e' WHEN 4 THEN 'NFCe' WHEN 5 THEN 'N/A' WHEN 6 THEN 'nfse' WHEN 7 THEN 'recibo' WHEN 8 THEN '' END AS document_type,
  CASE o_orderkey % 7 WHEN 0 THEN 'Modelo 65' WHEN 1 THEN 'cte' END AS subtype,
  CASE o_orderkey % 5 WHEN 0 THEN '55' WHEN 1 THEN '57' WHEN 2 THEN '99' END AS model,
  CASE o_orderkey % 6 WHEN 0 THEN 'nota_' WHEN 1 THEN 'nfc-' WHEN 2 THEN 'conhecimento' WHEN 3 THEN 'manifesto' WHEN 4 THEN 'servico' ELSE 'scan' END || o_orderkey || '.xml' AS file_name,
  o_totalprice FROM orders)"""
UP = "upper(coalesce(document_type, ''))"
CATEGORY_SQL = f"""(CASE WHEN {UP} <> '' AND {UP} <> 'N/A' THEN coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in ref.CATEGORY_BY_TYPE.items())}}}[{UP}], {UP})
  WHEN regexp_matches(upper(subtype), '55|NFE') THEN 'NF-e' WHEN regexp_matches(upper(subtype), '65|NFC') THEN 'NFC-e' WHEN regexp_matches(upper(subtype), '57|CTE') THEN 'CT-e'
  WHEN model = '55' THEN 'NF-e' WHEN model = '65' THEN 'NFC-e' WHEN model = '57' THEN 'CT-e'
  WHEN regexp_matches(upper(file_name), 'NFE|NF-E|NOTA') THEN 'NF-e' WHEN regexp_matches(upper(file_name), 'NFC') THEN 'NFC-e'
  WHEN regexp_matches(upper(file_name), 'CTE|CT-E|CONHECIMENTO') THEN 'CT-e' WHEN regexp_matches(upper(file_name), 'MDF|MANIFESTO') THEN 'MDF-e'
  WHEN regexp_matches(upper(file_name), 'NFS|SERVIC') THEN 'NFSe' ELSE 'Desconhecido' END)"""


def messy_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose type is spelt, missing or hidden in other fields."""
    key = F.col("o_orderkey")
    pick = lambda modulus, values: F.coalesce(*[F.when(key % modulus == i, F.lit(v)) for i, v in enumerate(values)])
    lead = pick(6, ["nota_", "nfc-", "conhecimento", "manifesto", "servico", "scan"])
    return table(spark, folder, "orders").select(
        key.alias("id"),
        pick(12, ["NFe", "nf-e", "NFC", "ct_e", "NFCe", "N/A", "nfse", "recibo", ""]).alias("document_type"),
        pick(7, ["Modelo 65", "cte"]).alias("subtype"),
        pick(5, ["55", "57", "99"]).alias("model"),
        F.concat(lead, key.cast("string"), F.lit(".xml")).alias("file_name"),
        "o_totalprice",
    )


@register("document_categories", "CLS4", sql=f"WITH {MESSY_SQL} SELECT id, {CATEGORY_SQL} AS category FROM m")
def document_categories(spark: SparkSession, folder: str) -> DataFrame:
    m = messy_documents(spark, folder)
    named = classify.category(F.col("document_type"), F.col("subtype"), F.col("model"), F.col("file_name"))
    return m.select("id", named.alias("category"))


WORDS = ["", "documento ", "planilha csv ", "valor total ", "como corrigir xml ", "status da validação ", "erro ", "nf-e e CT-e "]
QUESTION_SQL = f"""qs AS (SELECT conv_id, turn, role, [{', '.join("'" + w + "'" for w in WORDS)}][(conv_id * 3 + turn) % 8 + 1] || text AS question FROM conversations)"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages, most of them led by a fiscal phrase."""
    lead = F.element_at(F.array(*[F.lit(w) for w in WORDS]), ((F.col("conv_id") * 3 + F.col("turn")) % 8).cast("int") + 1)
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", F.concat(lead, "text").alias("question"))


def _any(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(question), '{w}')" for w in words)


@register(
    "routed_questions", "CLS5",
    sql=f"""WITH {QUESTION_SQL} SELECT conv_id, turn, CASE {' '.join(f"WHEN {_any(w)} THEN '{n}'" for n, w in ref.QUESTION_ROUTES)} ELSE 'general' END AS query_type FROM qs""",
)
def routed_questions(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("conv_id", "turn", classify.question_route(F.col("question")).alias("query_type"))


@register(
    "question_intents", "CLS6",
    sql=f"""WITH {QUESTION_SQL} SELECT conv_id, turn, CASE WHEN {_any(ref.HOWTO_MARKERS)} THEN 'howto' WHEN {_any(ref.VALIDATION_MARKERS)} THEN 'validation' END AS intent FROM qs""",
)
def question_intents(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("conv_id", "turn", classify.question_intent(F.col("question")).alias("intent"))


@register(
    "question_type_hints", "TXT9",
    sql=f"""WITH {QUESTION_SQL} SELECT conv_id, turn, array_to_string(list_filter([{', '.join(f"CASE WHEN {_any(m)} THEN '{k}' END" for k, m in ref.TYPE_HINTS.items())}], lambda x: x IS NOT NULL), ',') AS hints FROM qs""",
)
def question_type_hints(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("conv_id", "turn", F.array_join(classify.type_hints(F.col("question")), ",").alias("hints"))
