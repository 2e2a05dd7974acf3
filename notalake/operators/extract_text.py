"""Structured fields out of recognised text.

Every text is read inside its own row with array functions: a text is never exploded into lines
and grouped again, so there is no shuffle, and one very long text costs one row, not one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions.codes import contains_any, digits_only
from ..functions.dates import recognised_date
from ..functions.numbers import PLAIN_NUMBER
from ..functions.text import started, trim_space
from .stages import computed_once

def document_type(text: Column) -> Column:
    """nfe / nfce / cte / mdfe / unknown: tags, then names, then key prefixes, then the model digits of a key."""
    t = F.lower(text)
    tagged = lambda kind: contains_any(t, ref.TEXT_TAGS[kind])
    any_tag = contains_any(t, [tag for tags in ref.TEXT_TAGS.values() for tag in tags])
    by_tag = (
        F.when(tagged("nfce") | contains_any(t, ref.TEXT_MODEL_65), F.lit("nfce"))
        .when(tagged("nfe"), F.lit("nfe"))
        .when(tagged("cte"), F.lit("cte"))
        .when(tagged("mdfe"), F.lit("mdfe"))
    )
    by_name = F.coalesce(*[F.when(contains_any(t, names), F.lit(kind)) for kind, names in ref.TEXT_NAMES])
    by_prefix = F.coalesce(*[F.when(t.rlike(kind + "[0-9]{44}"), F.lit(kind)) for kind in ref.TEXT_KEY_PREFIXES])
    model = F.regexp_extract(t, "([0-9]{2})[0-9]{42}", 1)
    by_model = F.coalesce(*[F.when(model == m, F.lit(kind)) for m, kind in ref.TEXT_KEY_MODELS.items()])
    return F.coalesce(F.when(any_tag, by_tag), by_name, by_prefix, by_model, F.lit("unknown"))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(trim_space(F.regexp_extract(text, started(pattern), 1)), F.lit(""))


def _amount(text: Column) -> Column:
    """1.234,56 with every dot a thousands mark; unreadable is NULL."""
    return F.regexp_extract(F.translate(text, ",.", "."), PLAIN_NUMBER, 0).try_cast("double")


def labelled_fields(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds one column per labelled field. Where two labels feed a field, the first one found wins."""
    labels = F.struct(*[_found(F.col(text), pattern).alias(f"_{name}") for name, pattern in ref.LABEL_PATTERNS.items()])
    found = computed_once(df, "_labels", labels).select(*df.columns, "_labels.*")  # each pattern runs once a text
    stated, freight = _amount(F.col("_valor_total")), _amount(F.col("_cte_valor_prestacao"))
    return found.select(
        *df.columns,
        F.col("_cnpj").alias("emitente_cnpj"),
        F.col("_cpf").alias("destinatario_cpf"),
        F.col("_ie").alias("emitente_ie"),
        recognised_date(F.col("_data_emissao")).alias("data_emissao"),
        F.coalesce(F.nullif(stated, F.lit(0.0)), freight, stated).alias("valor_total"),
        F.coalesce("_numero", "_cte_numero").alias("numero"),
        F.col("_chave_acesso").alias("chave_acesso"),
        F.col("_protocolo").alias("protocolo_autorizacao"),
        F.col("_razao_social").alias("emitente_razao_social"),
        F.col("_nome_destinatario").alias("destinatario_razao_social"),
        F.col("_endereco_emitente").alias("emitente_logradouro"),
        F.col("_municipio_emitente").alias("emitente_municipio"),
        F.upper("_uf_emitente").alias("emitente_uf"),
        F.col("_cte_serie").alias("serie"),
        F.col("_cte_modal").alias("modal"),
        F.col("_cte_tipo_servico").alias("tipo_servico"),
        F.upper("_cte_uf_inicio").alias("uf_inicio"),
        F.upper("_cte_uf_fim").alias("uf_fim"),
        F.col("_cte_municipio_inicio").alias("municipio_inicio"),
        F.col("_cte_municipio_fim").alias("municipio_fim"),
    )


def text_items(df: DataFrame, *keys: str, text: str = "raw_text") -> DataFrame:
    """One row per line of the item section; lines with unreadable amounts are left out."""
    section = F.regexp_extract(F.col(text), started(ref.ITEM_SECTION_PATTERN.removeprefix("(?is)"), "is"), 1)
    pattern = "(?U)" + ref.ITEM_LINE_PATTERN
    names = ["codigo", "descricao", "quantidade", "unidade", "valor_unitario", "valor_total"]
    cut = computed_once(df.select(*keys, text), "_section", section).filter("_section <> ''")
    # One pass over the section, then one over each short match: its groups, between signs that no group can hold.
    lines = F.regexp_extract_all("_section", F.lit(pattern), F.lit(0))
    rows = cut.select(*keys, F.posexplode(lines).alias("pos", "line"))
    groups = F.split(F.regexp_replace("line", pattern, "\u0001".join(f"${i + 1}" for i in range(len(names)))), "\u0001", -1)
    parts = computed_once(rows, "_item", groups)
    money = lambda c: _amount(F.trim(F.replace(F.col(c), F.lit("R$"), F.lit(""))))
    read = parts.select(*keys, "pos", *[F.get("_item", i).alias(n) for i, n in enumerate(names)]).select(
        *keys,
        (F.col("pos") + 1).alias("item_pos"),
        F.trim("codigo").alias("codigo"),
        trim_space(F.col("descricao")).alias("descricao"),
        _amount(F.col("quantidade")).alias("quantidade"),
        F.trim("unidade").alias("unidade"),
        money("valor_unitario").alias("valor_unitario"),
        money("valor_total").alias("valor_total"),
    )
    return read.filter("quantidade IS NOT NULL AND valor_unitario IS NOT NULL AND valor_total IS NOT NULL")


def text_taxes(text: Column) -> dict[str, Column]:
    return {tax: _amount(_found(text, pattern)) for tax, pattern in ref.TAX_PATTERNS.items()}


def access_key(text: Column) -> Column:
    """44 digits, even when blanks or dots break them up."""
    return F.nullif(F.regexp_extract(digits_only(text), r"(\d{44})", 1), F.lit(""))


def registration_runs(text: Column) -> Column:
    """Distinct runs of 14 digits, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{14}"), F.lit(0)))


def _lines(text: Column) -> Column:
    stripped = F.transform(F.split(text, "\r\n|\n|\r", -1), trim_space)
    return F.filter(stripped, lambda ln: F.length(ln) > 0)


def _first(condition) -> Column:
    """Smallest index of a line that satisfies `condition(line struct)`, or -1."""
    return F.coalesce(F.array_min(F.transform(F.filter("_lines", condition), lambda ln: ln["i"])), F.lit(-1))


def loose_type(text: Column) -> Column:
    t = F.upper(text)
    return (
        F.when(t.contains("MDF") | t.contains("MANIFESTO"), F.lit("MDF"))
        .when(t.contains("CTE") | t.contains("CONHECIMENTO"), F.lit("CTE"))
        .when(t.contains("NFS") | t.contains("NOTA FISCAL"), F.lit("NFE"))
        .otherwise("MDF")
    )


def loose_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Header fields and items of unlabelled lines.

    A line serves one field. Each field takes its first free line in the order registration, person,
    number, date; of the total lines the last readable one counts; what is left may be an item. Each
    step only needs the lines taken by the steps before it, so the cascade is a chain of look-ups.
    Cargo documents and manifests keep only their type.
    """
    has = lambda ln, pattern: F.length(F.regexp_extract(ln, pattern, 1)) > 0
    number = "(?iuU)" + ref.LINE_NUMBER

    def marked(ln: Column, i: Column) -> Column:
        lowered = F.lower(ln)
        return F.struct(
            i.alias("i"),
            ln.alias("text"),
            has(ln, ref.LINE_CNPJ).alias("cnpj"),
            has(ln, ref.LINE_CPF).alias("cpf"),
            has(ln, number).alias("number"),
            ln.rlike(r"^\d{1,10}$").alias("bare"),
            has(ln, ref.LINE_DATE).alias("date"),
            ((lowered.contains("total") | lowered.contains("valor")) & has(ln, ref.LINE_MONEY)).alias("total"),
        )

    goods = F.col("tipo_documento") == "NFE"
    nothing = F.array().cast("array<string>")
    step = df.withColumn("tipo_documento", loose_type(F.coalesce(F.col(text), F.lit(""))))
    step = step.withColumn("_lines", F.transform(F.when(goods, _lines(F.col(text))).otherwise(nothing), marked))
    step = step.withColumn("_p1", _first(lambda ln: ln["cnpj"]))
    step = step.withColumn("_p2", _first(lambda ln: ln["cpf"] & (ln["i"] != F.col("_p1"))))
    free = lambda ln, *taken: ~ln["i"].isin(*[F.col(t) for t in taken])
    step = step.withColumn("_p3", _first(lambda ln: (ln["number"] | ln["bare"]) & free(ln, "_p1", "_p2")))
    step = step.withColumn("_p4", _first(lambda ln: ln["date"] & free(ln, "_p1", "_p2", "_p3")))
    rest = F.filter("_lines", lambda ln: free(ln, "_p1", "_p2", "_p3", "_p4"))
    step = step.withColumn("_rest", rest)
    line = lambda p: F.when(F.col(p) >= 0, F.element_at("_lines", F.col(p) + 1)["text"])
    readable = F.filter(
        F.transform(
            F.filter("_rest", lambda ln: ln["total"]), lambda ln: _amount(F.regexp_extract(ln["text"], ref.LINE_MONEY, 1))
        ),
        lambda v: v.isNotNull(),
    )
    words = lambda ln: F.split(ln["text"], r"(?U)\s+", -1)
    item_lines = F.filter(
        "_rest",
        lambda ln: ~ln["total"]
        & (F.size(words(ln)) >= 3)
        & has(F.element_at(words(ln), -1), ref.LINE_MONEY)
        & has(F.element_at(words(ln), -2), ref.LINE_MONEY),
    )
    plain = lambda t: F.regexp_extract(t, PLAIN_NUMBER, 0).try_cast("double")
    items = F.transform(
        item_lines,
        lambda ln: F.struct(
            F.array_join(F.slice(words(ln), F.lit(1), F.size(words(ln)) - 2), " ").alias("descricao"),
            plain(F.replace(F.element_at(words(ln), -2), F.lit(","), F.lit("."))).alias("quantidade"),
            _amount(F.element_at(words(ln), -1)).alias("valor_total"),
        ),
    )
    by_pattern = F.nullif(F.regexp_extract(line("_p3"), number, 1), F.lit(""))
    return step.select(
        *df.columns,
        "tipo_documento",
        digits_only(F.regexp_extract(line("_p1"), ref.LINE_CNPJ, 1)).alias("emitente_cnpj"),
        digits_only(F.regexp_extract(line("_p2"), ref.LINE_CPF, 1)).alias("destinatario_doc"),
        F.coalesce(by_pattern, line("_p3")).alias("numero"),
        F.regexp_extract(line("_p4"), ref.LINE_DATE, 1).alias("data_emissao"),
        F.when(F.size(readable) > 0, F.element_at(readable, -1)).alias("total"),
        items.alias("itens"),
    ).withColumns(
        {c: F.nullif(F.col(c), F.lit("")) for c in ("emitente_cnpj", "destinatario_doc")}
    )


def small_fields(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """The short mapper: registration, date, total."""
    has = lambda ln, pattern: F.length(F.regexp_extract(ln, pattern, 1)) > 0

    def marked(ln: Column, i: Column) -> Column:
        lowered = F.lower(ln)
        return F.struct(
            i.alias("i"),
            ln.alias("text"),
            has(ln, ref.LINE_CNPJ).alias("cnpj"),
            has(ln, ref.LINE_DATE).alias("date"),
            (lowered.contains("total") | lowered.contains("valor")).alias("total"),
        )

    step = df.withColumn("_lines", F.transform(_lines(F.col(text)), marked))
    step = step.withColumn("_p1", _first(lambda ln: ln["cnpj"]))
    step = step.withColumn("_p2", _first(lambda ln: ln["date"] & (ln["i"] != F.col("_p1"))))
    line = lambda p: F.when(F.col(p) >= 0, F.element_at("_lines", F.col(p) + 1)["text"])
    totals = F.filter(
        F.transform(
            F.filter("_lines", lambda ln: ln["total"] & ~ln["i"].isin(F.col("_p1"), F.col("_p2"))),
            lambda ln: _amount(F.regexp_extract(ln["text"], ref.LINE_MONEY, 1)),
        ),
        lambda v: v.isNotNull(),
    )
    return step.select(
        *df.columns,
        F.nullif(digits_only(F.regexp_extract(line("_p1"), ref.LINE_CNPJ, 1)), F.lit("")).alias("emitente_cnpj"),
        F.regexp_extract(line("_p2"), ref.LINE_DATE, 1).alias("data_emissao"),
        F.when(F.size(totals) > 0, F.element_at(totals, -1)).alias("total"),
    )
