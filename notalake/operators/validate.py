"""The rule book as a data-quality job.

Every rule is a condition with a severity and a message. Item rules need only the item row (plus
the document's operation code), so they run map-side; what reaches the shuffle is already summed
per (document, operation code). A document that holds a third of all items therefore arrives as a
handful of rows per map task, and no group of items is ever collected.

Documents: id, document_type, numero, serie, data_emissao, total_cents, emitente_cnpj,
emitente_razao_social, has_recipient, destinatario_doc, cfop and the tax columns.
Items: document_id, item_no, descricao, ncm, cfop, quantidade, unit_cents, total_cents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions.codes import cnpj_is_valid, digits_only, normal_cfop, zero_fill
from ..sources.fiscal_view import money

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    condition: Column
    message: Column

    @property
    def fires(self) -> Column:
        return F.coalesce(self.condition, F.lit(False))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def issues(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """Long table: keys, rule, severity, message; one row per rule that fires."""
    candidates = F.array(
        *[
            F.when(
                r.fires,
                F.struct(
                    F.lit(i).alias("seq"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), r.message.alias("message")
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    # No higher-order function over the rules: Spark interprets those and all that is in them.
    listed = df.select(*keys, candidates.alias("found")).select(*keys, F.explode_outer("found").alias("issue"))
    return listed.filter(F.col("issue").isNotNull()).select(*keys, "issue.*")


def count_fired(rules: list[Rule], severity: str) -> Column:
    chosen = [F.when(r.fires, 1).otherwise(0) for r in rules if r.severity == severity]
    return reduce(add, chosen, F.lit(0)).cast("bigint")


def item_rules() -> list[Rule]:
    """Rules of one item; `doc_cfop` is the operation code of its document."""
    label = F.concat(F.lit("Item "), F.col("item_no").cast("string"), F.lit(": "))
    say = lambda *parts: F.concat(label, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    ncm, cfop = F.trim("ncm"), F.trim("cfop")
    expected = F.col("quantidade") * F.col("unit_cents")
    stated = F.col("total_cents")
    return [
        Rule("item_description", WARNING, F.coalesce(F.col("descricao"), F.lit("")) == "", say("Descrição não informada")),
        Rule("item_ncm_missing", WARNING, _blank(F.col("ncm")), say("NCM não informado")),
        Rule(
            "item_ncm_unknown",
            WARNING,
            ~_blank(F.col("ncm")) & ~ncm.isin(list(ref.NCM_DESCRIPTIONS)),
            say("NCM ", ncm, " não reconhecido"),
        ),
        Rule("item_cfop_missing", ERROR, _blank(F.col("cfop")), say("CFOP não informado")),
        Rule(
            "item_cfop_differs",
            WARNING,
            ~_blank(F.col("cfop")) & ~_blank(F.col("doc_cfop")) & (cfop != F.trim("doc_cfop")),
            say("CFOP ", cfop, " diferente do CFOP do documento ", F.trim("doc_cfop")),
        ),
        Rule("item_quantity", ERROR, F.coalesce(F.col("quantidade"), F.lit(0)) <= 0, say("Quantidade inválida")),
        Rule("item_unit_value", ERROR, F.col("unit_cents") < 0, say("Valor unitário inválido")),
        Rule("item_total_value", ERROR, stated < 0, say("Valor total inválido")),
        Rule(
            "item_total_differs",
            ERROR,
            (F.col("quantidade") > 0) & (F.col("unit_cents") >= 0) & (F.abs(expected - stated) > 1),
            say(
                "Total calculado (", money(expected).cast("string"), ") diferente do informado (", money(stated).cast("string"), ")"
            ),
        ),
    ]


def resolved_type(document_type: Column, other_type: Column, text: Column, key: Column) -> Column:
    """The type of a document that may not state it: its other type field, then names in its text, then in its key."""
    named = lambda c: F.coalesce(*[F.when(F.lower(c).contains(t), F.lit(t.upper())) for t in ("nfe", "cte", "mdfe")])
    stated = lambda c: F.nullif(F.upper(c), F.lit(""))
    return F.coalesce(stated(document_type), stated(other_type), named(text), named(key), F.lit("DESCONHECIDO"))


def header_rules(typed: bool = False) -> list[Rule]:
    """Rules of the document itself: type, parties, operation code, identification.

    With `typed`, the type that is judged is the column `resolved_type`.
    """
    kind = F.upper(F.coalesce(F.col("document_type"), F.lit("")))
    resolved = F.col("resolved_type") if typed else F.when(kind == "", F.lit("DESCONHECIDO")).otherwise(kind)
    cnpj, recipient = F.trim("emitente_cnpj"), F.trim("destinatario_doc")
    is_company = F.length(digits_only(recipient)) > 11
    return [
        Rule(
            "type_unrecognised",
            WARNING,
            ~resolved.isin(ref.KNOWN_TYPES),
            F.concat(
                F.lit("Tipo de documento não reconhecido: "),
                resolved,
                F.lit(". Algumas validações podem não ser aplicáveis."),
            ),
        ),
        Rule("issuer_cnpj_missing", ERROR, _blank(F.col("emitente_cnpj")), F.lit("CNPJ do emitente não informado")),
        Rule(
            "issuer_cnpj_invalid",
            ERROR,
            ~_blank(F.col("emitente_cnpj")) & ~cnpj_is_valid(cnpj),
            F.concat(F.lit("CNPJ do emitente inválido: "), cnpj),
        ),
        Rule("issuer_name_missing", WARNING, _blank(F.col("emitente_razao_social")), F.lit("Razão social do emitente não informada")),
        Rule(
            "recipient_id_missing",
            WARNING,
            F.col("has_recipient") & _blank(F.col("destinatario_doc")),
            F.lit("CNPJ/CPF do destinatário não informado"),
        ),
        Rule(
            "recipient_cnpj_invalid",
            WARNING,
            F.col("has_recipient") & is_company & ~cnpj_is_valid(recipient),
            F.concat(F.lit("CNPJ do destinatário inválido: "), recipient),
        ),
        Rule(
            "total_missing",
            WARNING,
            F.col("total_cents").isNull(),
            F.lit("Total do documento não informado, utilizando 0.0 para validação"),
        ),
        Rule("cfop_missing", ERROR, _blank(F.col("cfop")), F.lit("CFOP não informado")),
        Rule(
            "cfop_unknown",
            WARNING,
            ~_blank(F.col("cfop")) & ~normal_cfop(F.trim("cfop")).isin(list(ref.CFOP_DESCRIPTIONS)),
            F.concat(F.lit("CFOP "), F.trim("cfop"), F.lit(" não reconhecido")),
        ),
        Rule("type_missing", WARNING, F.coalesce(F.col("document_type"), F.lit("")) == "", F.lit("Tipo de documento não especificado")),
        Rule("number_missing", ERROR, F.coalesce(F.col("numero"), F.lit("")) == "", F.lit("Número do documento não informado")),
        Rule("series_missing", WARNING, F.coalesce(F.col("serie"), F.lit("")) == "", F.lit("Série do documento não informada")),
        Rule("issue_date_missing", WARNING, F.coalesce(F.col("data_emissao"), F.lit("")) == "", F.lit("Data de emissão não informada")),
    ]


def states_plain_amount() -> Column:
    """A cargo document whose ICMS is one amount, not a group with a situation code."""
    return (F.coalesce(F.col("document_type"), F.lit("")) == "CTe") & F.col("icms_cst").isNull() & F.col("icms_csosn").isNull()


def tax_rules(forms: bool = False) -> list[Rule]:
    """Taxes of goods documents, and of cargo documents that give their ICMS as a group.

    Without a tax block (`has_taxes` false) ICMS and IPI are missing, both as errors, and nothing else is said.
    With `forms`, columns `icms_form`, `ipi_form`, `pis_form` and `cofins_form` say of a tax without a code
    whether it is a `number` or a `group`. A number as ICMS ends the check of the block, unless it is 0; an
    ICMS group without a code is no finding; other taxes without a code count as code 00.
    """
    goods = ~states_plain_amount()
    block = F.coalesce(F.col("has_taxes"), F.lit(True))
    form = lambda tax: F.col(f"{tax}_form") if forms else F.lit(None).cast("string")
    coded = lambda tax: F.col(f"{tax}_cst").isNotNull()
    amount = lambda tax: F.coalesce(F.col(f"{tax}_cents"), F.lit(0))
    uncoded = lambda tax: ~coded(tax) & F.coalesce((form(tax) == "group") | ((form(tax) == "number") & (amount(tax) != 0)), F.lit(False))
    icms_uncoded = uncoded("icms") & F.col("icms_csosn").isNull()
    given = goods & block & ~(icms_uncoded & (F.coalesce(form("icms"), F.lit("")) == "number"))
    cst, csosn = zero_fill(F.col("icms_cst"), 2), zero_fill(F.col("icms_csosn"), 3)
    normal = given & F.col("icms_cst").isNotNull()
    simples = given & F.col("icms_cst").isNull() & F.col("icms_csosn").isNotNull()
    ipi = F.coalesce(zero_fill(F.col("ipi_cst"), 2), F.lit("00"))
    has_ipi = given & (coded("ipi") | uncoded("ipi"))
    number = lambda name: F.coalesce(F.col(name), F.lit(0))
    rules = [
        Rule("icms_cst_invalid", ERROR, normal & ~cst.isin(ref.ICMS_CST), F.concat(F.lit("CST ICMS "), cst, F.lit(" inválido"))),
        Rule(
            "icms_zero",
            WARNING,
            normal & ~cst.isin(ref.ICMS_CST_ZERO_ALLOWED) & (number("icms_cents") <= 0),
            F.concat(F.lit("ICMS com valor zerado para CST "), cst),
        ),
        Rule("icms_csosn_invalid", ERROR, simples & ~csosn.isin(ref.CSOSN), F.concat(F.lit("CSOSN "), csosn, F.lit(" inválido"))),
        Rule("icms_missing", ERROR, goods & ~normal & ~simples & ~(block & icms_uncoded), F.lit("ICMS não informado")),
        Rule("ipi_cst_invalid", ERROR, has_ipi & ~ipi.isin(ref.IPI_CST), F.concat(F.lit("CST IPI "), ipi, F.lit(" inválido"))),
        Rule(
            "ipi_value_unexpected",
            WARNING,
            has_ipi & ~ipi.isin(ref.IPI_CST_NO_WARNING) & ((number("ipi_rate") > 0) | (number("ipi_cents") > 0)),
            F.concat(F.lit("IPI com valor/alíquota para CST "), ipi),
        ),
        Rule("ipi_missing", WARNING, given & ~coded("ipi") & ~uncoded("ipi"), F.lit("IPI não informado")),
        Rule("ipi_missing_with_block", ERROR, goods & ~block, F.lit("IPI não informado")),
    ]
    for tax in ("pis", "cofins"):
        code = zero_fill(F.col(f"{tax}_cst"), 2)
        rules += [
            Rule(
                f"{tax}_zero",
                WARNING,
                given & code.isin(ref.PIS_COFINS_CST_TAXED) & ((number(f"{tax}_rate") <= 0) | (number(f"{tax}_cents") <= 0)),
                F.concat(F.lit(f"{tax.upper()} com alíquota/valor zerado para CST "), code),
            ),
            Rule(f"{tax}_missing", WARNING, given & ~coded(tax) & ~uncoded(tax), F.lit(f"{tax.upper()} não informado")),
        ]
    rules.append(
        Rule(
            "icms_st_incomplete",
            WARNING,
            given & (F.col("st_cents") > 0) & ((number("st_mva") <= 0) | (number("st_rate") <= 0)),
            F.lit("ICMS ST com valor, mas sem MVA ou alíquota informada"),
        )
    )
    return rules


def cargo_tax_rules() -> list[Rule]:
    """A cargo document with a plain amount: it only must not be negative; an absent one is no finding."""
    return [Rule("cte_icms_negative", ERROR, states_plain_amount() & (F.col("icms_cents") < 0), F.lit("Valor de ICMS inválido no CT-e"))]


def totals_issues(documents: DataFrame, items: DataFrame) -> DataFrame:
    """id, rule, severity, message: an item sum that differs from the stated total, and documents without items."""
    kept = documents.filter(~F.upper(F.coalesce("document_type", F.lit(""))).isin(ref.TYPES_WITHOUT_ITEMS))
    checked = totals_check(kept, item_totals(items))
    text = lambda c: money(F.col(c)).cast("string")
    differs = F.concat(F.lit("Divergência nos totais: calculado "), text("calculated_cents"), F.lit(", informado "), text("stated_cents"))
    rules = [
        Rule("no_items", WARNING, F.col("n_items") == 0, F.lit("Documento não contém itens")),
        Rule("totals_differ", ERROR, (F.col("n_items") > 0) & ~F.col("totals_valid"), differs),
    ]
    return issues(checked, rules, "id").drop("seq")


def item_totals(items: DataFrame) -> DataFrame:
    """Per document: number of items and their sum; partial sums before the shuffle."""
    return items.groupBy("document_id").agg(F.count("*").alias("n_items"), F.sum("total_cents").alias("sum_cents"))


def totals_check(documents: DataFrame, totals: DataFrame) -> DataFrame:
    """Item sum against stated total, tolerance one cent. No items, or no total: not valid and the sum is 0."""
    joined = documents.select("id", "total_cents").join(totals, documents["id"] == totals["document_id"], "left")
    usable = (F.coalesce(F.col("n_items"), F.lit(0)) > 0) & (F.coalesce(F.col("total_cents"), F.lit(0)) != 0)
    calculated = F.when(usable, F.col("sum_cents")).otherwise(F.lit(0).cast("bigint"))
    difference = F.abs(calculated - F.coalesce(F.col("total_cents"), F.lit(0)))
    return joined.select(
        "id",
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("total_cents", F.lit(0)).cast("bigint").alias("stated_cents"),
        calculated.alias("calculated_cents"),
        (usable & (difference <= 1)).alias("totals_valid"),
    )


def item_issues(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Long table of item findings. Documents without item lists (cargo, manifests) are skipped.

    Both sides are joined on the document; stored bucketed by it, the join needs no exchange, and
    AQE splits the partition of a document with very many items.
    """
    d = documents.select(F.col("id").alias("document_id"), F.col("cfop").alias("doc_cfop"), "document_type")
    joined = items.join(d, "document_id")
    kept = joined.filter(~F.upper(F.coalesce("document_type", F.lit(""))).isin(ref.TYPES_WITHOUT_ITEMS))
    return issues(kept, item_rules(), "document_id", "item_no")


def _item_sums(items: DataFrame) -> DataFrame:
    """Findings and sums per (document, operation code): what map tasks send, however many items there are."""
    own = [r for r in item_rules() if r.name != "item_cfop_differs"]
    return items.groupBy("document_id", F.trim("cfop").alias("item_cfop")).agg(
        F.count("*").alias("n"),
        F.sum("total_cents").alias("cents"),
        F.sum(count_fired(own, ERROR)).alias("errors"),
        F.sum(count_fired(own, WARNING)).alias("warnings"),
    )


def verdicts(documents: DataFrame, items: DataFrame) -> DataFrame:
    """id, n_items, n_errors, n_warnings, calculated_cents, status (error / warning / success).

    Header and tax rules are counted before the join, so a document crosses the network as a handful
    of numbers. Join and final aggregation share one partitioning by document. `resolved_type` and the
    forms of taxes without codes are used where `documents` has those columns.
    """
    typed, forms = "resolved_type" in documents.columns, "icms_form" in documents.columns
    document_rules = header_rules(typed) + tax_rules(forms) + cargo_tax_rules()
    narrow = documents.select(
        "id",
        F.trim("cfop").alias("doc_cfop"),
        F.coalesce("total_cents", F.lit(0)).cast("bigint").alias("total"),
        F.upper(F.coalesce("document_type", F.lit(""))).isin(ref.TYPES_WITHOUT_ITEMS).alias("skips_items"),
        count_fired(document_rules, ERROR).alias("own_errors"),
        count_fired(document_rules, WARNING).alias("own_warnings"),
    )
    sums = _item_sums(items)
    # one row a document on either side: never a broadcast, however small a few columns of a wide table look
    joined = narrow.hint("merge").join(sums.hint("merge"), narrow["id"] == sums["document_id"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    differs = ~blank("item_cfop") & ~blank("doc_cfop") & (F.col("item_cfop") != F.col("doc_cfop"))
    zero = F.lit(0).cast("bigint")
    total_of = lambda c: F.coalesce(F.sum(c), zero)
    counted = joined.groupBy("id", "total", "skips_items", "own_errors", "own_warnings").agg(
        total_of("n").alias("n_items"),
        total_of("cents").alias("sum_cents"),
        total_of("errors").alias("item_errors"),
        (total_of("warnings") + F.coalesce(F.sum(F.when(differs, F.col("n"))), zero)).alias("item_warnings"),
    )
    judged, has_items = ~F.col("skips_items"), F.col("n_items") > 0
    usable = judged & has_items & (F.col("total") != 0)
    calculated = F.when(usable, F.col("sum_cents")).otherwise(zero)
    mismatch = judged & has_items & ~(usable & (F.abs(calculated - F.col("total")) <= 1))
    one = lambda c: F.when(c, 1).otherwise(0)
    of_items = lambda c: F.when(judged, F.col(c)).otherwise(zero)
    result = counted.select(
        "id",
        "n_items",
        (F.col("own_errors") + of_items("item_errors") + one(mismatch)).alias("n_errors"),
        (F.col("own_warnings") + of_items("item_warnings") + one(judged & ~has_items)).alias("n_warnings"),
        calculated.alias("calculated_cents"),
    )
    status = F.when(F.col("n_errors") > 0, ERROR).when(F.col("n_warnings") > 0, WARNING).otherwise("success")
    return result.withColumn("status", status)


def merged_issues(findings: DataFrame) -> DataFrame:
    """One finding per (document, message regardless of case): first wording kept, an error outranks a
    warning, first details that are not empty. Input: document_id, seq, message, category, details.

    All three choices are ordinary aggregates, so copies collapse before the shuffle.
    """
    is_warning = F.lower("category").isin("aviso", "warning")
    detail = F.when(F.trim("details") != "", F.col("details"))
    first_error = F.min_by(F.when(~is_warning, F.col("category")), F.when(~is_warning, F.col("seq")))
    merged = findings.groupBy("document_id", F.lower(F.trim("message")).alias("message_key")).agg(
        F.min_by("message", "seq").alias("message"),
        F.min_by("category", "seq").alias("first_category"),
        first_error.alias("error_category"),
        F.min_by(detail, F.when(detail.isNotNull(), F.col("seq"))).alias("details"),
        F.min("seq").alias("seq"),
    )
    return merged.select(
        "document_id",
        "seq",
        "message",
        F.coalesce("error_category", "first_category").alias("category"),
        F.coalesce("details", F.lit("")).alias("details"),
    )


def error_counts(merged: DataFrame) -> DataFrame:
    not_warning = ~F.lower("category").isin("aviso", "warning")
    return merged.groupBy("document_id").agg(F.count_if(not_warning).alias("n_errors"), F.count("*").alias("n_findings"))


def code_checks(documents: DataFrame, first_ncm: Column | None = None) -> DataFrame:
    """Long table of the codes of a document and whether each is known."""
    known = lambda code, table: code.isin(list(table))
    checks = [
        ("cfop", F.col("cfop"), known(normal_cfop(F.col("cfop")), ref.CFOP_DESCRIPTIONS)),
        ("cst_icms", F.col("icms_cst"), known(zero_fill(F.col("icms_cst"), 2), ref.ICMS_CST)),
        ("cst_ipi", F.col("ipi_cst"), known(zero_fill(F.col("ipi_cst"), 2), ref.IPI_CST)),
    ]
    if first_ncm is not None:
        checks.append(("ncm", first_ncm, known(F.trim(first_ncm), ref.NCM_DESCRIPTIONS)))
    present = F.filter(
        F.array(
            *[
                F.when(code.isNotNull(), F.struct(F.lit(name).alias("code_type"), code.alias("code"), ok.alias("is_valid")))
                for name, code, ok in checks
            ]
        ),
        lambda c: c.isNotNull(),
    )
    return documents.select("id", F.explode_outer(present).alias("check")).select("id", "check.*")


def code_check_summary(checks: DataFrame) -> DataFrame:
    """Counts of valid and invalid codes, and pending / valid / invalid."""
    grouped = checks.groupBy("id").agg(
        F.count_if(F.col("is_valid")).alias("valid_codes"),
        F.count_if(~F.col("is_valid")).alias("invalid_codes"),
        F.count("code_type").alias("total_codes"),
    )
    status = F.when(F.col("total_codes") == 0, "pending").when(F.col("invalid_codes") == 0, "valid").otherwise("invalid")
    return grouped.withColumn("status", status)
