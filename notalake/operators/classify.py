"""What a document, an operation or a chat question is. Pure column work: no job here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions.codes import cfop_operation, contains_any, first_match


def document_class(document_type: Column, doc_cfop: Column, first_item_cfop: Column) -> Column:
    """mdfe / cte by type, otherwise the operation of the document's code or of its first item's."""
    kind = F.upper(F.trim(F.coalesce(document_type, F.lit(""))))
    own = F.when(F.coalesce(doc_cfop, F.lit("")) != "", doc_cfop).otherwise(first_item_cfop)
    return (
        F.when(kind.isin("MDF", "MDFE"), F.lit("mdfe")).when(kind == "CTE", F.lit("cte")).otherwise(cfop_operation(own))
    )


def issuer_profile(cnpj: Column) -> Column:
    return F.when(F.coalesce(cnpj, F.lit("")) != "", F.lit("fornecedor")).otherwise("cliente")


def sector(total: Column) -> Column:
    """By size of the total; an unreadable total counts as none."""
    return F.when(total > 10000.0, F.lit("industria")).when(total > 0.0, F.lit("comercio")).otherwise("servicos")


def category(document_type: Column, subtype: Column, model: Column, file_name: Column) -> Column:
    """Uniform category: stated type, else extracted subtype, else model number, else the file name."""
    stated = F.upper(F.coalesce(document_type, F.lit("")))
    named = F.coalesce(*[F.when(stated == k, F.lit(v)) for k, v in ref.CATEGORY_BY_TYPE.items()], stated)
    by_subtype = first_match(F.upper(F.coalesce(subtype, F.lit(""))), [(v, m) for m, v in ref.CATEGORY_BY_SUBTYPE_MARKER])
    by_model = F.coalesce(*[F.when(model == k, F.lit(v)) for k, v in ref.CATEGORY_BY_MODEL.items()])
    by_file = first_match(F.upper(F.coalesce(file_name, F.lit(""))), [(v, m) for m, v in ref.CATEGORY_BY_FILE_MARKER])
    return F.when((stated != "") & (stated != "N/A"), named).otherwise(
        F.coalesce(by_subtype, by_model, by_file, F.lit(ref.CATEGORY_UNKNOWN))
    )


def question_route(text: Column) -> Column:
    return first_match(F.lower(text), ref.QUESTION_ROUTES, F.lit("general"))


def question_intent(text: Column) -> Column:
    """howto is looked for first; NULL when neither applies."""
    return first_match(F.lower(text), [("howto", ref.HOWTO_MARKERS), ("validation", ref.VALIDATION_MARKERS)])


def type_hints(text: Column) -> Column:
    """Every document type a question mentions."""
    lowered = F.lower(text)
    hints = F.array(*[F.when(contains_any(lowered, markers), F.lit(kind)) for kind, markers in ref.TYPE_HINTS.items()])
    return F.filter(hints, lambda h: h.isNotNull())
