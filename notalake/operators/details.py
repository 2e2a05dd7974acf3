"""Findings out of validation details, whose values are of any kind: flags, numbers, texts, objects, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A false flag of a field with one of these in its name is a status and no finding.
STATUS_TOKENS = ("valido", "válido", "valid", "status")

#: Places of the kinds of findings, in the order in which they are taken.
ISSUE, WARNING, STATUS, FIELD = 1_000_000, 2_000_000, 3_000_000, 4_000_000


def _as_text(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def empty(value: Column) -> Column:
    """null, false, zero, and empty texts, lists and objects."""
    kind = _kind(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return (
        F.is_variant_null(value)
        | ((kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(value, "$", "boolean"), F.lit(True)))
        | (number & (F.try_variant_get(value, "$", "double") == 0))
        | F.to_json(value).isin('""', "[]", "{}")
    )


def _judged(value: Column) -> Column:
    """What an object says of itself: `valido`, else `is_valid`, else that it is fine."""
    said = F.coalesce(F.try_variant_get(value, "$.valido", "variant"), F.try_variant_get(value, "$.is_valid", "variant"))
    return F.coalesce(~empty(said), F.lit(True))


def detail_findings(documents: DataFrame, key: str, details: str, has_errors: str) -> DataFrame:
    """key, seq, message, category, details: the long table of findings in a VARIANT column of details.

    Entries of `issues` are errors and entries of `warnings` are warnings; a `status` of error counts where
    there is no other finding so far (`has_errors` says whether other sources had some); each entry of
    `validations` is read by its kind. Fields are taken in the order of their names.
    """
    d = F.col(details)

    def finding(seq: Column, message: Column, category: Column, text: Column) -> Column:
        return F.struct(seq.cast("int").alias("seq"), message.alias("message"), category.alias("category"), text.alias("details"))

    def listed(path: str, first: int, category: str) -> Column:
        entries = F.coalesce(F.try_variant_get(d, path, "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(entries, lambda v, i: finding(i + first, _as_text(v), F.lit(category), F.lit("")))

    issues, warnings = listed("$.issues", ISSUE, "Erro"), listed("$.warnings", WARNING, "Aviso")
    failed = (F.try_variant_get(d, "$.status", "string") == "error") & ~F.coalesce(F.col(has_errors), F.lit(False)) & (F.size(issues) + F.size(warnings) == 0)
    said = F.coalesce(F.try_variant_get(d, "$.message", "string"), F.lit("Erro na validação"))
    status = F.when(failed, F.array(finding(F.lit(STATUS), said, F.lit("Status"), F.to_json(d)))).otherwise(F.array().cast("array<struct<seq:int,message:string,category:string,details:string>>"))

    def of_field(entry: Column, i: Column) -> Column:
        name, value = entry["key"], entry["value"]
        kind, seq = _kind(value), i + FIELD
        message = F.concat(F.lit("Erro na validação de "), name)
        is_status = F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(t)), F.lit(True)) for t in STATUS_TOKENS], F.lit(False))
        shown = F.when(F.is_variant_null(value), F.lit("None")).otherwise(_as_text(value))
        return (
            F.when(kind == "BOOLEAN", F.when(empty(value) & ~is_status, finding(seq, message, name, F.lit("A validação retornou falso"))))
            .when(kind.startswith("OBJECT"), F.when(~_judged(value), finding(seq, F.coalesce(F.try_variant_get(value, "$.message", "string"), message), name, F.coalesce(F.try_variant_get(value, "$.details", "string"), F.lit("")))))
            .when(empty(value), finding(seq, message, name, F.concat(F.lit("Valor inválido: "), shown)))
        )

    fields = F.map_entries(F.coalesce(F.try_variant_get(d, "$.validations", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    each = F.concat(issues, warnings, status, F.array_compact(F.transform(fields, of_field)))
    return documents.filter(d.isNotNull()).select(key, F.explode(each).alias("f")).select(key, "f.*")
