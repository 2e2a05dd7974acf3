"""Registration numbers, operation codes and digests."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import reference_data as ref


def digits_only(text: Column) -> Column:
    """NULL becomes ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9]", "")


def zero_fill(text: Column, width: int) -> Column:
    """Left zeros up to `width`; longer text is kept whole (lpad alone would cut it)."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def _weighted_sum(number: Column, weights: list[int]) -> Column:
    """Sum of digit times weight, the last weight on the last digit. Plain arithmetic, so it stays in generated code."""
    places = len(weights) - 1
    shifted = lambda k: F.call_function("div", number, F.lit(10**k)) if k else number
    terms = [(shifted(places - i) % 10) * w for i, w in enumerate(weights)]
    return reduce(add, terms)


def cnpj_check_digits(number: Column) -> Column:
    """The two modulo-11 digits that complete a 12-digit registration: number in, 0..99 out."""
    # Modulo-11 weights of the twelve digits; the first check digit weighs 2 in the second sum.
    first_weights = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    second_weights = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3]
    # A rest of 0 or 1 gives digit 0: (11 - rest) is then 11 or 10, and both end at 0 here.
    digit = lambda total: (11 - total % 11) % 11 % 10
    first = digit(_weighted_sum(number, first_weights))
    second = digit(_weighted_sum(number, second_weights) + first * 2)
    return (first * 10 + second).cast("int")


def cnpj_is_valid(text: Column) -> Column:
    """Formatted or bare; two registrations have a preset verdict."""
    bare = digits_only(text)
    uniform = bare == F.repeat(F.substring(bare, 1, 1), 14)
    return (
        F.when((F.length(bare) != 14) | uniform, F.lit(False))
        .when(bare == ref.CNPJ_ALWAYS_VALID, F.lit(True))
        .when(bare == ref.CNPJ_ALWAYS_INVALID, F.lit(False))
        .otherwise(cnpj_check_digits(F.substring(bare, 1, 12).try_cast("bigint")) == F.substring(bare, 13, 2).try_cast("int"))
    )


def normal_cfop(code: Column) -> Column:
    return zero_fill(digits_only(code), 4)


def cfop_operation(code: Column) -> Column:
    """compra / venda / devolucao / other; an empty code is unknown."""
    clean = normal_cfop(code)
    return (
        F.when(F.coalesce(code, F.lit("")) == "", F.lit("unknown"))
        .when(clean.isin(ref.CFOP_PURCHASES), F.lit("compra"))
        .when(clean.isin(ref.CFOP_SALES), F.lit("venda"))
        .when(clean.isin(ref.CFOP_RETURNS), F.lit("devolucao"))
        .otherwise(F.lit("other"))
    )


def content_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def request_key(query: Column, context: dict[str, Column]) -> Column:
    """Digest of a question and its context; the order in which the context was given does not matter."""
    ordered = F.to_json(F.struct(*[context[name].alias(name) for name in sorted(context)]))
    return F.sha2(F.concat(query, F.lit("|"), ordered), 256)


def record_key(fields: dict[str, Column]) -> Column:
    return F.md5(F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)])))


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(m) for m in markers])


def first_match(text: Column, routes: Iterable[tuple[str, list[str]]], default: Column | None = None) -> Column:
    """Label of the first route one of whose markers occurs."""
    routes = list(routes)
    chain = F.when(contains_any(text, routes[0][1]), F.lit(routes[0][0]))
    for label, markers in routes[1:]:
        chain = chain.when(contains_any(text, markers), F.lit(label))
    return chain if default is None else chain.otherwise(default)
