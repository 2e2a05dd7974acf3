"""The number spellings of the domain. Each reader has its own rule, so each has its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard before any cast: Spark would also accept forms such as `1d`.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _guarded(text: Column) -> Column:
    """The number, or NULL. Mentions `text` once: these expressions nest, and every mention is evaluated again."""
    return F.regexp_extract(text, PLAIN_NUMBER, 0).try_cast("double")


def _comma_rule(text: Column) -> Column:
    """A comma is the decimal point and the dots beside it group thousands; without one the text stays."""
    return F.when(text.contains(","), F.translate(text, ",.", ".")).otherwise(text)


def rule_number(text: Column) -> Column:
    """Rule-book reading: currency marks and blanks dropped, anything unreadable is 0."""
    return F.coalesce(_guarded(_comma_rule(F.regexp_replace(F.trim(text), r"[R$\s]", ""))), F.lit(0.0))


def xml_number(text: Column, strict_reference: bool = False) -> Column:
    """Reading of XML amounts. `strict_reference` keeps the odd mixed-separator result (1.234,56 -> 1.23456)."""
    kept = F.regexp_replace(text, r"[^0-9.,+\-eE]", "")
    if strict_reference:
        both = kept.contains(",") & kept.contains(".")
        comma_last = F.instr(kept, ",") > F.instr(kept, ".")
        joined = (
            F.when(both & comma_last, F.replace(kept, F.lit(","), F.lit("")))
            .when(both, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .otherwise(F.replace(kept, F.lit(","), F.lit(".")))
        )
    else:
        joined = _comma_rule(kept)
    # After the first dot further dots are noise.
    single_dot = F.regexp_replace(joined, r"^([^.]*\.)|\.", "$1")
    scientific = F.when(F.lower(kept).contains("e"), _guarded(F.translate(kept, ",", ".")))
    return F.coalesce(scientific, _guarded(single_dot), F.lit(0.0))


def display_number(text: Column) -> Column:
    """Import and listing screens: only the literal mark `R$` and plain blanks are dropped."""
    bare = F.replace(F.replace(F.trim(text), F.lit("R$"), F.lit("")), F.lit(" "), F.lit(""))
    return F.coalesce(_guarded(_comma_rule(bare)), F.lit(0.0))


def store_number(text: Column) -> Column:
    """Ranking reader: every dot is a thousands mark, unreadable is NULL."""
    bare = F.replace(F.replace(F.trim(text), F.lit("R$"), F.lit("")), F.lit(" "), F.lit(""))
    return _guarded(F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def coerced_amount(text: Column) -> Column:
    """Amount on its way into storage: NULL stays NULL, unreadable becomes 0."""
    return F.when(text.isNotNull(), rule_number(text))


def plain_float(text: Column) -> Column:
    """A bare float literal or NULL; Brazilian spellings are not understood here."""
    return _guarded(F.trim(text))


def money2(value: Column) -> Column:
    """Two places, half to even, in decimal arithmetic."""
    return F.bround(value.cast("decimal(38,10)"), 2).cast("decimal(18,2)")


def currency_text(value: Column) -> Column:
    """R$ 1.234,56"""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(value, 2), ",.", ".,"))


def decimal_comma(value: Column, places: int = 2) -> Column:
    """1234,56: no grouping, comma as the decimal point (CSV export)."""
    return F.translate(F.replace(F.format_number(value, places), F.lit(","), F.lit("")), ".", ",")
