"""Ranking scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import reference_data as ref


def value_score(value: Column) -> Column:
    """Log scaled onto 0..1; nothing, zero or less scores 0."""
    return F.when(value > 0, F.least(F.lit(1.0), F.log10(value + 1) / 6.0)).otherwise(F.lit(0.0))


def recency_score(created_at: Column, as_of: datetime) -> Column:
    """exp(-days/30); the future counts as today, no date as 0."""
    moment = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    seconds = F.timestamp_diff("MICROSECOND", created_at.cast("timestamp_ntz"), moment) / F.lit(1e6)
    # greatest() skips NULLs, so a missing date has to be told apart first.
    days = F.greatest(seconds / F.lit(86400.0), F.lit(0.0))
    return F.when(created_at.isNull(), F.lit(0.0)).otherwise(F.exp(-days / F.lit(30.0)))


def hybrid_score(similarity: Column, value: Column, recency: Column) -> Column:
    return similarity * ref.WEIGHT_SIMILARITY + value * ref.WEIGHT_VALUE + recency * ref.WEIGHT_RECENCY


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays inside one row; a zero norm gives 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(F.lit(0.0))
