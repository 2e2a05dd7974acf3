"""Corpus pipeline: documents in, packed training sequences out. Each stage is one operator of notalake.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notalake.llm.common import stored, table
from notalake.llm.decontaminate import drop_leaks
from notalake.llm.jaccard_join import keep_first
from notalake.llm.packing import pack_stage
from notalake.llm.quality_rules import keep_good
from notalake.llm.secret_scan import mask_secrets

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_first),
    ("decontaminate", drop_leaks),
    ("secret_scan", mask_secrets),
    ("packing", pack_stage),
]

#: Learned rules, alignment and tokenizing have no SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
