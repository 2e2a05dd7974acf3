"""Parquet tables of a warehouse folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def target_columns(df: DataFrame, target: list[str]) -> DataFrame:
    """Keep what the target table knows, in its order; anything else is dropped silently."""
    return df.select(*[c for c in target if c in df.columns])
