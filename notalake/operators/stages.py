"""Keeping an expensive value from being computed more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds `name`, evaluated once per row whatever is built on it.

    Filters on a projected column are pushed below the projection by repeating its expression, and
    projections merge; for a parser call that multiplies the work. A generator over a one-element
    array is a stage neither passes, costs no shuffle and stays in the same task.

    The array is a column of a projection, which Spark always compiles; the expressions of a generator
    are interpreted where the stage is too long to be compiled whole. `explode_outer`, since Spark
    filters the input of a plain `explode` by the array's size and would compute it twice.
    """
    held = f"_{name}_held"
    return df.select("*", F.array(value).alias(held)).select("*", F.explode_outer(held).alias(name)).drop(held)


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """More tasks for a costly row-by-row job whose input has fewer partitions than there are cores.

    A file of one row group is one task however long the work per row. On input that already has a
    partition per core, which is every large table, this adds nothing. With `task_rows` a larger table is
    dealt out too, at most that many rows a task, for work that dwarfs a shuffle of them; its splits may
    be few or empty, since a row group is read whole by one of them. That counts the rows of `df`.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = -(-df.count() // task_rows) if task_rows else 0
    return df.repartition(max(tasks, cores)) if tasks > 1 or df.rdd.getNumPartitions() < cores else df
