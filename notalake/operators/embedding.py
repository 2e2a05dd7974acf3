"""Vectors from a caller's model, computed once a text and kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import computed_once
from .vectors import unit_length

CACHE = "digest string, embedding array<float>"
#: A model is opened once a worker; then it takes a batch of texts and gives a vector, or None, for each.
Model = Callable[[], Callable[[list[str]], list[list[float] | None]]]


def model_column(model: Model, text: Column) -> Column:
    """The model as an iterator UDF: batches in, vectors out, one opening for all batches of a worker's task."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for texts in batches:
            yield pd.Series(run(texts.tolist()))

    return embed(text)


def create_cache(spark: SparkSession, path: str) -> None:
    """An empty cache; nothing happens where there is one."""
    spark.createDataFrame([], CACHE).coalesce(1).write.mode("ignore").parquet(f"{path}/batch=created")


def embedded(chunks: DataFrame, text: str, model: Model, cache: str, batch: str) -> DataFrame:
    """`chunks` with `embedding` (unit length; null where the model gave none, or the text is null).

    Only texts whose digest the cache has no vector for go to the model, each once; their vectors are
    written to the cache before they are joined back to all rows. A batch that runs again replaces its own
    entries. Texts the model failed on are in the cache as null and are not tried again.
    """
    spark = chunks.sparkSession
    create_cache(spark, cache)
    keyed = chunks.withColumn("digest", F.sha2(F.col(text).cast("binary"), 256))
    known = spark.read.schema(f"{CACHE}, batch string").parquet(cache).filter(F.col("batch") != batch).select("digest")
    fresh = keyed.filter(F.col(text).isNotNull()).select("digest", text).dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    run = computed_once(fresh.select("digest", text), "vector", model_column(model, F.col(text)))
    made = run.select("digest", unit_length(F.col("vector")).cast("array<float>").alias("embedding"))
    made.write.mode("overwrite").parquet(f"{cache}/batch={batch}")
    vectors = spark.read.schema(CACHE).parquet(cache).groupBy("digest").agg(F.any_value("embedding", True).alias("embedding"))
    return keyed.join(vectors, "digest", "left").drop("digest")
