"""Document stores as JSON files whose records have no common shape: kept as VARIANT, read field by field.

A store file is one object, {"documents": [...], "next_id": n}, over as many lines as it likes. Files are
the unit that Spark can split, so `write_store` makes many of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """file_name, position and `document` (VARIANT) of every record of the files at `path`."""
    stores = spark.read.option("multiLine", True).option("singleVariantColumn", "store").json(path)
    listed = stores.select(F.col("_metadata.file_name").alias("file_name"), F.try_variant_get("store", "$.documents", "array<variant>").alias("documents"))
    return listed.select("file_name", F.posexplode("documents").alias("position", "document"))


def field(document: str, path: str, kind: str) -> Column:
    """The value at a JSON path in the wanted type; NULL where it is missing or of a kind that does not become it."""
    return F.try_variant_get(document, f"$.{path}", kind)


def flattened(documents: DataFrame, fields: dict[str, tuple[str, str]], document: str = "document") -> DataFrame:
    """One typed column a field, given as name: (path, type), beside the other columns."""
    return documents.select(*[c for c in documents.columns if c != document], *[field(document, path, kind).alias(name) for name, (path, kind) in fields.items()])


def schema_of_store(documents: DataFrame, document: str = "document") -> DataFrame:
    """One row: the schema that all records fit; fields whose types differ are VARIANT."""
    return documents.agg(F.schema_of_variant_agg(document).alias("schema"))


def write_store(records: DataFrame, path: str, per_file: int = 1000) -> None:
    """Records, a column `record` of JSON text and `id` of whole numbers, as store files of at most `per_file` records."""
    file = F.floor(F.col("id") / per_file)
    held = records.groupBy(file.alias("file")).agg(F.array_sort(F.collect_list(F.struct("id", "record"))).alias("r"), F.max("id").alias("last"))
    body = F.array_join(F.transform("r", lambda x: x["record"]), ",\n    ")
    text = F.concat(F.lit('{\n  "documents": [\n    '), body, F.lit('\n  ],\n  "next_id": '), (F.col("last") + 1).cast("string"), F.lit("\n}"))
    held.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
