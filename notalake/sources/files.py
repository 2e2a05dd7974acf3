"""File sources: XML folders, CSV, JSON document stores; and the file kinds that are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import reference_data as ref


def xml_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file_name, xml, size. Sub-folders are read too."""
    files = (
        spark.read.option("pathGlobFilter", "*.[xX][mM][lL]")
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
    )
    return files.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("xml"),
        F.col("_metadata.file_size").alias("size"),
    )


def extension(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1))


def routed(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds `route` (xml / text / none), `supported` and `error_code`. Scans arrive as recognised text."""
    kind = extension(F.col(name))
    route = (
        F.when(kind.isin(ref.XML_EXTENSIONS), F.lit("xml")).when(kind.isin(ref.SCAN_EXTENSIONS), F.lit("text")).otherwise("none")
    )
    return files.withColumns(
        {
            "extension": kind,
            "route": route,
            "supported": route != "none",
            "error_code": F.when(route == "none", F.lit("unsupported_file_type")),
        }
    )


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema types are inferred; with one, rows of another width are dropped."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    # A pruned read never looks at the other fields and would let short rows through.
    return reader.option("mode", "DROPMALFORMED").option("columnPruning", False).schema(schema).csv(path)


def csv_text(lines: DataFrame, header: list[str], column: str = "value") -> DataFrame:
    """CSV lines held in a column, quoting understood: rows of another width than the header's are dropped, values are trimmed text."""
    fields = ", ".join(f"_f{i} string" for i in range(len(header)))
    row = F.from_csv(column, f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    kept = lines.filter(F.trim(column) != "").select(row.alias("_row")).filter("_row._bad IS NULL")
    return kept.select(*[F.coalesce(F.trim(f"_row._f{i}"), F.lit("")).alias(name) for i, name in enumerate(header)])


def json_store(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of `{"documents": [...], "next_id": n}` files."""
    reader = spark.read.option("multiLine", True)
    store = (reader.schema(schema) if schema else reader).json(path)
    return store.select(F.explode("documents").alias("document")).select("document.*")
