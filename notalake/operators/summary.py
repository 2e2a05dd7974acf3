"""Portfolio, tax, embedding and import summaries. All are partial aggregates followed by one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def portfolio(df: DataFrame, category: Column, issuer: Column, value: Column) -> DataFrame:
    """One long table from one pass: dimension, key, n_documents, total_value.

    Both groupings and the grand total come from grouping sets, so the documents are scanned once.
    The number of result rows is the number of categories plus issuers, kept long rather than nested.
    """
    base = df.select(category.alias("category"), issuer.alias("issuer"), value.alias("value"))
    sets = base.groupingSets([["category"], ["issuer"], []], "category", "issuer").agg(
        F.count("*").alias("n_documents"),
        F.sum("value").alias("total_value"),
        F.grouping("category").alias("no_category"),
        F.grouping("issuer").alias("no_issuer"),
    )
    dimension = F.when(F.col("no_category") == 0, "category").when(F.col("no_issuer") == 0, "issuer").otherwise("all")
    key = F.when(F.col("no_category") == 0, F.col("category")).when(F.col("no_issuer") == 0, F.col("issuer"))
    return sets.select(dimension.alias("dimension"), key.alias("key"), "n_documents", "total_value")


def top_by_count(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_documents")).orderBy(F.desc("n_documents"), key).limit(n)


def tax_totals(df: DataFrame, taxes: dict[str, str]) -> DataFrame:
    """One row per tax; the sums come from one pass and only then turn into rows."""
    sums = df.agg(*[F.sum(column).alias(name) for name, column in taxes.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("tax"), F.col(name).alias("amount")) for name in taxes])
    return sums.select(F.explode(pairs).alias("t")).select("t.*")


def status_shares(df: DataFrame, status: Column) -> DataFrame:
    """Status, its count and share. The window runs over the few status rows, not over documents."""
    counts = df.groupBy(status.alias("status")).agg(F.count("*").alias("n_documents"))
    everything = F.sum("n_documents").over(Window.partitionBy(F.lit(0)))
    return counts.select("status", "n_documents", F.round(F.col("n_documents") * 100.0 / everything, 4).alias("percent"))


def outcome_report(df: DataFrame, success: Column) -> DataFrame:
    """total, succeeded, failed and their percentages, in one row."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(success).alias("succeeded"), F.count_if(~success).alias("failed")
    ).select(
        "*",
        F.round(F.try_divide(F.col("succeeded") * 100.0, "total"), 4).alias("succeeded_percent"),
        F.round(F.try_divide(F.col("failed") * 100.0, "total"), 4).alias("failed_percent"),
    )


def document_value(extracted: Column) -> Column:
    """The value in a VARIANT record: `total`, else `valor_total`, else `value`; NULL where the first that is there is no number."""
    first = F.coalesce(*[F.try_variant_get(extracted, f"$.{name}", "variant") for name in ("total", "valor_total", "value")])
    return F.try_variant_get(first, "$", "double")


def financial_lines(df: DataFrame, document_type: Column, total: Column, taxes: dict[str, Column], status: Column) -> DataFrame:
    """part, position, line: a report on documents, their value, types, taxes and verdicts.

    One pass over the documents; what is ordered afterwards is one row a type, a tax or a status. Types and
    taxes come by falling count and amount, a tax without an amount does not come.
    """
    base = df.select(document_type.alias("type"), status.alias("status"), total.alias("total"), *[c.alias(n) for n, c in taxes.items()])
    sets = base.groupingSets([["type"], ["status"], []], "type", "status").agg(
        F.count("*").alias("n"), F.sum("total").alias("total"), *[F.sum(n).alias(n) for n in taxes], F.grouping("type").alias("_t"), F.grouping("status").alias("_s")
    )
    count = F.col("n").cast("string")
    plain = lambda c: F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))
    whole, by_type, by_status = (F.col("_t") + F.col("_s") == 2), F.col("_t") == 0, F.col("_s") == 0
    line = lambda part, weight, *text: F.struct(F.lit(part).alias("part"), weight.cast("double").alias("weight"), F.concat(*text).alias("line"))
    none = F.lit(0)
    amounts = [F.when(F.col(n) != 0, line(5, -F.col(n), F.lit(f"  - {n}: R$ "), plain(F.col(n)))) for n in taxes]
    some = F.coalesce(*[F.when(F.col(n) != 0, F.lit(True)) for n in taxes], F.lit(False))
    of_whole = F.array(
        line(0, none, F.lit("Total de documentos analisados: "), count),
        line(1, none, F.lit("Valor total dos documentos: R$ "), F.format_number(F.coalesce("total", F.lit(0.0)), 2)),
        line(2, none, F.lit("Distribuição por tipo de documento:")),
        F.when(some, line(4, none, F.lit("Resumo de impostos:"))),
        *amounts,
        line(6, none, F.lit("Status de validação:")),
    )
    lines = (
        F.when(whole, F.when(F.col("n") > 0, F.array_compact(of_whole)))
        .when(by_type, F.array(line(3, -F.col("n"), F.lit("  - "), F.col("type"), F.lit(": "), count, F.lit(" documentos"))))
        .when(by_status, F.array(line(7, none, F.lit("  - "), F.col("status"), F.lit(": "), count, F.lit(" documentos"))))
    )
    order = Window.partitionBy("part").orderBy("weight", "line")
    return sets.select(F.explode(lines).alias("l")).select("l.*").select("part", F.row_number().over(order).alias("position"), "line")


def store_totals(documents: DataFrame, chunks: DataFrame, insights: DataFrame, status: Column) -> DataFrame:
    """measure, key, n: documents, those by status, chunks, vectors and their bytes (four a number), insights."""
    row = lambda df, name, n: df.agg(n.cast("bigint").alias("n")).select(F.lit(name).alias("measure"), F.lit(None).cast("string").alias("key"), "n")
    by_status = documents.groupBy(status.alias("key")).agg(F.count("*").alias("n")).select(F.lit("documents_by_status").alias("measure"), "key", "n")
    of_chunks = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.coalesce(F.sum(F.size("embedding").cast("bigint") * 4), F.lit(0)).alias("vector_bytes"))
    return (
        row(documents, "documents", F.count("*"))
        .unionByName(by_status)
        .unionByName(of_chunks.unpivot([], ["chunks", "vectors", "vector_bytes"], "measure", "n").select("measure", F.lit(None).cast("string").alias("key"), "n"))
        .unionByName(row(insights, "insights", F.count("*")))
    )
