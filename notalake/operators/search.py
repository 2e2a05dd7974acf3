"""Facet filters, text search and paging over whole tables. No row cap before a filter."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import reference_data as ref
from ..functions.codes import digits_only

EXACT_FACETS = {"id", "fiscal_document_id", "session_id"}
REGISTRATION_FACETS = {"issuer_cnpj", "recipient_cnpj"}


def facet_filter(df: DataFrame, **facets: Any) -> DataFrame:
    """All given facets must hold; empty values are ignored.

    `created_after` is inclusive and `created_before` exclusive, ids are equal, registrations are
    compared by digits (only dots are removed from the stored side), everything else is a
    case-insensitive contains in which % and _ keep their SQL meaning.
    """
    conditions = []
    for name, value in facets.items():
        if value is None or value == "":
            continue
        if name == "created_after":
            conditions.append(F.col("created_at") >= F.lit(value))
        elif name == "created_before":
            conditions.append(F.col("created_at") < F.lit(value))
        elif name in EXACT_FACETS:
            conditions.append(F.col(name) == F.lit(value))
        elif name in REGISTRATION_FACETS:
            digits = "".join(ch for ch in str(value) if ch.isdigit())
            conditions.append(F.replace(F.col(name), F.lit("."), F.lit("")).ilike(f"%{digits}%"))
        else:
            conditions.append(F.col(name).ilike(f"%{value}%"))
    return df.filter(reduce(and_, conditions)) if conditions else df


def exact_filter(df: DataFrame, **facets: Any) -> DataFrame:
    """Equality on every facet; one that names no column lets everything pass."""
    for name, value in facets.items():
        if name in df.columns:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def criteria_search(
    df: DataFrame,
    limit: int = 10,
    document_type: str | None = None,
    issuer_cnpj: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    validation_status: str | None = None,
) -> DataFrame:
    """Exact criteria with an inclusive date range, newest first: one top-k pass, no full sort."""
    wanted = {"document_type": document_type, "issuer_cnpj": issuer_cnpj, "validation_status": validation_status}
    for name, value in wanted.items():
        if value:
            df = df.filter(F.col(name) == value)
    if date_from:
        df = df.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        df = df.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    return df.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)


def ordering(order_by: str, direction: str = "desc") -> Column:
    """Sort key from the allow-list; NULLs count as largest, so they lead a descending list."""
    column = order_by if order_by in ref.SORTABLE else "created_at"
    return F.desc_nulls_first(column) if direction.lower() == "desc" else F.asc_nulls_last(column)


def page(
    df: DataFrame, number: int = 1, size: int = 10, order_by: str = "created_at", direction: str = "desc", tie: str = "id"
) -> DataFrame:
    """One page, as a top-k of each task. A tie-break makes pages disjoint.

    Each task sends the rows up to the page's end, so this is for the first pages of a list; a list that
    is paged through has a `rank_index`, or goes on from its last row (`page_after`).
    """
    size = size if size > 0 else 10
    return df.orderBy(ordering(order_by, direction), tie).offset((number - 1) * size).limit(size)


def rank_index(df: DataFrame, path: str, order_by: str = "created_at", direction: str = "desc", tie: str = "id", ranges: int = 64) -> None:
    """Writes the list in order, in `ranges` folders of about the same number of rows, with the rows before each.

    The order includes the tie-break, so rows with one sort key spread over folders as well.
    """
    order = (ordering(order_by, direction), F.asc_nulls_first(tie))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt.withColumn("range_no", F.spark_partition_id()).write.mode("overwrite").partitionBy("range_no").parquet(f"{path}/rows")
    spark = df.sparkSession
    counts = spark.read.parquet(f"{path}/rows").groupBy("range_no").agg(F.count("*").alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range
    counts.select("range_no", "n_rows", before.alias("rows_before")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def ranked_page(
    spark: SparkSession, path: str, number: int = 1, size: int = 10, order_by: str = "created_at", direction: str = "desc", tie: str = "id"
) -> DataFrame:
    """A page of a `rank_index`, at any depth: only the folders that hold it are opened."""
    size = size if size > 0 else 10
    offset = (number - 1) * size
    held = (F.col("rows_before") < offset + size) & (F.col("rows_before") + F.col("n_rows") > offset)
    opened = spark.read.parquet(f"{path}/ranges").filter(held).collect()  # at most one row a range
    rows = spark.read.parquet(f"{path}/rows")
    inside = rows.filter(F.col("range_no").isin([r["range_no"] for r in opened])).drop("range_no")
    skipped = offset - min((r["rows_before"] for r in opened), default=offset)
    return inside.orderBy(ordering(order_by, direction), F.asc_nulls_first(tie)).offset(skipped).limit(size)


def page_after(
    df: DataFrame, last_key: Any, last_tie: Any, size: int = 10, order_by: str = "created_at", direction: str = "desc", tie: str = "id"
) -> DataFrame:
    """The page that follows the row with this sort key and tie-break; no row before it is sorted."""
    column = order_by if order_by in ref.SORTABLE else "created_at"
    key, descending = F.col(column), direction.lower() == "desc"
    if last_key is None:
        follows = (key.isNull() & (F.col(tie) > F.lit(last_tie))) | (key.isNotNull() if descending else F.lit(False))
    else:
        beyond = key < F.lit(last_key) if descending else (key > F.lit(last_key)) | key.isNull()
        follows = beyond | ((key == F.lit(last_key)) & (F.col(tie) > F.lit(last_tie)))
    return df.filter(follows).orderBy(ordering(order_by, direction), tie).limit(size if size > 0 else 10)


def page_totals(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: total, page, page_size, total_pages."""
    size = size if size > 0 else 10
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(number).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        F.ceil(F.col("total") / size).cast("bigint").alias("total_pages"),
    )


def contains_text(df: DataFrame, query: str, *fields: str) -> DataFrame:
    """Rows any of whose fields contains the query, whatever the case."""
    needle = query.lower()
    return df.filter(reduce(or_, [F.coalesce(F.lower(F.col(f)).contains(needle), F.lit(False)) for f in fields]))


def matches_reference(reference: str, *fields: str) -> Column:
    """A field contains the reference, or the digits of a field contain the digits of the reference."""
    wanted = reference.lower().strip()
    digits = "".join(ch for ch in wanted if ch.isdigit())
    if not wanted and not digits:
        return F.lit(False)

    def hit(value: Column) -> Column:
        tests = [value.contains(wanted)] if wanted else []
        if digits:
            tests.append(digits_only(value).contains(digits))
        return F.coalesce(reduce(or_, tests), F.lit(False))

    # Each field is named once a test, so that all is compiled; no lambda, which Spark interprets. Costly fields are best `computed_once`.
    return reduce(or_, [hit(F.lower(F.col(name).cast("string"))) for name in fields])


def missing_required(emitente: Column, itens: Column, total: Column) -> Column:
    """Names of the required parts a document lacks, joined by commas; '' when it may be imported."""
    return F.concat_ws(
        ", ",
        F.when(emitente.isNull(), F.lit("emitente")),
        F.when(itens.isNull(), F.lit("itens")),
        F.when(total.isNull(), F.lit("total")),
    )


def unprocessed(df: DataFrame, status: str = "embedding_status") -> DataFrame:
    return df.filter(F.coalesce(F.col(status), F.lit("")) != "completed")


def unexpired(df: DataFrame, as_of: str, expires: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires) > F.lit(as_of).cast("timestamp_ntz"))
