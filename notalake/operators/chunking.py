"""Documents -> chunk tables, with the status the embedding run leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import computed_once


def assembled_text(document_type: Column, number: Column, issuer: Column, extracted: list[tuple[str, Column]], *bodies: Column) -> Column:
    """Type, number, issuer, the plain pairs of the extracted data and the texts, with blanks between. Empty parts vanish."""
    filled = lambda label, c: F.when(c.cast("string") != "", F.concat(F.lit(label), c.cast("string")))
    parts = [filled("Tipo: ", document_type), filled("Número: ", number), filled("CNPJ Emissor: ", issuer)]
    parts += [filled(f"{name}: ", value) for name, value in extracted]
    return F.concat_ws(" ", *parts, *[F.nullif(b, F.lit("")) for b in bodies])


def chunk_table(df: DataFrame, key: str, chunks: Column, header: Column | None = None) -> DataFrame:
    """key, chunk_number (from 0), total_chunks, content_text, chunk_size."""
    kept = df.select("*", *([header.alias("_header")] if header is not None else []))
    # Unfolding implies a filter on the array, which would be pushed down and cut the text a second time.
    rows = computed_once(kept, "_chunks", chunks).select(
        key, *(["_header"] if header is not None else []), F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_number", "_text")
    )
    content = F.concat("_header", "_text") if header is not None else F.col("_text")
    return rows.select(
        key, "chunk_number", "total_chunks", content.alias("content_text"), F.length(content).alias("chunk_size")
    )


def chunk_records(df: DataFrame, chunks: Column, fields: dict[str, Column], configured_size: int) -> DataFrame:
    """One row a chunk with all it is stored with: number, content under its header, sizes, and the document's fields.

    `fields` gives document_id, document_type, file_name, issuer_cnpj and document_number; what is missing is ''.
    """
    named = {name: F.coalesce(value.cast("string"), F.lit("")) for name, value in fields.items()}
    wanted = ("document_id", "document_type", "file_name", "issuer_cnpj", "document_number")
    rows = df.select(*[named[n].alias(n) for n in wanted], chunks.alias("_text"))
    rows = computed_once(rows, "_chunks", F.col("_text")).select(*wanted, F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_number", "_part"))
    content = F.concat(metadata_header(F.col("document_type"), F.col("issuer_cnpj")), F.col("_part"))
    return rows.select(
        *wanted, "chunk_number", "total_chunks", content.alias("content_text"), F.length(content).alias("chunk_size"), F.lit(configured_size).alias("configured_size")
    )


def metadata_header(document_type: Column, issuer: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("[Tipo de Documento: "), empty(document_type), F.lit(", CNPJ Emissor: "), empty(issuer), F.lit("]\n"))


def embedding_status(documents: DataFrame, chunks: DataFrame, key: str, embedded: Column) -> DataFrame:
    """completed when every chunk has a vector, processing when some have, failed when none has or there is no chunk."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.count_if(embedded).alias("n_embedded"))
    done, all_of = F.coalesce("n_embedded", F.lit(0)).cast("bigint"), F.coalesce("n_chunks", F.lit(0)).cast("bigint")
    status = F.when(done == 0, "failed").when(done < all_of, "processing").otherwise("completed")
    return documents.select(key).join(counts, key, "left").select(
        key, all_of.alias("n_chunks"), done.alias("n_embedded"), status.alias("embedding_status")
    )
