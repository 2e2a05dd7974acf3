"""Token ids as binary files: documents in ascending doc_id order, ids in Simple-8b words.

Texts are range-partitioned and sorted by doc_id, tokenized in that order, and written as Parquet
rows that each hold one segment: the documents of about 4 MB of text, or one longer text. A
segment's payload is self-contained:

    "S8B1" | version u32 | documents u64 | ids u64 | blocks u64 | words u64
    doc_id i64 x documents | has_id u8 x documents | ids of each document u64 x documents
    first word of each block u64 x (blocks + 1) | words u64 x words

all little-endian. Parquet is only the container that Spark can write to any shared store; a reader
needs no more than the payload. Files are numbered by partition, which follows the order of doc_id.

Defined results: null text is empty and holds only the end id; documents with equal doc_id follow
one another ordered by text; null doc_id comes first; an empty table gives no files' rows; other
columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .arrow_text import slices
from .common import stored, table
from .registry import query
from .token_pieces import SLICE_BYTES, encoder

MAGIC = b"S8B1"
SEGMENT = "file int, segment int, first_id long, n_documents long, n_ids long, payload binary"


def pack_segment(doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bytes:
    words, starts = simple8b.encode(ids)
    head = np.array([len(counts), len(ids), len(starts) - 1, len(words)], "<u8")
    return b"".join([MAGIC, np.array([1], "<u4").tobytes(), head.tobytes(), doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), counts.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether each is known, ids, ids of each document."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    documents, n, blocks, n_words = (int(x) for x in np.frombuffer(payload, "<u8", 4, 8))
    at = 40
    parts = []
    for kind, size in (("<i8", documents), ("u1", documents), ("<u8", documents), ("<u8", blocks + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(payload, kind, size, at))
        at += parts[-1].nbytes
    doc_ids, known, counts, starts, words = parts
    return doc_ids, known.astype(bool), simple8b.decode(words, starts.astype(np.int64), n), counts.astype(np.int64)


def _writer(path: str, cuts: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, cuts)
        file, first = TaskContext.get().partitionId(), 0
        for number, part in enumerate(slices(batches, "text", SLICE_BYTES)):
            ids, counts = encode(part.column("text"), end)
            doc = part.column("doc_id")
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            payload = pack_segment(doc.fill_null(0).to_numpy(), known, ids, counts)
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([file], pa.int32()), "segment": pa.array([number], pa.int32()), "first_id": [first], "n_documents": [len(counts)], "n_ids": [len(ids)], "payload": pa.array([payload], pa.binary())}
            )
            first += len(ids)

    return run


def token_segments(docs: DataFrame, tokenizer: str, cuts: str, end: int | None, *, files: int | None = None) -> DataFrame:
    """Segments of all documents in ascending doc_id order; `files` partitions, else as many as the session says."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = chosen.repartitionByRange(files, order[0]) if files else chosen.repartitionByRange(order[0])
    return ranged.sortWithinPartitions(*order).mapInArrow(_writer(tokenizer, cuts, end), SEGMENT)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload")):
            doc_ids, known, ids, counts = unpack_segment(payload.as_py())
            ends = np.cumsum(counts)
            edges = [0, *ends.tolist()]
            small = ids.astype("<u4")
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc_ids, mask=~known),
                    "start": pa.array(base + ends - counts),
                    "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array([zlib.crc32(small[a:b].tobytes()) for a, b in zip(edges, edges[1:])], pa.int64()),
                }
            )


def document_index(segments: DataFrame) -> DataFrame:
    """Per document, read back from the written segments: doc_id, start, n_tokens, ids_crc32.

    Where a file starts is a running sum over one row a file; that small table, no larger than the
    number of partitions written, is broadcast.
    """
    from pyspark.sql import Window

    sizes = segments.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = sizes.select("file", F.coalesce(before, F.lit(0)).alias("file_start"))
    placed = segments.join(F.broadcast(files), "file").select((F.col("file_start") + F.col("first_id")).alias("base"), "payload")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    segments = token_segments(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), "words", 2)
    return document_index(stored(segments, "token-files"))
