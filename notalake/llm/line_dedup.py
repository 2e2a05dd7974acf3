"""Substring dedup by line hashing, down to the sentences of a line.

A unit ends at a line end or after a word with a full stop, question or exclamation mark. Its digest
is of its words with A-Z folded, so white space does not count. Digests are grouped globally; of each,
the occurrence that ranks first (doc_id, then text digest, then place) is kept. Neighbouring units
that are repeats elsewhere form a run; a run of `min_words` words or more is removed, a shorter one
stays, so that short sentences which recur by chance are left alone and long passages go whatever
their sentences' lengths. Offsets of what was removed refer to the original text.

Defined results: null text has no units and stays null, empty text stays empty; rows that repeat both
doc_id and text count as one document and are treated alike; null doc_id ranks last; an empty table
gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import Words, mix, slices
from .common import free_name, stored, table
from .registry import query

MIN_WORDS = 24  # passages worth removing have more, sentences that recur by chance fewer
ENDS = np.zeros(256, bool)
ENDS[list(b".!?")] = True

UNIT = "doc_id long, digest long, unit int, start int, stop int, words int, d1 long, d2 long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words = Words(part.column("text"), lower=True)
        n = len(words.starts)
        if not n:
            continue
        lines = np.concatenate(([0], np.cumsum(words.data == 0x0A)))
        first = np.ones(n, bool)
        first[1:] = (words.doc[1:] != words.doc[:-1]) | (lines[words.starts[1:]] > lines[words.ends[:-1]]) | ENDS[words.data[words.ends[:-1] - 1]]
        heads = np.flatnonzero(first)
        doc = words.doc[heads]
        count = np.diff(np.append(heads, n))
        place = (np.arange(n) - np.repeat(heads, count)).astype(np.uint64)
        hashes = words.hashes()
        one = np.add.reduceat(mix(hashes + mix(place + np.uint64(1))), heads)
        two = np.add.reduceat(mix((hashes ^ np.uint64(0x5851F42D4C957F2D)) + mix(place + np.uint64(1 << 32))), heads)
        begin = words.starts[heads]
        same = np.append(doc[1:] == doc[:-1], False)
        stop = np.where(same, np.append(begin[1:], 0), words.offsets[doc + 1])  # up to the next unit
        number = np.arange(len(heads)) - np.searchsorted(doc, doc, "left")
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                part.column("digest").take(pa.array(doc)),
                pa.array(number.astype(np.int32)),
                pa.array(words.code_points(begin, doc).astype(np.int32)),
                pa.array(words.code_points(stop, doc).astype(np.int32)),
                pa.array(count.astype(np.int32)),
                pa.array(mix(one + count.astype(np.uint64)).view(np.int64)),
                pa.array(mix(two).view(np.int64)),
            ],
            ["doc_id", "digest", "unit", "start", "stop", "words", "d1", "d2"],
        )


def repeated_units(docs: DataFrame) -> DataFrame:
    """Units that are not the first of their digest: doc_id, digest of the text, unit, start, stop, words."""
    units = docs.filter(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(_units, UNIT)
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank"), "digest", "unit")
    same = units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("first"))
    known = stored(same.filter("n > 1").select("d1", "d2", "first"), "repeated-digests")
    return units.join(known, ["d1", "d2"]).filter(rank != F.col("first")).select("doc_id", "digest", "unit", "start", "stop", "words")


def _cut(name: str, units: str, text: str, min_words: int):
    """Forms runs of neighbouring repeats, and takes those that are long enough out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, spans = [], [], []
            for whole, marked in zip(batch.column(text).to_pylist(), batch.column(units).to_pylist()):
                cuts: list[list[int]] = []
                taken = 0
                runs: list[list[int]] = []  # last unit, start, stop, words, units
                for u in sorted({(m["unit"], m["start"], m["stop"], m["words"]) for m in marked or []}):
                    if runs and runs[-1][0] + 1 == u[0]:
                        runs[-1] = [u[0], runs[-1][1], u[2], runs[-1][3] + u[3], runs[-1][4] + 1]
                    else:
                        runs.append([u[0], u[1], u[2], u[3], 1])
                for _, start, stop, words, n in runs:
                    if words >= min_words:
                        cuts.append([start, stop])
                        taken += n
                if cuts:
                    edges = [0, *[x for c in cuts for x in c], len(whole)]
                    whole = "".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(whole)
                removed.append(taken)
                spans.append(cuts)
            struct = pa.StructArray.from_arrays([pa.array(removed, pa.int32()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["n_removed", "spans"])
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != units}
            columns[text] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), struct], [*columns, name])

    return run


def dedup(docs: DataFrame, *, min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """`docs` with repeats taken out of `text`, a struct column (n_removed, spans), and that column's name."""
    name = free_name(docs, "repeats")
    key, units, who, other = (free_name(docs, n) for n in ("text_digest", "repeated_units", "unit_doc_id", "unit_text_digest"))
    marked = repeated_units(docs).groupBy(F.col("doc_id").alias(who), F.col("digest").alias(other)).agg(F.collect_list(F.struct("unit", "start", "stop", "words")).alias(units))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(marked, F.col("doc_id").eqNullSafe(F.col(who)) & (F.col(key) == F.col(other)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], units)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string("n_removed int, spans array<array<int>>"))])
    return joined.mapInArrow(_cut(name, units, "text", min_words), schema), name


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out, name = dedup(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform(F.col(f"{name}.spans"), lambda s: F.concat_ws(":", F.get(s, 0).cast("string"), F.get(s, 1).cast("string"))), ",")
    return out.select("doc_id", F.col(f"{name}.n_removed").cast("long").alias("n_removed"), spans.alias("removed"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("kept_chars"), "text")
