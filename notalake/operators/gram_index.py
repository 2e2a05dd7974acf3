"""Posting lists of character grams, for many text searches over one table.

Rows are numbered inside segments of a few thousand. Every segment's grams of one to three characters, of
all searched fields, have posting lists of row numbers, kept as gaps; a list lies in a slot, sorted by gram.
A gram that more than one row in eight of a segment holds has no list there and leaves every row in the
running. A search looks up the rarest of its grams, meets the lists of those, and the text decides, so the
result is that of a scan for `contains` in any field, whatever the case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import spread

LONGEST = 3
SLOTS = 64
SPLIT = 8  # tasks that write a slot
RAREST = 2  # grams of a search whose lists are met
SEGMENT = 16_384  # rows of a segment at most; a row number is a short
COMMON = 8  # a gram in more than one of this many rows has no list
MET = 1_000_000  # rows that leave a task at once


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def _places(texts: list[list[str]], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (gram, row) pairs of the fields' texts, by gram and row: grams as texts, where each starts, and the rows."""
    codes = [np.frombuffer("".join(field).encode("utf-32-le", "surrogatepass"), np.uint32) for field in texts]
    alphabet = np.unique(np.concatenate([np.unique(c) for c in codes]))
    base = len(alphabet) + 1  # 0 is no character
    found = []
    for field, code in zip(texts, codes, strict=True):
        row = np.repeat(np.arange(rows), np.fromiter(map(len, field), np.int64, rows))
        gram = np.searchsorted(alphabet, code).astype(np.int64) + 1
        letter = gram
        for size in range(1, LONGEST + 1):
            if size > 1:
                whole = row[: -(size - 1)] == row[size - 1 :]
                gram = gram[: len(whole)] * base + letter[size - 1 :]
                found.append((gram[whole], row[: -(size - 1)][whole]))
            else:
                found.append((gram, row))
    grams, where = (np.concatenate(parts) for parts in zip(*found, strict=True))
    names = None
    if base**LONGEST * rows >= 1 << 63:
        names, grams = np.unique(grams, return_inverse=True)
    pairs = np.sort(grams * rows + where)  # far quicker than np.unique, which hashes
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    ids, where = np.divmod(pairs, rows)
    starts = np.flatnonzero(np.diff(ids, prepend=-1))
    left = ids[starts] if names is None else names[ids[starts]]
    letters = np.array(["", *map(chr, alphabet.tolist())], object)
    text = np.full(len(left), "", object)
    for _ in range(LONGEST):
        text = letters[left % base] + text
        left = left // base
    return text, starts, where


def _segment(batch: pa.RecordBatch, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The segment's keys in one row without a gram, and a row for each gram."""
    rows = batch.num_rows
    held = lambda *columns: pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    same = lambda value, n: pa.array(np.full(n, value, np.int64))
    yield held(pa.nulls(1), same(number, 1), same(rows, 1), same(rows, 1), pa.nulls(1), pa.ListArray.from_arrays([0, rows], batch.column(0)))
    texts = [column.to_pylist() for column in batch.columns[1:]]
    if not any(map(any, texts)):
        return
    text, starts, where = _places(texts, rows)
    sizes = np.diff(starts, append=len(where))
    gaps = np.diff(where, prepend=0)
    gaps[starts] = where[starts]
    listed = sizes * COMMON <= rows
    kept = pa.array(gaps[np.repeat(listed, sizes)].astype(np.int16))
    ends = np.concatenate([[0], np.cumsum(np.where(listed, sizes, 0))])
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), kept, mask=pa.array(~listed))
    yield held(pa.array(text, pa.string()), same(number, len(text)), same(rows, len(text)), pa.array(sizes), lists, pa.nulls(len(text)))


def build(docs: DataFrame, key: str, fields: list[str], path: str) -> None:
    """`path`/postings (slot, gram, segment, rows, n, gaps, keys) and `path`/counts (gram, n_rows).

    Fields that are null have no grams. Slot -1 holds the keys of each segment's rows, in their order.
    """
    texts = spread(docs).select(F.col(key).alias("key"), *[F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)])
    plain = T.StructType().add("gram", "string").add("segment", "long").add("rows", "integer").add("n", "integer")
    plain = plain.add("gaps", T.ArrayType(T.ShortType())).add("keys", T.ArrayType(texts.schema["key"].dataType))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            item = batch.schema.field(0).type
            schema = pa.schema(
                [("gram", pa.string()), ("segment", pa.int64()), ("rows", pa.int32()), ("n", pa.int32()), ("gaps", pa.list_(pa.int16())), ("keys", pa.list_(item))]
            )
            for at in range(0, batch.num_rows, SEGMENT):
                yield from _segment(batch.slice(at, SEGMENT), number, schema)
                number += 1

    rows = texts.mapInArrow(segments, plain).withColumn("slot", F.when(F.col("gram").isNull(), F.lit(-1)).otherwise(_slot(F.col("gram"))))
    dealt = rows.repartition(SLOTS * SPLIT, "slot", F.pmod(F.xxhash64("segment"), F.lit(SPLIT))).sortWithinPartitions("slot", "gram", "segment")
    dealt.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/postings")
    spark = docs.sparkSession
    lists = spark.read.parquet(f"{path}/postings").filter("slot >= 0")
    lists.groupBy("gram").agg(F.sum("n").alias("n_rows")).write.mode("overwrite").parquet(f"{path}/counts")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """needle, segment, at: the rows that all lists of a needle hold; without a list, every row of the segment."""
    for batch in batches:
        needles, numbers, ats, size = [], [], [], 0
        columns = [batch.column(n) for n in ("needle", "segment", "rows", "lists")]
        for i in range(batch.num_rows):
            needle, number, rows, lists = (c[i] for c in columns)
            sets = [np.cumsum(one.values.to_numpy(zero_copy_only=False), dtype=np.int64) for one in lists]
            at = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sets) if sets else np.arange(rows.as_py())
            needles.append(pa.repeat(needle, len(at)))
            numbers.append(pa.repeat(number, len(at)))
            ats.append(pa.array(at.astype(np.int32)))
            size += len(at)
            if size >= MET or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in (needles, numbers, ats)], names=["needle", "segment", "at"])
                needles, numbers, ats, size = [], [], [], 0


def search(spark: SparkSession, path: str, docs: DataFrame, key: str, fields: list[str], searches: DataFrame) -> DataFrame:
    """search_id, key of every row any of whose fields contains the search's text, for a table (search_id, query).

    A search that is null or empty finds nothing. One job answers all searches; those with one text are looked up once.
    """
    asked = searches.filter(F.length("query") > 0).select("search_id", F.lower("query").alias("needle"))
    size = F.least(F.char_length("needle"), F.lit(LONGEST))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("needle") - size + 1), lambda i: F.substr("needle", i, size)))
    grams = asked.select("needle").distinct().select("needle", F.explode(own).alias("gram"))
    counted = grams.join(spark.read.parquet(f"{path}/counts"), "gram", "left").fillna(0, ["n_rows"])
    order = Window.partitionBy("needle").orderBy("n_rows", "gram")
    rare = counted.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= RAREST)
    rare = rare.select("needle", "gram", F.count("*").over(Window.partitionBy("needle")).alias("wanted"), _slot(F.col("gram")).alias("slot"))
    postings = spark.read.parquet(f"{path}/postings")
    each = postings.select("slot", "gram", "segment", "rows", "gaps").join(rare, ["slot", "gram"]).groupBy("needle", "segment")
    lists = each.agg(F.first("rows").alias("rows"), F.collect_list("gaps").alias("lists"), (F.count("*") == F.first("wanted")).alias("whole"))
    met = lists.filter("whole").select("needle", "segment", "rows", "lists").mapInArrow(_met, "needle string, segment bigint, at int")
    keys = postings.filter("slot = -1").select("segment", F.posexplode("keys").alias("at", "key"))
    likely = met.join(keys, ["segment", "at"]).select("needle", F.col("key").alias("k")).distinct()
    texts = docs.select(F.col(key).alias("key"), *[F.lower(F.col(f).cast("string")).alias(f"f{i}") for i, f in enumerate(fields)])
    tested = texts.join(likely, F.col("key").eqNullSafe(F.col("k")))
    holds = reduce(or_, [F.coalesce(F.contains(F.col(f"f{i}"), F.col("needle")), F.lit(False)) for i in range(len(fields))])
    return tested.filter(holds).select("needle", "key").join(asked, "needle").select("search_id", F.col("key").alias(key))
