"""A keyed table in buckets, for upserts that rewrite only what they touch and reads without a window.

`path`/data/<batch>/bucket=<b> holds the whole bucket as of a batch, one row a key; `path`/manifest/<batch>
says which buckets the batch wrote. A batch writes its folders, then its manifest, which is what makes
them visible: a run that fails before leaves the table as it was, and a batch that runs again overwrites
its own folders and manifest and nothing else. Readers of an older state keep their folders.

The number of buckets is fixed when the table is made and bounds everything that reaches the driver.
A bucket may be larger than a task can hold.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relate import latest

TASK_ROWS = 100_000  # of a task that finds the newest rows, about
WAVE_ROWS = 15_000_000  # that are shuffled at a time, about; a bucket at least. Every wave reads all changes
MANIFEST = "batch bigint, bucket int, buckets int, keys array<string>, layout string"


def create(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64) -> None:
    """An empty table; nothing happens where there is one already."""
    first = spark.createDataFrame([(-1, None, buckets, keys, schema.json())], MANIFEST)
    first.coalesce(1).write.mode("ignore").parquet(f"{path}/manifest/created")


def _state(spark: SparkSession, path: str, before: int | None = None) -> tuple[dict[int, int], int, list[str], T.StructType]:
    """Newest batch of each bucket, number of buckets, keys, schema. At most one row a bucket reaches the driver."""
    entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/*")
    made = entries.filter("batch = -1").first()
    known = entries.filter("batch >= 0") if before is None else entries.filter((F.col("batch") >= 0) & (F.col("batch") < before))
    newest = {r["bucket"]: r["batch"] for r in known.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}
    return newest, made["buckets"], made["keys"], T.StructType.fromJson(json.loads(made["layout"]))


def _read(spark: SparkSession, path: str, where: dict[int, int], schema: T.StructType) -> DataFrame:
    if not where:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{batch}/bucket={bucket}" for bucket, batch in sorted(where.items())])


def _waves(rows: dict[int, int]) -> list[list[int]]:
    """Buckets in order, as many together as have WAVE_ROWS rows, or one that has more."""
    waves: list[list[int]] = []
    held = 0
    for b in sorted(rows):
        if not waves or held + rows[b] > WAVE_ROWS:
            waves, held = [*waves, []], 0
        waves[-1].append(b)
        held += rows[b]
    return waves


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted when it has been written, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def upsert(changes: DataFrame, path: str, order: list[Column], batch: int) -> list[int]:
    """Of the rows of a key, in the table or new, the first under `order` stays. Returns the buckets written.

    Buckets are written in waves, so the rows that are shuffled at a time are bounded, and a row is shuffled and
    sorted once. `changes` is read for the counts, its keys only, and for every wave; store it where it is costly.
    Rows with a null key make a key of their own.
    """
    spark = changes.sparkSession
    newest, buckets, keys, schema = _state(spark, path, before=batch)
    place = lambda n: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    counted = lambda df: {r["b"]: r["count"] for r in df.groupBy(place(buckets).alias("b")).count().collect()}
    arriving = counted(changes)
    touched = sorted(arriving)
    kept = {b: newest[b] for b in touched if b in newest}
    there = counted(_read(spark, path, kept, schema))
    rows = {b: arriving[b] + there.get(b, 0) for b in touched}
    # A small bucket is one slice and one file, a large one several: no task writes more than a part of it.
    ways = max(rows.values(), default=0) // TASK_ROWS + 1
    for n, wave in enumerate(_waves(rows)):
        old = _read(spark, path, {b: kept[b] for b in wave if b in kept}, schema)
        both = old.unionByName(changes.filter(place(buckets).isin(wave)).select(*schema.fieldNames()))
        both = both.withColumns({"bucket": place(buckets), "_slice": place(buckets * ways)})
        tasks = ways * len(wave)
        both = both.repartition(tasks, "_slice") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else both.repartition("_slice")
        # the window's order is the writer's as well
        merged = latest(both, ["bucket", "_slice", *keys], *order).drop("_slice")
        with _shuffles_dropped(spark):
            merged.write.mode("append" if n else "overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/data/{batch}")
    entries = spark.createDataFrame([(batch, b, buckets, keys, None) for b in touched], MANIFEST)
    entries.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{batch}")
    return touched


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last batch: its buckets' newest folders, one row a key."""
    newest, _, _, schema = _state(spark, path)
    return _read(spark, path, newest, schema)
