"""Continuous ingest, history counts and expiring de-duplication.

Every job takes its checkpoint and output location from the caller, reads with `availableNow` by
default (a scheduled run that catches up and stops) and can be restarted after any failure.
"""

from __future__ import annotations

import bisect
import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import bucket_store, extract_xml

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """History events as they land in a folder; event time as an instant."""
    raw = (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    return raw.withColumn("ts", instant(F.col("ts")))


def instant(wall: Column) -> Column:
    """Event time must be an instant: wall-clock time counts as UTC, whatever the session zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), wall))


def wall_clock(instant: Column) -> Column:
    """Back from the instant to wall-clock time."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def history_counts(events: DataFrame, window: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Tumbling counts per event type; a repeated event id within the lateness counts once."""
    unique = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    counts = unique.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total_value"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n_events", "total_value")


def first_within(events: DataFrame, key: str, time_to_live: datetime.timedelta, lateness: datetime.timedelta | None = None) -> DataFrame:
    """A cache as a stream: an event passes if its key has no entry whose life it meets, and makes a new one.

    Events of a batch are taken in the order of time, so for events that arrive in that order the
    batches' sizes do not matter. An event that comes behind newer ones of earlier batches passes if
    it is a whole life away from every entry of its key, before or after; what has passed already
    stays, so no two events of a key that pass are closer than a life. Spark drops an event that comes
    more than `lateness` behind the newest of earlier batches; that is never less than the life, which
    is its default, and a backlog in no order needs the span of its events.

    The state of a key are the times of its entries that an event within the lateness can still meet;
    it goes once the watermark is past the last entry's life.
    """
    lateness = time_to_live if lateness is None else lateness
    if lateness < time_to_live:
        raise ValueError("lateness must not be less than time_to_live")
    life = round(time_to_live.total_seconds() * 1_000_000)
    order = [c for c in ("ts", "event_id") if c in events.columns]

    def passing(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        entries = list(state.get[0]) if state.exists else []
        kept = []
        for at in rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist():
            place = bisect.bisect_right(entries, at)
            kept.append((place == 0 or at - entries[place - 1] >= life) and (place == len(entries) or entries[place] - at >= life))
            if kept[-1]:
                entries.insert(place, at)
        passed = state.getCurrentWatermarkMs()
        entries = [e for e in entries if e + life > passed * 1000] or entries[-1:]
        state.update((entries,))
        state.setTimeoutTimestamp(max((entries[-1] + life) // 1000, passed + 1))
        yield rows[kept]

    marked = events.withWatermark("ts", f"{round(lateness.total_seconds() * 1000)} milliseconds")
    return marked.groupBy(key).applyInPandasWithState(passing, events.schema, "entries array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends results to parquet; the file sink is exactly-once with its checkpoint."""
    query = (
        df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def xml_stream(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """One row per new XML file."""
    files = (
        spark.readStream.option("pathGlobFilter", "*.[xX][mM][lL]")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder, wholetext=True)
    )
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("xml"))


def ingest_xml(files: DataFrame, table: str, rejected: str, checkpoint: str, links: str, buckets: int = 64) -> StreamingQuery:
    """XML job per micro-batch: documents, what manifests carry (`links`), and rejects, out of one parse.

    Documents go to a bucketed table, newest version of a file last. Of the others a batch owns one folder
    and overwrites it. A replayed batch adds nothing twice; a new checkpoint needs new tables. What a batch was
    parsed to is kept beside the table until the next one: a parse tree takes many times the disk of its columns.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{table}/parsed"
        outcomes = extract_xml.outcomes_of(extract_xml.parsed(batch), "file_name")
        outcomes.write.mode("overwrite").option("compression", "zstd").parquet(path)
        parsed = spark.read.schema(outcomes.schema).parquet(path)
        docs = parsed.filter("error IS NULL").drop("error", "raw_text")
        rows = docs.drop("_unloading").withColumn("batch", F.lit(batch_id).cast("bigint"))
        bucket_store.create(spark, table, rows.schema, ["file_name"], buckets)
        bucket_store.upsert(rows, table, [F.desc("batch")], batch_id)
        extract_xml.linked_documents(docs, "file_name").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{links}/batch_id={batch_id}")
        parsed.filter("error IS NOT NULL").select("file_name", "error", "raw_text").write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")

    query = files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current_documents(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of every file ever ingested, as its bucket holds it."""
    return bucket_store.current(spark, table)
