"""Expiring de-duplication in the order of event time: a stateful processor with timers.

An event waits until the watermark says that nothing older can come, then the events of a key are
taken in their order, so neither files nor micro-batches nor late arrivals within the lateness change
what passes. State holds times and ids only and lies in RocksDB; a key's state goes when its last
entry has expired. What comes behind the watermark, which is later than the lateness, makes no entry:
what was behind the batch before already is dropped by Spark and counted (`dropped_late`), the rest is
given as late.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstInOrder(StatefulProcessor):
    """Per key: `waiting` (time, id) of events the watermark has not passed, `last` the time of the newest entry."""

    def __init__(self, key: str, life: int):
        self.key, self.life = key, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.last = handle.getValueState("last", "at long")

    def _wake(self, at: int) -> None:
        """When the watermark is past this microsecond."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed_by = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for frame in rows:
            at = frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            late, event = at <= passed_by, frame["event_id"].to_numpy()
            yield self._frame(key, list(zip(at[late].tolist(), event[late].tolist())), late=True)
            if not late.all():
                self.waiting.appendList(list(zip(at[~late].tolist(), event[~late].tolist())))
                first = min(int(at[~late].min()), first or (1 << 62))
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((int(r[0]), int(r[1])) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in waiting if e[0] // 1000 + 1 < watermark]
        rest = waiting[len(due) :]
        last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for at, event in due:
            if last is None or at - last >= self.life:
                last = at
                passed.append((at, event))
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        elif waiting:
            self.waiting.clear()
        if last is not None and not rest and (last + self.life) // 1000 < watermark:
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            if not rest:
                self._wake(last + self.life)
        yield self._frame(key, passed)

    def _frame(self, key, events: list[tuple[int, int]], late: bool = False) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(events), "event_id": [e for _, e in events], "at": [at for at, _ in events], "late": [late] * len(events)})


def first_in_order(events: DataFrame, key: str, time_to_live: datetime.timedelta, lateness: datetime.timedelta) -> DataFrame:
    """key, event_id, ts, late: the events that find no living entry of their key, in event time, and those that came late.

    Only key, id and time enter the state; other columns are joined back by event_id where they are
    wanted. A key's waiting events are those of the lateness, whatever the size of a batch.
    """
    life = round(time_to_live.total_seconds() * 1_000_000)
    kind = dict(events.dtypes)[key]
    narrow = events.withWatermark("ts", f"{round(lateness.total_seconds() * 1000)} milliseconds").select(key, "event_id", "ts")
    found = narrow.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).groupBy(key).transformWithStateInPandas(
        FirstInOrder(key, life), f"`{key}` {kind}, event_id bigint, at bigint, late boolean", "append", "eventTime"
    )
    return found.select(key, "event_id", F.timestamp_micros("at").alias("ts"), "late")


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs until the source is exhausted, with state in RocksDB; the session's own provider is put back."""
    conf = df.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)
    return query



def dropped_late(query: StreamingQuery) -> int:
    """Rows of this run that Spark dropped since they came behind the watermark of an earlier batch."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
