"""The rate limiter on a stream: windows from each key's first event, in event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "user_id long, event_id long, start_us long, allowed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Events wait in the key's state until the watermark has passed them; then a timer lets them through in the order of time."""

    def __init__(self, limit: int, width_us: int):
        self.limit, self.width = limit, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start_us long, used long")
        self.waiting = handle.getListState("waiting", "us long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendList([(int(us), int(i)) for us, i in zip(part["us"], part["event_id"], strict=True)])
            first = min(int(part["us"].min()), first if first is not None else 1 << 62)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((us, i) for us, i in self.waiting.get())
        rest = [e for e in events if e[0] >= passed]
        start, used = self.window.get() or (None, 0)
        out = []
        for us, i in events[: len(events) - len(rest)]:
            if start is None or us >= start + self.width:
                start, used = us, 0
            out.append((key[0], i, start, used < self.limit))
            used += 1
        if out:
            self.window.update((start, used))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "start_us", "allowed"])

    def close(self) -> None:
        pass


def limited(events: DataFrame, limit: int, hours: int, late: str = "1 hour") -> DataFrame:
    """On a stream of events (user_id, event_id, ts), what `requests.rate_limited` says: user_id, event_id, window_start, allowed.

    Events may come out of order by up to `late`; an event's answer comes when the watermark has passed it, so those of the
    last hour wait for later events. Events without user or time are left out, later ones dropped. State is in the
    checkpoint: after a restart it goes on where it was. The session needs `spark.sql.streaming.stateStore.providerClass` to be STORE.
    """
    own = events.filter("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    found = own.groupBy("user_id").transformWithStateInPandas(Limiter(limit, hours * 3_600_000_000), OUT, "append", "eventTime")
    return found.select("user_id", "event_id", F.timestamp_micros("start_us").alias("window_start"), "allowed")
