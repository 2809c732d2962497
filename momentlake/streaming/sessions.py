"""Sessions of a stream: keyed event-time timers (Structured Streaming, RocksDB state)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from momentlake.operators.sessions import SessionTimers

OUTPUT = "key string, start_s long, end_s long, n_records long"


class SessionProcessor(StatefulProcessor):
    """Keeps one key's open sessions; the timer of a session runs out when the watermark passes its end plus the gap.

    Events late by less than the watermark may fill or join sessions that are still open; later ones are dropped by Spark.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, end long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [(int(s), int(s), 1) for frame in rows for s in frame["second"]]
        spans = sorted([(int(a), int(b), int(n)) for a, b, n in self.open.get()] + events)
        timers, joined = SessionTimers(self.gap), []
        for a, b, n in spans:
            if (done := timers.event(key, a, b, n)) is not None:
                joined.append(done[1:])
        joined += [d[1:] for d in timers.expire()]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.open.put([tuple(j) for j in joined])
        for _, end, _ in joined:
            self.handle.registerTimer((end + self.gap) * 1000 + 1)
        yield pd.DataFrame({"key": [], "start_s": [], "end_s": [], "n_records": []}).astype({"key": "object", "start_s": "int64", "end_s": "int64", "n_records": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [(int(a), int(b), int(n)) for a, b, n in self.open.get()]
        out = [h for h in held if (h[1] + self.gap) * 1000 < now]
        rest = [h for h in held if h not in out]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        yield pd.DataFrame({"key": [key[0]] * len(out), "start_s": [h[0] for h in out], "end_s": [h[1] for h in out], "n_records": [h[2] for h in out]})

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, key: str, second: str, time: str, *, gap: int = 1800, late: str = "1 hour") -> DataFrame:
    """A stream of closed sessions from a stream of events; ``time`` is the event-time column, ``second`` its epoch seconds. Needs the RocksDB state store."""
    rows = events.where(f"{key} is not null and {second} is not null").select(events[key].alias("key"), events[second].alias("second"), events[time].alias("time")).withWatermark("time", late)
    return rows.groupBy("key").transformWithStateInPandas(SessionProcessor(gap), OUTPUT, "Append", "EventTime")
