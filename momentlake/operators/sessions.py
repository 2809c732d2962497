"""Grouping activity into sessions: keyed timers over ordered events.

``SessionTimers`` is the state machine, used by the batch operator here and by the stream in
``momentlake.streaming.sessions``: an event opens a key's session or, if it comes before the key's timer runs out,
extends it and resets the timer; a timer that runs out emits start, end and count.

In batch, events are spread by key and time slice, so that a user who writes a third of all records is spread as
well, and sorted inside the partition by Spark. A session that cannot touch a neighbouring slice is final. The others
(at most two per key and slice) go through the timers once more, per key.

Defined results: events with a null key or a null time take no part; a single event is a session; equal times
belong together; an event exactly ``gap`` seconds later still extends; repeated rows must be removed before, if
they are to count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SessionTimers:
    """Open sessions by key. Events of a key must come in order of time."""

    def __init__(self, gap: int):
        self.gap = gap
        self.open: dict = {}

    def event(self, key, start: int, end: int, count: int):
        """An event (or a part of a session). Gives the key's former session if its timer had run out before."""
        held = self.open.get(key)
        if held is not None and start - held[1] <= self.gap:
            held[1] = max(held[1], end)
            held[2] += count
            return None
        self.open[key] = [start, end, count]
        return None if held is None else (key, *held)

    def expire(self, now: int | None = None) -> list[tuple]:
        """The sessions whose timers ran out before ``now`` (None: all), no longer open."""
        out = [(k, *v) for k, v in self.open.items() if now is None or v[1] + self.gap < now]
        for k, *_ in out:
            del self.open[k]
        return out


def _timed(batches, gap: int, names: list[str], kind: pa.DataType):
    """Rows (key, start, end, count), sorted by key and start, through the timers; whole stretches of a batch at a time."""
    timers, last = SessionTimers(gap), None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind if i == 0 else pa.int64()) for i in range(4)], names)

    for b in batches:
        keys = b.column(0)
        if not b.num_rows:
            continue
        code = keys.dictionary_encode()
        code, words = code.indices.to_numpy(), code.dictionary.to_pylist()
        start, end, count = (b.column(i).to_numpy() for i in (1, 2, 3))
        # within the batch the timer of a row is reset by the next one if that is in time: stretches of such rows are one event
        new = np.ones(b.num_rows, bool)
        new[1:] = (code[1:] != code[:-1]) | (start[1:] - end[:-1] > gap)
        first = np.nonzero(new)[0]
        stops, sums = np.maximum.reduceat(end, first), np.add.reduceat(count, first)
        done = []
        for i, s, e, c in zip(code[first].tolist(), start[first].tolist(), stops.tolist(), sums.tolist()):
            key = words[i]
            if last is not None and key != last:
                done += timers.expire()
            last = key
            if (closed := timers.event(key, s, e, c)) is not None:
                done.append(closed)
        if done:
            yield out(done)
    if rest := timers.expire():
        yield out(rest)


def sessions(df: DataFrame, key: str, second: str, gap: int = 1800, *, slice_seconds: int = 86_400) -> DataFrame:
    """``(key, start_s, end_s, n_records)`` of every longest run of a key's events that are at most ``gap`` seconds apart."""
    slice_seconds = max(slice_seconds, 2 * gap + 2)
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[dict(df.dtypes)[key]]
    schema = f"`{key}` {dict(df.dtypes)[key]}, start_s long, end_s long, n_records long"
    names = [key, "start_s", "end_s", "n_records"]
    events = df.where(F.col(key).isNotNull() & F.col(second).isNotNull()).select(key, F.col(second).cast("long").alias("start_s"))
    sliced = events.withColumn("slice", F.floor(F.col("start_s") / slice_seconds)).repartition(F.col(key), F.col("slice"))
    ordered = sliced.sortWithinPartitions(key, "start_s").select(key, "start_s", F.col("start_s").alias("end_s"), F.lit(1).cast("long").alias("n_records"))
    # a partition may hold several slices of a key: what is joined there needs no second pass
    parts = ordered.mapInArrow(lambda b: _timed(b, gap, names, kind), schema)
    low = F.pmod(F.col("start_s"), F.lit(slice_seconds)) <= gap
    high = F.pmod(F.col("end_s"), F.lit(slice_seconds)) >= slice_seconds - gap
    marked = parts.withColumn("edge", low | high)
    # both outcomes come from one pass: edge parts are gathered by key, the others stay where they are spread
    joined = marked.where("edge").drop("edge").repartition(F.col(key)).sortWithinPartitions(key, "start_s").mapInArrow(lambda b: _timed(b, gap, names, kind), schema)
    return marked.where("not edge").drop("edge").unionByName(joined)
