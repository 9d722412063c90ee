"""Events of many drives, each drive's handled in order of event time: the base of the streaming operators.

A drive's events wait in state until the watermark has passed their time, so shuffled and late arrivals come out in order, in whatever triggers they came;
an event-time timer hands them on when no further event arrives. What Spark's watermark calls late is dropped, also what is from before 1970. A drive that is idle for ``idle_ms`` of event time is finished,
and its state goes. Timers follow event time, so a catch-up run (``availableNow``) ends, and a replay of old events expires what it did live.

The key of the state is a hash bucket of drives, not a drive: calls of a state cost the same for one drive and for thousands, and what the drives of a bucket have ready is worked on in arrays.
A task holds one bucket at a time, so tables with very many drives take more ``buckets``; a stream keeps the number it began with.

With ``late`` None nothing waits: a trigger's events are put in order within themselves and handled at once, and state stays.

Needs Spark's RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE, IDLE_MS = "5 seconds", 3_600_000
BUCKETS = 256

_HELD = ("ids", "t", "kind", "rn")


class Drives:
    """Events of some drives in order of (drive, time, kind, row number): ``ids`` of the drives, where each one's begin, and the state that each has had (None: none)."""

    def __init__(self, drive: np.ndarray, t: np.ndarray, kind: np.ndarray, rn: np.ndarray, v: np.ndarray, states: dict[int, np.ndarray]):
        self.drive, self.t, self.kind, self.rn, self.v = drive, t, kind, rn, v
        self.start = np.flatnonzero(np.concatenate([[True], drive[1:] != drive[:-1]])) if len(drive) else np.zeros(0, np.int64)
        self.ids = drive[self.start].tolist()
        self.states = [states.get(d) for d in self.ids]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """``x`` by drive."""
        return np.split(x, self.start[1:]) if len(self.start) else []


class InOrder(StatefulProcessor):
    """Subclasses give ``take`` and perhaps ``finish``; a drive's state is an array of doubles, none at first."""

    def __init__(self, idle_ms: int = IDLE_MS, waits: bool = True):
        self.idle_ms, self.waits = idle_ms, waits

    def take(self, d: Drives) -> tuple[list[np.ndarray], pd.DataFrame | None]:
        """The states of the drives after their events (microseconds, kind, row number, a row of values each), and the rows they bring."""
        raise NotImplementedError

    def finish(self, ids: list[int], states: list[np.ndarray]) -> pd.DataFrame | None:
        """What is still to come from drives that end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._timer = handle.getValueState("timer", "due long")
        self._drives = handle.getValueState("drives", "ids binary, last binary, sizes binary, nums binary")
        self._held = handle.getListState("held", ", ".join(f"{c} binary" for c in (*_HELD, "v")))  # an element for each arrival or rest

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [p for p in rows if len(p)]
        cols = [np.concatenate([p[c].to_numpy(np.int64) for p in new]) for c in ("drive_id", "t", "kind", "rn")] if new else []
        if new:
            cols.append(np.concatenate([np.stack(p["v"].to_numpy()).astype(float) for p in new]))
        if self.waits:
            if new:
                self._held.appendValue(tuple(c.tobytes() for c in cols))
            yield from self._on(timerValues.getCurrentWatermarkInMs())
        elif new:
            last, states = self._known()
            out = self._taken(cols, last, states)
            self._keep(last, states)
            if out is not None and len(out):
                yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        if self._timer.exists() and self._timer.get()[0] <= watermark_ms:  # later ones were set by events of this trigger
            yield from self._on(watermark_ms)

    def close(self) -> None:
        pass

    def _known(self) -> tuple[dict[int, int], dict[int, np.ndarray]]:
        """Of each drive with a state the time of its last event in milliseconds, and the state."""
        if not self._drives.exists():
            return {}, {}
        ids, last, sizes, nums = (np.frombuffer(x, float if k == 3 else np.int64) for k, x in enumerate(self._drives.get()))
        return dict(zip(ids.tolist(), last.tolist(), strict=True)), dict(zip(ids.tolist(), np.split(nums, np.cumsum(sizes)[:-1]), strict=True))

    def _keep(self, last: dict[int, int], states: dict[int, np.ndarray]) -> None:
        if not states:
            self._drives.clear()
            return
        nums = [np.asarray(states[d], float) for d in states]
        self._drives.update(tuple(x.tobytes() for x in (np.array(list(states), np.int64), np.array([last[d] for d in states], np.int64), np.array([len(n) for n in nums], np.int64), np.concatenate(nums))))

    def _taken(self, cols: list[np.ndarray], last: dict[int, int], states: dict[int, np.ndarray]) -> pd.DataFrame | None:
        """Takes events in any order; ``last`` and ``states`` have what is known after them."""
        at = np.lexsort(cols[3::-1])
        d = Drives(*(c[at] for c in cols), states)
        new, out = self.take(d)
        states.update(zip(d.ids, new, strict=True))
        last.update(zip(d.ids, (t[-1] // 1000 for t in d.parts(d.t)), strict=True))
        return out

    def _on(self, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Hands on what the watermark has passed, ends drives that are idle, and sets the timer for what is next."""
        last, states = self._known()
        held = list(self._held.get()) if self._held.exists() else []
        cols = [np.concatenate([np.frombuffer(h[k], np.int64) for h in held]) if held else np.zeros(0, np.int64) for k in range(4)]
        v = np.concatenate([np.frombuffer(h[4]) for h in held]).reshape(len(cols[0]), -1) if len(cols[0]) else np.zeros((0, 0))
        ready = cols[1] <= watermark_ms * 1000
        if ready.any():
            out = self._taken([c[ready] for c in (*cols, v)], last, states)
            cols, v = [c[~ready] for c in cols], v[~ready]
            if len(v):
                self._held.put([tuple(c.tobytes() for c in (*cols, v))])
            else:
                self._held.clear()
            if out is not None and len(out):
                yield out
        waiting = set(cols[0].tolist())
        over = [d for d in states if d not in waiting and last[d] + self.idle_ms <= watermark_ms]
        if over:
            out = self.finish(over, [states.pop(d) for d in over])
            if out is not None and len(out):
                yield out
        if ready.any() or over:
            self._keep(last, states)
        timer = self._timer.get()[0] if self._timer.exists() else 0
        due = min([*([-(-int(cols[1].min()) // 1000)] if len(v) else []), *(last[d] + self.idle_ms for d in states if d not in waiting)], default=None)
        if due is not None:
            due = max(due, watermark_ms + 1)
        if due != timer:
            if timer > watermark_ms:
                self._handle.deleteTimer(timer)
            if due is not None:
                self._handle.registerTimer(due)
                self._timer.update((due,))
            else:
                self._timer.clear()


def events(df: DataFrame, kind: int | Column, values: list[str], time: str = "event_time") -> DataFrame:
    """(drive_id, event_time, t, kind, rn, v) of the rows of ``df`` (drive_id, a timestamp, rn, ``values``); null values are NaN."""
    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in values])
    rn = F.col("rn").cast("long") if "rn" in df.columns else F.lit(0).cast("long")
    return df.select("drive_id", F.col(time).alias("event_time"), F.unix_micros(time).alias("t"), (F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"), rn.alias("rn"), v.alias("v"))


def in_order(rows: DataFrame, processor: InOrder, schema: str, late: str | None, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` of ``events`` through the processor, as a stream."""
    processor.waits = late is not None
    rows = rows.withWatermark("event_time", late) if late is not None else rows
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("drive_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if late is not None else "None")


def seconds_as_time(c: str) -> Column:
    """A timestamp of a column of seconds."""
    return F.timestamp_micros(F.round(F.col(c) * 1_000_000).cast("long"))
