"""Row-count operators as streams: the fusion filter with its centred variance, and sliding windows with all features.

A drive's state is what later rows need of earlier ones: the filter's states and covariances with the rows around the one that is next, or the last rows of a window.
Rows that wait for later ones come with these, or when the drive ends (``in_order``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolith.operators import ekf, features
from odolith.operators.context import STANDSTILL, TUNNEL, context_of
from odolith.operators.signals import SIGNALS, signals_of
from odolith.sources.drives import SENSORS
from odolith.streaming.in_order import IDLE_MS, LATE, Drives, InOrder, events, in_order

_AHEAD, _BACK = 4, 5
_FILTERED = ["timestamp", "acc_x", "acc_y", "gyro_z", "ambient_lux", "ai_speed", "ai_speed_std", "pos_x", "pos_y", "speed", "heading", "in_outage", "aggressive"]
FUSED = [*ekf.STATE, "open_loop_pos_x", "open_loop_pos_y", "fused_pos_error_m", "open_loop_error_m"]


class _Rows:
    """Rows kept in a drive's state: what else there is comes first, then time, row number and values of each row."""

    def __init__(self, width: int, fixed: int):
        self.width, self.fixed = width + 2, fixed

    def unpacked(self, states: list[np.ndarray | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """A row of the rest for each drive, and the kept rows."""
        own = np.array([np.zeros(self.fixed) if s is None else s[: self.fixed] for s in states]).reshape(-1, self.fixed)
        return own, [np.zeros((0, self.width)) if s is None else s[self.fixed :].reshape(-1, self.width) for s in states]

    def with_new(self, d: Drives) -> tuple[np.ndarray, list[np.ndarray]]:
        """``unpacked``, with the new rows behind the kept ones."""
        own, kept = self.unpacked(d.states)
        # a double holds 15 digits of the microseconds exactly, and row numbers too
        return own, [np.concatenate(x) if len(x[0]) else x[1] for x in zip(kept, d.parts(np.column_stack([d.t, d.rn, d.v])), strict=True)]

    @staticmethod
    def packed(own: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
        return [np.concatenate([o, r.ravel()]) for o, r in zip(own, rows, strict=True)]


class _Filter(InOrder):
    """State: how many rows are kept before the next one to filter, whether it has begun, whether the drive is aggressive, x, P; then the kept rows and those that wait."""

    def __init__(self, scale: float, first_dt: float | None, idle_ms: int):
        super().__init__(idle_ms)
        self.scale, self.first_dt = scale, first_dt
        self.rows = _Rows(len(_FILTERED), 3 + 6 + 36)

    def take(self, d):
        return self._run(np.array(d.ids), *self.rows.with_new(d), _AHEAD)

    def finish(self, ids, states):
        return self._run(np.array(ids), *self.rows.unpacked(states), 0)[1]

    def _run(self, ids, own, rows, ahead):
        """All drives that have a row to filter are run in step."""
        size, done, begun = np.array([len(r) for r in rows]), own[:, 0].astype(np.int64), own[:, 1] > 0
        until = size - ahead
        due = np.flatnonzero((until > done) & (begun | (size >= 2) | (ahead == 0) | (self.first_dt is not None)))
        if not len(due):
            return self.rows.packed(own, rows), None
        every, size, done, begun, until = np.concatenate([rows[k] for k in due]), size[due], done[due], begun[due], until[due]
        start = np.cumsum(size) - size
        drive, local = np.repeat(np.arange(len(due)), size), np.arange(len(every)) - np.repeat(start, size)
        at = np.flatnonzero((local >= done[drive]) & (local < until[drive]))
        c = {n: every[:, 2 + k] for k, n in enumerate(_FILTERED)}
        var, wide = np.zeros(len(at)), np.full(len(every) + len(due) * (_BACK + _AHEAD), np.nan)
        place = np.arange(len(every)) + drive * (_BACK + _AHEAD) + _BACK  # each drive with room on both sides
        for axis in ("acc_x", "acc_y"):
            wide[place] = c[axis]
            var += np.nanvar(np.lib.stride_tricks.sliding_window_view(wide, _BACK + _AHEAD + 1)[place[at] - _BACK], axis=1)
        mode = context_of(c["ambient_lux"][at], np.fmin(c["ai_speed"], c["speed"])[at], var * self.scale, np.abs(c["gyro_z"][at]))
        dt = np.diff(c["timestamp"], prepend=np.nan)
        new = start[~begun]
        own[due[~begun], 2] = c["aggressive"][new] > 0
        dt[new] = self.first_dt if self.first_dt is not None else np.where(size[~begun] > 1, dt[np.minimum(new + 1, len(dt) - 1)], 0.1)
        pdf = pd.DataFrame({n: c[n][at] for n in ("ai_speed", "ai_speed_std", "gyro_z", "pos_x", "pos_y", "speed", "heading")})
        pdf = pdf.assign(drive_id=drive[at], rn=every[at, 1].astype(np.int64), dt=dt[at], still=mode == STANDSTILL, tunnel=mode == TUNNEL, in_outage=c["in_outage"][at] > 0, aggressive=own[due, 2][drive[at]] > 0)
        carried = {k: (own[due[k], 3:9], own[due[k], 9:45].reshape(6, 6)) for k in np.flatnonzero(begun).tolist()}
        got, ends = ekf.run_filter(pdf, ekf.FilterParams(), carried)
        out = got.assign(drive_id=ids[due][drive[at]], context_mode=mode, fused_pos_error_m=np.hypot(got["fused_pos_x"] - pdf["pos_x"], got["fused_pos_y"] - pdf["pos_y"]), open_loop_error_m=np.hypot(got["open_loop_pos_x"] - pdf["pos_x"], got["open_loop_pos_y"] - pdf["pos_y"]))
        first = np.maximum(0, until - _BACK)
        for k, q in enumerate(due.tolist()):
            x, p = ends[k]
            own[q, 0], own[q, 1], own[q, 3:9], own[q, 9:45], rows[q] = until[k] - first[k], 1, x, p.ravel(), rows[q][first[k] :]
        return self.rows.packed(own, rows), out[["drive_id", "rn", "context_mode", *FUSED]]


def fuse_stream(df: DataFrame, scale: float = 1.0, first_dt: float | None = None, late: str | None = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """(drive_id, rn, context_mode, states, errors) as of ``with_context`` and ``fuse``, over a stream of their rows with event_time, whose steps are the filter's.

    A row comes out once four later ones are known, or when its drive ends. The style is that of a drive's first row.
    """
    rows = events(df.withColumn("aggressive", F.col("style") == "aggressive"), 0, _FILTERED)
    return in_order(rows, _Filter(scale, first_dt, idle_ms), "drive_id long, rn long, context_mode string, " + ", ".join(f"{c} double" for c in FUSED), late)


_WINDOWED = [*SENSORS, "timestamp", "speed"]


class _Windows(InOrder):
    """State: how many rows came before the kept ones; the kept rows are the last of a window and the one before it, which its first difference takes."""

    def __init__(self, size: int, step: int, causal: bool, idle_ms: int, rate: float = 10.0):
        super().__init__(idle_ms)
        self.size, self.step, self.causal, self.rate = size, step, causal, rate
        self.rows = _Rows(len(_WINDOWED), 2)

    def take(self, d):
        return self._run(np.array(d.ids), *self.rows.with_new(d), 0 if self.causal else 1)

    def finish(self, ids, states):
        return self._run(np.array(ids), *self.rows.unpacked(states), 0)[1]

    def _run(self, ids, own, rows, ahead):
        """Ends of windows among each drive's rows from its ``own[1]`` on, of which the last ``ahead`` wait for a neighbour."""
        every, size = np.concatenate(rows), np.array([len(r) for r in rows])
        before, done = own.astype(np.int64).T
        until, start = size - ahead, np.cumsum(size) - size
        drive, local = np.repeat(np.arange(len(rows)), size), np.arange(len(every)) - np.repeat(start, size)
        place = before[drive] + local + 1  # as row numbers from 1 on
        ends = np.flatnonzero((local >= done[drive]) & (local < until[drive]) & (place >= self.size) & ((place - self.size) % self.step == 0))
        out = None
        if len(ends):
            sig = signals_of(every[:, 2:8], self.rate, self.causal, start[size > 0])
            spans = ends[:, None] + np.arange(1 - self.size, 1)[None]
            out = pd.DataFrame({"drive_id": ids[drive[ends]], "rn": every[ends, 1].astype(np.int64), "t_end": every[ends, 8], "y": every[ends, 9], **{s: list(sig[s][spans]) for s in SIGNALS}})
        first = np.maximum(0, until - self.size)
        return self.rows.packed(np.column_stack([before + first, until - first]).astype(float), [r[k:] for r, k in zip(rows, first.tolist(), strict=True)]), out


def windows_stream(df: DataFrame, size: int = 15, step: int = 2, causal: bool = False, late: str | None = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """``features.windows`` over a stream of drives' rows with event_time: windows of ``size`` rows, the ends ``step`` apart."""
    rows = events(df, 0, _WINDOWED)
    schema = "drive_id long, rn long, t_end double, y double, " + ", ".join(f"{s} array<double>" for s in SIGNALS)
    return in_order(rows, _Windows(size, step, causal, idle_ms), schema, late)


def features_stream(df: DataFrame, window_sec: float = 1.5, step_sec: float = 0.2, rate: float = 10.0, group: str = "all", causal: bool = False, late: str | None = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """All columns of ``features.features`` over a stream: the windows are its state, the statistics the same columns as in batch."""
    n, step = features.rows_of(window_sec, rate, 4), features.rows_of(step_sec, rate, 1)
    return features.of_windows(windows_stream(df, n, step, causal, late, idle_ms), n, rate, group)
