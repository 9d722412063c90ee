"""The on-device engine as a keyed stream, and streaming forms of the merging and carrying operators.

The state of a drive is a ring of the last 15 samples and some numbers. Samples and fixes are events of their own: a fix counts after the samples of its
time. The batch form runs the drives of a task in step, the stream one drive's events as they come in order; both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import cos, pi, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolith.operators.context import (
    DARK, FIX_BIAS, FIX_HEADING, FIX_MOVING, FIX_PLACE, FIX_SPEED, FOLLOW, MAG_GAIN, MOVING, RING, SIGMA_BASE, SIGMA_FIRST, SIGMA_GAIN, SIGMA_STILL, STD_GAIN, STILL_TURN, STILL_VAR,
)
from odolith.sources.drives import GRAVITY
from odolith.streaming.in_order import IDLE_MS, LATE, InOrder, events, in_order, seconds_as_time

OUT = "drive_id long, rn long, predicted_speed double, state_speed double, state_heading double, state_x double, state_y double, gyro_bias double, sigma double, standstill boolean, tunnel_alert boolean"
_NAMES = [x.split()[0] for x in OUT.split(", ")]
SAMPLE, FIX, RESET = 0, 1, 2
_SENSED = ["acc_x", "acc_y", "acc_z", "gyro_z", "ambient_lux", "dt"]
_FIXED = ["pos_x", "pos_y", "speed", "heading"]


@dataclass
class DeviceEngine:
    ring: list[float] = field(default_factory=list)
    x: float = 0.0
    y: float = 0.0
    speed: float = 0.0
    heading: float = 0.0
    bias: float = 0.0
    sigma: float = SIGMA_FIRST
    seen: int = 0
    still: bool = False
    alert: bool = False

    def sample(self, ax: float, ay: float, az: float, gz: float, lux: float, dt: float) -> float:
        """Takes a sample; the speed it predicts, 0 until the ring is full."""
        self.ring = [*self.ring, ay, sqrt(ax * ax + ay * ay + az * az)][-2 * RING :]
        self.seen += 1
        if self.seen < RING:
            return 0.0
        ys, mags = self.ring[::2], self.ring[1::2]
        mean = sum(ys) / RING
        std = sqrt(var := max(0.0, sum(v * v for v in ys) / RING - mean * mean))
        self.still = var < STILL_VAR and abs(gz) < STILL_TURN
        self.alert = lux < DARK and self.speed > MOVING
        predicted = 0.0 if self.still else max(0.0, (sum(mags) / RING - GRAVITY) * MAG_GAIN + std * STD_GAIN)
        self.sigma = SIGMA_STILL if self.still else SIGMA_BASE + std * SIGMA_GAIN
        alpha = 0.0 if self.still else FOLLOW
        self.speed = (1 - alpha) * self.speed + alpha * predicted
        self.heading += (gz - self.bias) * dt
        self.x += self.speed * sin(self.heading) * dt
        self.y += self.speed * cos(self.heading) * dt
        return predicted

    def fix(self, gx: float, gy: float, speed: float, heading: float | None) -> None:
        """A satellite fix pulls position, speed and, when moving, heading and bias."""
        self.x += FIX_PLACE * (gx - self.x)
        self.y += FIX_PLACE * (gy - self.y)
        self.speed += FIX_SPEED * (speed - self.speed)
        if heading is not None and heading == heading and speed > FIX_MOVING:
            err = (heading - self.heading + pi) % (2 * pi) - pi
            self.heading = (self.heading + FIX_HEADING * err + pi) % (2 * pi) - pi
            self.bias += FIX_BIAS * err

    def reset(self) -> None:
        """Back to a new engine's state."""
        self.__init__()

    def packed(self) -> list[float]:
        return [self.x, self.y, self.speed, self.heading, self.bias, self.sigma, float(self.seen), float(self.still), float(self.alert), *self.ring]

    @classmethod
    def unpacked(cls, n: list[float]) -> DeviceEngine:
        return cls(list(n[9:]), *n[:6], int(n[6]), bool(n[7]), bool(n[8]))


class _Bank:
    """Engines of several drives as arrays: a step takes one event of each."""

    def __init__(self, n: int):
        self.ring, self.seen = np.zeros((n, RING, 2)), np.zeros(n, np.int64)
        self.x, self.y, self.speed, self.heading, self.bias, self.sigma = (np.full(n, v) for v in (0.0, 0.0, 0.0, 0.0, 0.0, SIGMA_FIRST))
        self.still, self.alert = np.zeros(n, bool), np.zeros(n, bool)

    def put(self, k: int, e: DeviceEngine) -> None:
        own = np.array(e.ring).reshape(-1, 2)
        self.ring[k, RING - len(own) :], self.seen[k] = own, e.seen
        self.x[k], self.y[k], self.speed[k], self.heading[k], self.bias[k], self.sigma[k], self.still[k], self.alert[k] = e.x, e.y, e.speed, e.heading, e.bias, e.sigma, e.still, e.alert

    def engine(self, k: int) -> DeviceEngine:
        n = min(RING, int(self.seen[k]))
        return DeviceEngine(self.ring[k, RING - n :].ravel().tolist(), *(float(v[k]) for v in (self.x, self.y, self.speed, self.heading, self.bias, self.sigma)), int(self.seen[k]), bool(self.still[k]), bool(self.alert[k]))

    def sample(self, k: np.ndarray, ax, ay, az, gz, lux, dt) -> np.ndarray:
        """A sample of each of the drives ``k``; their predicted speeds."""
        self.ring[k, :-1] = self.ring[k, 1:]
        self.ring[k, -1, 0], self.ring[k, -1, 1] = ay, np.sqrt(ax * ax + ay * ay + az * az)
        self.seen[k] += 1
        full = self.seen[k] >= RING
        out = np.zeros(len(k))
        if full.any():
            k, gz, dt, lux = k[full], gz[full], dt[full], lux[full]
            ys, mags = self.ring[k, :, 0], self.ring[k, :, 1]
            mean = ys.sum(1) / RING
            var = np.maximum((ys * ys).sum(1) / RING - mean * mean, 0.0)
            std = np.sqrt(var)
            still = (var < STILL_VAR) & (np.abs(gz) < STILL_TURN)
            self.still[k], self.alert[k] = still, (lux < DARK) & (self.speed[k] > MOVING)
            out[full] = predicted = np.where(still, 0.0, np.maximum((mags.sum(1) / RING - GRAVITY) * MAG_GAIN + std * STD_GAIN, 0.0))
            self.sigma[k] = np.where(still, SIGMA_STILL, SIGMA_BASE + SIGMA_GAIN * std)
            alpha = np.where(still, 0.0, FOLLOW)
            self.speed[k] = (1 - alpha) * self.speed[k] + alpha * predicted
            self.heading[k] += (gz - self.bias[k]) * dt
            self.x[k] += self.speed[k] * np.sin(self.heading[k]) * dt
            self.y[k] += self.speed[k] * np.cos(self.heading[k]) * dt
        return out

    def fix(self, k: np.ndarray, gx, gy, speed, heading) -> None:
        self.x[k] += FIX_PLACE * (gx - self.x[k])
        self.y[k] += FIX_PLACE * (gy - self.y[k])
        self.speed[k] += FIX_SPEED * (speed - self.speed[k])
        use = (speed > FIX_MOVING) & ~np.isnan(heading)
        k, err = k[use], (heading[use] - self.heading[k[use]] + pi) % (2 * pi) - pi
        self.heading[k] = (self.heading[k] + FIX_HEADING * err + pi) % (2 * pi) - pi
        self.bias[k] += FIX_BIAS * err

    def reset(self, k: np.ndarray) -> None:
        for i in k.tolist():
            self.put(i, DeviceEngine())


_PIECE = 100_000


def _together(pdf: pd.DataFrame, fix_every: int, carried: dict) -> tuple[pd.DataFrame, dict]:
    """Sorted events of several drives, all drives in step; and each drive's engine at its end, which later events may go on with.

    A sample's row has the state after the fixes of its own time. ``pdf`` may have kind and t; without them all rows are samples.
    """
    ids = pdf["drive_id"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    size = np.diff(np.append(start, len(ids)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    bank = _Bank(len(start))
    for k, i in enumerate(start):
        if ids[i] in carried:
            bank.put(k, carried[ids[i]])
    col = {c: pdf[c].to_numpy(dtype=float) for c in [*_SENSED, *_FIXED]}
    kind = pdf["kind"].to_numpy() if "kind" in pdf else np.zeros(len(ids), np.int64)
    t = pdf["t"].to_numpy() if "t" in pdf else np.arange(len(ids))
    latest = np.full(len(start), -1)  # each drive's last sample in this piece
    out = {c: np.zeros(len(ids)) for c in _NAMES[2:9]} | {c: np.zeros(len(ids), bool) for c in _NAMES[9:]}
    for step in range(int(size[0])):
        n = int(np.searchsorted(-size, -step, side="left"))  # drives with more than ``step`` rows come first
        i = start[:n] + step
        sampled = np.flatnonzero(kind[i] == SAMPLE)
        out["predicted_speed"][i[sampled]] = bank.sample(sampled, *(col[c][i[sampled]] for c in _SENSED))
        latest[sampled] = i[sampled]
        fixed = kind[i] == FIX
        if fix_every:
            fixed |= (kind[i] == SAMPLE) & (bank.seen[:n] % fix_every == 0)
        if len(k := np.flatnonzero(fixed)):
            bank.fix(k, *(col[c][i[k]] for c in _FIXED))
        if len(k := np.flatnonzero(kind[i] == RESET)):
            bank.reset(k)
        k = np.flatnonzero((latest[:n] >= 0) & (kind[i] != RESET))
        k = k[t[latest[k]] == t[i[k]]]
        for c, v in zip(_NAMES[3:], (bank.speed, bank.heading, bank.x, bank.y, bank.bias, bank.sigma, bank.still, bank.alert), strict=True):
            out[c][latest[k]] = v[k]
    made = pd.DataFrame({"drive_id": ids, "rn": pdf["rn"].to_numpy(), **out})
    return made[kind == SAMPLE].reset_index(drop=True), {d: bank.engine(k) for k, d in enumerate(ids[start].tolist())}


def _in_step(df: DataFrame, fix_every: int, order: list[str]) -> DataFrame:
    """A task runs its drives in step, in sorted pieces that are cut between times; a drive that is longer than a piece hands its engine on."""

    def run(pieces):
        held, size, carried = [], 0, {}
        for pdf in pieces:
            if len(pdf):
                held.append(pdf)
                size += len(pdf)
            if size >= _PIECE:
                whole = pd.concat(held, ignore_index=True)
                held, size = [], 0
                cut = len(whole)
                if "t" in whole:  # a sample and the fixes of its time stay together
                    at = whole["t"].to_numpy(), whole["drive_id"].to_numpy()
                    while cut > 0 and all(a[cut - 1] == a[-1] for a in at):
                        cut -= 1
                    held, size = [whole.iloc[cut:]], len(whole) - cut
                if cut:
                    out, ends = _together(whole.iloc[:cut], fix_every, carried)
                    carried = {d: ends[d] for d in whole["drive_id"].iloc[cut - 1 : cut]}
                    yield out
        if held:
            yield _together(pd.concat(held, ignore_index=True), fix_every, carried)[0]

    return df.repartition("drive_id").sortWithinPartitions("drive_id", *order).mapInPandas(run, OUT)


def replay(df: DataFrame, fix_every: int = 10) -> DataFrame:
    """Rows of ``OUT`` for each row (drive, sensors, dt); every ``fix_every``-th sample brings a fix (0: none)."""
    return _in_step(df, fix_every, ["rn"])


def device_events(samples: DataFrame, fixes: DataFrame | None = None, resets: DataFrame | None = None) -> DataFrame:
    """One table of events, batch or stream: samples (drive_id, event_time, rn, sensors, dt), fixes (drive_id, event_time, pos_x, pos_y, speed, heading) and resets (drive_id, event_time)."""
    out = events(samples, SAMPLE, _SENSED)
    for other, kind, values in ((fixes, FIX, _FIXED), (resets, RESET, [])):
        if other is not None:
            out = out.unionByName(events(other, kind, values))
    return out


def replay_events(happened: DataFrame) -> DataFrame:
    """Rows of ``OUT`` for the samples among ``device_events``, in batch."""
    value = lambda k, kind: F.when(F.col("kind") == kind, F.get("v", F.lit(k)))
    cols = [value(k, SAMPLE).alias(c) for k, c in enumerate(_SENSED)] + [value(k, FIX).alias(c) for k, c in enumerate(_FIXED)]
    return _in_step(happened.select("drive_id", "t", "kind", "rn", *cols), 0, ["t", "kind", "rn"])


class _Device(InOrder):
    def take(self, d):
        pdf = pd.DataFrame({"drive_id": d.drive, "t": d.t, "kind": d.kind, "rn": d.rn})
        for kind, names in ((SAMPLE, _SENSED), (FIX, _FIXED)):
            own = d.kind == kind
            pdf = pdf.assign(**{c: np.where(own, d.v[:, k], np.nan) for k, c in enumerate(names)})
        out, ends = _together(pdf, 0, {i: DeviceEngine.unpacked(s.tolist()) for i, s in zip(d.ids, d.states, strict=True) if s is not None})
        return [np.array(ends[i].packed()) for i in d.ids], out


def stream(happened: DataFrame, late: str | None = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """``replay_events`` over a stream of ``device_events``: equal rows, in whatever order and triggers the events come within ``late``. A drive that is idle for ``idle_ms`` begins anew."""
    rows = happened.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(len(_SENSED) - 1)), lambda k: F.coalesce(F.get("v", k), F.lit(float("nan")))))
    return in_order(rows, _Device(idle_ms), OUT, late)


class _Carry(InOrder):
    """Nulls take the last value; rows of the kinds ``shown`` come out."""

    def __init__(self, values: list[str], shown: list[int], idle_ms: int):
        super().__init__(idle_ms)
        self.values, self.shown = values, shown

    def take(self, d):
        before = np.array([np.full(d.v.shape[1], np.nan) if s is None else s for s in d.states])
        place = np.arange(len(d.drive)) + np.cumsum(np.bincount(d.start, minlength=len(d.drive)))  # behind the own drive's state
        rows = np.empty((len(d.drive) + len(d.ids), d.v.shape[1]))
        rows[place], rows[d.start + np.arange(len(d.ids))] = d.v, before
        drive = np.empty(len(rows), np.int64)
        drive[place], drive[d.start + np.arange(len(d.ids))] = d.drive, d.ids
        rows = pd.DataFrame(rows).groupby(drive).ffill().to_numpy()[place]
        own = np.isin(d.kind, self.shown)
        out = pd.DataFrame(rows[own], columns=self.values).astype(object)
        out = out.where(out.notna(), None)
        out.insert(0, "t", d.t[own] / 1e6)
        out.insert(0, "drive_id", d.drive[own])
        return [rows[k - 1] for k in np.append(d.start[1:], len(rows))], out


def carry_stream(df: DataFrame, values: list[str], late: str | None = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """Last observation carried forward over a stream of (drive_id, t in seconds, values): nulls take the drive's last value in order of time, until it is idle for ``idle_ms``."""
    rows = events(df.withColumn("event_time", seconds_as_time("t")), 0, values)
    return in_order(rows, _Carry(values, [0], idle_ms), "drive_id long, t double, " + ", ".join(f"{c} double" for c in values), late)


def merge_stream(acc: DataFrame, gyro: DataFrame, gps: DataFrame, late: str | None = LATE, idle_ms: int = IDLE_MS) -> DataFrame:
    """``merge_sensors`` over streams of (drive_id, t, values): three kinds of events, of which the gyroscope's come out with the last values of all."""
    names = [c for df in (gyro, acc, gps) for c in df.columns if c not in ("drive_id", "t")]
    rows = None
    for kind, df in enumerate((acc, gps, gyro)):
        wide = df.select("drive_id", "t", *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names])
        one = events(wide.withColumn("event_time", seconds_as_time("t")), kind, names)
        rows = one if rows is None else rows.unionByName(one)
    return in_order(rows, _Carry(names, [2], idle_ms), "drive_id long, t double, " + ", ".join(f"{c} double" for c in names), late)


def sliding_counts(df: DataFrame, length: str = "1500 milliseconds", slide: str = "200 milliseconds", late: str = "5 seconds") -> DataFrame:
    """Per drive and sliding event-time window, speed and vibration statistics; ``df`` has a timestamp column ``event_time``."""
    w = df.withWatermark("event_time", late).groupBy("drive_id", F.window("event_time", length, slide))
    return w.agg(F.count("*").alias("n"), F.avg("speed").alias("speed_mean"), F.stddev_pop("acc_y").alias("ay_std")).select("drive_id", F.col("window.end").alias("t_end"), "n", "speed_mean", "ay_std")


def merge_sensors(acc: DataFrame, gyro: DataFrame, gps: DataFrame) -> DataFrame:
    """One row for each gyroscope sample with the last accelerometer and position values up to it; inputs (drive_id, t, values)."""
    from pyspark.sql import Window as W

    cols = {"acc": [c for c in acc.columns if c not in ("drive_id", "t")], "gps": [c for c in gps.columns if c not in ("drive_id", "t")], "gyro": [c for c in gyro.columns if c not in ("drive_id", "t")]}
    every = acc.withColumn("kind", F.lit(0)).unionByName(gps.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(gyro.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    w = W.partitionBy("drive_id").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = [F.last(c, ignorenulls=True).over(w).alias(c) for c in cols["acc"] + cols["gps"]]
    return every.select("drive_id", "t", "kind", *cols["gyro"], *carried).where("kind = 2").drop("kind")
