"""Sequence operators over (drive_id, rn): differences, gradients, rolling means, held courses, interpolation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from odolith.sources.drives import order, so_far


def _after():
    return order().rowsBetween(W.currentRow, W.unboundedFollowing)


def diff(x: str) -> Column:
    """Step from the row before, 0 at first."""
    return F.col(x) - F.coalesce(F.lag(x).over(order()), F.col(x))


def step_dt(t: str = "timestamp", first: float | None = None) -> Column:
    """Seconds since the row before; the first row takes the next row's, or ``first``."""
    own = F.col(t) - F.lag(t).over(order())
    return F.coalesce(own, F.lit(first)) if first is not None else F.coalesce(own, F.lead(t).over(order()) - F.col(t), F.lit(0.1))


def gradient(x: str, h: Column | float, causal: bool = False) -> Column:
    """Central differences, one-sided at the ends (one row: 0); causal: backward differences."""
    h = F.lit(h) if isinstance(h, float | int) else h
    before, after, here = F.lag(x).over(order()), F.lead(x).over(order()), F.col(x)
    if causal:
        return F.coalesce((here - before) / h, F.lit(0.0))
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - here) / h).when(after.isNull(), (here - before) / h).otherwise((after - before) / (2 * h))


def rolling_mean(x: str, reach: int = 3) -> Column:
    return F.avg(x).over(order().rowsBetween(-reach, reach))


def hold_course(df: DataFrame, px: str = "pos_x", py: str = "pos_y", speed: str = "speed", out: str = "course") -> DataFrame:
    """Course over ground from smoothed steps; at 0.4 m/s or less the last course stays, at first the first row's."""
    d = df.withColumn("dx_", diff(px)).withColumn("dy_", diff(py))
    d = d.withColumn("c_", F.atan2(rolling_mean("dx_"), rolling_mean("dy_")))
    held = F.coalesce(F.last(F.when(F.col(speed) > 0.4, F.col("c_")), ignorenulls=True).over(so_far()), F.first("c_").over(so_far()))
    return d.withColumn(out, held).drop("dx_", "dy_", "c_")


def local_variance(ahead: int = 4, back: int = 5, scale: float = 1.0) -> Column:
    """Population variance of acc_x plus that of acc_y over neighbouring rows; ahead=0, back=9 looks at no later row."""
    w = order().rowsBetween(-back, ahead)
    return (F.var_pop("acc_x").over(w) + F.var_pop("acc_y").over(w)) * scale


def interpolate(value: str, t: str = "timestamp") -> Column:
    """Linear in time between rows where ``value`` is not null, constant beyond the first and last of them."""
    known = F.when(F.col(value).isNotNull(), F.col(t))
    t0, t1 = F.last(known, ignorenulls=True).over(so_far()), F.first(known, ignorenulls=True).over(_after())
    v0, v1 = F.last(value, ignorenulls=True).over(so_far()), F.first(value, ignorenulls=True).over(_after())
    return F.when(v0.isNull(), v1).when(v1.isNull() | (t1 <= t0), v0).otherwise(v0 + (v1 - v0) * (F.col(t) - t0) / (t1 - t0))


def with_signals(df: DataFrame, rate: float = 10.0, causal: bool = False) -> DataFrame:
    """The twelve signals that features are made of."""
    h = 1.0 / rate
    sq = lambda c: c * c
    d = df.select("*", *[F.col(f"{k}_{a}").alias(f"{s}{a}") for k, s in (("acc", "a"), ("gyro", "g")) for a in "xyz"])
    d = d.select("*", *[gradient(f"{s}{a}", h, causal).alias(f"d{s}{a}") for s in "ag" for a in "xyz"])
    norm = lambda *c: F.sqrt(sum((sq(F.col(x)) for x in c[1:]), sq(F.col(c[0]))))
    return d.select(
        "*", norm("ax", "ay", "az").alias("acc_mag"), norm("gx", "gy", "gz").alias("gyro_mag"), norm("ax", "ay").alias("acc_horiz"),
        norm("dax", "day", "daz").alias("jerk_mag"), norm("dgx", "dgy", "dgz").alias("alpha_mag"), F.col("dgz").alias("alpha_z"),
    ).drop("dax", "day", "daz", "dgx", "dgy", "dgz")


def signals_of(sensors: np.ndarray, rate: float = 10.0, causal: bool = False, start: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """``with_signals`` of rows (acc_x, acc_y, acc_z, gyro_x, gyro_y, gyro_z) in order; of several drives' rows if it is said where each begins."""
    n = len(sensors)
    first = np.zeros(n + 1, bool)
    first[np.append([0] if start is None else start, n)] = True
    step = np.zeros_like(sensors)
    if n > 1:
        step[1:] = (sensors[1:] - sensors[:-1]) * rate
        if not causal:
            inner, begins = np.flatnonzero(~first[:-1] & ~first[1:]), np.flatnonzero(first[:-1] & ~first[1:])
            step[begins] = step[begins + 1]
            step[inner] = (sensors[inner + 1] - sensors[inner - 1]) * rate / 2
        step[np.flatnonzero(first[:-1] & (first[1:] | causal))] = 0
    norm = lambda x: np.sqrt((x * x).sum(1))
    made = [*sensors.T, norm(sensors[:, :3]), norm(sensors[:, 3:]), norm(sensors[:, :2]), norm(step[:, :3]), norm(step[:, 3:]), step[:, 5]]
    return dict(zip(SIGNALS, made, strict=True))


SIGNALS = ["ax", "ay", "az", "gx", "gy", "gz", "acc_mag", "gyro_mag", "acc_horiz", "jerk_mag", "alpha_mag", "alpha_z"]
