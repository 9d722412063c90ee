"""Noise and confidence terms of the filter, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blend(sigma: Column) -> Column:
    """Weight of the model's speed in the prediction."""
    return 0.25 / (1.0 + 1.5 * F.greatest(sigma, F.lit(0.0)))


def velocity_noise(sigma: Column, base: float = 0.12) -> Column:
    return base + 1.5 * sigma * sigma


def heading_noise(speed: Column, r: float = 0.12) -> Column:
    ratio = 1.5 / F.greatest(speed, F.lit(0.2))
    return r * r * (1.0 + ratio * ratio)


def band(v: Column, sigma: Column, k: float = 2.0) -> tuple[Column, Column]:
    return F.greatest(v - k * sigma, F.lit(0.0)), v + k * sigma


def radius(sigma: Column) -> Column:
    return F.greatest(4 * sigma, F.lit(1.5))


def gauge(v: Column) -> Column:
    """How full a gauge up to 120 km/h is, in per cent, at v m/s."""
    return F.least(v * 3.6 / 120.0 * 100, F.lit(100.0))


def countdown(t: Column, end: Column) -> Column:
    """Seconds left of an outage."""
    return F.greatest(end - t, F.lit(0.0))


def gain_shown(naive: Column, fused: Column) -> Column:
    """How much of the naive error is gone, in per cent and not below 0; null where it is too small to compare."""
    return F.when(naive > 0.1, F.greatest((naive - fused) / naive * 100, F.lit(0.0)))


def clock(t: Column) -> Column:
    """Seconds as mm:ss."""
    return F.format_string("%02d:%02d", F.floor(t / 60).cast("int"), F.floor(t % 60).cast("int"))


def label(name: Column) -> Column:
    """A feature's name as a title."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
