"""Simulated drives of four driving styles, one task to a drive, with or without sensor noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from odolith.sources.drives import GRAVITY

# fixed values: cycle in seconds; then stretches (until, speed at their begin and end, a sine on it (gain, rate), turn rate (wave, gain, rate), 'flip' being a constant that changes sign each cycle)
STYLES = {
    "A": (90.0, [(20, 0, 14, None, None), (45, 14, 14, (1.2, 0.2), ("cos", 0.01, 0.15)), (60, 8, 8, None, ("flip", np.radians(90 / 15), None)), (75, 16, 16, None, None), (90, 16, 0, None, None)]),
    "D": (50.0, [(15, 0, 0, None, None), (28, 0, 11, None, ("sin", 0.01, 0.2)), (40, 12, 12, None, ("cos", 0.03, 0.25)), (50, 12, 0, None, None)]),
    "E": (70.0, [(12, 0, 24, None, None), (30, 25, 25, (3.0, 0.4), ("cos", 0.04, 0.3)), (42, 15, 15, None, ("flip", np.radians(90 / 12), None)), (52, 18, 0, None, None), (70, 0, 0, None, None)]),
}
# fixed values: smoothing, accelerometer and gyroscope (degrees/s) noise, biases of acc_x, acc_y and gyro_z (degrees/s)
NOISE = {"A": (0.92, 0.14, 0.20, -0.03, 0.05, 0.15), "B": (0.95, 0.12, 0.18, -0.02, 0.04, 0.12), "D": (0.88, 0.15, 0.22, -0.03, 0.05, 0.15), "E": (0.82, 0.22, 0.35, -0.05, 0.07, 0.20)}

SCHEMA = "drive_id long, rn long, driver_id string, timestamp double, acc_x double, acc_y double, acc_z double, gyro_x double, gyro_y double, gyro_z double, pos_x double, pos_y double, speed double, heading double, ambient_lux double"


def targets(style: str, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Speed and turn rate a driver aims at."""
    if style == "B":
        return 23 + 4.5 * np.sin(2 * np.pi * 0.012 * t) + 1.2 * np.cos(2 * np.pi * 0.03 * t), 0.015 * np.sin(2 * np.pi * 0.02 * t)
    cycle, parts = STYLES[style]
    at, v, w, begin = t % cycle, np.zeros(len(t)), np.zeros(len(t)), 0.0
    for until, v0, v1, wave, turn in parts:
        here = (at >= begin) & (at < until)
        own = v0 + (v1 - v0) * (at[here] - begin) / (until - begin)
        v[here] = own + (wave[0] * np.sin(wave[1] * t[here]) if wave else 0)
        if turn:
            wave, gain, rate = turn
            w[here] = np.where(t[here] % (2 * cycle) < cycle, gain, -gain) if wave == "flip" else gain * {"sin": np.sin, "cos": np.cos}[wave](rate * t[here])
        begin = until
    return v, w


def trajectory(drive_id: int, style: str, seconds: float, rate: float, seed: int | None) -> pd.DataFrame:
    """One drive; without a seed it has no noise."""
    n, dt = int(seconds * rate), 1 / rate
    t = np.linspace(0, seconds, n)
    aim, turn = targets(style, t)
    smooth, acc_std, gyro_std, bias_x, bias_y, bias_turn = NOISE[style]
    v, speed = 0.0, np.zeros(n)
    for i in range(n):
        v = smooth * v + (1 - smooth) * aim[i]
        speed[i] = max(0.0, v)
    heading = np.concatenate([[0.0], np.cumsum(turn[1:] * dt)]) if n else np.zeros(0)
    vm, hm = (0.5 * (x[1:] + x[:-1]) for x in (speed, heading))
    x, y = (np.concatenate([[0.0], np.cumsum(vm * f(hm) * dt)])[:n] for f in (np.sin, np.cos))
    rng = np.random.default_rng(seed)
    e = (lambda s: rng.normal(0, s, n)) if seed is not None else (lambda s: np.zeros(n))
    shake = 0.20 * speed / 25 + 0.03
    hum = lambda f, hz: shake * f(2 * np.pi * hz * t)
    return pd.DataFrame({
        "drive_id": drive_id, "rn": np.arange(1, n + 1), "driver_id": style, "timestamp": t,
        "acc_x": speed * turn + bias_x + hum(np.cos, 4.2) + e(acc_std), "acc_y": np.gradient(speed, dt) + bias_y + hum(np.sin, 3.5) + e(acc_std), "acc_z": GRAVITY + 1.6 * hum(np.sin, 5.0) + e(acc_std), "gyro_x": e(np.radians(gyro_std)), "gyro_y": e(np.radians(gyro_std)), "gyro_z": turn + np.radians(bias_turn) + e(np.radians(gyro_std)),
        "pos_x": x, "pos_y": y, "speed": speed, "heading": (heading + np.pi) % (2 * np.pi) - np.pi, "ambient_lux": 1500.0,
    })


def simulate(spark: SparkSession, drives: list[tuple[str, float]], rate: float = 10.0, seed: int | None = 42) -> DataFrame:
    """Rows of ``SCHEMA`` for drives [(style, seconds)]."""
    spec = spark.createDataFrame([(i, s, float(d)) for i, (s, d) in enumerate(drives)], "id long, style string, seconds double").repartition(max(1, len(drives)), "id")

    def run(pieces):
        for pdf in pieces:
            for r in pdf.itertuples(index=False):
                yield trajectory(r.id, r.style, r.seconds, rate, None if seed is None else seed + r.id)

    return spec.mapInPandas(run, SCHEMA)
