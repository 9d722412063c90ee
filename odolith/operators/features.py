"""Sliding-window features: 18 statistics of each of 12 signals and three interactions, from one shuffle by drive.

Each signal's window is collected once by a ROWS frame; rows that end no window are dropped before any statistic is taken, so the
statistics are those of surviving rows only. Single statistics are plain columns; all features of many windows come from ``of_windows``, which
takes the same sums in the same order over batches of windows.
"""

from __future__ import annotations

from math import cos, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.operators.signals import SIGNALS, with_signals
from odolith.sources.drives import order

GROUPS = ("all", "enhanced", "spectral", "base")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def quantile(z: Column, n: int, q: float) -> Column:
    """Linear interpolation in a sorted array of n."""
    at = q * (n - 1)
    lo = int(at)
    low = F.get(z, F.lit(lo))
    return low if at == lo else low + (F.get(z, F.lit(lo + 1)) - low) * (at - lo)


def mean(a: Column, n: int) -> Column:
    return _sum(a) / n


def centred(a: Column, m: Column) -> Column:
    """``m`` must be a column that exists: an expression would be evaluated for every element."""
    return F.transform(a, lambda v: v - m)


def base_stats(a: Column, m: Column, c: Column, n: int) -> dict[str, Column]:
    """Of a window ``a`` of n, its mean and the centred window."""
    rms = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v) / n)
    return {"mean": m, "std": rms(c), "min": F.array_min(a), "max": F.array_max(a), "p2p": F.array_max(a) - F.array_min(a), "rms": rms(a)}


def enhanced_stats(c: Column, z: Column, med: Column, std: Column, n: int) -> dict[str, Column]:
    """``c`` centred, ``z`` sorted. zcr counts how often "equals the mean" toggles; zcr_true counts sign changes about the mean."""
    cube = F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v * v) / n
    fourth = F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v * v * v) / n
    pairs = lambda f: F.aggregate(F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), lambda x, y: F.when(f(x) != f(y), 1.0).otherwise(0.0)), F.lit(0.0), lambda acc, v: acc + v) / (n - 1)
    return {
        "median": med, "iqr": quantile(z, n, 0.75) - quantile(z, n, 0.25), "mad": quantile(F.array_sort(F.transform(z, lambda v: F.abs(v - med))), n, 0.5),
        "skew": F.when(std > 1e-6, cube / (std * std * std)).otherwise(0.0), "kurt": F.when(std > 1e-6, fourth / (std * std * std * std) - 3).otherwise(0.0),
        "p10": quantile(z, n, 0.1), "p90": quantile(z, n, 0.9), "zcr": pairs(lambda v: v != 0), "zcr_true": pairs(F.signum),
    }


def _doubles(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _table(f, n: int) -> Column:
    """f over the angles of each frequency: a constant, so the plan holds it once and not as n^2 expressions."""
    return F.expr("array(" + ", ".join(_doubles(f(2 * pi * k * i / n) for i in range(n)) for k in range(n // 2 + 1)) + ")")


def power(c: Column, n: int) -> Column:
    """Squared magnitudes of a centred window's real Fourier transform, one for each frequency k/n."""
    part = lambda f: F.transform(_table(f, n), lambda t: _sum(F.zip_with(c, t, lambda x, w: x * w)))
    return F.zip_with(part(cos), part(sin), lambda re, im: re * re + im * im)


def spectral_stats(p: Column, n: int, rate: float = 10.0) -> dict[str, Column]:
    """``p`` as of ``power``. Magnitudes count as equal to nine decimals when the dominant frequency is looked for."""
    freq = [k * rate / n for k in range(n // 2 + 1)]
    total = _sum(p) + 1e-9
    weighed = lambda w: _sum(F.zip_with(p, F.expr(_doubles(w)), lambda x, k: x * k)) / total
    mags = F.transform(p, lambda v: F.round(F.sqrt(v), 9))
    return {
        "spec_centroid": weighed(freq), "dom_freq": (F.array_position(mags, F.array_max(mags)) - 1) * rate / n,
        "power_low": weighed([f <= 1.5 for f in freq]), "power_high": weighed([1.5 < f <= 5.0 for f in freq]),
    }


def interactions(c, size=F.abs) -> dict:
    """``c`` gives a feature by name, a column or an array, and ``size`` what is without sign."""
    return {"vibration_power": c("acc_mag_std") * c("acc_horiz_rms"), "jerk_motion_intensity": c("jerk_mag_rms") * (c("gyro_mag_mean") + 0.01), "curv_ratio": size(c("ax_mean")) / (size(c("gz_mean")) + 0.05)}


def rows_of(seconds: float, rate: float, least: int) -> int:
    """Rows in a duration, halves to even."""
    return max(least, round(seconds * rate))


def windows(df: DataFrame, size: int, step: int, signals: list[str] = SIGNALS, causal: bool = False) -> DataFrame:
    """(drive_id, rn, t_end, y, one array for each signal) at the window ends size, size + step, ..."""
    frame = order().rowsBetween(-(size - 1), 0)
    d = with_signals(df, causal=causal)
    d = d.select("drive_id", "rn", F.col("timestamp").alias("t_end"), F.col("speed").alias("y"), *[F.collect_list(s).over(frame).alias(s) for s in signals])
    return d.where((F.col("rn") >= size) & ((F.col("rn") - size) % step == 0))


def prepared(w: DataFrame, n: int, signals: list[str]) -> DataFrame:
    """Windows with each signal's mean (``__m``), centred (``__c``) and sorted (``__z``) window as columns."""
    d = w.select("*", *[mean(F.col(s), n).alias(f"{s}__m") for s in signals])
    return d.select("*", *[centred(F.col(s), F.col(f"{s}__m")).alias(f"{s}__c") for s in signals], *[F.array_sort(s).alias(f"{s}__z") for s in signals])


def features(df: DataFrame, window_sec: float = 1.5, step_sec: float = 0.2, rate: float = 10.0, group: str = "all", signals: list[str] = SIGNALS, causal: bool = False) -> DataFrame:
    """(drive_id, rn, t_end, y, features): 219 of them in group 'all', 171 in 'enhanced', 123 in 'spectral', 75 in 'base'."""
    n, step = rows_of(window_sec, rate, 4), rows_of(step_sec, rate, 1)
    return of_windows(windows(df, n, step, signals, causal), n, rate, group, signals)


def of_windows(w: DataFrame, n: int, rate: float = 10.0, group: str = "all", signals: list[str] = SIGNALS) -> DataFrame:
    """The features of windows of n rows, as ``windows`` or a stream gives them."""
    if group not in GROUPS:
        raise ValueError(f"unknown feature group {group!r}; one of {GROUPS}")
    names = feature_names(group, signals)

    @F.arrow_udf("struct<" + ", ".join(f"{k}: double" for k in names) + ">")
    def made(*arrays: pa.Array) -> pa.Array:
        got: dict[str, pa.Array] = {}
        for s, a in zip(signals, arrays, strict=True):
            got |= {f"{s}_{k}": v for k, v in _signal(a, n, rate, group).items()}
        plain = {k: got[k].to_numpy(zero_copy_only=False) for k in _MIXED if k in got}
        if "curv_ratio" in names:
            got |= {k: pa.array(v) for k, v in interactions(lambda k: plain[k], np.abs).items()}
        return pa.StructArray.from_arrays([got[k] for k in names], names)

    return w.select("drive_id", "rn", "t_end", "y", made(*signals).alias("_f")).select("drive_id", "rn", "t_end", "y", "_f.*")


_BASE = ("mean", "std", "min", "max", "p2p", "rms")
_ENHANCED = ("median", "iqr", "mad", "skew", "kurt", "p10", "p90", "zcr")
_SPECTRUM = ("spec_centroid", "dom_freq", "power_low", "power_high")
_MIXED = ("acc_mag_std", "acc_horiz_rms", "jerk_mag_rms", "gyro_mag_mean", "ax_mean", "gz_mean")


def feature_names(group: str = "all", signals: list[str] = SIGNALS) -> list[str]:
    """Names of a group's features in their order."""
    out = [f"{s}_{k}" for s in signals for k in _BASE]
    out += [f"{s}_{k}" for s in signals for k in _ENHANCED] if group in ("all", "enhanced") else []
    out += [f"{s}_{k}" for s in signals for k in _SPECTRUM] if group in ("all", "spectral") else []
    return out + (list(interactions(lambda _: 1.0, abs)) if set(signals) == set(SIGNALS) else [])


def _signal(a: pa.Array, n: int, rate: float, group: str) -> dict[str, pa.Array]:
    """A signal's features of a batch of windows; a window with nulls in it is shorter, as a collected list has none."""
    size = np.diff(a.offsets.to_numpy())
    flat = a.flatten().to_numpy(zero_copy_only=False)
    if (size == n).all():
        return {k: pa.array(v) for k, v in _of_size(flat.reshape(-1, n), n, rate, group).items() if v is not None}
    begin, out = np.cumsum(size) - size, {}
    for own in np.unique(size):
        at = np.flatnonzero(size == own)
        for k, v in _of_size(flat[begin[at][:, None] + np.arange(own)[None]], n, rate, group).items():
            value, known = out.setdefault(k, (np.zeros(len(size)), np.zeros(len(size), bool)))
            if v is not None:
                value[at], known[at] = v, True
    return {k: pa.array(value, mask=~known) for k, (value, known) in out.items()}


def _added(x: np.ndarray) -> np.ndarray:
    """Sums of rows, element after element as ``_sum`` adds them."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out = out + x[:, k]
    return out


def _of_size(x: np.ndarray, n: int, rate: float, group: str) -> dict[str, np.ndarray | None]:
    """``base_stats``, ``enhanced_stats`` without zcr_true and ``spectral_stats`` of windows of as many values each; None is null, as columns give it where a window has fewer than n."""
    size = x.shape[1]

    def at(z, q):
        place = q * (n - 1)
        lo = int(place)
        if z is None or lo + (place != lo) >= size:
            return None
        return z[:, lo] if place == lo else z[:, lo] + (z[:, lo + 1] - z[:, lo]) * (place - lo)

    with np.errstate(all="ignore"):
        m = _added(x) / n
        c = x - m[:, None]
        std, rms = np.sqrt(_added(c * c) / n), np.sqrt(_added(x * x) / n)
        low, high = (np.fmin.reduce(x, axis=1), x.max(1)) if size else (None, None)
        out = {"mean": m, "std": std, "min": low, "max": high, "p2p": high - low if size else None, "rms": rms}
        if group in ("all", "enhanced"):
            z = np.sort(x, axis=1)
            med, q1, q3 = at(z, 0.5), at(z, 0.25), at(z, 0.75)
            far = None if med is None else np.sort(np.abs(z - med[:, None]), axis=1)
            flat, away = std <= 1e-6, c != 0
            out |= {
                "median": med, "iqr": None if q3 is None else q3 - q1, "mad": at(far, 0.5),
                "skew": np.where(flat, 0.0, _added(c * c * c) / n / (std * std * std)), "kurt": np.where(flat, 0.0, _added(c * c * c * c) / n / (std * std * std * std) - 3),
                "p10": at(z, 0.1), "p90": at(z, 0.9), "zcr": (away[:, 1:] != away[:, :-1]).sum(1) / (n - 1),
            }
        if group in ("all", "spectral"):
            out |= dict.fromkeys(_SPECTRUM) if size < n else _spectrum(c, n, rate)
    return out


def _spectrum(c: np.ndarray, n: int, rate: float) -> dict[str, np.ndarray]:
    freq = np.array([k * rate / n for k in range(n // 2 + 1)])
    part = lambda f: [_added(c * np.array([f(2 * pi * k * i / n) for i in range(n)])) for k in range(n // 2 + 1)]
    p = np.stack([re * re + im * im for re, im in zip(part(cos), part(sin), strict=True)], 1)
    total = _added(p) + 1e-9
    return {
        "spec_centroid": _added(p * freq) / total, "dom_freq": np.floor(np.sqrt(p) * 1e9 + 0.5).argmax(1) * rate / n,
        "power_low": _added(p * (freq <= 1.5)) / total, "power_high": _added(p * ((freq > 1.5) & (freq <= 5.0))) / total,
    }


# fixed values: parts of names that leave a feature out of a subset
_SPECTRAL = ("spec", "dom_freq", "power")
SUBSETS = {"base": (*_SPECTRAL, "median", "iqr", "mad", "skew", "kurt", "p10", "p90", "zcr", "jerk_motion", "vibration", "curv"), "enhanced": (*_SPECTRAL, "jerk", "alpha", "vibration", "curv"), "kinematic": _SPECTRAL, "all": ()}


def subset(columns: list[str], kind: str) -> list[str]:
    """Feature names of a subset: 72 for base, 126 for enhanced, 170 for kinematic, 219 for all."""
    return [c for c in columns if c not in ("drive_id", "rn", "t_end", "y") and not any(k in c for k in SUBSETS[kind])]
