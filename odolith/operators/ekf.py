"""The six-state fusion filter: positions, forward and lateral speed, heading, gyroscope bias.

The recursion is the one part that no window expresses. Everything row-wise around it (time steps, context, outage) is done
in columns first. A task then runs the filter for all of its drives in step, as batched 6 x 6 algebra: one round of
calls per row number, not per row. Rows come sorted and in pieces; a drive that is longer than a piece hands its state on, so
memory is bounded however long a drive is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odolith.operators.context import STANDSTILL, TUNNEL, context_mode
from odolith.operators.signals import local_variance, step_dt


@dataclass(frozen=True)
class FilterParams:
    q_pos: float = 0.05
    q_vel: float = 0.12
    q_lat: float = 0.05
    q_heading: float = 0.003
    q_bias: float = 1e-6
    r_pos: float = 2.0
    r_vel: float = 0.4
    r_heading: float = 0.12
    r_zupt: float = 0.04
    nhc_std: float = 0.05
    aggressive_nhc_std: float = 0.25
    aggressive_q_vel: float = 0.20
    nhc: bool = True
    zupt: bool = True
    #: the older five-state form: no lateral speed, a fixed heading noise, and headings used over 1 m/s only
    legacy: bool = False
    #: in place of the model's deviation, for filters that take it as constant
    sigma: float | None = None


P0 = np.array([4.0, 4.0, 1.0, 0.25, 0.05, 0.0001])


def wrap(a):
    return (a + np.pi) % (2 * np.pi) - np.pi


class Filter:
    """States of D drives, x (D, 6) and P (D, 6, 6)."""

    def __init__(self, x: np.ndarray, aggressive: np.ndarray, params: FilterParams = FilterParams(), cov: np.ndarray | None = None):
        self.x, self.k = np.array(x, float), params
        self.P = np.repeat(np.diag(P0 * ([1, 1, 1, 0, 1, 1] if params.legacy else 1))[None], len(x), 0) if cov is None else np.array(cov, float)
        self.aggressive = np.asarray(aggressive, bool)
        self.q_vel = np.where(self.aggressive, params.aggressive_q_vel, params.q_vel)
        self.r_nhc = np.where(self.aggressive, params.aggressive_nhc_std, params.nhc_std) ** 2

    def part(self, rows) -> Filter:
        return Filter(self.x[rows], self.aggressive[rows], self.k, self.P[rows])

    def put(self, rows, other: Filter) -> None:
        self.x[rows], self.P[rows] = other.x, other.P

    def predict(self, dt, v_ai, sigma, gyro, still, tunnel) -> None:
        x, n = self.x, len(self.x)
        alpha = np.where(still, 0.0, 0.25 / (1 + 1.5 * np.maximum(sigma, 0)))
        keep, keep_lat = np.where(still, 0.0, 1 - alpha), np.where(still, 0.0, 0.9)
        v, lat = keep * x[:, 2] + alpha * v_ai, keep_lat * x[:, 3]
        h = np.where(still, x[:, 4], wrap(x[:, 4] + (gyro - x[:, 5]) * dt))
        s, c = np.sin(h), np.cos(h)
        east, north = v * s + lat * c, v * c - lat * s
        moving = (~still).astype(float)
        f = np.repeat(np.eye(6)[None], n, 0)
        f[:, 0, 2], f[:, 0, 3] = keep * s * dt, keep_lat * c * dt
        f[:, 1, 2], f[:, 1, 3] = keep * c * dt, -keep_lat * s * dt
        f[:, 0, 4], f[:, 0, 5] = moving * north * dt, -moving * north * dt * dt
        f[:, 1, 4], f[:, 1, 5] = -moving * east * dt, moving * east * dt * dt
        f[:, 2, 2], f[:, 3, 3], f[:, 4, 5] = keep, keep_lat, -moving * dt
        self.x = np.stack([x[:, 0] + east * dt, x[:, 1] + north * dt, v, lat, h, x[:, 5]], 1)
        k, q = self.k, np.zeros((n, 6))
        q[:, :2], q[:, 2], q[:, 3], q[:, 4] = k.q_pos**2, self.q_vel + 1.5 * sigma * sigma, 0.0 if k.legacy else k.q_lat**2, k.q_heading**2
        q[:, 5] = (k.q_bias * np.where(tunnel, 0.1, 1.0)) ** 2
        self.P = f @ self.P @ f.transpose(0, 2, 1)
        self.P[:, range(6), range(6)] += q

    def _update(self, states: list[int], innovation: np.ndarray, r: np.ndarray, free: list[int]) -> None:
        """Measures ``states`` directly, with noise variances r; only the states in ``free`` move. Joseph form."""
        n, m = len(self.x), len(states)
        s = self.P[:, states][:, :, states].copy()
        s[:, range(m), range(m)] += r
        gain = self.P[:, :, states] @ np.linalg.inv(s)
        gain[:, [i for i in range(6) if i not in free]] = 0
        self.x = self.x + (gain @ innovation[:, :, None])[:, :, 0]
        ikh = np.repeat(np.eye(6)[None], n, 0)
        ikh[:, :, states] -= gain
        self.P = ikh @ self.P @ ikh.transpose(0, 2, 1) + (gain * np.broadcast_to(r, (n, m))[:, None, :]) @ gain.transpose(0, 2, 1)

    def nhc(self) -> None:
        self._update([3], -self.x[:, [3]], self.r_nhc[:, None], [0, 1, 2, 3, 4])

    def stop(self) -> None:
        states = [2] if self.k.legacy else [2, 3]  # the five states have no lateral speed: it and its covariance stay 0
        self._update(states, -self.x[:, states], np.full((len(self.x), len(states)), self.k.r_zupt**2), states)

    def gps(self, px, py, v, heading) -> None:
        k = self.k
        z = np.stack([px, py, v], 1)
        self._update([0, 1, 2], z - self.x[:, :3], np.tile([k.r_pos**2, k.r_pos**2, k.r_vel**2], (len(z), 1)), [0, 1, 2, 3])
        if k.legacy:
            use = np.flatnonzero(v > 1.0)
            if len(use):
                own = self.part(use)
                own._heading(heading[use], np.full(len(use), k.r_heading**2))
                self.put(use, own)
        else:
            self._heading(heading, k.r_heading**2 * (1 + (1.5 / np.maximum(v, 0.2)) ** 2))

    def _heading(self, heading, r) -> None:
        self._update([4], wrap(heading - self.x[:, 4])[:, None], r[:, None], [4, 5])
        self.x[:, 4] = wrap(self.x[:, 4])


STATE = ["fused_pos_x", "fused_pos_y", "fused_velocity", "fused_lat_velocity", "fused_heading", "fused_gyro_bias"]
_IN = ["drive_id", "rn", "dt", "ai_speed", "ai_speed_std", "gyro_z", "still", "tunnel", "in_outage", "pos_x", "pos_y", "speed", "heading", "aggressive"]
_PIECE = 100_000


def run_filter(pdf: pd.DataFrame, params: FilterParams, carried: dict | None = None) -> tuple[pd.DataFrame, dict]:
    """Runs sorted rows of ``_IN`` for all drives in step; (drive_id, rn, ``STATE`` and the open-loop position), and {drive: (x, P)} at their ends."""
    carried = carried or {}
    ids = pdf["drive_id"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    size = np.diff(np.append(start, len(ids)))
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    col = {c: pdf[c].to_numpy() for c in _IN[2:]}
    if params.sigma is not None:
        col["ai_speed_std"] = np.full(len(ids), params.sigma)
    x = np.stack([col["pos_x"][start], col["pos_y"][start], col["speed"][start], np.zeros(len(start)), col["heading"][start], np.zeros(len(start))], 1)
    f = Filter(x, col["aggressive"][start], params)
    for d, i in enumerate(start):
        if ids[i] in carried:
            f.x[d], f.P[d] = carried[ids[i]]
    out = np.zeros((len(ids), 8))
    for step in range(int(size[0])):
        live = int(np.searchsorted(-size, -step, side="left"))  # drives with more than ``step`` rows come first
        i = start[:live] + step
        g = f if live == len(start) else f.part(slice(0, live))
        still = col["still"][i].astype(bool)
        g.predict(col["dt"][i], col["ai_speed"][i], col["ai_speed_std"][i], col["gyro_z"][i], still, col["tunnel"][i].astype(bool))
        if params.nhc:
            g.nhc()
        if params.zupt and still.any():
            own = g.part(still)
            own.stop()
            g.put(still, own)
        out[i, 6:] = g.x[:, :2]
        fix = ~col["in_outage"][i].astype(bool)
        if fix.any():
            own = g.part(fix)
            j = i[fix]
            own.gps(col["pos_x"][j], col["pos_y"][j], col["speed"][j], col["heading"][j])
            g.put(fix, own)
        out[i, :6] = g.x
        if g is not f:
            f.put(slice(0, live), g)
    res = pd.DataFrame(out, columns=[*STATE, "open_loop_pos_x", "open_loop_pos_y"])
    res.insert(0, "drive_id", ids)
    res.insert(1, "rn", pdf["rn"].to_numpy())
    return res, {ids[s]: (f.x[d].copy(), f.P[d].copy()) for d, s in enumerate(start)}


def with_context(df: DataFrame, scale: float = 1.0, causal: bool = False, gps_free: bool = False) -> DataFrame:
    """Rows with context_mode, from light, the lesser of model and GPS speed (gps_free: the model's), and the variance around each row."""
    v = F.col("ai_speed") if gps_free else F.least("ai_speed", "speed")
    var = local_variance(0, 9, scale) if causal else local_variance(4, 5, scale)
    return df.withColumn("acc_var", var).withColumn("context_mode", context_mode(F.col("ambient_lux"), v, F.col("acc_var"), F.abs("gyro_z")))


def _inputs(df: DataFrame, params: FilterParams, rule: str, first_dt: float | None) -> dict:
    """Columns the filter takes besides those of ``df``."""
    if rule == "context":
        still, tunnel = F.col("context_mode") == STANDSTILL, F.col("context_mode") == TUNNEL
    else:
        mag = F.sqrt(F.col("acc_x") ** 2 + F.col("acc_y") ** 2 + F.col("acc_z") ** 2)
        still, tunnel = (F.abs(mag - 9.81) < 0.25) & (F.abs("gyro_z") < 0.05) & (F.col("ai_speed") < 0.4) & F.lit(params.zupt), F.lit(False)
    return {"still": still, "tunnel": tunnel, "dt": step_dt(first=first_dt)}


@dataclass(frozen=True)
class Variant:
    """A filter with its rule for standing still, its first time step, and the column of the headings that it is given."""

    name: str
    params: FilterParams = FilterParams()
    rule: str = "context"
    first_dt: float | None = None
    heading: str = "heading"


def fuse_variants(df: DataFrame, variants: list[Variant]) -> DataFrame:
    """``df`` with, for each variant, ``<name>_`` before the filter's states and its errors ``pos_error_m`` and ``open_loop_error_m``.

    One pass over the rows runs all filters. The time step, a window over drives, leaves them clustered and sorted, so nothing is shuffled
    for the filters, and all columns pass through, so nothing is joined back. Kept names are those of ``df``.
    """
    own = {}
    for k, v in enumerate(variants):
        own |= {f"_{k}_{c}": x for c, x in _inputs(df, v.params, v.rule, v.first_dt).items()}
    rows = df.withColumn("_aggressive", F.col("style") == "aggressive").withColumns({c: x for c, x in own.items() if not c.endswith("_dt")})
    rows = rows.withColumns({c: x for c, x in own.items() if c.endswith("_dt")}).sortWithinPartitions("drive_id", "rn")
    added = [f"{v.name}_{c}" for v in variants for c in [*_FUSED, "pos_error_m", "open_loop_error_m"]]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    kept = df.columns

    def run(pieces):
        held, size, carried = [], 0, [{} for _ in variants]

        def done():
            pdf = pd.concat(held, ignore_index=True)
            last, new = pdf["drive_id"].iloc[-1], {}
            for k, v in enumerate(variants):
                part = pd.DataFrame({c: pdf[c] for c in ("drive_id", "rn", "ai_speed", "ai_speed_std", "gyro_z", "in_outage", "pos_x", "pos_y", "speed")})
                part = part.assign(dt=pdf[f"_{k}_dt"], still=pdf[f"_{k}_still"], tunnel=pdf[f"_{k}_tunnel"], heading=pdf[v.heading], aggressive=pdf["_aggressive"])
                got, states = run_filter(part, v.params, carried[k])
                carried[k] = {last: states[last]}
                new |= {f"{v.name}_{c}": got[g].to_numpy() for c, g in zip(_FUSED, [*STATE, "open_loop_pos_x", "open_loop_pos_y"], strict=True)}
                for c, x, y in (("pos_error_m", "fused_pos_x", "fused_pos_y"), ("open_loop_error_m", "open_loop_pos_x", "open_loop_pos_y")):
                    new[f"{v.name}_{c}"] = np.hypot(got[x] - pdf["pos_x"], got[y] - pdf["pos_y"]).to_numpy()
            return pd.concat([pdf[kept], pd.DataFrame(new)], axis=1)

        for pdf in pieces:
            if len(pdf):
                held.append(pdf)
                size += len(pdf)
            if size >= _PIECE:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return rows.mapInPandas(run, schema)


_FUSED = [*(c.removeprefix("fused_") for c in STATE), "open_loop_pos_x", "open_loop_pos_y"]


def fuse(df: DataFrame, params: FilterParams = FilterParams(), rule: str = "context", first_dt: float | None = None) -> DataFrame:
    """Rows of ``df`` (truth, sensors, ai_speed, ai_speed_std, in_outage, context_mode) with the filter's states and errors.

    ``rule`` 'context' stops the filter at a standstill context; 'rest' where acceleration is that of gravity and turn and speed are small.
    """
    out = fuse_variants(df, [Variant("fused", params, rule, first_dt)])
    names = {"fused_open_loop_pos_x": "open_loop_pos_x", "fused_open_loop_pos_y": "open_loop_pos_y", "fused_open_loop_error_m": "open_loop_error_m"}
    return out.withColumnsRenamed(names)


def stages() -> list[Variant]:
    """Three stages of the filter: five states on headings derived from places, six on these, six on the headings given.

    They need the column ``course``, what ``hold_course`` adds.
    """
    return [Variant("five_states", FilterParams(legacy=True, nhc=False), heading="course"), Variant("six_states", heading="course"), Variant("given_heading")]
