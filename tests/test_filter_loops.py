"""The batched filter against the formulas written out for one drive, row by row, with plain lists."""

import math

import numpy as np
import pandas as pd
import pytest

from odolith.operators import ekf


def matmul(a, b):
    return [[sum(a[i][k] * b[k][j] for k in range(len(b))) for j in range(len(b[0]))] for i in range(len(a))]


def transposed(a):
    return [list(r) for r in zip(*a, strict=True)]


def diagonal(v):
    return [[v[i] if i == j else 0.0 for j in range(len(v))] for i in range(len(v))]


def inverse(a):
    n = len(a)
    m = [list(r) + diagonal([1.0] * n)[i] for i, r in enumerate(a)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        m[i] = [v / m[i][i] for v in m[i]]
        for r in range(n):
            if r != i:
                m[r] = [v - m[r][i] * w for v, w in zip(m[r], m[i], strict=True)]
    return [r[n:] for r in m]


def wrap(a):
    return (a + math.pi) % (2 * math.pi) - math.pi


def measure(x, p, rows, innovation, noise, frozen):
    """A measurement of single states, Joseph form; the gains of ``frozen`` states are zero."""
    n = len(x)
    h = [[1.0 if j == r else 0.0 for j in range(n)] for r in rows]
    s = matmul(matmul(h, p), transposed(h))
    s = [[v + (noise[i] if i == j else 0.0) for j, v in enumerate(r)] for i, r in enumerate(s)]
    k = matmul(matmul(p, transposed(h)), inverse(s))
    k = [[0.0] * len(rows) if i in frozen else r for i, r in enumerate(k)]
    x = [v + sum(k[i][j] * innovation[j] for j in range(len(rows))) for i, v in enumerate(x)]
    a = [[(1.0 if i == j else 0.0) - v for j, v in enumerate(r)] for i, r in enumerate(matmul(k, h))]
    p = [[u + v for u, v in zip(r, w, strict=True)] for r, w in zip(matmul(matmul(a, p), transposed(a)), matmul(matmul(k, diagonal(noise)), transposed(k)), strict=True)]
    return x, p


def six_states(rows, aggressive=False):
    x = [rows[0]["pos_x"], rows[0]["pos_y"], rows[0]["speed"], 0.0, rows[0]["heading"], 0.0]
    p = diagonal([4.0, 4.0, 1.0, 0.25, 0.05, 0.0001])
    for r in rows:
        dt, sigma, gyro = r["dt"], r["ai_speed_std"], r["gyro_z"]
        f = diagonal([1.0] * 6)
        if r["still"]:
            v = lat = 0.0
            h = x[4]
            f[2][2] = f[3][3] = 0.0
        else:
            alpha = 0.25 / (1 + 1.5 * max(0.0, sigma))
            v, lat = (1 - alpha) * x[2] + alpha * r["ai_speed"], 0.9 * x[3]
            h = wrap(x[4] + (gyro - x[5]) * dt)
            s, c = math.sin(h), math.cos(h)
            f[0][2], f[0][3], f[0][4], f[0][5] = (1 - alpha) * s * dt, 0.9 * c * dt, (v * c - lat * s) * dt, -(v * c - lat * s) * dt * dt
            f[1][2], f[1][3], f[1][4], f[1][5] = (1 - alpha) * c * dt, -0.9 * s * dt, -(v * s + lat * c) * dt, (v * s + lat * c) * dt * dt
            f[2][2], f[3][3], f[4][5] = 1 - alpha, 0.9, -dt
        s, c = math.sin(h), math.cos(h)
        x = [x[0] + (v * s + lat * c) * dt, x[1] + (v * c - lat * s) * dt, v, lat, h, x[5]]
        q = [0.05**2, 0.05**2, (0.20 if aggressive else 0.12) + 1.5 * sigma**2, 0.05**2, 0.003**2, (1e-6 * (0.1 if r["tunnel"] else 1.0)) ** 2]
        p = [[v + (q[i] if i == j else 0.0) for j, v in enumerate(w)] for i, w in enumerate(matmul(matmul(f, p), transposed(f)))]
        x, p = measure(x, p, [3], [-x[3]], [(0.25 if aggressive else 0.05) ** 2], {5})
        if r["still"]:
            x, p = measure(x, p, [2, 3], [-x[2], -x[3]], [0.04**2] * 2, {0, 1, 4, 5})
        open_loop = x[:2]
        if not r["in_outage"]:
            x, p = measure(x, p, [0, 1, 2], [r["pos_x"] - x[0], r["pos_y"] - x[1], r["speed"] - x[2]], [4.0, 4.0, 0.16], {4, 5})
            x, p = measure(x, p, [4], [wrap(r["heading"] - x[4])], [0.12**2 * (1 + (1.5 / max(r["speed"], 0.2)) ** 2)], {0, 1, 2, 3})
            x[4] = wrap(x[4])
        yield [*x, *open_loop]


def five_states(rows, aggressive=False):
    x = [rows[0]["pos_x"], rows[0]["pos_y"], rows[0]["speed"], rows[0]["heading"], 0.0]
    p = diagonal([4.0, 4.0, 1.0, 0.05, 0.0001])
    for r in rows:
        dt, sigma = r["dt"], r["ai_speed_std"]
        f = diagonal([1.0] * 5)
        if r["still"]:
            v, h = 0.0, x[3]
            f[2][2] = 0.0
        else:
            alpha = 0.25 / (1 + 1.5 * max(0.0, sigma))
            v, h = (1 - alpha) * x[2] + alpha * r["ai_speed"], wrap(x[3] + (r["gyro_z"] - x[4]) * dt)
            s, c = math.sin(h), math.cos(h)
            f[0][2], f[0][3], f[0][4] = (1 - alpha) * s * dt, v * c * dt, -v * c * dt * dt
            f[1][2], f[1][3], f[1][4] = (1 - alpha) * c * dt, -v * s * dt, v * s * dt * dt
            f[2][2], f[3][4] = 1 - alpha, -dt
        x = [x[0] + v * math.sin(h) * dt, x[1] + v * math.cos(h) * dt, v, h, x[4]]
        q = [0.05**2, 0.05**2, (0.20 if aggressive else 0.12) + 1.5 * sigma**2, 0.003**2, (1e-6 * (0.1 if r["tunnel"] else 1.0)) ** 2]
        p = [[v + (q[i] if i == j else 0.0) for j, v in enumerate(w)] for i, w in enumerate(matmul(matmul(f, p), transposed(f)))]
        if r["still"]:
            x, p = measure(x, p, [2], [-x[2]], [0.04**2], {0, 1, 3, 4})
        open_loop = x[:2]
        if not r["in_outage"]:
            x, p = measure(x, p, [0, 1, 2], [r["pos_x"] - x[0], r["pos_y"] - x[1], r["speed"] - x[2]], [4.0, 4.0, 0.16], {3, 4})
            if r["speed"] > 1.0:
                x, p = measure(x, p, [3], [wrap(r["heading"] - x[3])], [0.12**2], {0, 1, 2})
                x[3] = wrap(x[3])
        yield [x[0], x[1], x[2], 0.0, x[3], x[4], *open_loop]


def drive(k, n):
    rng = np.random.default_rng(k)
    speed = np.abs(rng.normal(4, 4, n)) * (rng.random(n) > 0.2)
    return pd.DataFrame({
        "drive_id": k, "rn": range(1, n + 1), "dt": rng.choice([0.1, 0.2, 1.0], n), "ai_speed": np.abs(speed + rng.normal(0, 1, n)), "ai_speed_std": rng.choice([0.0, 0.05, 0.5, 4.0], n), "gyro_z": rng.normal(0, 0.5, n),
        "still": rng.random(n) < 0.2, "tunnel": rng.random(n) < 0.2, "in_outage": (np.arange(n) > n // 3) & (np.arange(n) < n // 2), "pos_x": np.cumsum(speed), "pos_y": np.cumsum(rng.normal(0, 2, n)), "speed": speed, "heading": rng.uniform(-math.pi, math.pi, n), "aggressive": bool(k % 2),
    })


@pytest.mark.parametrize(("loop", "params"), [(six_states, ekf.FilterParams()), (five_states, ekf.FilterParams(legacy=True, nhc=False))])
def test_filters_equal_the_formulas_row_by_row(loop, params):
    parts = [drive(k, n) for k, n in ((1, 60), (2, 37), (3, 60), (4, 1))]
    got, _ = ekf.run_filter(pd.concat(parts, ignore_index=True), params)
    at = 0
    for p in parts:
        want = list(loop(p.to_dict("records"), bool(p.aggressive.iloc[0])))
        assert np.allclose(got.iloc[at : at + len(p), 2:].to_numpy(), np.array(want), rtol=1e-9, atol=1e-9)
        at += len(p)


def test_lateral_speed_after_one_constraint():
    f = ekf.Filter(np.array([[0.0, 0, 0, 2.5, 0, 0]]), [False])
    f.nhc()
    assert f.x[0, 3] == pytest.approx(2.5 * 0.0025 / 0.2525, abs=1e-12) and abs(f.x[0, 3]) < 0.5
    f.predict(np.array([0.1]), np.array([14.0]), np.array([0.2]), np.array([0.01]), np.array([False]), np.array([True]))
    assert np.isfinite(f.x).all()
