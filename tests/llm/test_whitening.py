"""Whitening against plain numpy: distinct fit list, exact deviations, unit covariance, lengths, odd rows."""

import numpy as np
import pytest

from odolith.llm import whitening
from odolith.llm.queries import QUERIES

KIND = "vec_id long, embedding array<double>, x string, n int, w array<double>"


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", 1, [2.0]) for i, v in rows], kind).repartition(3)


def plain(vectors):
    """{vector as a tuple: (deviation, whitened by component, explained)} and the components' number, from centred values and numpy's covariance."""
    x = np.array(sorted({tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for v in vectors}), np.int64)
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    v = np.cov(y.T, bias=True).reshape(x.shape[1], x.shape[1])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    return n, e / np.trace(v), {tuple(a): (int(((n * a - s).astype(object) ** 2).sum()), b / np.sqrt(e)) for a, b in zip(x, y @ u, strict=True)}


def check(got, rows):
    n, explained, by = plain([v for _, v in rows])
    want = {i: by[tuple(int(np.floor(64 * c)) + 1_000_000 for c in v)] for i, v in rows}
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        dev, w = want[r["vec_id"]]
        k = r["component"] - 1
        s = sign.setdefault(k, np.sign(r["whitened"] * w[k]))
        assert r["n"] == n and r["deviation"] == dev
        assert r["whitened"] * s == pytest.approx(w[k], abs=1e-7)
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9) and r["identity_error"] < 1e-9


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 24)) @ np.diag(np.linspace(0.2, 3, 24))
    rows = list(enumerate([*base, *base[:40], *[base[0]] * 200]))  # one vector holds more than half of the rows
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 16 * len(rows)
    check(got, rows)


def test_the_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op12_embedding_whitening"](spark, sf).collect()
    assert len(got) == 16 * len(rows)
    check(got, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    some, short = rng.normal(size=(30, 5)), rng.normal(size=(20, 2))
    bad = [None, [], [None] * 5, [float("nan")] + [0.0] * 4, [float("inf")] + [1.0] * 4, [1.0, None, 1.0, 1.0, 1.0]]
    rows = [*enumerate(some), *[(100 + k, v) for k, v in enumerate(short)], (7, some[7]), (200, [1.0, 2.0, 3.0])]
    got = whitening.whiten(frame(spark, [*rows, *[(300 + k, v) for k, v in enumerate(bad)], (None, some[0])])).collect()
    assert {r["vec_id"] for r in got} == {*range(30), *range(100, 120), None}  # one vector of its length has no component
    assert sum(r["vec_id"] == 7 for r in got) == 10 and sum(r["vec_id"] is None for r in got) == 5
    check([r for r in got if r["vec_id"] in range(30)], list(enumerate(some)))
    check([r for r in got if r["vec_id"] in range(100, 120)], [(100 + k, v) for k, v in enumerate(short)])
    assert not whitening.whiten(frame(spark, [])).collect() and not whitening.whiten(frame(spark, [(1, None)])).collect()


def test_dependent_dimensions_and_several_aggregations(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a = rng.integers(-50, 50, size=(60, 2))
    v = np.c_[a, a[:, 0], 0 * a[:, 0] + 3] / 64
    once = whitening.whiten(frame(spark, list(enumerate(v)))).collect()
    assert {r["component"] for r in once} == {1, 2} and all(r["identity_error"] < 1e-9 for r in once)
    monkeypatch.setattr(whitening, "PAIRS", 3)
    again = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(frame(spark, list(enumerate(v)))).collect()}
    assert all(abs(again[r["vec_id"], r["component"]]) == pytest.approx(abs(r["whitened"]), abs=1e-9) for r in once)


def test_deviations_beyond_a_long_and_huge_entries(spark):
    rows = [(0, [1e9, 0.0]), (1, [-1e9, 1.0]), (2, [1e300, 2.0]), (3, [0.0, 5.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, rows)).collect()}
    assert {k[0] for k in got} == {0, 1, 2, 3} and all(r["deviation"] is None and np.isfinite(r["whitened"]) for r in got.values())
