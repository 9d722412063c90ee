"""Embedding links against brute force: recall, lengths, repeated and null ids, copies, crowded cells, and the index itself."""

from collections import defaultdict

import numpy as np
import pytest

from odolith.llm import components, vectors

KIND = "vec_id long, embedding array<double>, home string, cell long, copies long"


def brute(rows):
    """{row: (n_links, component)} with rows (id, vector or None) whose ids are distinct and not null."""
    ids = np.array([r[0] for r in rows])
    a, b, deg = [], [], np.zeros(len(rows), int)
    by = defaultdict(list)
    for k, (_, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[len(v)].append(k)
    for of in by.values():
        u = vectors.unit(np.array([rows[k][1] for k in of]))
        i, j = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
        for x, y in zip(i, j, strict=True):
            a.append(of[x])
            b.append(of[y])
            deg[of[x]] += 1
            deg[of[y]] += 1
    lab = components.local_labels(len(rows), np.array(a, int), np.array(b, int))
    low = {}
    for k, c in enumerate(lab):
        low[c] = min(low.get(c, ids[k]), ids[k])
    return {int(ids[k]): (int(deg[k]), int(low[c])) for k, c in enumerate(lab)}, len(a)


def compare(spark, rows, least=0.95, kind=KIND, parts=5):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "h", 1, 2) for i, v in rows], kind).repartition(parts)
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    want, n = brute(rows)
    assert set(got) == set(want)
    assert sum(r["n_links"] for r in got.values()) / 2 >= least * n and all(r["n_links"] <= want[i][0] for i, r in got.items())
    if sum(r["n_links"] for r in got.values()) == 2 * n:
        assert all((r["n_links"], r["component_id"]) == want[i] for i, r in got.items())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    return got


def near(rng, n_base, each, dim, spread=0.08):
    base = rng.normal(size=(n_base, dim))
    return np.concatenate([base, np.repeat(base, each, 0) + spread * rng.normal(size=(n_base * each, dim))])


@pytest.mark.parametrize("kind", [KIND, KIND.replace("double", "float")])
def test_links_equal_brute_force_at_all_lengths(spark, kind):
    rng = np.random.default_rng(6)
    rows = list(enumerate([*near(rng, 40, 8, 16), *near(rng, 10, 6, 5), *near(rng, 6, 6, 40), [1.0, 2.0], [2.0, 4.0], [-3.0], [5.0], [1.0, -0.0], [1.0, 0.0]]))
    n = len(rows)
    if "float" in kind:
        rows = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
    rows += [(n + k, v) for k, v in enumerate([None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, []])]
    got = compare(spark, rows, kind=kind)
    assert got[n - 5]["component_id"] == n - 6 and got[n - 3]["n_links"] == 0 and got[n - 1]["n_links"] == 1
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["kept"] for k in range(6))


@pytest.mark.parametrize("block", [16, 8192])
def test_copies_and_crowded_cells(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(7)
    one = rng.normal(size=8)
    x = [*(one + 0.05 * rng.normal(size=(150, 8))), *[one] * 40, *rng.normal(size=(30, 8))]
    compare(spark, [(3 * i + 5, v) for i, v in enumerate(x)], parts=7)


def test_a_fine_grid_keeps_the_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 2)
    rng = np.random.default_rng(8)
    x = near(rng, 150, 5, 12, 0.15)
    compare(spark, list(enumerate(x)), 0.93)


def test_repeated_and_null_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, a), (None, a), (4, a), (4, a), (4, b), (9, b), (7, [0.0, 0.0, 1.0]), (7, None), (None, None)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert len(got) == len(rows)
    assert {(r["vec_id"], r["component_id"]) for r in got if r["vec_id"] in (4, 9)} == {(4, None), (9, None)}, got  # 4 is one node, so both groups are one
    assert all(r["component_id"] == 7 and r["kept"] and r["n_links"] == 0 for r in got if r["vec_id"] == 7)
    assert sum(r["n_links"] for r in got if r["vec_id"] == 9) == 1


def test_empty_tables_and_tables_without_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], kind)).count() == 0
    got = vectors.near_vectors(spark.createDataFrame([(1, None), (2, [0.0]), (2, [])], kind)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_cells_are_those_within_the_margin():
    rng = np.random.default_rng(9)
    u = vectors.unit(rng.normal(size=(300, 10)))
    ix = vectors.fit(u, 300 * vectors.PER_CELL)
    d = np.stack([((u[:, None, :5] - ix.books[0][None]) ** 2).sum(2)[:, c // len(ix.books[1])] + ((u[:, None, 5:] - ix.books[1][None]) ** 2).sum(2)[:, c % len(ix.books[1])] for c in range(len(ix.books[0]) * len(ix.books[1]))], 1)
    for k, cells in enumerate(ix.cells(u)):
        assert cells[0] == d[k].argmin() == ix.homes(u[k : k + 1])[0] and len(set(cells.tolist())) == len(cells)
        assert set(cells.tolist()) == set(np.flatnonzero(d[k] <= d[k].min() + ix.margin + 1e-12).tolist())


def test_traversal_meets_the_nearest_cells_first():
    rng = np.random.default_rng(3)
    for k, margin in ((1, 0.0), (5, 0.3), (12, 2.0), (9, 1e9)):
        ix = vectors.Index(rng.normal(size=(k, 4)), rng.normal(size=(k + 2, 4)), margin)
        u = vectors.unit(rng.normal(size=(60, 8)))
        a, b = ix._gaps(u)
        for r, cells in enumerate(ix.cells(u)):
            gap = (a[r][:, None] + b[r][None, :]).ravel()  # cell (i, j) is number i * len(second) + j
            assert sorted(cells) == np.flatnonzero(gap <= margin).tolist()
            assert (np.diff(gap[cells]) >= 0).all() and cells[0] == ix.homes(u[r : r + 1])[0]
    assert ix.cells(np.zeros((0, 8))) == []
