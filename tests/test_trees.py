"""The shared trainer against trees grown one row at a time, at all sizes of nodes, with nulls, folds, settings, quantiles."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolith.operators import models, trees

NAMES = ["a", "b", "c", "d"]


def table(spark, n=1000, seed=1, null=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = np.abs(3 + 2 * x[:, 0] * (x[:, 1] > 0) + x[:, 2] ** 2 + 0.1 * rng.normal(size=n))
    x[rng.random((n, 4)) < null] = np.nan
    rows = [(int(i % 5), int(i), *[None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)], float(t), "PQR"[i % 3]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "drive_id long, rn long, a double, b double, c double, d double, y double, who string").withColumn("setting", F.lit(0)).repartition(3), x, y


def fitted(spark, df, specs, group=None):
    edges = trees.bin_edges(df, NAMES)
    data = trees.binned(df, NAMES, edges, group).persist()
    return trees.fit(data, specs, NAMES, edges), data, edges


def brute(codes, g, h, depth, s):
    """Every threshold of every feature and both ways for nulls, by sums over rows; the tree as nested tuples."""
    value = -s.step * g.sum() / (h.sum() + s.l2)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.l2)
    best = (max(s.gamma, 1e-12), None)
    whole = np.ones(len(g), bool)
    for null_left in (False, True):
        for f in range(codes.shape[1]):
            for b in range(1, codes[:, f].max(initial=1)):
                left = np.where(codes[:, f] == 0, null_left, codes[:, f] <= b)
                if min(h[left].sum(), h[~left].sum()) >= s.least and left.any() and not left.all():
                    gain = (score(left) + score(~left) - score(whole)) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b, null_left, left))
    if not depth or best[1] is None:
        return value
    f, b, null_left, left = best[1]
    return f, best[0], brute(codes[left], g[left], h[left], depth - 1, s), brute(codes[~left], g[~left], h[~left], depth - 1, s)


def same(tree, k, want):
    if isinstance(want, float):
        assert tree.feature[k] == -1 and tree.value[k] == pytest.approx(want, abs=1e-9)
        return
    assert tree.feature[k] == want[0] and tree.gain[k] == pytest.approx(want[1], rel=1e-9)
    same(tree, tree.left[k], want[2])
    same(tree, tree.right[k], want[3])


@pytest.mark.parametrize("small", [10**6, 300, 40])
def test_second_order_trees_equal_brute_force(spark, monkeypatch, small):
    """Whole trees in a task, subtrees of nodes with few rows, and almost all by histograms."""
    monkeypatch.setattr(trees, "SMALL", small)
    df, x, y = table(spark)
    s = trees.Spec("m", (0, 1, 2, 3), "second_order", 3, 4, 0.3, l2=1.0, gamma=0.05, least=5.0)
    got, data, edges = fitted(spark, df, [s])
    codes = trees.codes_of(x, edges[0])
    base, pred = y.mean(), np.full(len(y), y.mean())
    assert got["m"].base == pytest.approx(base)
    for t, tree in enumerate(got["m"].trees):
        same(tree, 0, brute(codes, pred - y, np.ones(len(y)), 4, s))
        pred = pred + tree.arrays().value[tree.arrays().nodes(codes)]
        assert len(got["m"].trees) > t
    p = trees.predictions(data, got, ["rn"]).toPandas().sort_values("rn")
    assert np.allclose(p.p_m, np.maximum(pred, 0))


def test_big_nodes_equal_small_ones(spark, monkeypatch):
    df, _, _ = table(spark, 800, 2, 0.0)
    specs = [trees.Spec("f", (0, 1, 2, 3), "forest", 5, 6), trees.Spec("q", (0, 1, 2), "quantile", 4, 3, 0.5, least=20, alpha=0.9), trees.Spec("s", (1, 2, 3), "squared", 4, 4, 0.2, least=20)]
    got, data, _ = fitted(spark, df, specs)
    small = trees.predictions(data, got, ["rn"]).toPandas().sort_values("rn")
    monkeypatch.setattr(trees, "SMALL", 60)
    monkeypatch.setattr(trees, "NODES", 3)
    big = trees.predictions(data, fitted(spark, df, specs)[0], ["rn"]).toPandas().sort_values("rn")
    for n in ("p_f", "p_s"):
        assert np.allclose(small[n], big[n], atol=1e-6), n
    assert np.abs(small.p_q - big.p_q).mean() < 0.01  # sketches and sorted rows give the same value of a row


def test_quantile_leaves_and_coverage(spark):
    df, x, y = table(spark, 3000, 3)
    s = [trees.Spec(f"q{a}", (0, 1, 2, 3), "quantile", 40, 4, 0.2, least=20, alpha=a) for a in (0.05, 0.95)]
    train, test = df.where("rn % 3 > 0"), df.where("rn % 3 = 0")
    edges = trees.bin_edges(train, NAMES)
    data = trees.binned(train, NAMES, edges).persist()
    got = trees.fit(data, s, NAMES, edges)
    rows = np.arange(len(y)) % 3 > 0
    codes, yy = trees.codes_of(x, edges[0])[rows], y[rows]
    for m in got.values():  # the first tree's leaves, by a loop over its rows
        w = m.trees[0].arrays()
        leaf = w.nodes(codes)
        for k in np.unique(leaf):
            assert w.value[k] == pytest.approx(0.2 * np.quantile(yy[leaf == k] - m.base, m.spec.alpha, method="inverted_cdf"), abs=1e-9)
    p = trees.predictions(trees.binned(test, NAMES, edges), got, ["y"]).toPandas()
    inside = ((p.y >= p["p_q0.05"]) & (p.y <= p["p_q0.95"])).mean()
    assert 0.84 < inside < 0.96


def test_forests_settings_and_folds(spark):
    """Bootstrap weights average one; a fold's model is that of its rows alone; settings don't mix."""
    w = trees._weights(np.arange(20000), 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.06)
    df, _, _ = table(spark, 600, 4)
    s = trees.Spec("m", (0, 1, 2, 3), "forest", 4, 5)
    both = df.unionByName(df.withColumn("setting", F.lit(1)).withColumn("y", F.col("y") * 10 + 5))
    edges = trees.bin_edges(both, NAMES)
    data = trees.binned(both, NAMES, edges, "who").persist()
    got = trees.fit(data, [dataclasses.replace(s, name="p", held="P"), dataclasses.replace(s, name="one", setting=1)], NAMES, edges)
    own = trees.fit(trees.binned(df.where("who <> 'P'"), NAMES, edges, "who"), [s], NAMES, edges)
    assert [t.feature for t in got["p"].trees] == [t.feature for t in own["m"].trees]
    p = trees.predictions(data, got, ["setting", "y"]).toPandas()
    assert p[p.setting == 0].p_p.notna().all() and p[p.setting == 0].p_one.isna().all() and p[p.setting == 1].p_one.mean() > 20
    assert sum(got["one"].importances().values()) == pytest.approx(1)


def test_odd_tables(spark):
    df, _, _ = table(spark, 50, 5)
    empty, _, _ = fitted(spark, df.where("false"), []), None, None
    assert empty[0] == {}
    same_y = df.withColumn("y", F.lit(2.0)).withColumn("a", F.lit(None).cast("double"))
    got, data, _ = fitted(spark, same_y.unionByName(same_y.withColumn("y", F.lit(None).cast("double"))), [trees.Spec("f", (0, 1, 2, 3), "forest", 2, 3), trees.Spec("q", (0, 1), "quantile", 2, 2, least=1.0)])
    p = trees.predictions(data, got, ["rn"]).toPandas()
    assert (p.p_f == 2).all() and (p.p_q == 2).all() and all(t.feature == [-1] for t in got["f"].trees)
    with pytest.raises(ValueError, match="losses"):
        trees.fit(data, [trees.Spec("x", (0,), "cubic")], NAMES, {0: []})


@pytest.mark.parametrize("kind,method", [("second_order", "conformal"), ("hist", "quantile")])
def test_speed_models_of_these_trees_survive_saving(spark, tmp_path, kind, method):
    df, _, _ = table(spark, 300, 6)
    m = models.SpeedModel(kind, method, {"trees": 6, "depth": 3, "least": 5}).train(df.where("rn % 2 = 0"), NAMES, df.where("rn % 2 = 1"))
    p = m.predict(df).toPandas().sort_values("rn")
    assert (p.v_pred >= 0).all() and (p.v_std > 0).all() and m.evaluate(df)["mae"] < df.toPandas().y.std() and len(m.importances(2)) == 2
    m.save(spark, str(tmp_path / "m"))
    again = models.SpeedModel.load(spark, str(tmp_path / "m")).predict(df).toPandas().sort_values("rn")
    assert np.allclose(p.v_pred, again.v_pred) and np.allclose(p.v_std, again.v_std)


def test_histograms_add_up(spark):
    df, x, y = table(spark, 500, 7)
    got, data, edges = fitted(spark, df, [trees.Spec("m", (0, 2), "squared", 0, 3)])
    rows = trees.histograms(data, got["m"]).toPandas()
    codes = trees.codes_of(x, edges[0])
    for f, c in (("a", 0), ("c", 2)):
        own = rows[rows.feature == f].set_index("bin")
        for b in np.unique(codes[:, c]):
            m = codes[:, c] == b
            assert own.n[b] == m.sum() and own.g[b] == pytest.approx((y.mean() - y[m]).sum())
    assert set(rows.feature) == {"a", "c"}


def test_exact_edges_are_the_least_values_that_reach_a_share(spark):
    """Also where a sketch of the size used is off by some ranks, with ties, nulls and a feature without values."""
    n = 60_000
    rows = spark.range(n).select(F.lit(3).alias("setting"), (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / 1e3).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    got, pdf = trees.bin_edges(rows, ["a", "b", "c"], exact=True)[3], rows.toPandas()
    for e, c in zip(got, "abc", strict=True):
        v = np.sort(pdf[c].dropna().to_numpy(float))
        want = np.unique([v[-(-k * len(v) // trees.BINS) - 1] for k in range(1, trees.BINS)]) if len(v) else np.zeros(0)
        assert np.array_equal(e, want)
