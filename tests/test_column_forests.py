"""Forests of more rows than a task has whole: features are dealt out, rows are shuffled once, and the trees are those that are grown whole."""

import numpy as np
from pyspark.sql import functions as F

from odolith.operators import trees


def test_dealt_features_grow_the_same_trees_without_dealing_rows_again(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, (1500, 9)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 8] = x[:, 2]  # ties
    y = np.abs(np.nan_to_num(x[:, 0]) / 5 + (x[:, 1] > 9) * np.nan_to_num(x[:, 2]) / 7).round(1)
    names = [f"x{k}" for k in range(9)]
    rows = [(i % 5, i, "PQ"[i % 2], None if i % 50 == 7 else float(t), i % 3 // 2, *[None if np.isnan(v) else float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "drive_id long, rn long, who string, y double, setting int, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    edges = trees.bin_edges(df, names)
    data = trees.binned(df, names, edges, "who").persist()
    specs = [trees.Spec("all", tuple(range(9)), trees=3, depth=6), trees.Spec("held", (1, 2, 5), trees=2, depth=3, held="P"), trees.Spec("other", tuple(range(9)), trees=2, depth=3, setting=1), trees.Spec("none", (0,), trees=2, setting=4)]
    whole = trees.fit(data, specs, names, edges)
    monkeypatch.setattr(trees, "WHOLE_FOREST", 0)
    calls, dealt = [], trees._small_nodes
    monkeypatch.setattr(trees, "_small_nodes", lambda *a: (calls.append(1), dealt(*a))[1])
    once = trees.fit(data, specs, names, edges)
    assert not calls  # no node's rows were dealt out
    codes = trees._Rows(data.toArrow().combine_chunks().to_batches()[0]).codes
    for s in specs:
        assert len(once[s.name].trees) == len(whole[s.name].trees) == s.trees
        for a, b in zip(whole[s.name].trees, once[s.name].trees, strict=True):
            assert sorted(zip(a.feature, a.bin, a.null_left, strict=True)) == sorted(zip(b.feature, b.bin, b.null_left, strict=True))
            assert np.allclose(sorted(a.gain), sorted(b.gain)) and np.array_equal(sorted(a.cover), sorted(b.cover))
            assert np.allclose(*(t.arrays().value[t.arrays().nodes(codes)] for t in (a, b)), rtol=1e-12)
    assert trees.Ensemble.unpacked(once["all"].packed()).trees[0].feature == list(once["all"].trees[0].feature)
    # beyond what a task holds of features, nodes' rows are dealt out
    monkeypatch.setattr(trees, "COLUMNS", 0)
    apart = trees.fit(data, specs[1:2], names, edges)["held"]
    assert calls and np.allclose(apart.of(codes), whole["held"].of(codes))
    assert data.where(F.col("setting") == 1).count()
