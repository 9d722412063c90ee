"""Forests whose trees are grown whole in tasks, and nodes whose sums are what their siblings leave of their parents'."""

import numpy as np
from pyspark.sql import functions as F

from odolith.operators import trees


def made(n=900, seed=8):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 33, (n, 6)).astype(np.uint8)
    y = np.abs(codes[:, 0] / 5.0 + (codes[:, 1] > 9) * codes[:, 2] / 7.0 + rng.normal(size=n))
    return codes, y, rng.integers(1, 4, n).astype(float)


def test_only_the_smaller_of_two_siblings_is_counted(monkeypatch):
    codes, y, w = made()
    s = trees.Spec("f", tuple(range(6)), depth=8)
    counted, whole = [], trees._added_up
    monkeypatch.setattr(trees, "_added_up", lambda by, rows, *a: (counted.append(sum(map(len, rows))), whole(by, rows, *a))[1])
    few = trees.grow(codes, -w * y, w, y, 8, s, 33)
    once = sum(counted)
    monkeypatch.setattr(trees, "_PARENTS", 0)
    every = trees.grow(codes, -w * y, w, y, 8, s, 33)
    assert once < 0.7 * (sum(counted) - once)
    assert (few.feature, few.bin, few.left) == (every.feature, every.bin, every.left) and np.allclose(few.value, every.value) and len(few.feature) > 150


def test_equal_splits_go_to_the_first_feature_whatever_the_last_bits():
    codes, y, w = made(12)
    codes = np.stack([codes[:, 0], 34 - np.maximum(codes[:, 0], 1), codes[:, 0]], 1).astype(np.uint8)  # the same order, turned round, and again
    tree = trees.grow(codes, -w * y, w, y, 4, trees.Spec("f", (0, 1, 2), depth=4), 35)
    assert set(tree.feature) == {-1, 0}


def test_whole_trees_equal_those_of_dealt_nodes(spark, monkeypatch):
    codes, y, _ = made(700)
    names = list("abcdef")
    rows = [(i % 5, i, "PQ"[i % 2], float(t), *[float(v) for v in r]) for i, (r, t) in enumerate(zip(codes, y, strict=True))]
    df = spark.createDataFrame(rows, "drive_id long, rn long, who string, y double, " + ", ".join(f"{c} double" for c in names)).withColumn("setting", F.lit(0)).repartition(3)
    edges = trees.bin_edges(df, names)
    data = trees.binned(df, names, edges, "who").persist()
    specs = [trees.Spec("all", tuple(range(6)), trees=9, depth=7), trees.Spec("held", (1, 2, 5), trees=3, depth=5, held="P"), trees.Spec("none", (0,), trees=2, setting=4)]
    calls, dealt = [], trees._small_nodes
    monkeypatch.setattr(trees, "_small_nodes", lambda *a: (calls.append(1), dealt(*a))[1])
    whole = trees.fit(data, specs, names, edges)
    assert not calls  # rows were dealt once for a task, and not once for each tree
    monkeypatch.setattr(trees, "WHOLE_FOREST", 0)
    each = trees.fit(data, specs, names, edges)
    monkeypatch.setattr(trees, "SMALL", 5)
    big = trees.fit(data, specs, names, edges)
    a, b, c = (trees.predictions(data, m, ["rn"]).toPandas().sort_values("rn") for m in (whole, each, big))
    assert [len(m.trees) for m in whole.values()] == [9, 3, 2] and {f for t in whole["held"].trees for f in t.feature} == {-1, 1, 2, 5}
    own = trees.predictions(data, {"held": whole["held"]}, ["rn", "grp"], held=True).toPandas().sort_values("rn")
    assert np.array_equal(own.p_held.notna(), own.grp == "P") and np.array_equal(own.p_held[own.grp == "P"], a.p_held[(own.grp == "P").to_numpy()])
    for p in ("p_all", "p_held"):
        assert np.allclose(a[p], b[p]) and np.allclose(a[p], c[p]), p


def test_sketches_of_edges_are_off_by_few_ranks_and_leave_out_what_is_no_value(spark, monkeypatch):
    monkeypatch.setattr(trees, "RANKS", 40)
    df = spark.range(6000).select(F.pmod("id", F.lit(2)).cast("int").alias("setting"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / 8.0).alias("a"), F.when(F.col("id") % 3 > 0, F.lit(float("nan"))).otherwise(F.col("id") % 4).alias("b b"), F.lit(None).cast("double").alias("c"))
    got, pdf = trees.bin_edges(df, ["a", "b b", "c"]), df.toPandas()
    for k in (0, 1):
        v = np.sort(pdf[pdf.setting == k]["a"].dropna().to_numpy())
        want = np.array([-(-q * len(v) // trees.BINS) for q in range(1, trees.BINS)])
        assert len(got[k][0]) == len(want) and np.abs(np.searchsorted(v, got[k][0], "right") - want).max() <= len(v) / 40 + 8
        assert set(got[k][1]) <= set(pdf[pdf.setting == k]["b b"].dropna()) and len(got[k][1]) and not len(got[k][2])
