"""Boosted trees by levels: in one task or a job a level, the same trees; and steps that mustn't meet in one task."""

import dataclasses
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolith.operators import models, trees

NAMES = [f"x{k}" for k in range(40)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 40)).round(3)
    y = np.abs(2 + x[:, 0] + x[:, 33] * (x[:, 5] > 0))
    x[rng.random(x.shape) < 0.05] = np.nan
    made = [(i % 9, i, "AB"[i % 2], float(t), *[None if np.isnan(v) else float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(made, "drive_id long, rn long, who string, y double, " + ", ".join(f"{c} double" for c in NAMES)).withColumn("setting", F.lit(0)).repartition(3, "drive_id").persist()
    edges = trees.bin_edges(df, NAMES)
    return df, x, edges, trees.binned(df, NAMES, edges, "who").persist()


def jobs_of(spark, f):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    out = f()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def test_rounds_of_small_models_are_no_jobs_and_large_ones_grow_the_same_trees(spark, rows, monkeypatch):
    _, _, edges, data = rows
    s = trees.Spec("all", tuple(range(40)), "second_order", 12, 4, 0.3, l2=1.0, gamma=0.01, least=3.0)
    specs = [s, trees.Spec("held", tuple(range(30, 40)), "squared", 7, 3, 0.2, least=5.0, held="A")]
    small, jobs = jobs_of(spark, lambda: trees.fit(data, specs, NAMES, edges))
    assert jobs < 6  # and not one or more a round
    monkeypatch.setattr(trees, "WHOLE", 0)
    monkeypatch.setattr(trees, "NODES", 5)
    large = trees.fit(data, specs, NAMES, edges)
    for k in ("all", "held"):
        assert [t.feature for t in small[k].trees] == [t.feature for t in large[k].trees] and len(small[k].trees) == {"all": 12, "held": 7}[k]
    a, b = (trees.predictions(data, m, ["rn", "y"]).toPandas().sort_values("rn") for m in (small, large))
    assert np.allclose(a.p_all, b.p_all) and np.allclose(a.p_held, b.p_held) and (a.p_all - a.y).abs().mean() < (a.y.mean() - a.y).abs().mean() / 2


def test_edges_of_blocks_are_each_features_own(spark, rows):
    df, x, edges, _ = rows
    for k, e in enumerate(edges[0]):
        v = np.sort(x[~np.isnan(x[:, k]), k])
        want = np.unique([v[int(np.ceil(q * len(v) / trees.BINS)) - 1] for q in range(1, trees.BINS)])
        assert np.array_equal(e, want), k


def test_importance_is_spread_over_tasks(spark, rows, monkeypatch):
    df, _, edges, data = rows
    m = trees.fit(data, [trees.Spec("m", tuple(range(40)), "second_order", 5, 3, 0.5, l2=1.0)], NAMES, edges)["m"]
    parts = []
    whole = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda d, f, schema, *a: (parts.append(d.rdd.getNumPartitions()) if "gain" not in schema and schema.startswith("f int") else None, whole(d, f, schema, *a))[1])
    got = {r["feature"]: r["importance_mean"] for r in models.permutation_importance(m, df.drop("setting"), repeats=2).collect()}
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))] and max(got, key=got.get) == "x0"


def test_an_ablation_has_no_more_jobs_for_more_rounds(spark, rows):
    df = rows[0].drop("setting", "who")
    s = trees.Spec("m", (), "second_order", 2, 3, 0.5, l2=1.0)
    few, jobs = jobs_of(spark, lambda: models.feature_ablation(df.where("rn % 3 > 0"), df.where("rn % 3 = 0"), s).collect())
    more, same = jobs_of(spark, lambda: models.feature_ablation(df.where("rn % 3 > 0"), df.where("rn % 3 = 0"), dataclasses.replace(s, trees=9)).collect())
    assert jobs == same and [r["n_features"] for r in more] == [40] * 4 and all(b["mae"] < a["mae"] for a, b in zip(few, more, strict=True))
