"""A random forest of the shared trainer as a speed model, and subtrees from histograms that fit a cache."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolith.operators import models, trees


def test_shared_forest_is_its_trees_and_survives_saving(spark, tmp_path):
    rows = [(i % 7, i, float(i * 37 % 101), float(i * 53 % 97) if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame([(*r, r[2] + (r[3] or 0.0) / 5) for r in rows], "drive_id long, rn long, a double, b double, y double").cache()
    m = models.SpeedModel(options={"trees": 5, "depth": 6}, shared=True).train(df, ["a", "b"])
    got = m.predict(df).toPandas().sort_values("rn")
    one = m.fitted["point"]
    each = one.each(trees.codes_of(got[["a", "b"]].to_numpy(float), one.edges))
    assert each.shape == (5, 600) and (one.spec.depth, one.spec.seed) == (6, 42)
    assert np.allclose(got.v_pred, np.maximum(each.mean(0), 0)) and np.allclose(got.v_std, np.maximum(each.std(0), 0.05))
    assert m.evaluate(df)["mae"] < 3 and m.importances(1)[0][0] == "a"
    m.save(spark, str(tmp_path / "m"))
    again = models.SpeedModel.load(spark, str(tmp_path / "m")).predict(df).select(F.col("rn"), "v_pred", "v_std").toPandas().sort_values("rn")
    assert np.array_equal(again.v_pred, got.v_pred) and np.array_equal(again.v_std, got.v_std)
    with pytest.raises(ValueError, match="shared forest"):
        models.SpeedModel("boosted", "conformal", shared=True).train(df, ["a", "b"], df)


def test_subtrees_do_not_hang_on_what_fits_a_cache(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 7))
    codes = np.minimum(1 + np.floor((x + 3) * 4), 30).clip(1).astype(np.uint8)
    codes[rng.random(codes.shape) < 0.05] = 0
    y = np.abs(x[:, 0] * 2 + x[:, 1] ** 2)
    w = rng.integers(1, 4, 900).astype(float)
    s = trees.Spec("f", tuple(range(7)), depth=9)
    whole = trees.grow(codes, -w * y, w, y, 9, s, 34)
    monkeypatch.setattr(trees, "_CELLS", 1)
    assert trees.grow(codes, -w * y, w, y, 9, s, 34) == whole and len(whole.feature) > 200
    # the root's split is the one of its whole histogram
    hist = trees._histograms(codes, np.zeros(900, np.int64), -w * y, w, 1, 34)
    gain, f, b, null_left, low = trees.best_splits(hist, 0.0, 1.0)
    left = np.where(codes[:, f[0]] == 0, null_left[0], codes[:, f[0]] <= b[0])
    assert (whole.feature[0], whole.bin[0], whole.null_left[0], whole.gain[0]) == (f[0], b[0], null_left[0], gain[0])
    assert low[0] == pytest.approx([(-w * y)[left].sum(), w[left].sum(), left.sum()])
