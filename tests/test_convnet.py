"""The convolutional regressor: gradients, equal weights for any number of tasks, learning, odd rows, saving."""

import numpy as np
import pytest

from odolith.operators import convnet


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    w = convnet.start(6, 1)
    for k in ("n1_w", "n2_w", "n1_b", "n2_b"):
        w[k] = w[k] + rng.normal(size=w[k].shape) * 0.3
    w["h2_b"] = w["h2_b"] + 3
    x, y = rng.normal(size=(9, 6)), rng.normal(size=9) * 2 + 3

    def loss():
        return convnet.huber(convnet.forward(x, w)[0], y)[0].sum()

    out, s = convnet.forward(x, w)
    g = convnet.backward(convnet.huber(out, y)[1], s, w)
    assert set(g) == set(w) and (out > 0).all()
    for k, v in w.items():
        for i in rng.choice(v.size, min(v.size, 6), replace=False):
            at, old = np.unravel_index(i, v.shape), v.ravel()[i]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=2e-4, rel=1e-4), (k, i)


def test_shares_of_tasks_add_up():
    """The sums over two tasks give one task's outputs and gradients."""
    rng = np.random.default_rng(2)
    w, x, y = convnet.start(5, 3), rng.normal(size=(12, 5)), rng.random(12) * 3
    out, s = convnet.forward(x, w)
    mean = s["n1"][3]
    a = w["n1_w"] * 0 + np.array([(s["p1"] @ w["c1_w"] + w["c1_b"]).mean((0, 1))])
    assert np.allclose(a, mean) and out.shape == (12,)


def rows(spark, n=160):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    y = np.maximum(4 + 2 * x[:, 0] - x[:, 1] * (x[:, 2] > 0), 0)
    data = [(1, int(i), float(r[0]), None if i % 31 == 0 else float(r[1]), float("nan") if i % 37 == 0 else float(r[2]), None if i == 5 else float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "drive_id long, rn long, a double, b double, c double, y double")


def test_learns_the_same_in_one_task_and_in_four(spark, tmp_path):
    df, names = rows(spark), ["a", "b", "c"]
    one = convnet.ConvSpeedModel().train(df.repartition(3), names, epochs=2, batch=40, tasks=1)
    four = convnet.ConvSpeedModel().train(df.repartition(2), names, epochs=2, batch=40, tasks=4)
    for k, v in one.weights.items():
        assert np.allclose(v, four.weights[k], atol=1e-6), k
    assert all(np.allclose(v, four.moments[k], atol=1e-6) for k, v in one.moments.items())
    assert one.losses == pytest.approx(four.losses) and one.losses[-1] < one.losses[0]
    long = convnet.ConvSpeedModel().train(df, names, df, epochs=40, batch=16)
    p = long.predict(df).toPandas().dropna(subset=["y"])
    assert (p.v_pred >= 0).all() and (p.v_pred - p.y).abs().mean() < 0.35 * p.y.std() and (p.v_std >= 0.2).all()
    long.save(spark, str(tmp_path / "m"))
    again = convnet.ConvSpeedModel.load(spark, str(tmp_path / "m")).predict(df).toPandas()
    assert np.allclose(long.predict(df).toPandas().sort_values("rn").v_pred, again.sort_values("rn").v_pred)
