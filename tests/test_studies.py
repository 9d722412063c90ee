"""Studies, order statistics, forests in one pass and reports, on small simulated drives."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolith.operators import ekf, features, metrics, models, motion, signals
from odolith.plans import report
from odolith.sources import simulate
from odolith.streaming import device


@pytest.fixture(scope="module")
def drives(spark):
    return simulate.simulate(spark, [("A", 40.0), ("E", 40.0), ("B", 30.0)], seed=2).persist()


@pytest.fixture(scope="module")
def model(drives):
    f = features.features(drives.where("driver_id <> 'B'"), group="base", signals=["acc_mag", "jerk_mag"]).persist()
    names = [c for c in f.columns if c not in ("drive_id", "rn", "t_end", "y")]
    return models.SpeedModel(options={"trees": 6, "depth": 5}).train(f, names), f


def test_order_statistics_equal_sorting(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(0, 3, 501).tolist(), "b": [1.5] * 40 + [2.5] * 7, "c": [0.25], "d": rng.integers(0, 5, 300).astype(float).tolist()}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x] + [("a", None), (None, 7.0)], "k string, v double").repartition(5)
    got = {r["k"]: r for r in metrics.exact_percentiles(df, "v", ["k"], {"p50": 0.5, "p95": 0.95, "least": 0.0, "most": 1.0}).collect()}
    for k, x in values.items():
        assert [got[k]["p50"], got[k]["p95"], got[k]["least"], got[k]["most"]] == pytest.approx([np.percentile(x, 50), np.percentile(x, 95), min(x), max(x)]), k
    q = {r["k"]: (r["q_hat"], r["n"]) for r in metrics.conformal_quantile(df, "v", ["k"]).collect()}
    for k, x in values.items():
        assert q[k] == (sorted(x)[min(len(x) - 1, int(np.ceil((len(x) + 1) * 0.9)))], len(x))


def test_forest_in_one_pass_equals_its_trees(model):
    m, f = model
    got = m.predict(f).select("drive_id", "rn", "v_pred", "v_std").toPandas().sort_values(["drive_id", "rn"])
    stages, each = m.model.stages, []
    for t in stages[1].trees:
        each.append(t.transform(stages[0].transform(f)).select("drive_id", "rn", "prediction").toPandas().sort_values(["drive_id", "rn"]).prediction.to_numpy())
    each = np.stack(each)
    assert np.allclose(got.v_pred, np.maximum(each.mean(0), 0)) and np.allclose(got.v_std, np.maximum(each.std(0), 0.05))


def test_model_speeds_reach_the_filter(drives, model):
    m, _ = model
    held = drives.where("driver_id = 'B'")
    p = m.predict(features.features(held, group="base", signals=["acc_mag", "jerk_mag"]))
    t = models.trajectories(held, p, 10.0, 20.0)
    got = t.orderBy("rn").toPandas()
    ends = p.orderBy("rn").toPandas()
    assert len(got) == 300 and np.interp(got.timestamp, ends.t_end, ends.v_pred) == pytest.approx(got.ai_speed.to_numpy())
    r = models.navigate(held, p, 10.0, 20.0, 3.0).first()
    inside = got[(got.timestamp >= 10) & (got.timestamp < 20)]
    assert r["fused_exit"] == pytest.approx(inside.open_loop_error_m.iloc[-1]) and r["fused_outage_peak"] == pytest.approx(inside.open_loop_error_m.max()) and r["naive_exit"] == pytest.approx(inside.pos_error_m.iloc[-1])


def test_robustness_depends_on_the_sensors(drives, model, monkeypatch):
    m, _ = model
    whole = features.features
    monkeypatch.setattr(features, "features", lambda d, **k: whole(d, group="base", signals=["acc_mag", "jerk_mag"], **k))
    got = {r["case"]: r for r in models.robustness(m, drives.where("driver_id = 'B'"), start=10.0, end=20.0, settle=3.0).collect()}
    assert list(got) == ["clean", "noise", "acc_bias", "gyro_bias", "dropout"]
    assert got["clean"]["mae"] != got["acc_bias"]["mae"] and got["clean"]["exit_mean"] != got["acc_bias"]["exit_mean"]
    assert got["clean"]["mae"] == got["gyro_bias"]["mae"]  # these features don't see the turn rate
    f = whole(drives, group="base", signals=["acc_mag"])
    n, left = f.count(), models.lose_windows(f).count()
    assert 0.85 * n < left < n and models.lose_windows(f).exceptAll(f).count() == 0
    assert set(models.latency_ms(m, drives)) == {"features", "end_to_end"}


def test_stages_and_variants_run_together(drives):
    df = metrics.outage(motion.naive(drives), 10.0, 20.0).withColumn("ai_speed", F.col("speed") * 0.9).withColumn("ai_speed_std", F.lit(0.3)).withColumn("style", F.lit("normal"))
    df = signals.hold_course(ekf.with_context(df))
    got = ekf.fuse_variants(df, ekf.stages()).toPandas()
    alone = ekf.fuse(df).toPandas()
    key = ["drive_id", "rn"]
    a, b = got.sort_values(key), alone.sort_values(key)
    assert np.allclose(a.given_heading_pos_x, b.fused_pos_x) and np.allclose(a.given_heading_open_loop_error_m, b.open_loop_error_m)
    assert not np.allclose(a.five_states_pos_x, a.six_states_pos_x) and (a.five_states_lat_velocity == 0).all()
    plan = ekf.fuse_variants(df, ekf.stages())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_reset_and_results_that_repeat(spark, drives):
    e = device.DeviceEngine()
    for _ in range(20):
        e.sample(0.1, 0.5, 9.9, 0.02, 50.0, 0.1)
    e.fix(1.0, 1.0, 3.0, 0.4)
    assert e.packed() != device.DeviceEngine().packed()
    e.reset()
    assert e.packed() == device.DeviceEngine().packed()
    assert metrics.repeats_exactly(lambda: metrics.drive_summary(drives), ["drive_id"])
    assert not metrics.repeats_exactly(lambda: drives.select("drive_id", "rn", F.rand().alias("x")), ["drive_id"])


def test_report_and_tables(spark, drives, tmp_path):
    df = metrics.outage(motion.naive(drives), 10.0, 20.0).withColumn("ai_speed", F.col("speed") * 0.9).withColumn("ai_speed_std", F.lit(0.3)).withColumn("style", F.lit("normal"))
    fused = ekf.fuse(ekf.with_context(df))
    m = metrics.drive_metrics(fused, {"naive": ("pos_error_m", "pos_error_m"), "fused": ("fused_pos_error_m", "open_loop_error_m")}, 3.0).join(drives.select("drive_id", "driver_id").distinct(), "drive_id")
    text = report.benchmark_report(m)
    assert "Driver B (Highway)" in text and "Driver E: exit errors of" in text and text.count("| Driver") == 3
    f = report.frames(fused, 52.0, -1.0)
    assert {"naive_lat", "fused_bg_mrad", "ai_v", "is_blackout", "context_mode"} <= set(f.columns)
    report.write_frames(f, str(tmp_path / "frames"))
    assert spark.read.json(str(tmp_path / "frames")).count() == f.count()
    report.write_table(m, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 3
    assert json.loads(report.metric_documents(m, 2).first()["document"])["n"] > 0
