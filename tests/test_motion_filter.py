"""The filter, context rules, models, sources and streaming against independent restatements of the formulas."""

import dataclasses
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from odolith.functions.geo import wrap
from odolith.operators import context, ekf, features, metrics, models, motion, signals, trees
from odolith.plans import catalogue, report
from odolith.sources import drives, simulate
from odolith.streaming import device

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("lux", "speed", "var", "gyro", "mode"), [
    (1500.0, 0.1, 0.005, 0.002, "STANDSTILL"), (1200.0, 12.0, 0.15, 0.05, "NORMAL_URBAN"),
    (35.0, 14.0, 0.10, 0.02, "PREDICTIVE_TUNNEL_BLACKOUT"), (1500.0, 25.0, 0.25, 0.02, "HIGHWAY_CRUISING"),
])
def test_context_modes(spark, lux, speed, var, gyro, mode):
    row = spark.range(1).select(context.context_mode(F.lit(lux), F.lit(speed), F.lit(var), F.lit(gyro)).alias("m")).first()
    assert row["m"] == mode


def test_nhc_pulls_lateral_speed_to_zero():
    f = ekf.Filter(np.array([[0, 0, 10, 2.5, 0, 0.0]]), [False])
    f.nhc()
    assert f.x[0, 3] == pytest.approx(2.5 * 0.0025 / 0.2525)
    f.predict(np.array([0.1]), np.array([14.0]), np.array([0.2]), np.array([0.01]), np.array([False]), np.array([True]))
    assert f.x.shape == (1, 6) and np.isfinite(f.P).all()


def test_covariance_stays_symmetric_and_positive():
    rng = np.random.default_rng(0)
    f = ekf.Filter(rng.normal(size=(7, 6)), rng.random(7) < 0.5)
    for i in range(60):
        still = rng.random(7) < 0.2
        f.predict(np.full(7, 0.1), rng.random(7) * 20, rng.random(7), rng.normal(size=7) * 0.1, still, rng.random(7) < 0.2)
        f.nhc()
        if i % 3:
            f.gps(*rng.normal(size=(2, 7)) * 5, rng.random(7) * 20, rng.normal(size=7))
        assert np.allclose(f.P, f.P.transpose(0, 2, 1), atol=1e-9)
        assert np.linalg.eigvalsh((f.P + f.P.transpose(0, 2, 1)) / 2).min() > -1e-9


def test_filter_in_step_equals_one_by_one_and_in_pieces():
    rng = np.random.default_rng(1)
    parts = []
    for d, n in ((1, 30), (2, 12), (3, 45)):
        p = pd.DataFrame({c: rng.normal(size=n) for c in ekf._IN[2:]})
        p["dt"], p["ai_speed_std"], p["speed"] = 0.1, 0.2, p["speed"].abs() * 5
        for c in ("still", "tunnel", "in_outage", "aggressive"):
            p[c] = rng.random(n) < 0.3
        p["aggressive"] = p["aggressive"].iloc[0]
        p.insert(0, "drive_id", d)
        p.insert(1, "rn", range(1, n + 1))
        parts.append(p)
    k = ekf.FilterParams()
    together, _ = ekf.run_filter(pd.concat(parts, ignore_index=True), k)
    alone = pd.concat([ekf.run_filter(p, k)[0] for p in parts], ignore_index=True)
    assert np.allclose(together.values, alone.values)
    a, state = ekf.run_filter(parts[2].iloc[:20].reset_index(drop=True), k)
    b, _ = ekf.run_filter(parts[2].iloc[20:].reset_index(drop=True), k, state)
    assert np.allclose(pd.concat([a, b]).values, alone[alone.drive_id == 3].values)


def test_uncertainty_changes_the_trajectory(spark):
    df = simulate.simulate(spark, [("A", 40.0)], seed=3)
    df = metrics.outage(df.withColumn("ai_speed", F.col("speed") * 0.8).withColumn("style", F.lit("normal")), 10.0, 25.0)
    ends = []
    for sigma in (0.0, 10.0):
        out = ekf.fuse(ekf.with_context(df.withColumn("ai_speed_std", F.lit(sigma))))
        ends.append(out.agg(F.max_by("fused_pos_x", "rn"), F.sum("fused_pos_error_m")).first())
    assert ends[0] != ends[1]


def test_naive_equals_a_loop(spark):
    df = simulate.simulate(spark, [("D", 20.0)], seed=5)
    got = motion.naive(df).orderBy("rn").toPandas()
    x, y, v, h = got.pos_x[0], got.pos_y[0], got.speed[0], got.heading[0]
    for i in range(1, len(got)):
        dt = got.timestamp[i] - got.timestamp[i - 1]
        h1, v1 = h + got.gyro_z[i] * dt, v + got.acc_y[i] * dt
        x, y = x + (v + v1) / 2 * math.sin((h + h1) / 2) * dt, y + (v + v1) / 2 * math.cos((h + h1) / 2) * dt
        h, v = h1, v1
        assert (got.naive_pos_x[i], got.naive_pos_y[i], got.naive_velocity[i]) == pytest.approx((x, y, v), abs=1e-8)


def test_features_equal_numpy(spark):
    df = simulate.simulate(spark, [("E", 12.0)], seed=1)
    f = features.features(df)
    assert len(f.columns) - 4 == 219
    names = f.columns
    assert [len(features.subset(names, k)) for k in ("base", "enhanced", "kinematic", "all")] == [72, 126, 170, 219]
    assert [len(features.features(df, group=g).columns) - 4 for g in ("enhanced", "spectral", "base")] == [171, 123, 75]
    with pytest.raises(ValueError, match="group"):
        features.features(df, group="minimal")
    got, raw = f.orderBy("rn").toPandas(), df.orderBy("rn").toPandas()
    mag = np.sqrt(raw.acc_x**2 + raw.acc_y**2 + raw.acc_z**2).to_numpy()
    assert len(got) == (len(raw) - 15) // 2 + 1
    for r in got.iloc[[0, 7, 30]].itertuples():
        w = mag[r.rn - 15 : r.rn]
        c = w - w.mean()
        p = np.abs(np.fft.rfft(c)) ** 2
        fr = np.fft.rfftfreq(15, 0.1)
        want = [w.mean(), w.std(), np.median(w), np.percentile(w, 90), np.median(abs(w - np.median(w))), (c**3).mean() / w.std() ** 3, (c**4).mean() / w.std() ** 4 - 3, (fr * p).sum() / p.sum(), fr[p.argmax()], p[fr <= 1.5].sum() / p.sum()]
        have = [getattr(r, f"acc_mag_{k}") for k in ("mean", "std", "median", "p90", "mad", "skew", "kurt", "spec_centroid", "dom_freq", "power_low")]
        assert have == pytest.approx(want, abs=1e-6)


def test_window_counts():
    for sec, n in ((0.5, 1498), (1.0, 1496), (1.5, 1493), (2.0, 1491), (3.0, 1486)):
        w, s = features.rows_of(sec, 10, 4), features.rows_of(0.2, 10, 1)
        assert (3000 - w) // s + 1 == n


def test_interpolation_hits_its_knots_and_holds_its_ends(spark):
    rows = [(1, i, float(i), None if i not in (3, 6) else float(i * 10)) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "drive_id long, rn long, timestamp double, v double")
    got = [r["x"] for r in df.select("rn", signals.interpolate("v").alias("x")).orderBy("rn").collect()]
    assert got == pytest.approx([30, 30, 30, 40, 50, 60, 60, 60])


def test_wrap_is_idempotent(spark):
    df = spark.createDataFrame([(x,) for x in (-9.5, -math.pi, 0.0, 3.0, math.pi, 7.0, 40.0)], "a double").select(wrap(F.col("a")).alias("w"))
    for a, b in df.select("w", wrap(F.col("w")).alias("again")).collect():
        assert -math.pi <= a < math.pi and a == pytest.approx(b)


@pytest.mark.parametrize(("header", "row", "want"), [
    ("Time since start (ms),GPS speed (kmh),GPS orientation", "0,36,90|100,72,180|50,36,270", {"speed": [10.0, 20.0, 10.0], "timestamp": [0.0, 0.1, 0.2], "heading": [math.pi / 2, -math.pi, -math.pi / 2]}),
    ("timestamp,gps_lat,gps_lon,velocity,light", "5,52.0,-1.0,3,80|7,52.001,-1.0,60,80|7.5,52.001,-1.0,-4,80", {"speed": [3.0, 45.0, 0.0], "timestamp": [0.0, 0.1, 0.6], "pos_y": [0.0, math.radians(0.001) * 6371000, math.radians(0.001) * 6371000]}),
    # "gyroscope yaw" holds " y", which counts before yaw does
    ("Accelerometer X,accelerometer y,Gyroscope_yaw,Gyroscope yaw", "1,2,3,4|1,2,3,4|1,2,3,4", {"acc_x": [1.0] * 3, "acc_y": [2.0] * 3, "gyro_z": [3.0] * 3, "gyro_y": [4.0] * 3, "acc_z": [9.80665] * 3, "ambient_lux": [1500.0] * 3, "pos_x": [0.0] * 3}),
])
def test_logs_of_any_producer(spark, tmp_path, header, row, want):
    folder = tmp_path / "Driver B"
    folder.mkdir()
    (folder / "log.csv").write_text(header + "\n" + row.replace("|", "\n") + "\n")
    raw = drives.read_log(spark, str(folder), min_bytes=0)
    got = drives.standardize(raw).orderBy("rn").toPandas()
    assert list(got.columns) == drives.COLUMNS and set(got.driver_id) == {"B"} and set(got.drive_id) == {"log"}
    for c, v in want.items():
        assert got[c].tolist() == pytest.approx(v, abs=1e-6), c
    assert drives.read_log(spark, str(folder)).count() == 0  # a pointer, not data


def test_slices_of_a_manifest(spark):
    raw = spark.range(1, 21).select(F.lit("f").alias("drive_id"), F.col("id").alias("rn"))
    m = spark.createDataFrame([("f", "_train", "train", 10, 5), ("f", "_test", "test", 0, 3)], "drive_id string, suffix string, split string, offset long, max_rows long")
    got = sorted(tuple(r) for r in drives.slices(raw, m).select("drive_id", "split", "rn").collect())
    assert got == [("f_test", "test", i) for i in (1, 2, 3)] + [("f_train", "train", i) for i in range(1, 6)]


def test_suite_has_twelve_slices_of_ten_logs(spark):
    m = drives.suite(spark)
    assert m.count() == 12 and m.select("drive_id").distinct().count() == 10 and m.where("split = 'train'").count() == 6
    raw = spark.range(1, 12_001).select(F.lit("S-M").alias("drive_id"), F.col("id").alias("rn"))
    got = {r[0]: r[1:] for r in drives.slices(raw, m).groupBy("drive_id").agg(F.min("rn"), F.max("rn")).collect()}
    assert got == {"S-M": (1, 3000), "S-M_train": (1, 2000)}


def test_leakage_gate_raises(spark):
    a = spark.createDataFrame([(1, "A", 1.0)], "drive_id long, driver_id string, y double")
    b = spark.createDataFrame([(2, "B", 1.0)], "drive_id long, driver_id string, y double")
    metrics.check_no_leakage(["acc_mag_mean"], a, b)
    with pytest.raises(ValueError, match="shared_driver_id"):
        metrics.check_no_leakage(["acc_mag_mean"], a, a)
    with pytest.raises(ValueError, match="banned"):
        metrics.check_no_leakage(["speed"], a, b)


def test_models_predict_and_survive_saving(spark, tmp_path):
    df = features.features(simulate.simulate(spark, [("A", 60.0), ("E", 60.0)], seed=2), group="base", signals=["acc_mag", "jerk_mag"]).cache()
    names = [c for c in df.columns if c not in ("drive_id", "rn", "t_end", "y")]
    m = models.SpeedModel(options={"trees": 5, "depth": 4}).train(df, names)
    p = m.predict(df).toPandas()
    assert (p.v_pred >= 0).all() and (p.v_std >= 0.05).all() and m.evaluate(df)["mae"] < df.toPandas().y.std()
    assert len(m.importances(3)) == 3 and json.loads(m.schema_json())["num_features"] == len(names)
    m.save(spark, str(tmp_path / "m"))
    again = models.SpeedModel.load(spark, str(tmp_path / "m")).predict(df).toPandas()
    assert np.allclose(p.sort_values(["drive_id", "rn"]).v_pred, again.sort_values(["drive_id", "rn"]).v_pred) and m.size_kb(spark, str(tmp_path / "m")) > 0
    for method in ("conformal", "quantile"):
        a, b = df.where("drive_id = 0"), df.where("drive_id <> 0")
        q = models.SpeedModel("boosted", method, {"trees": 3, "depth": 3}).train(a, names, b).predict(df).toPandas()
        assert (q.v_std > 0).all()
        with pytest.raises(ValueError, match="rows of its own"):
            models.SpeedModel("boosted", method).train(a, names)
    with pytest.raises(ValueError, match="ensemble"):
        models.SpeedModel("boosted", "ensemble").train(df, names)


def small_trees(monkeypatch):
    """Small trees in place of the models; gives a list of the models asked for."""
    seen, fit, made = [], trees.fit, dict(models.KINDS)
    monkeypatch.setattr(trees, "fit", lambda data, specs, *a: seen.extend(specs) or fit(data, [dataclasses.replace(s, trees=2, depth=2) for s in specs], *a))
    for kind in made:
        monkeypatch.setitem(models.KINDS, kind, lambda k, kind=kind: seen.append((kind, k.get("trees", 100), k.get("depth", {"boosted": 6, "random_forest": 12}[kind]))) or made[kind]({"trees": 2, "depth": 2}))
    return seen


def size(s):
    return s if isinstance(s, tuple) else (s.loss, s.trees, s.depth, len(s.features))


def test_model_queries_are_of_full_size(spark, monkeypatch):
    seen, given = small_trees(monkeypatch), []
    whole = models.permutation_importance
    monkeypatch.setattr(models, "permutation_importance", lambda m, df, *a, **k: given.append(df) or whole(m, df, *a, **k))
    got = catalogue.QUERIES["q40_permutation_importance"](spark, SF).toPandas()
    assert len(got) == got.feature.nunique() == 219 and got.importance_mean.notna().all()
    assert given[0].where("drive_id % 3 <> 0").count() == 0 < given[0].count()
    for q in ("q39_forest_with_deviation", "q42_leave_one_driver_out"):
        catalogue.QUERIES[q](spark, SF)
    assert [size(s) for s in seen[:2]] == [("second_order", 100, 6, 219), ("random_forest", 100, 12)]
    who = catalogue.drive_view(spark, SF).groupBy("drive_id").agg(F.min_by("driver_id", "rn").alias("w")).select("w").distinct().orderBy("w").collect()
    assert [(size(s), s.held) for s in seen[2:]] == [(("forest", 100, 10, 219), r["w"]) for r in who] and len(who) > 2


def test_permuted_feature_raises_the_error(spark):
    """Against trees walked again for every copy of the rows."""
    rows = [(i % 7, i, float(i * 37 % 101), float(i * 53 % 97), 3.0) for i in range(400)]
    df = spark.createDataFrame([(*r, r[2]) for r in rows], "drive_id long, rn long, a double, b double, c double, y double")
    m = models.fit_together(df.withColumn("setting", F.lit(0)), ["a", "b", "c"], {"m": dataclasses.replace(models.BOOSTED, trees=30, depth=5)})[0]["m"]
    got = {r["feature"]: r for r in models.permutation_importance(m, df).collect()}
    assert list(got) == ["a", "b", "c"] and got["a"].importance_mean > 15 and got["a"].importance_std > 0
    assert abs(got["b"].importance_mean) < 1 and got["c"].importance_mean == pytest.approx(0, abs=1e-9)
    assert [r["feature"] for r in models.permutation_importance(m, df, ["b"], repeats=2).collect()] == ["b"]
    codes = trees.codes_of(df.select("a", "b", "c").toPandas().to_numpy(), m.edges)
    y, rng = np.array([r[2] for r in rows]), np.random.default_rng(0)
    rise = []
    for _ in range(40):
        mixed = codes.copy()
        mixed[:, 0] = rng.permutation(mixed[:, 0])
        rise.append(np.abs(y - np.maximum(m.of(mixed), 0)).mean() - np.abs(y - np.maximum(m.of(codes), 0)).mean())
    assert got["a"].importance_mean == pytest.approx(np.mean(rise), rel=0.1)


def test_window_sweep_and_feature_ablation(spark, monkeypatch):
    seen = small_trees(monkeypatch)
    d = simulate.simulate(spark, [("A", 20.0), ("E", 20.0)], seed=2).persist()
    first = F.col("drive_id") == d.agg(F.min("drive_id")).first()[0]
    got = models.window_sweep(d.where(first), d.where(~first), seconds=(0.5, 1.0)).collect()
    assert [(r.window_sec, r.n_features) for r in got] == [(0.5, 219), (1.0, 219)] and all(0 < r.mae <= r.rmse and r.r2 < 1 for r in got)
    assert [r.train_windows for r in got] == [d.where(first).where(f"rn >= {n} and (rn - {n}) % 2 = 0").count() for n in (5, 10)]
    rows = [(i % 4, i, float(i), float(i % 5), float(i % 3), float(i % 7), float(i)) for i in range(200)]
    f = spark.createDataFrame(rows, "drive_id long, rn long, y double, ax_mean double, ax_median double, jerk_mag_mean double, ax_spec_centroid double")
    got = models.feature_ablation(f.where("drive_id > 0"), f.where("drive_id = 0")).collect()
    assert [(r["subset"], r["n_features"]) for r in got] == [("base", 2), ("enhanced", 2), ("kinematic", 3), ("all", 4)]
    assert got[3].mae < got[0].mae and all(r.mae <= r.rmse for r in got)
    assert [(size(s)[:3], s.setting) for s in seen] == [(("forest", 100, 12), k) for k in (0, 1)] + [(("second_order", 100, 6), 0)] * 4
    assert [len(s.features) for s in seen] == [219, 219, 2, 2, 3, 4] and {"q54_window_sweep_metrics", "q55_feature_ablation"} <= set(catalogue.QUERIES)


def test_reports(spark):
    df = simulate.simulate(spark, [("A", 5.0)], seed=None)
    f = report.frames(df, 52.0, -1.0).toPandas()
    assert len(f) == 25 and f.cum_dist_m.is_monotonic_increasing
    assert "| x | 1.00 | 2.00 |" in report.markdown({"x": (1.0, 2.0)})
    doc = json.loads(report.metric_documents(metrics.target_audit(df)).first()["document"])
    assert doc["n"] == 50


def test_cross_drive_statistics(spark):
    df = spark.createDataFrame([(1.005,), (3.0,)], "e double")
    r = metrics.across_drives(df, ["e"]).first()
    assert r["num_drives"] == 2 and r["e_mean"] == pytest.approx((round(1.01, 2) + 3) / 2) and r["e_std"] == pytest.approx((3 - 1.01) / 2)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_sliding_windows(spark):
    df = simulate.simulate(spark, [("A", 5.0)], seed=1).withColumn("event_time", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")))
    n = device.sliding_counts(df).agg(F.max("n"), F.count("*")).first()
    assert n[0] == 15 and n[1] > 20


def test_robustness_cases(spark):
    df = simulate.simulate(spark, [("B", 20.0)], seed=6)
    biased = models.perturb(df, "gyro_bias").join(df.select("rn", F.col("gyro_z").alias("g")), "rn")
    assert biased.where(F.abs(F.col("gyro_z") - F.col("g") - 0.02) > 1e-12).count() == 0
    assert models.perturb(df, "dropout").exceptAll(df).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        models.perturb(df, "storm")
