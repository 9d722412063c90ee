"""Streams equal their batch forms for shuffled and late events, over triggers and a restart, and end by themselves."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from odolith.operators import ekf, features, metrics, signals
from odolith.sources import simulate
from odolith.streaming import device, in_order, sequences

LIMIT = 100


@pytest.fixture(scope="module")
def drives(spark):
    """Three drives with a gap in time between them and the row that moves the watermark past all of them."""
    df = simulate.simulate(spark, [("A", 6.0), ("B", 9.0), ("E", 4.0)], seed=4).withColumn("dt", signals.step_dt())
    return df.withColumn("event_time", F.timestamp_micros(F.round((F.col("timestamp") + 1e9) * 1e6).cast("long"))).cache()


def last(df):
    """A row of another drive, far ahead in time."""
    return df.limit(1).withColumn("drive_id", F.lit(-1).cast("long")).withColumn("event_time", F.timestamp_seconds(F.lit(2_000_000_000)))


def run(spark, df, make, out_schema, tmp_path, tag):
    """Rows of the stream ``make`` gives of ``df``: events within two seconds of each other shuffled over files, one file a trigger, stopped and begun again half way."""
    src, out, cp = (str(tmp_path / f"{tag}-{x}") for x in ("in", "out", "cp"))
    jitter = F.pmod(F.xxhash64("drive_id", "event_time", "kind" if "kind" in df.columns else F.lit(0)), F.lit(1900)) / 1000
    dealt = df.withColumn("_f", F.floor((F.unix_micros("event_time") / 1e6 + jitter) / 3).cast("int")).cache()
    files = sorted(r[0] for r in dealt.select("_f").distinct().collect())
    assert len(files) > 2
    began = time.time()

    def go():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = make(stream).writeStream.format("parquet").option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start(out)
        assert q.awaitTermination(LIMIT), "the stream did not end"

    for part in (files[:2], files[2:]):
        for f in part:
            dealt.where(F.col("_f") == f).drop("_f").orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(src)
        if f == files[-1]:
            last(df).coalesce(1).write.mode("append").parquet(src)
        go()
    assert time.time() - began < LIMIT
    return spark.read.schema(out_schema).parquet(out).where("drive_id >= 0")


def same(got, want, by=("drive_id", "rn"), tol=1e-9):
    got, want = (x.toPandas().sort_values(list(by)).reset_index(drop=True) for x in (got, want))
    assert len(want) > 0
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=tol, atol=tol)


def test_device_events_equal_replay(spark, drives, tmp_path):
    fixes = drives.where("rn % 10 = 0").select("drive_id", "event_time", "pos_x", "pos_y", "speed", "heading")
    own = device.device_events(drives, fixes)
    want = device.replay_events(own)
    same(want, device.replay(drives))  # a fix of a sample's own time counts as one that comes with it
    same(run(spark, own, device.stream, device.OUT, tmp_path, "device"), want)


def test_fixes_between_samples_and_resets(spark, drives, tmp_path):
    """Fixes of their own times and without headings, and a reset, against the engine fed one by one."""
    late = F.expr("event_time + interval 37 milliseconds")
    fixes = drives.where("rn % 7 = 3").select("drive_id", late.alias("event_time"), (F.col("pos_x") + 1).alias("pos_x"), "pos_y", F.lit(5.0).alias("speed"), F.when(F.col("rn") % 2 == 0, F.col("heading")).alias("heading"))
    resets = drives.where("rn = 33").select("drive_id", F.expr("event_time + interval 50 milliseconds").alias("event_time"))
    own = device.device_events(drives, fixes, resets).cache()
    rows = []
    for _, g in own.toPandas().sort_values(["drive_id", "t", "kind", "rn"]).groupby("drive_id"):
        e = device.DeviceEngine()
        for r in g.itertuples():
            if r.kind == device.SAMPLE:
                p = e.sample(*r.v)
                rows.append((r.drive_id, r.rn, p, e.speed, e.heading, e.x, e.y, e.bias, e.sigma, e.still, e.alert))
            elif r.kind == device.FIX:
                e.fix(*r.v)
            else:
                e.reset()
    want = spark.createDataFrame(rows, device.OUT)
    same(device.replay_events(own), want)
    same(run(spark, own, device.stream, device.OUT, tmp_path, "fixes"), want)


def test_merged_sensors_equal_batch(spark, drives, tmp_path):
    v = drives.withColumn("t", F.round(F.col("timestamp") + 1e9, 6))
    acc, gyro, gps = v.where("rn % 3 = 1").select("drive_id", "t", "acc_x", "acc_y"), v.where("rn % 2 = 0").select("drive_id", "t", "gyro_z"), v.where("rn % 5 = 2").select("drive_id", "t", "pos_x")
    want = device.merge_sensors(acc, gyro, gps)
    kinds = acc.withColumn("kind", F.lit(0)).unionByName(gps.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(gyro.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    kinds = kinds.withColumn("event_time", in_order.seconds_as_time("t"))
    make = lambda s: device.merge_stream(*(s.where(f"kind = {k}").select("drive_id", F.when(F.col("drive_id") < 0, 2e9).otherwise(F.col("t")).alias("t"), *names) for k, names in ((0, ["acc_x", "acc_y"]), (2, ["gyro_z"]), (1, ["pos_x"]))))
    same(run(spark, kinds, make, want.schema, tmp_path, "merged"), want, ("drive_id", "t"))


def test_filter_equals_fuse(spark, drives, tmp_path):
    df = drives.withColumn("ai_speed", F.col("speed") * 0.9).withColumn("ai_speed_std", F.lit(0.3)).withColumn("style", F.when(F.col("driver_id") == "E", "aggressive").otherwise("normal"))
    df = metrics.outage(df, 1.5, 3.0).cache()
    names = ["drive_id", "rn", "context_mode", *ekf.STATE, "open_loop_pos_x", "open_loop_pos_y", "fused_pos_error_m", "open_loop_error_m"]
    want = ekf.fuse(ekf.with_context(df)).select(names)
    same(run(spark, df, sequences.fuse_stream, want.schema, tmp_path, "fused"), want, tol=1e-7)


@pytest.mark.parametrize("causal", [False, True])
def test_all_features_equal_batch(spark, drives, tmp_path, causal):
    want = features.features(drives, causal=causal)
    assert len(want.columns) == 4 + 219
    got = run(spark, drives, lambda s: sequences.features_stream(s, causal=causal), want.schema, tmp_path, "features")
    plain = [c for c in want.columns if not c.endswith("_zcr")]  # these hang on how a mean is rounded
    same(got.select(plain), want.select(plain), tol=1e-7)


def test_without_waiting_and_with_state_kept(spark, tmp_path):
    """Triggers as they come: a value is carried into the next trigger."""
    rows = [(1, 0.0, 5.0, None), (1, 1.0, None, 2.0), (1, 2.0, None, None), (2, 0.5, None, 1.0)]
    schema = "drive_id long, t double, a double, b double"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = device.carry_stream(src, ["a", "b"], late=None).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(LIMIT)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("drive_id", "t").collect()]
    assert got == [(1, 0.0, 5.0, None), (1, 1.0, 5.0, 2.0), (1, 2.0, 5.0, 2.0), (2, 0.5, None, 1.0)]
