"""Blocked operators equal the plain ones, also where one drive is all there is; and a long drive spreads over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolith.operators import blocked, features, motion
from odolith.sources import simulate


@pytest.fixture(scope="module")
def drive(spark):
    """One drive of 3,000 rows."""
    return simulate.simulate(spark, [("A", 300.0)], seed=9).repartition(6).cache()


def frame(df, names):
    return df.select("drive_id", "rn", *names).toPandas().sort_values(["drive_id", "rn"]).reset_index(drop=True)


def close(a, b, names):
    a, b = frame(a, names), frame(b, names)
    assert len(a) == len(b) and (a.rn == b.rn).all()
    for c in names:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-6, rtol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("block", [7, 500, 10_000])
def test_dead_reckoning(drive, block):
    names = ["naive_heading", "naive_velocity", "naive_pos_x", "naive_pos_y", "pos_error_m", "speed_error_mps"]
    close(blocked.naive(drive, block), motion.naive(drive), names)
    ai = drive.withColumn("ai_speed", F.col("speed") * 0.9)
    close(blocked.ai_dead_reckoning(ai, block), motion.ai_dead_reckoning(ai), ["ai_heading", "ai_pos_x", "ai_pos_y", "ai_pos_error_m"])


@pytest.mark.parametrize("causal", [False, True])
def test_features(drive, causal):
    want = features.features(drive, group="base", signals=["acc_mag", "jerk_mag", "alpha_z"], causal=causal)
    got = blocked.features(drive, 250, group="base", signals=["acc_mag", "jerk_mag", "alpha_z"], causal=causal)
    assert got.columns == want.columns
    close(got, want, want.columns[2:])


def test_blocks_and_their_copies(spark):
    df = spark.range(1, 31).select(F.lit(1).alias("drive_id"), F.col("id").alias("rn"))
    got = {}
    for r in blocked.in_blocks(df, 10, before=3, after=2).collect():
        got.setdefault(r["_block"], set()).add(r["rn"])
    assert got == {0: set(range(1, 13)), 1: set(range(8, 23)), 2: set(range(18, 31)), 3: {28, 29, 30}}
    assert sorted(r["rn"] for r in blocked.own(blocked.in_blocks(df, 10, 3, 2), 10).collect()) == list(range(1, 31))
    with pytest.raises(ValueError, match="longer"):
        blocked.in_blocks(df, 3, before=3)


def test_numbers_by_buckets(spark):
    """Ties, a long drive whose times cluster, and a null order."""
    rng = np.random.default_rng(3)
    rows = [(1, int(t), i) for i, t in enumerate(np.concatenate([rng.integers(0, 50, 1500), rng.integers(10**6, 10**9, 1500)]))] + [(2, 5, 1), (2, 5, 0), (3, 1, 9)]
    df = spark.createDataFrame(rows, "drive_id long, t long, e long").repartition(5)
    got = {(r["drive_id"], r["t"], r["e"]): r["rn"] for r in blocked.numbered(df, "t", "e", block=100).collect()}
    for d in (1, 2, 3):
        own = sorted((t, e) for k, t, e in rows if k == d)
        assert [got[d, t, e] for t, e in own] == list(range(1, len(own) + 1))


def test_one_drive_is_many_tasks(spark, drive):
    """No task has more than twice the median's rows, with one drive as the whole input."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        f = blocked.features(drive, 100, group="base", signals=["acc_mag"])
        sizes = sorted(r["n"] for r in f.groupBy(F.spark_partition_id().alias("p")).agg(F.count("acc_mag_std").alias("n")).collect())
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
