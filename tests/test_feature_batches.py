"""All features of a batch of windows against the same statistics as columns, also where windows have nulls."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from odolith.operators import features


def _by_columns(w, n, names):
    """Features of each signal from the column forms."""
    d = features.prepared(w, n, names)
    d = d.select("*", *[v.alias(f"{s}_{k}") for s in names for k, v in features.base_stats(F.col(s), F.col(f"{s}__m"), F.col(f"{s}__c"), n).items()])
    d = d.select("*", *[features.quantile(F.col(f"{s}__z"), n, 0.5).alias(f"{s}__q") for s in names], *[features.power(F.col(f"{s}__c"), n).alias(f"{s}__p") for s in names])
    rest = [v.alias(f"{s}_{k}") for s in names for k, v in features.enhanced_stats(F.col(f"{s}__c"), F.col(f"{s}__z"), F.col(f"{s}__q"), F.col(f"{s}_std"), n).items() if k != "zcr_true"]
    return d.select("*", *rest, *[v.alias(f"{s}_{k}") for s in names for k, v in features.spectral_stats(F.col(f"{s}__p"), n).items()])


def test_batches_equal_columns(spark):
    rng, n = np.random.default_rng(3), 15
    rows = [(1, k, 0.0, 1.0, rng.normal(size=n).tolist(), rng.integers(0, 3, n).astype(float).tolist()) for k in range(40)]
    rows += [(2, 0, 0.0, 1.0, [2.5] * n, [0.0] * n), (2, 1, 0.0, None, [1.0, 2.0, 4.0], []), (2, 2, 0.0, 1.0, [0.1] * 14, [1.0, float("nan")] * 7 + [2.0])]
    w = spark.createDataFrame(rows, "drive_id long, rn long, t_end double, y double, ax array<double>, gz array<double>")
    got = features.of_windows(w, n, signals=["ax", "gz"])
    want = _by_columns(w, n, ["ax", "gz"]).select(got.columns)
    assert len(got.columns) == 4 + 2 * 18
    is_null = lambda df: df.select("drive_id", "rn", *[F.col(c).isNull().alias(c) for c in got.columns[2:]]).toPandas().sort_values(["drive_id", "rn"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(is_null(got), is_null(want))
    a, b = (x.toPandas().sort_values(["drive_id", "rn"]).reset_index(drop=True) for x in (got, want))
    exact = [c for c in got.columns if "_spec" not in c and "_power" not in c and "_dom" not in c and not c.endswith(("skew", "kurt"))]
    pd.testing.assert_frame_equal(a[exact], b[exact], check_exact=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-12, atol=1e-12)


def test_no_function_is_called_for_each_element(spark):
    w = spark.createDataFrame([], "drive_id long, rn long, t_end double, y double, ax array<double>")
    plan = features.of_windows(w, 15, signals=["ax"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    assert features.of_windows(w, 15, signals=["ax"]).count() == 0
