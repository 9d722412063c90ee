"""Studies that hold no more at once than they need."""

from dataclasses import replace

from pyspark.sql import functions as F

from odolith.operators import models
from odolith.sources.drives import drive_view

SF = "/root/testdata/sf0.001"


def test_a_sweep_holds_the_features_of_one_window_length(spark, monkeypatch):
    drives, seen, whole = drive_view(spark, SF), [], models.fit_together
    monkeypatch.setattr(models, "fit_together", lambda train, *a: (seen.append([r[0] for r in train.select("setting").distinct().collect()]), whole(train, *a))[1])
    got = models.window_sweep(drives.where("drive_id % 3 <> 0"), drives.where("drive_id % 3 = 0"), (0.5, 1.0), replace(models.FOREST, trees=2, depth=3)).collect()
    assert seen == [[0], [1]] and [r["window_sec"] for r in got] == [0.5, 1.0]
    assert all(r["train_windows"] > 0 and r["mae"] > 0 for r in got) and got[0]["train_windows"] > got[1]["train_windows"]


class Constant:
    def predict(self, df):
        return df.withColumn("v_pred", F.lit(5.0)).withColumn("v_std", F.lit(1.0))


def test_lost_windows_are_those_of_the_clean_case(spark, monkeypatch):
    drives, calls, whole = drive_view(spark, SF), [], models.features.features
    monkeypatch.setattr(models.features, "features", lambda *a, **b: (calls.append(1), whole(*a, **b))[1])
    made = models.robustness(Constant(), drives, ("clean", "dropout", "gyro_bias"), start=1.95, end=3.95, settle=0.8, scale=0.0025)
    assert len(calls) == 2  # and not a pass for each case
    assert made.select("case").columns == ["case"]
