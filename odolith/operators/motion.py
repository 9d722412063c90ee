"""Trajectories by integration: every recursion is a sum of terms known row by row, so two stacked running sums do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolith.operators.signals import interpolate, step_dt
from odolith.sources.drives import order, so_far


def _integrate(df: DataFrame, speed: str, heading: str, x: str, y: str) -> DataFrame:
    """Positions from the means of neighbouring rows' speed and heading, from the first row's pos_x and pos_y."""
    v = 0.5 * (F.lag(speed).over(order()) + F.col(speed))
    h = 0.5 * (F.lag(heading).over(order()) + F.col(heading))
    d = df.select("*", F.coalesce(v * F.sin(h) * F.col("dt_"), F.lit(0.0)).alias("sx_"), F.coalesce(v * F.cos(h) * F.col("dt_"), F.lit(0.0)).alias("sy_"))
    first = lambda c: F.first(c).over(so_far())
    return d.withColumn(x, first("pos_x") + F.sum("sx_").over(so_far())).withColumn(y, first("pos_y") + F.sum("sy_").over(so_far())).drop("sx_", "sy_")


def _turned(df: DataFrame, heading: str) -> DataFrame:
    d = df.withColumn("dt_", step_dt())
    turn = F.when(F.col("rn") > F.first("rn").over(so_far()), F.col("gyro_z") * F.col("dt_")).otherwise(0.0)
    return d.withColumn("turn_", turn).withColumn(heading, F.first("heading").over(so_far()) + F.sum("turn_").over(so_far())).drop("turn_")


def naive(df: DataFrame) -> DataFrame:
    """The drive's rows with naive_heading, naive_velocity, naive_pos_x/y, pos_error_m, speed_error_mps, from its first heading, speed and place."""
    d = _turned(df, "naive_heading")
    gain = F.when(F.col("rn") > F.first("rn").over(so_far()), F.col("acc_y") * F.col("dt_")).otherwise(0.0)
    d = d.withColumn("gain_", gain).withColumn("naive_velocity", F.first("speed").over(so_far()) + F.sum("gain_").over(so_far()))
    d = _integrate(d, "naive_velocity", "naive_heading", "naive_pos_x", "naive_pos_y")
    return d.withColumn("pos_error_m", F.hypot(F.col("naive_pos_x") - F.col("pos_x"), F.col("naive_pos_y") - F.col("pos_y"))).withColumn("speed_error_mps", F.abs(F.col("naive_velocity") - F.col("speed"))).drop("dt_", "gain_")


def dense_speed(df: DataFrame, v: str = "v_pred", sigma: str | None = "v_std") -> DataFrame:
    """ai_speed and ai_speed_std on all rows from predictions at window ends (null elsewhere); without sigma 0.2."""
    d = df.withColumn("ai_speed", F.greatest(interpolate(v), F.lit(0.0)))
    return d.withColumn("ai_speed_std", F.greatest(interpolate(sigma), F.lit(0.05)) if sigma else F.lit(0.2))


def ai_dead_reckoning(df: DataFrame) -> DataFrame:
    """Rows with ai_speed, and ai_heading, ai_pos_x/y and ai_pos_error_m from it and the gyroscope."""
    d = _integrate(_turned(df, "ai_heading"), "ai_speed", "ai_heading", "ai_pos_x", "ai_pos_y")
    return d.withColumn("ai_pos_error_m", F.hypot(F.col("ai_pos_x") - F.col("pos_x"), F.col("ai_pos_y") - F.col("pos_y"))).drop("dt_")
