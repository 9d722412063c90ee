"""Driving context from light, speed and vibration; and the on-device rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from odolith.sources.drives import GRAVITY, order

# fixed values: the contexts and where they begin
STANDSTILL, TUNNEL, HIGHWAY, URBAN = "STANDSTILL", "PREDICTIVE_TUNNEL_BLACKOUT", "HIGHWAY_CRUISING", "NORMAL_URBAN"
REST_VAR, REST_TURN, REST_SPEED, DARK, MOVING, FAST = 0.018, 0.01, 0.5, 100, 4, 18
# fixed values: the on-device rules. Standing still by the variance of acc_y and the turn; speed and deviation by the vibration; how far a state follows the
# predicted speed; and how far a fix pulls place, speed, heading (over a speed) and bias
RING = 15
STILL_VAR, STILL_TURN, MAG_GAIN, STD_GAIN, SIGMA_STILL, SIGMA_BASE, SIGMA_GAIN, SIGMA_FIRST, FOLLOW = 0.02, 0.012, 1.85, 4.2, 0.04, 0.15, 0.35, 0.2, 0.2
FIX_PLACE, FIX_SPEED, FIX_HEADING, FIX_BIAS, FIX_MOVING = 0.15, 0.2, 0.1, 0.005, 1.2


def context_mode(lux: Column, speed: Column, acc_var: Column, gyro_abs: Column) -> Column:
    return F.when((acc_var < REST_VAR) & (gyro_abs < REST_TURN) & (speed < REST_SPEED), STANDSTILL).when((lux < DARK) & (speed > MOVING), TUNNEL).when(speed > FAST, HIGHWAY).otherwise(URBAN)


def context_of(lux: np.ndarray, speed: np.ndarray, acc_var: np.ndarray, gyro_abs: np.ndarray) -> np.ndarray:
    """``context_mode`` of arrays."""
    return np.select([(acc_var < REST_VAR) & (gyro_abs < REST_TURN) & (speed < REST_SPEED), (lux < DARK) & (speed > MOVING), speed > FAST], [STANDSTILL, TUNNEL, HIGHWAY], URBAN)


def tunnel_alert(mode: Column) -> Column:
    return mode == TUNNEL


def driver_style(driver: Column) -> Column:
    return F.when(driver == "E", "aggressive").otherwise("normal")


def profile_label(driver: Column) -> Column:
    """A driver's name with the driving style it stands for."""
    return F.when(driver == "E", "Driver E (Aggressive)").when(driver == "B", "Driver B (Highway)").when(driver == "D", "Driver D (Urban)").otherwise("Driver A (Normal)")


def device_rules(size: int = RING) -> dict[str, Column]:
    """mean_ay, var_ay, mean_mag, standstill, speed and sigma over the last ``size`` rows."""
    w = order().rowsBetween(-(size - 1), 0)
    mag = F.sqrt(F.col("acc_x") * F.col("acc_x") + F.col("acc_y") * F.col("acc_y") + F.col("acc_z") * F.col("acc_z"))
    mean, square = F.avg("acc_y").over(w), F.avg(F.col("acc_y") * F.col("acc_y")).over(w)
    var = F.greatest(square - mean * mean, F.lit(0.0))
    still = (var < STILL_VAR) & (F.abs("gyro_z") < STILL_TURN)
    speed = F.greatest((F.avg(mag).over(w) - GRAVITY) * MAG_GAIN + F.sqrt(var) * STD_GAIN, F.lit(0.0))
    return {"mean_ay": mean, "var_ay": var, "mean_mag": F.avg(mag).over(w), "standstill": still, "device_speed": F.when(still, 0.0).otherwise(speed), "device_sigma": F.when(still, SIGMA_STILL).otherwise(SIGMA_BASE + F.sqrt(var) * SIGMA_GAIN)}
