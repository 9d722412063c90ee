"""Angles and the local east-north plane."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def wrap(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + F.lit(pi), F.lit(2 * pi)) - F.lit(pi)


def enu_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(lat0))


def enu_y(lat: Column, lat0: Column) -> Column:
    return F.radians(lat - lat0) * EARTH_M


def enu_lat(y: Column, lat0: Column) -> Column:
    return lat0 + F.degrees(y / EARTH_M)


def enu_lon(x: Column, lat0: Column, lon0: Column) -> Column:
    return lon0 + F.degrees(x / (EARTH_M * F.cos(F.radians(lat0))))
