"""Sensor-trajectory analytics on Spark."""
