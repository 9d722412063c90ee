"""Sinks: dashboard frames, metric documents and the Markdown summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolith.functions.geo import enu_lat, enu_lon
from odolith.operators.context import profile_label
from odolith.operators.metrics import across_drives, extremes
from odolith.sources.drives import order, so_far


def frames(df: DataFrame, lat0: float, lon0: float, every: int = 2) -> DataFrame:
    """Every ``every``-th row of drives as a dashboard frame: geodetic places, rounded, and the way covered over the frames kept."""
    d = df.where((F.col("rn") - 1) % every == 0)
    d = d.withColumn("step_", F.coalesce(F.hypot(F.col("pos_x") - F.lag("pos_x").over(order()), F.col("pos_y") - F.lag("pos_y").over(order())), F.lit(0.0))).withColumn("way_", F.sum("step_").over(so_far()))
    la, lo = F.lit(lat0), F.lit(lon0)
    place = lambda x, y, n: [F.round(enu_lat(F.col(y), la), 6).alias(f"{n}_lat"), F.round(enu_lon(F.col(x), la, lo), 6).alias(f"{n}_lon")]
    cols = ["drive_id", "rn", F.round("timestamp", 2).alias("t"), *place("pos_x", "pos_y", "gt"), F.round("speed", 2).alias("gt_v"), F.round("heading", 3).alias("gt_h")]
    have = set(df.columns)
    if "naive_pos_x" in have:
        cols += [*place("naive_pos_x", "naive_pos_y", "naive"), F.round("pos_error_m", 2).alias("naive_err")]
    if "fused_pos_x" in have:
        cols += [*place("fused_pos_x", "fused_pos_y", "fused"), F.round("fused_velocity", 2).alias("fused_v"), F.round("fused_heading", 3).alias("fused_h"), F.round(F.col("fused_gyro_bias") * 1000, 3).alias("fused_bg_mrad"), F.round("fused_pos_error_m", 2).alias("fused_err")]
    if "ai_speed" in have:
        cols += [F.round("ai_speed", 2).alias("ai_v"), F.round("ai_speed_std", 3).alias("ai_sigma_v")]
    cols += [F.col(c).alias(n) for c, n in (("in_outage", "is_blackout"), ("context_mode", "context_mode")) if c in have]
    return d.select(*cols, F.round("way_", 1).alias("cum_dist_m"))


def baseline(df: DataFrame) -> DataFrame:
    """What a figure of the naive trajectory plots: both paths, both speeds and the error over time."""
    return df.select("drive_id", "rn", "timestamp", "pos_x", "pos_y", "naive_pos_x", "naive_pos_y", "speed", "naive_velocity", "pos_error_m")


def three_way(df: DataFrame, start: float, end: float) -> DataFrame:
    """What a figure of truth, model and fused paths plots; ``shaded`` marks the outage with its end."""
    shaded = (F.col("timestamp") >= start) & (F.col("timestamp") <= end)
    return df.select("drive_id", "rn", "timestamp", "pos_x", "pos_y", "ai_pos_x", "ai_pos_y", "fused_pos_x", "fused_pos_y", "ai_pos_error_m", "fused_pos_error_m", shaded.alias("shaded"))


def write_frames(df: DataFrame, path: str) -> None:
    """JSON lines, one folder to a drive."""
    df.write.mode("overwrite").partitionBy("drive_id").json(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """An experiment's table as CSV with a header, Parquet or JSON."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def metric_documents(per_drive: DataFrame, places: int | None = None) -> DataFrame:
    """(drive_id, document): each drive's metrics as one JSON text; with ``places`` doubles are decimals of so many."""
    kind = dict(per_drive.dtypes)
    cols = [F.col(c).cast(f"decimal(30,{places})").alias(c) if places is not None and kind[c] == "double" else F.col(c) for c in per_drive.columns if c != "drive_id"]
    return per_drive.select("drive_id", F.to_json(F.struct(*cols)).alias("document"))


def breakdown(per_drive: DataFrame) -> DataFrame:
    """A row per drive for the report: its profile, distance, and naive and fused errors; ``per_drive`` has driver_id."""
    figures = {"distance": "distance_m", "naive_drift_pct": "naive_drift_pct", "naive_exit": "naive_exit_m", "fused_exit": "fused_exit_m", "fused_outage_peak": "fused_peak_m", "fused_settled": "fused_settled_m"}
    return per_drive.select("drive_id", profile_label(F.col("driver_id")).alias("profile"), "driver_id", *[F.col(c).alias(n) for c, n in figures.items() if c in per_drive.columns])


def markdown(stats: dict, title: str = "Trajectory benchmark", drives: list[dict] | None = None, notes: list[str] | None = None) -> str:
    """A table of {metric: (mean, deviation)}, one of rows of ``breakdown``, and notes; every cell is computed."""
    lines = [f"# {title}", "", "| metric | mean | deviation |", "| --- | --- | --- |", *[f"| {k} | {m:.2f} | {s:.2f} |" for k, (m, s) in stats.items()]]
    if drives:
        names = list(drives[0])
        cell = lambda v: f"{v:.2f}" if isinstance(v, float) else str(v)
        lines += ["", "## By drive", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *["| " + " | ".join(cell(d[n]) for n in names) + " |" for d in drives]]
    if notes:
        lines += ["", "## Observations", "", *[f"{i}. {n}" for i, n in enumerate(notes, 1)]]
    return "\n".join(lines) + "\n"


def benchmark_report(per_drive: DataFrame, hardest: str = "E", most: int = 200) -> str:
    """The report on drives with naive and fused metrics: means, the ``most`` drives of the largest exit error, and the range over the hardest driver."""
    cols = [c for c in ("naive_drift_pct", "naive_exit", "ai_drift_pct", "ai_exit", "fused_drift_pct", "fused_outage_peak", "fused_exit", "fused_settled", "fused_rmse", "naive_rmse", "ai_rmse") if c in per_drive.columns]
    r = across_drives(per_drive, cols).first()
    e = extremes(per_drive, hardest, ["fused_exit", "naive_final"]).first()
    notes = [f"The error at the end of the outage, before the first fix, is {r['fused_exit_mean']:.2f} m ± {r['fused_exit_std']:.2f} m over {r['num_drives']} drives.", f"Once settled after the outage it is {r['fused_settled_mean']:.2f} m ± {r['fused_settled_std']:.2f} m."]
    notes.append(f"Driver {hardest}: exit errors of {e['fused_exit_min']:.1f} to {e['fused_exit_max']:.1f} m, where naive integration ends up to {e['naive_final_max']:.1f} m off." if e["num_drives"] else f"Driver {hardest}: no drives.")
    rows = [x.asDict() for x in breakdown(per_drive).orderBy(F.desc("fused_exit_m"), "drive_id").limit(most).collect()]
    return markdown({c: (r[f"{c}_mean"], r[f"{c}_std"]) for c in cols}, drives=rows, notes=notes)
