"""The table of drives: rows keyed (drive_id, rn), one per sample, seconds as doubles.

``drive_view`` derives it from the events table; ``standardize`` from sensor logs whose headers differ by producer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from odolith.functions.geo import enu_x, enu_y, wrap



def order():
    """The one window of sequence operators: rows of a drive in order."""
    return W.partitionBy("drive_id").orderBy("rn")


def so_far():
    return order().rowsBetween(W.unboundedPreceding, W.currentRow)


SENSORS = ["acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
COLUMNS = ["drive_id", "rn", "driver_id", "timestamp", "pos_x", "pos_y", "speed", "heading", *SENSORS, "ambient_lux"]
# fixed values: the place that coordinates are relative to, and standard gravity
ORIGIN = (52.40166, -1.50529)
GRAVITY = 9.80665
# fixed values: a step of time that isn't positive, or is longer, counts as the usual one
USUAL_STEP, LONGEST_STEP = 0.1, 1


def repaired_step(d: Column) -> Column:
    return F.when(d.isNull(), 0.0).when((d <= 0) | (d > LONGEST_STEP), USUAL_STEP).otherwise(d)


def repaired_dt(t: Column) -> Column:
    """Seconds since the row before: 0 at first; steps that are not positive, or over a second, count as 0.1."""
    d = t - F.lag(t).over(order())
    return repaired_step(d)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of drives before they are numbered: (drive_id, ts, event_id, driver_id, raw_t, speed, sensors, ambient_lux) of ``events``."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("drive_id"),
        "ts",
        "event_id",
        F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B").when(F.col("event_type") == "signup", "D").otherwise("E").alias("driver_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("raw_t"),
        F.least(F.greatest(F.col("value") / 10, F.lit(0.0)), F.lit(45.0)).alias("speed"),
        ((k - 50) / 100).alias("acc_x"),
        ((F.col("value") - 50) / 25).alias("acc_y"),
        (GRAVITY + (F.col("event_id") % 7 - 3) * 0.05).alias("acc_z"),
        ((F.col("event_id") % 5 - 2) * 0.01).alias("gyro_x"),
        ((F.col("event_id") % 3 - 1) * 0.01).alias("gyro_y"),
        ((k - 50) / 500).alias("gyro_z"),
        F.when(F.col("event_type") == "error", 30.0).otherwise(1500.0).alias("ambient_lux"),
    )


def drive_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drive for each user of ``events``; sensors, light and driver are fixed functions of its columns."""
    # the one shuffle that all windows over drives share; its number of partitions is set, as what follows is heavy in work, not in bytes
    e = event_rows(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "drive_id")
    rows = e.withColumn("rn", F.row_number().over(W.partitionBy("drive_id").orderBy("ts", "event_id")).cast("long"))
    timed = rows.withColumn("dt", repaired_dt(F.col("raw_t")))
    turned = timed.withColumn("timestamp", F.sum("dt").over(so_far())).withColumn("heading", wrap(F.sum(F.col("gyro_z") * F.col("dt")).over(so_far())))
    placed = turned.withColumn("pos_x", F.sum(F.col("speed") * F.sin("heading") * F.col("dt")).over(so_far())).withColumn("pos_y", F.sum(F.col("speed") * F.cos("heading") * F.col("dt")).over(so_far()))
    return placed.select(COLUMNS)


#: the same in DuckDB's SQL, as common table expressions that end in ``drives``
DRIVES_SQL = """
    ev AS (
        SELECT user_id AS drive_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
               CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'signup' THEN 'D' ELSE 'E' END AS driver_id,
               epoch_us(ts) / 1e6 AS raw_t, least(greatest(value / 10, 0e0), 45e0) AS speed,
               (CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) - 50) / 100 AS acc_x, (value - 50) / 25 AS acc_y,
               9.80665e0 + (event_id % 7 - 3) * 5e-2 AS acc_z, (event_id % 5 - 2) * 1e-2 AS gyro_x, (event_id % 3 - 1) * 1e-2 AS gyro_y,
               (CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) - 50) / 500 AS gyro_z,
               CASE WHEN event_type = 'error' THEN 30e0 ELSE 1500e0 END AS ambient_lux
        FROM events),
    gaps AS (SELECT *, raw_t - lag(raw_t) OVER (PARTITION BY drive_id ORDER BY rn) AS d FROM ev),
    timed AS (SELECT *, CASE WHEN d IS NULL THEN 0e0 WHEN d <= 0 OR d > 1 THEN 1e-1 ELSE d END AS dt FROM gaps),
    summed AS (SELECT *, sum(dt) OVER (PARTITION BY drive_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS timestamp,
                      sum(gyro_z * dt) OVER (PARTITION BY drive_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS h FROM timed),
    turned AS (SELECT *, h - 2 * pi() * floor((h + pi()) / (2 * pi())) AS heading FROM summed),
    drives AS (SELECT * EXCLUDE (d, h), sum(speed * sin(heading) * dt) OVER (PARTITION BY drive_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pos_x,
                      sum(speed * cos(heading) * dt) OVER (PARTITION BY drive_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pos_y FROM turned)"""

# fixed values: header names, lower-cased, in order of preference
TIME = ["time since start (ms)", "timestamp", "time", "t", "time_stamp", "epoch"]
LAT = ["gps latitude (degrees)", "gt_lat", "latitude", "gps_lat", "lat"]
LON = ["gps longitude (degrees)", "gt_lon", "longitude", "gps_lon", "lon", "lng"]
SPEED = ["gps speed (kmh)", "speed", "vehiclespeed", "gps_speed", "gt_speed", "velocity"]
COURSE = ["gps orientation", "gps orientation ()", "gps_orientation", "course", "gps_heading"]
ACC = {"x": ["acc_x", "accx", "ax", "lateralacceleration"], "y": ["acc_y", "accy", "ay", "longitudinalacceleration", "forward_accel"], "z": ["acc_z", "accz", "az", "verticalacceleration"]}
GYRO = {"x": ["gyro_x", "gyrox", "gx", "rollrate"], "y": ["gyro_y", "gyroy", "gy", "pitchrate"], "z": ["gyro_z", "gyroz", "gz", "yawrate", "yaw_rate"]}
ROTATION = {"x": "roll", "y": "pitch", "z": "yaw"}
DRIVER_PATHS = [("A", ("Driver A", "S-S")), ("B", ("Driver B", "S-M")), ("D", ("Driver D", "S-Y")), ("E", ("Driver E", "Vf", "Vta", "Vtb", "Vw"))]


def pick(columns: list[str], aliases: list[str]) -> str | None:
    """The column whose trimmed, lower-cased name comes first among the aliases."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[a] for a in aliases if a in by_name), None)


def _axis(columns: list[str], sensor: str, axis: str, aliases: list[str]) -> str | None:
    """The last column named after the sensor and the axis, else one of the aliases."""
    found = None
    for c in columns:
        k = c.strip().lower()
        if sensor not in k:
            continue
        owner = next((a for a in "xyz" if (sensor == "gyroscope" and ROTATION[a] in k) or f" {a}" in k or k.endswith(a) or f"acc_{a}" in k), None)
        if owner == axis:
            found = c
    return found or pick(columns, aliases)


def _ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`").cast("double")


def standardize(raw: DataFrame) -> DataFrame:
    """Rows of ``COLUMNS`` from logs with drive_id, rn, optionally driver_id, and sensor columns under any of the known headers."""
    from odolith.operators.signals import diff, gradient, hold_course

    cols = [c for c in raw.columns if c not in ("drive_id", "rn", "driver_id")]
    whole = W.partitionBy("drive_id")
    df = raw if "driver_id" in raw.columns else raw.withColumn("driver_id", F.lit("Unknown"))
    time, lat, lon, speed = (pick(cols, a) for a in (TIME, LAT, LON, SPEED))
    if time is None:
        df = df.withColumn("timestamp_", (F.col("rn") - 1) * 0.1)
    else:
        df = df.withColumn("raw_t_", _ref(time))
        if "ms" in time.lower():
            df = df.withColumn("raw_t_", F.col("raw_t_") / 1000)
        else:
            df = df.withColumn("gap_", F.col("raw_t_") - F.lag("raw_t_").over(order()))
            wide = (F.max("raw_t_").over(whole) - F.min("raw_t_").over(whole) > 10000) & (F.percentile("gap_", 0.5).over(whole) > 10)
            df = df.withColumn("ms_", F.coalesce(wide, F.lit(False))).withColumn("raw_t_", F.when(F.col("ms_"), F.col("raw_t_") / 1000).otherwise(F.col("raw_t_")))
        df = df.withColumn("step_", repaired_dt(F.col("raw_t_"))).withColumn("timestamp_", F.sum("step_").over(so_far()))
    df = df.withColumn("dt_", F.col("timestamp_") - F.lag("timestamp_").over(order())).withColumn("typical_", F.percentile("dt_", 0.5).over(whole))
    df = df.withColumn("typical_", F.when(F.col("typical_") > 0, F.col("typical_")).otherwise(0.1))
    if lat and lon:
        df = df.withColumn("lat0_", F.first(_ref(lat)).over(so_far())).withColumn("lon0_", F.first(_ref(lon)).over(so_far()))
        df = df.withColumn("pos_x_", enu_x(_ref(lon), F.col("lat0_"), F.col("lon0_"))).withColumn("pos_y_", enu_y(_ref(lat), F.col("lat0_")))
    elif {"gt_pos_x", "gt_pos_y"} <= set(cols):
        df = df.withColumn("pos_x_", _ref("gt_pos_x")).withColumn("pos_y_", _ref("gt_pos_y"))
    else:
        df = df.withColumn("pos_x_", F.lit(0.0)).withColumn("pos_y_", F.lit(0.0))
    if speed:
        v = _ref(speed) / 3.6 if "kmh" in speed.lower() or "km/h" in speed.lower() else _ref(speed)
    else:
        v = F.hypot(diff("pos_x_"), diff("pos_y_")) / F.col("typical_")
    df = df.withColumn("speed_", F.least(F.greatest(v, F.lit(0.0)), F.lit(45.0)))
    course = pick(cols, COURSE) or next((c for c in cols if "gps" in c.lower() and "orient" in c.lower()), None)
    df = df.withColumn("heading_", wrap(F.radians(_ref(course)))) if course else hold_course(df, "pos_x_", "pos_y_", "speed_", "heading_")
    sensors = {}
    for a in "xyz":
        acc, gyro = _axis(cols, "accelerometer", a, ACC[a]), _axis(cols, "gyroscope", a, GYRO[a])
        sensors[f"acc_{a}"] = _ref(acc) if acc else {"x": F.lit(0.0), "y": gradient("speed_", F.col("typical_")), "z": F.lit(GRAVITY)}[a]
        sensors[f"gyro_{a}"] = _ref(gyro) if gyro else gradient("heading_", F.col("typical_")) if a == "z" else F.lit(0.0)
    light = pick(cols, ["light"])
    out = {"drive_id": F.col("drive_id"), "rn": F.col("rn"), "driver_id": F.col("driver_id"), "timestamp": F.col("timestamp_"), "pos_x": F.col("pos_x_"), "pos_y": F.col("pos_y_"), "speed": F.col("speed_"), "heading": F.col("heading_")} | sensors
    out["ambient_lux"] = _ref(light) if light else F.lit(1500.0)
    return df.select(*[out[c].alias(c) for c in COLUMNS])


def infer_driver(path: Column) -> Column:
    """The driver a path names, first of A, B, D, E, else Unknown."""
    p, out = path, F.lit("Unknown")
    for name, parts in reversed(DRIVER_PATHS):
        hit = F.lit(False)
        for x in parts:
            hit = hit | p.contains(x)
        out = F.when(hit, name).otherwise(out)
    return out


def read_log(spark: SparkSession, path: str, min_bytes: int = 1000) -> DataFrame:
    """Raw rows of the CSV logs under ``path`` with drive_id (file name), rn and driver_id; files of ``min_bytes`` or fewer are pointers, not data."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    named = raw.select("*", F.regexp_replace("_metadata.file_path", "%20", " ").alias("path_"), F.col("_metadata.file_size").alias("size_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("line_")).where(F.col("size_") > min_bytes)
    per_file = W.partitionBy("path_").orderBy("block_", "line_")
    out = named.withColumn("drive_id", F.regexp_replace(F.element_at(F.split("path_", "/"), -1), r"\.csv$", "")).withColumn("rn", F.row_number().over(per_file).cast("long")).withColumn("driver_id", infer_driver(F.col("path_")))
    return out.drop("path_", "size_", "block_", "line_")


# fixed values: logs, what is put behind their names, the side they are on, and the rows before the slice
SUITE = [
    ("S-S1", "", "train", 0), ("S-S2", "", "train", 0), ("S-M", "_train", "train", 10000), ("S-Y1", "_train", "train", 10000), ("S-Vfa01", "", "train", 0), ("S-Vta1a", "", "train", 0),
    ("S-S3a", "", "test", 0), ("S-S3b", "", "test", 0), ("S-M", "", "test", 0), ("S-Y1", "", "test", 0), ("S-Vfa02", "", "test", 0), ("S-Vta1b", "", "test", 0),
]


def suite(spark: SparkSession, max_rows: int = 3000) -> DataFrame:
    """The manifest of the benchmark's twelve slices of ten logs, for ``slices``."""
    return spark.createDataFrame([(*x, max_rows) for x in SUITE], "drive_id string, suffix string, split string, offset long, max_rows long")


def slices(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """Row ranges of drives: ``manifest`` (drive_id, suffix, split, offset, max_rows), a fixed list of files, joined to the rows it names."""
    m = F.broadcast(manifest.select(F.col("drive_id").alias("file_"), "suffix", "split", "offset", "max_rows"))
    hit = raw.join(m, (raw.drive_id == m.file_) & (raw.rn > m["offset"]) & (raw.rn <= m["offset"] + m["max_rows"]))
    return hit.withColumn("drive_id", F.concat("drive_id", "suffix")).withColumn("rn", F.col("rn") - F.col("offset")).drop("file_", "suffix", "offset", "max_rows")
