"""The library's own queries over the supplied tables, each with the same question in DuckDB's SQL where SQL can ask it.

Drives are those of ``drive_view``; the outage is [1.95, 3.95) s and settling 0.8 s there, between samples, as its drives last five to ten seconds.
Computed doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from odolith.functions import geo, noise
from odolith.operators import blocked, context, ekf, features, merkle, metrics, models, motion, signals, trees
from odolith.plans import report
from odolith.sources import drives, log_rows, simulate
from odolith.sources.drives import DRIVES_SQL, drive_view, order
from odolith.streaming import device, run, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OUT_START, OUT_END, SETTLE = 1.95, 3.95, 0.8
SIZE, STEP = 15, 2
KEYS = ["drive_id", "rn"]
OVER = "OVER (PARTITION BY drive_id ORDER BY rn)"
RUN = "OVER (PARTITION BY drive_id ORDER BY rn ROWS UNBOUNDED PRECEDING)"


def query(name: str, sql: str | None = None, base: str = DRIVES_SQL):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {base}{sql}" if base else sql.strip()
        return f

    return put


def r6(c: str | Column, n: int = 6) -> Column:
    """Rounded, under its own name; -0 is 0."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, n) + F.lit(0.0)
    return out.alias(c) if isinstance(c, str) else out


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0 AS {n}" for n in names)


def _stand_in(df: DataFrame) -> DataFrame:
    """Drives with v_pred and v_std at window ends: the window's mean and deviation of speed, in the place of a model's."""
    w = order().rowsBetween(-(SIZE - 1), 0)
    end = (F.col("rn") >= SIZE) & ((F.col("rn") - SIZE) % STEP == 0)
    return df.withColumn("v_pred", F.when(end, F.avg("speed").over(w))).withColumn("v_std", F.when(end, F.stddev_pop("speed").over(w) * 0.1 + 0.1))


STAND_IN_SQL = f"""{DRIVES_SQL},
    preds AS (SELECT *, CASE WHEN rn >= 15 AND (rn - 15) % 2 = 0 THEN avg(speed) OVER w END AS v_pred,
                     CASE WHEN rn >= 15 AND (rn - 15) % 2 = 0 THEN stddev_pop(speed) OVER w * 1e-1 + 1e-1 END AS v_std
              FROM drives WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS 14 PRECEDING)),
    knots AS (SELECT *, last_value(v_pred IGNORE NULLS) OVER b AS v0, first_value(v_pred IGNORE NULLS) OVER a AS v1, last_value(v_std IGNORE NULLS) OVER b AS s0, first_value(v_std IGNORE NULLS) OVER a AS s1,
                     last_value(CASE WHEN v_pred IS NOT NULL THEN timestamp END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN v_pred IS NOT NULL THEN timestamp END IGNORE NULLS) OVER a AS t1
              FROM preds WINDOW b AS (PARTITION BY drive_id ORDER BY rn ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY drive_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    dense AS (SELECT *, greatest(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR t1 <= t0 THEN v0 ELSE v0 + (v1 - v0) * (timestamp - t0) / (t1 - t0) END, 0e0) AS ai_speed,
                     greatest(CASE WHEN s0 IS NULL THEN s1 WHEN s1 IS NULL OR t1 <= t0 THEN s0 ELSE s0 + (s1 - s0) * (timestamp - t0) / (t1 - t0) END, 5e-2) AS ai_speed_std FROM knots)"""


@query("q01_standard_drives", f" SELECT drive_id, rn, driver_id, {s6('timestamp', 'pos_x', 'pos_y', 'speed', 'heading', 'acc_x', 'acc_y', 'acc_z', 'gyro_x', 'gyro_y', 'gyro_z')}, ambient_lux FROM drives")
def _(spark, d):
    v = drive_view(spark, d)
    return v.select("drive_id", "rn", "driver_id", *[r6(c) for c in ("timestamp", "pos_x", "pos_y", "speed", "heading", *drives.SENSORS)], "ambient_lux")


@query("q02_geodetic_to_enu", f""", g AS (SELECT drive_id, rn, 524e-1 + pos_y / 1000 AS lat, -15e-1 + pos_x / 1000 AS lon FROM drives),
    o AS (SELECT *, first_value(lat) {OVER} AS lat0, first_value(lon) {OVER} AS lon0 FROM g)
    SELECT drive_id, rn, round(radians(lon - lon0) * 6371000 * cos(radians(lat0)), 4) + 0 AS east, round(radians(lat - lat0) * 6371000, 4) + 0 AS north FROM o""")
def _(spark, d):
    g = drive_view(spark, d).select(*KEYS, (F.col("pos_y") / 1000 + 52.4).alias("lat"), (F.col("pos_x") / 1000 - 1.5).alias("lon"))
    o = g.withColumn("lat0", F.first("lat").over(drives.so_far())).withColumn("lon0", F.first("lon").over(drives.so_far()))
    return o.select(*KEYS, r6(geo.enu_x(F.col("lon"), F.col("lat0"), F.col("lon0")), 4).alias("east"), r6(geo.enu_y(F.col("lat"), F.col("lat0")), 4).alias("north"))


@query("q03_enu_roundtrip", """, g AS (SELECT drive_id, rn, pos_x, pos_y, 524e-1 + degrees(pos_y / 6371000) AS lat, -15e-1 + degrees(pos_x / (6371000 * cos(radians(524e-1)))) AS lon FROM drives)
    SELECT drive_id, rn, round(lat, 9) AS lat, round(lon, 9) AS lon, round(radians(lon + 15e-1) * 6371000 * cos(radians(524e-1)) - pos_x, 5) + 0 AS dx, round(radians(lat - 524e-1) * 6371000 - pos_y, 5) + 0 AS dy FROM g""")
def _(spark, d):
    la, lo = F.lit(52.4), F.lit(-1.5)
    g = drive_view(spark, d).select(*KEYS, "pos_x", "pos_y", geo.enu_lat(F.col("pos_y"), la).alias("lat"), geo.enu_lon(F.col("pos_x"), la, lo).alias("lon"))
    return g.select(*KEYS, F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), r6(geo.enu_x(F.col("lon"), la, lo) - F.col("pos_x"), 5).alias("dx"), r6(geo.enu_y(F.col("lat"), la) - F.col("pos_y"), 5).alias("dy"))


@query("q04_wrap_angle", " SELECT event_id, round(value - 20 - 2 * pi() * floor((value - 20 + pi()) / (2 * pi())), 6) + 0 AS wrapped FROM events", "x AS (SELECT 1)")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", r6(geo.wrap(F.col("value") - 20)).alias("wrapped"))


@query("q05_diff_gradient", f""", n AS (SELECT *, lag(speed) {OVER} AS b, lead(speed) {OVER} AS a FROM drives)
    SELECT drive_id, rn, round(speed - coalesce(b, speed), 6) + 0 AS speed_diff, round(CASE WHEN b IS NULL AND a IS NULL THEN 0 WHEN b IS NULL THEN (a - speed) / 1e-1 WHEN a IS NULL THEN (speed - b) / 1e-1 ELSE (a - b) / 2e-1 END, 6) + 0 AS speed_gradient,
           round(coalesce((speed - b) / 1e-1, 0), 6) + 0 AS causal_gradient FROM n""")
def _(spark, d):
    v = drive_view(spark, d)
    return v.select(*KEYS, r6(signals.diff("speed")).alias("speed_diff"), r6(signals.gradient("speed", 0.1)).alias("speed_gradient"), r6(signals.gradient("speed", 0.1, causal=True)).alias("causal_gradient"))


@query("q06_held_course", f""", s AS (SELECT *, pos_x - coalesce(lag(pos_x) {OVER}, pos_x) AS dx, pos_y - coalesce(lag(pos_y) {OVER}, pos_y) AS dy FROM drives),
    m AS (SELECT *, atan2(avg(dx) OVER w, avg(dy) OVER w) AS c FROM s WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT drive_id, rn, round(coalesce(last_value(CASE WHEN speed > 4e-1 THEN c END IGNORE NULLS) {RUN}, first_value(c) {RUN}), 6) + 0 AS course FROM m""")
def _(spark, d):
    return signals.hold_course(drive_view(spark, d)).select(*KEYS, r6("course"))


@query("q07_local_variance", """ SELECT drive_id, rn, round(var_pop(acc_x) OVER w + var_pop(acc_y) OVER w, 6) AS acc_var, round(var_pop(acc_x) OVER c + var_pop(acc_y) OVER c, 6) AS acc_var_causal FROM drives
    WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), c AS (PARTITION BY drive_id ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return drive_view(spark, d).select(*KEYS, r6(signals.local_variance()).alias("acc_var"), r6(signals.local_variance(0, 9)).alias("acc_var_causal"))


@query("q08_context_mode", """, v AS (SELECT *, (var_pop(acc_x) OVER w + var_pop(acc_y) OVER w) * 25e-4 AS acc_var FROM drives WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
    m AS (SELECT drive_id, rn, CASE WHEN acc_var < 18e-3 AND abs(gyro_z) < 1e-2 AND speed < 5e-1 THEN 'STANDSTILL' WHEN ambient_lux < 100 AND speed > 4 THEN 'PREDICTIVE_TUNNEL_BLACKOUT' WHEN speed > 18 THEN 'HIGHWAY_CRUISING' ELSE 'NORMAL_URBAN' END AS context_mode FROM v)
    SELECT *, context_mode = 'PREDICTIVE_TUNNEL_BLACKOUT' AS tunnel_alert FROM m""")
def _(spark, d):
    v = drive_view(spark, d).withColumn("acc_var", signals.local_variance(scale=0.0025))
    m = v.withColumn("context_mode", context.context_mode(F.col("ambient_lux"), F.col("speed"), F.col("acc_var"), F.abs("gyro_z")))
    return m.select(*KEYS, "context_mode", context.tunnel_alert(F.col("context_mode")).alias("tunnel_alert"))


def _integral_sql(source: str, heading: str, speed: str, x: str, y: str) -> str:
    """CTEs from ``source`` (drives with ``dts``) to ``path`` with x and y."""
    return f"""
    mids AS (SELECT *, 5e-1 * (lag({speed}) {OVER} + {speed}) AS vm, 5e-1 * (lag({heading}) {OVER} + {heading}) AS hm FROM {source}),
    path AS (SELECT *, first_value(pos_x) {RUN} + sum(coalesce(vm * sin(hm) * dts, 0)) {RUN} AS {x}, first_value(pos_y) {RUN} + sum(coalesce(vm * cos(hm) * dts, 0)) {RUN} AS {y} FROM mids)"""


NAIVE_SQL = f"""{DRIVES_SQL},
    stepped AS (SELECT *, coalesce(timestamp - lag(timestamp) {OVER}, lead(timestamp) {OVER} - timestamp, 1e-1) AS dts FROM drives),
    spun AS (SELECT *, first_value(heading) {RUN} + sum(CASE WHEN rn > 1 THEN gyro_z * dts ELSE 0 END) {RUN} AS naive_heading, first_value(speed) {RUN} + sum(CASE WHEN rn > 1 THEN acc_y * dts ELSE 0 END) {RUN} AS naive_velocity FROM stepped),
    {_integral_sql("spun", "naive_heading", "naive_velocity", "naive_pos_x", "naive_pos_y")},
    naive AS (SELECT *, sqrt((naive_pos_x - pos_x) * (naive_pos_x - pos_x) + (naive_pos_y - pos_y) * (naive_pos_y - pos_y)) AS pos_error_m, abs(naive_velocity - speed) AS speed_error_mps FROM path)"""


@query("q09_naive_dead_reckoning", f" SELECT drive_id, rn, {s6('naive_heading', 'naive_velocity', 'naive_pos_x', 'naive_pos_y', 'pos_error_m', 'speed_error_mps')} FROM naive", NAIVE_SQL)
def _(spark, d):
    return motion.naive(drive_view(spark, d)).select(*KEYS, *[r6(c) for c in ("naive_heading", "naive_velocity", "naive_pos_x", "naive_pos_y", "pos_error_m", "speed_error_mps")])


def _metrics_sql(source: str, *errors: tuple) -> str:
    """CTEs to ``scored``; ``errors`` are (name, error) or (name, error, error at the outage's exit)."""
    figures = [
        f"""sqrt(avg({e} * {e})) AS {name}_rmse, max({e}) AS {name}_max, arg_max({e}, rn) AS {name}_final, coalesce(max({x[0] if x else e}) FILTER (in_outage), 0) AS {name}_outage_peak,
            coalesce(arg_max({x[0] if x else e}, rn) FILTER (in_outage), 0) AS {name}_exit, coalesce(arg_min({e}, rn) FILTER (timestamp >= 395e-2 + 8e-1), arg_max({e}, rn)) AS {name}_settled"""
        for name, e, *x in errors
    ]
    return f"""
    flagged AS (SELECT *, timestamp >= 195e-2 AND timestamp < 395e-2 AS in_outage FROM {source}),
    steps AS (SELECT *, sqrt(pow(pos_x - lag(pos_x) {OVER}, 2) + pow(pos_y - lag(pos_y) {OVER}, 2)) AS st,
                     CASE WHEN in_outage THEN sqrt(pow(pos_x - lag(pos_x) OVER i, 2) + pow(pos_y - lag(pos_y) OVER i, 2)) END AS st_in FROM flagged WINDOW i AS (PARTITION BY drive_id, in_outage ORDER BY rn)),
    m AS (SELECT drive_id, count(*) AS n, max(timestamp) - min(timestamp) AS duration, coalesce(sum(st), 0) AS distance, coalesce(sum(st_in), 0) AS outage_distance, {", ".join(figures)} FROM steps GROUP BY drive_id),
    scored AS (SELECT *, {", ".join(f"100 * {name}_final / (distance + 1e-5) AS {name}_drift_pct" for name, *_ in errors)} FROM m)"""


def _naive_metrics(spark, d):
    df = metrics.outage(motion.naive(drive_view(spark, d)), OUT_START, OUT_END)
    return metrics.drive_metrics(df, {"naive": ("pos_error_m", "pos_error_m")}, SETTLE)


_FIGURES = ("duration", "distance", "outage_distance", "naive_rmse", "naive_max", "naive_final", "naive_outage_peak", "naive_exit", "naive_settled")


@query("q10_naive_metrics", f" SELECT drive_id, n, {s6(*_FIGURES)}, round(naive_drift_pct, 4) AS naive_drift_pct FROM scored", NAIVE_SQL + "," + _metrics_sql("naive", ("naive", "pos_error_m")))
def _(spark, d):
    return _naive_metrics(spark, d).select("drive_id", "n", *[r6(c) for c in _FIGURES], r6("naive_drift_pct", 4))


SIGNALS_SQL = f"""{DRIVES_SQL},
    nb AS (SELECT *, {", ".join(f"CASE WHEN lag({c}) {OVER} IS NULL THEN (lead({c}) {OVER} - {c}) / 1e-1 WHEN lead({c}) {OVER} IS NULL THEN ({c} - lag({c}) {OVER}) / 1e-1 ELSE (lead({c}) {OVER} - lag({c}) {OVER}) / 2e-1 END AS d_{c}" for c in drives.SENSORS)} FROM drives),
    sig AS (SELECT drive_id, rn, timestamp, speed, gyro_z AS gz, acc_x AS ax, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS acc_mag, sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z) AS gyro_mag, sqrt(acc_x * acc_x + acc_y * acc_y) AS acc_horiz,
                   sqrt(d_acc_x * d_acc_x + d_acc_y * d_acc_y + d_acc_z * d_acc_z) AS jerk_mag, sqrt(d_gyro_x * d_gyro_x + d_gyro_y * d_gyro_y + d_gyro_z * d_gyro_z) AS alpha_mag, d_gyro_z AS alpha_z FROM nb),
    win AS (SELECT drive_id, rn, timestamp AS t_end, speed AS y, {", ".join(f"list({s}) OVER w AS {s}" for s in ("ax", "gz", "acc_mag", "gyro_mag", "acc_horiz", "jerk_mag", "alpha_mag", "alpha_z"))} FROM sig WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS 14 PRECEDING)),
    ends AS (SELECT * FROM win WHERE rn >= 15 AND (rn - 15) % 2 = 0)"""

_THREE = ["acc_mag", "jerk_mag", "gz"]


@query("q11_base_features", f""" SELECT drive_id, rn, {", ".join(f"round(list_avg({s}), 6) + 0 AS {s}_mean, round(list_stddev_pop({s}), 6) + 0 AS {s}_std, round(list_min({s}), 6) + 0 AS {s}_min, round(list_max({s}), 6) + 0 AS {s}_max, round(list_max({s}) - list_min({s}), 6) + 0 AS {s}_p2p, round(sqrt(list_avg(list_transform({s}, lambda v: v * v))), 6) + 0 AS {s}_rms" for s in _THREE)} FROM ends""", SIGNALS_SQL)
def _(spark, d):
    w = _windows(spark, d, _THREE)
    return w.select(*KEYS, *[r6(v).alias(f"{s}_{k}") for s in _THREE for k, v in _base(s).items()])


def _windows(spark, d, names: list[str]) -> DataFrame:
    return features.prepared(features.windows(drive_view(spark, d), SIZE, STEP, names), SIZE, names)


def _base(s: str) -> dict[str, Column]:
    return features.base_stats(F.col(s), F.col(f"{s}__m"), F.col(f"{s}__c"), SIZE)


def _enhanced(spark, d, names: list[str], keep: tuple[str, ...]) -> DataFrame:
    w = _windows(spark, d, names)
    w = w.select("*", *[_base(s)["std"].alias(f"{s}_std") for s in names], *[features.quantile(F.col(f"{s}__z"), SIZE, 0.5).alias(f"{s}__q") for s in names])
    return w.select(*KEYS, *[r6(v).alias(f"{s}_{k}") for s in names for k, v in features.enhanced_stats(F.col(f"{s}__c"), F.col(f"{s}__z"), F.col(f"{s}__q"), F.col(f"{s}_std"), SIZE).items() if k in keep])


@query("q12_quantile_features", f""" SELECT drive_id, rn, {", ".join(f"round(list_aggregate({s}, 'quantile_cont', 5e-1), 6) + 0 AS {s}_median, round(list_aggregate({s}, 'quantile_cont', 75e-2) - list_aggregate({s}, 'quantile_cont', 25e-2), 6) + 0 AS {s}_iqr, round(list_aggregate({s}, 'quantile_cont', 1e-1), 6) + 0 AS {s}_p10, round(list_aggregate({s}, 'quantile_cont', 9e-1), 6) + 0 AS {s}_p90" for s in _THREE)} FROM ends""", SIGNALS_SQL)
def _(spark, d):
    return _enhanced(spark, d, _THREE, ("median", "iqr", "p10", "p90"))


_MOMENT = "CASE WHEN list_stddev_pop({s}) > 1e-6 THEN list_avg(list_transform({s}, lambda v: pow(v - list_avg({s}), {k}))) / pow(list_stddev_pop({s}), {k}) {less} ELSE 0 END"


@query("q13_moment_features", f""" SELECT drive_id, rn, {", ".join(f"round({_MOMENT.format(s=s, k=3, less='')}, 6) + 0 AS {s}_skew, round({_MOMENT.format(s=s, k=4, less='- 3')}, 6) + 0 AS {s}_kurt" for s in _THREE)} FROM ends""", SIGNALS_SQL)
def _(spark, d):
    return _enhanced(spark, d, _THREE, ("skew", "kurt"))


@query("q14_mad_and_crossings", f""" SELECT drive_id, rn, {", ".join(f"round(list_aggregate({s}, 'mad'), 6) + 0 AS {s}_mad, round(list_sum(list_transform(range(14), lambda i: CASE WHEN sign({s}[i + 1] - list_avg({s})) <> sign({s}[i + 2] - list_avg({s})) THEN 1e0 ELSE 0e0 END)) / 14, 6) + 0 AS {s}_zcr_true" for s in _THREE)} FROM ends""", SIGNALS_SQL)
def _(spark, d):
    return _enhanced(spark, d, _THREE, ("mad", "zcr_true"))


def _dft(a: str, k: str, n: int) -> str:
    part = lambda f: f"pow(list_sum(list_transform(range({n}), lambda i: ({a}[i + 1] - list_avg({a})) * {f}(2 * pi() * {k} * i / {n}))), 2)"
    return f"({part('cos')} + {part('sin')})"


@query("q15_embedding_spectrum", f""" SELECT vec_id, {", ".join(f"round({_dft('e', str(k), 64)}, 6) + 0 AS p{k}" for k in (1, 5, 16, 32))} FROM v""", "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def _(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumn("m", features.mean(F.col("e"), 64)).withColumn("c", features.centred(F.col("e"), F.col("m"))).withColumn("p", features.power(F.col("c"), 64))
    return v.select("vec_id", *[r6(F.get("p", F.lit(k))).alias(f"p{k}") for k in (1, 5, 16, 32)])


def _spectral_sql(s: str) -> str:
    p = [f"{s}_p[{k + 1}]" for k in range(8)]
    tot = f"(list_sum({s}_p) + 1e-9)"
    mags = f"list_transform({s}_p, lambda v: round(sqrt(v), 9))"
    return f"""round(({" + ".join(f"{x} * {k} * 10 / 15" for k, x in enumerate(p))}) / {tot}, 6) + 0 AS {s}_spec_centroid, round((list_position({mags}, list_max({mags})) - 1) * 10e0 / 15, 6) + 0 AS {s}_dom_freq,
           round(({" + ".join(p[:3])}) / {tot}, 6) + 0 AS {s}_power_low, round(({" + ".join(p[3:])}) / {tot}, 6) + 0 AS {s}_power_high"""


@query("q16_spectral_features", f""", spec AS (SELECT drive_id, rn, {", ".join(f"list_transform(range(8), lambda k: {_dft(s, 'k', 15)}) AS {s}_p" for s in ("acc_mag", "gz"))} FROM ends) SELECT drive_id, rn, {_spectral_sql("acc_mag")}, {_spectral_sql("gz")} FROM spec""", SIGNALS_SQL)
def _(spark, d):
    names = ["acc_mag", "gz"]
    w = _windows(spark, d, names)
    w = w.select("*", *[features.power(F.col(f"{s}__c"), SIZE).alias(f"{s}__p") for s in names])
    return w.select(*KEYS, *[r6(v).alias(f"{s}_{k}") for s in names for k, v in features.spectral_stats(F.col(f"{s}__p"), SIZE).items()])


_RMS = "sqrt(list_avg(list_transform({s}, lambda v: v * v)))"


@query("q17_interaction_features", f""" SELECT drive_id, rn, round(list_stddev_pop(acc_mag) * {_RMS.format(s="acc_horiz")}, 6) AS vibration_power, round({_RMS.format(s="jerk_mag")} * (list_avg(gyro_mag) + 1e-2), 6) AS jerk_motion_intensity, round(abs(list_avg(ax)) / (abs(list_avg(gz)) + 5e-2), 6) AS curv_ratio FROM ends""", SIGNALS_SQL)
def _(spark, d):
    names = ["acc_mag", "acc_horiz", "jerk_mag", "gyro_mag", "ax", "gz"]
    w = _windows(spark, d, names)
    w = w.select("*", *[v.alias(f"{s}_{k}") for s in names for k, v in _base(s).items()])
    return w.select(*KEYS, *[r6(v).alias(k) for k, v in features.interactions(F.col).items()])


@query("q18_interpolated_speed", f" SELECT drive_id, rn, {s6('ai_speed', 'ai_speed_std')} FROM dense", STAND_IN_SQL)
def _(spark, d):
    return motion.dense_speed(_stand_in(drive_view(spark, d))).select(*KEYS, r6("ai_speed"), r6("ai_speed_std"))


AI_SQL = f"""{STAND_IN_SQL},
    stepped AS (SELECT *, coalesce(timestamp - lag(timestamp) {OVER}, lead(timestamp) {OVER} - timestamp, 1e-1) AS dts FROM dense),
    spun AS (SELECT *, first_value(heading) {RUN} + sum(CASE WHEN rn > 1 THEN gyro_z * dts ELSE 0 END) {RUN} AS ai_heading FROM stepped),
    {_integral_sql("spun", "ai_heading", "ai_speed", "ai_pos_x", "ai_pos_y")},
    ai AS (SELECT *, sqrt((ai_pos_x - pos_x) * (ai_pos_x - pos_x) + (ai_pos_y - pos_y) * (ai_pos_y - pos_y)) AS ai_pos_error_m FROM path)"""


def _ai(spark, d):
    return motion.ai_dead_reckoning(motion.dense_speed(_stand_in(drive_view(spark, d))))


@query("q19_model_dead_reckoning", f" SELECT drive_id, rn, {s6('ai_heading', 'ai_pos_x', 'ai_pos_y', 'ai_pos_error_m')} FROM ai", AI_SQL)
def _(spark, d):
    return _ai(spark, d).select(*KEYS, *[r6(c) for c in ("ai_heading", "ai_pos_x", "ai_pos_y", "ai_pos_error_m")])


_E = "abs(speed - ai_speed)"


@query("q20_regression_metrics", f" SELECT drive_id, round(avg({_E}), 6) AS mae, round(sqrt(avg({_E} * {_E})), 6) AS rmse, round(1 - sum(pow(speed - ai_speed, 2)) / (var_pop(speed) * count(*)), 6) AS r2, round(quantile_cont({_E}, 5e-1), 6) AS medae, round(quantile_cont({_E}, 95e-2), 6) AS p95 FROM dense GROUP BY drive_id", STAND_IN_SQL)
def _(spark, d):
    df = motion.dense_speed(_stand_in(drive_view(spark, d)))
    out = df.groupBy("drive_id").agg(*metrics.regression(F.col("speed"), F.col("ai_speed")))
    return out.select("drive_id", *[r6(c) for c in ("mae", "rmse", "r2", "medae", "p95")])


def _cover_sql(level: int, z: str) -> str:
    lo, hi = f"greatest(ai_speed - {z} * ai_speed_std, 0e0)", f"ai_speed + {z} * ai_speed_std"
    share = f"avg(CASE WHEN speed >= {lo} AND speed <= {hi} THEN 1e0 ELSE 0e0 END)"
    return f"round({share}, 6) AS cov_{level}, round(avg({hi} - {lo}), 6) AS width_{level}, round(abs({share} - {level} / 100e0), 6) AS cal_error_{level}"


@query("q21_interval_coverage", f" SELECT drive_id, {_cover_sql(90, '1645e-3')}, {_cover_sql(95, '196e-2')} FROM dense GROUP BY drive_id", STAND_IN_SQL)
def _(spark, d):
    df = motion.dense_speed(_stand_in(drive_view(spark, d)))
    out = df.groupBy("drive_id").agg(*metrics.coverage(F.col("speed"), F.col("ai_speed"), F.col("ai_speed_std")))
    return out.select("drive_id", *[r6(c) for c in out.columns[1:]])


@query("q22_conformal_quantile", f", ranked AS (SELECT driver_id, {_E} AS res, row_number() OVER (PARTITION BY driver_id ORDER BY {_E}) AS i, count(*) OVER (PARTITION BY driver_id) AS n FROM dense) SELECT driver_id, round(res, 6) AS q_hat, n FROM ranked WHERE i - 1 = least(n - 1, CAST(ceil((n + 1) * 9e-1) AS BIGINT))", STAND_IN_SQL)
def _(spark, d):
    df = motion.dense_speed(_stand_in(drive_view(spark, d))).select("driver_id", F.abs(F.col("speed") - F.col("ai_speed")).alias("res"))
    return metrics.conformal_quantile(df, "res", ["driver_id"]).select("driver_id", r6("q_hat"), "n")


_REGIMES = {"stationary": "speed < 5e-1", "low_speed": "speed >= 5e-1 AND speed < 5", "cruise": "speed >= 5", "fast": "speed >= 556e-2", "turning": "abs(gyro_z) > 5e-2", "accelerating": "acc_y > 8e-1", "braking": "acc_y < -8e-1"}


@query("q23_regime_metrics", ", tagged AS (" + " UNION ALL ".join(f"SELECT '{k}' AS regime, * FROM dense WHERE {c}" for k, c in _REGIMES.items()) + f") SELECT regime, count(*) AS n, round(avg({_E}), 6) AS mae, round(sqrt(avg({_E} * {_E})), 6) AS rmse, round(avg(ai_speed_std), 6) AS mean_sigma FROM tagged GROUP BY regime", STAND_IN_SQL)
def _(spark, d):
    df = motion.dense_speed(_stand_in(drive_view(spark, d)))
    e = F.abs(F.col("speed") - F.col("ai_speed"))
    out = metrics.by_regime(df, metrics.regimes(F.col("speed"), F.col("gyro_z"), F.col("acc_y"))).groupBy("regime").agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("ai_speed_std").alias("mean_sigma"))
    return out.select("regime", "n", r6("mae"), r6("rmse"), r6("mean_sigma"))


_AUDIT = ("duration", "min_speed", "max_speed", "mean_speed", "median_speed", "std_speed", "pct_stopped", "max_accel")


@query("q24_target_audit", f""", s AS (SELECT *, timestamp - lag(timestamp) {OVER} AS g, speed - lag(speed) {OVER} AS dv FROM drives), a AS (SELECT *, abs(coalesce(dv / CASE WHEN g <= 0 THEN 1e-1 ELSE g END, 0)) AS acc FROM s),
    t AS (SELECT drive_id, count(*) AS n, max(timestamp) - min(timestamp) AS duration, min(speed) AS min_speed, max(speed) AS max_speed, avg(speed) AS mean_speed, quantile_cont(speed, 5e-1) AS median_speed, stddev_pop(speed) AS std_speed,
          100 * avg(CASE WHEN speed < 1e-1 THEN 1e0 ELSE 0e0 END) AS pct_stopped, max(acc) AS max_accel, count(*) FILTER (acc > 8) AS n_jumps FROM a GROUP BY drive_id) SELECT drive_id, n, {s6(*_AUDIT)}, n_jumps FROM t""")
def _(spark, d):
    return metrics.target_audit(drive_view(spark, d)).select("drive_id", "n", *[r6(c) for c in _AUDIT], "n_jumps")


@query("q25_across_drives", " SELECT count(*) AS num_drives, " + ", ".join(f"round(avg(round({c}, 2)), 5) AS {c}_mean, round(stddev_pop(round({c}, 2)), 5) AS {c}_std" for c in ("naive_rmse", "naive_exit", "naive_settled", "distance")) + " FROM scored", NAIVE_SQL + "," + _metrics_sql("naive", ("naive", "pos_error_m")))
def _(spark, d):
    out = metrics.across_drives(_naive_metrics(spark, d), ["naive_rmse", "naive_exit", "naive_settled", "distance"])
    return out.select("num_drives", *[r6(c, 5) for c in out.columns[1:]])


@query("q26_unit_audit", f", s AS (SELECT *, sqrt(pow(pos_x - lag(pos_x) {OVER}, 2) + pow(pos_y - lag(pos_y) {OVER}, 2)) AS st FROM drives) SELECT drive_id, round(sum(st), 6) AS path_m, round(avg(speed) / 36e-1 * (max(timestamp) - min(timestamp)), 6) AS implied_m, round(sum(st) / (avg(speed) / 36e-1 * (max(timestamp) - min(timestamp)) + 1e-9), 6) AS ratio FROM s GROUP BY drive_id")
def _(spark, d):
    """How far drives go by their places against what their speeds imply if these are km/h."""
    st = F.hypot(F.col("pos_x") - F.lag("pos_x").over(order()), F.col("pos_y") - F.lag("pos_y").over(order()))
    s = drive_view(spark, d).withColumn("st", st).groupBy("drive_id").agg(F.sum("st").alias("path_m"), (F.avg("speed") / 3.6 * (F.max("timestamp") - F.min("timestamp"))).alias("implied_m"))
    return s.select("drive_id", r6("path_m"), r6("implied_m"), r6(F.col("path_m") / (F.col("implied_m") + 1e-9)).alias("ratio"))


@query("q27_leakage_gate", """ SELECT (SELECT count(*) FROM (SELECT DISTINCT drive_id FROM drives WHERE drive_id % 3 <> 0 INTERSECT SELECT DISTINCT drive_id FROM drives WHERE drive_id % 3 = 0)) AS shared_drive_id,
    (SELECT count(*) FROM (SELECT driver_id FROM drives WHERE drive_id % 3 <> 0 INTERSECT SELECT driver_id FROM drives WHERE drive_id % 3 = 0)) AS shared_driver_id,
    (SELECT count(*) FROM drives WHERE speed IS NULL OR isnan(speed)) AS bad_targets, CAST(1 AS BIGINT) AS banned""")
def _(spark, d):
    v = drive_view(spark, d).withColumn("y", F.col("speed"))
    return metrics.leakage_gate(["acc_mag_mean", "speed"], v.where("drive_id % 3 <> 0"), v.where("drive_id % 3 = 0"))


@query("q28_driver_folds", ", f AS (SELECT DISTINCT driver_id AS held_out FROM drives) SELECT held_out, count(*) FILTER (driver_id <> held_out) AS n_train, count(*) FILTER (driver_id = held_out) AS n_test, round(avg(speed) FILTER (driver_id <> held_out), 6) AS train_mean FROM drives, f GROUP BY held_out")
def _(spark, d):
    per = drive_view(spark, d).groupBy("driver_id").agg(F.count("*").alias("n"), F.sum("speed").alias("s"))
    every = per.agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    out = per.crossJoin(F.broadcast(every))  # one row
    return out.select(F.col("driver_id").alias("held_out"), (F.col("n_all") - F.col("n")).alias("n_train"), F.col("n").alias("n_test"), r6((F.col("s_all") - F.col("s")) / (F.col("n_all") - F.col("n"))).alias("train_mean"))


@query("q29_sensor_merge", """, a AS (SELECT drive_id, timestamp AS t, acc_x, acc_y FROM drives WHERE rn % 3 = 1), p AS (SELECT drive_id, timestamp AS t, pos_x, speed FROM drives WHERE rn % 5 = 2), g AS (SELECT drive_id, timestamp AS t, gyro_z FROM drives WHERE rn % 2 = 0)
    SELECT g.drive_id, round(g.t, 6) AS t, g.gyro_z, a.acc_x, a.acc_y, round(p.pos_x, 6) + 0 AS pos_x, p.speed FROM g ASOF LEFT JOIN a ON g.drive_id = a.drive_id AND g.t >= a.t ASOF LEFT JOIN p ON g.drive_id = p.drive_id AND g.t >= p.t""")
def _(spark, d):
    v = drive_view(spark, d).withColumn("t", F.col("timestamp"))
    m = device.merge_sensors(v.where("rn % 3 = 1").select("drive_id", "t", "acc_x", "acc_y"), v.where("rn % 2 = 0").select("drive_id", "t", "gyro_z"), v.where("rn % 5 = 2").select("drive_id", "t", "pos_x", "speed"))
    return m.select("drive_id", r6("t"), "gyro_z", "acc_x", "acc_y", r6("pos_x"), "speed")


@query("q30_dashboard_frames", f""", k AS (SELECT * FROM naive WHERE (rn - 1) % 2 = 0), s AS (SELECT *, coalesce(sqrt(pow(pos_x - lag(pos_x) {OVER}, 2) + pow(pos_y - lag(pos_y) {OVER}, 2)), 0) AS st FROM k)
    SELECT drive_id, rn, round(timestamp, 2) AS t, round(52.4068e0 + degrees(pos_y / 6371000), 6) AS gt_lat, round(-1.5197e0 + degrees(pos_x / (6371000 * cos(radians(52.4068e0)))), 6) AS gt_lon, round(speed / pi(), 2) AS gt_v, round(heading, 3) + 0 AS gt_h,
           round(52.4068e0 + degrees(naive_pos_y / 6371000), 6) AS naive_lat, round(-1.5197e0 + degrees(naive_pos_x / (6371000 * cos(radians(52.4068e0)))), 6) AS naive_lon, round(pos_error_m, 2) AS naive_err, timestamp >= 195e-2 AND timestamp < 395e-2 AS is_blackout, round(sum(st) {RUN}, 1) AS cum_dist_m FROM s""", NAIVE_SQL)
def _(spark, d):
    """With speeds over pi, as plain ones end in so few digits that rounding ties are common, on which engines differ."""
    df = metrics.outage(motion.naive(drive_view(spark, d)), OUT_START, OUT_END)
    return report.frames(df.withColumn("speed", F.col("speed") / F.pi()), 52.4068, -1.5197)


_RULES = ("mean_ay", "var_ay", "mean_mag", "device_speed", "device_sigma")


@query("q31_device_rules", f""", m AS (SELECT *, avg(acc_y) OVER w AS mean_ay, greatest(avg(acc_y * acc_y) OVER w - avg(acc_y) OVER w * avg(acc_y) OVER w, 0) AS var_ay, avg(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z)) OVER w AS mean_mag FROM drives WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS 14 PRECEDING)),
    f AS (SELECT *, var_ay < 2e-2 AND abs(gyro_z) < 12e-3 AS standstill FROM m WHERE rn >= 15),
    g AS (SELECT *, CASE WHEN standstill THEN 0 ELSE greatest((mean_mag - 9.80665e0) * 185e-2 + sqrt(var_ay) * 42e-1, 0) END AS device_speed, CASE WHEN standstill THEN 4e-2 ELSE 15e-2 + sqrt(var_ay) * 35e-2 END AS device_sigma FROM f)
    SELECT drive_id, rn, standstill, {s6(*_RULES)} FROM g""")
def _(spark, d):
    v = drive_view(spark, d).select("*", *[c.alias(k) for k, c in context.device_rules().items()]).where(F.col("rn") >= 15)
    return v.select(*KEYS, "standstill", *[r6(c) for c in _RULES])


@query("q32_noise_terms", f""" SELECT event_id, round(25e-2 / (1 + 15e-1 * greatest(s, 0)), 6) AS blend, round(12e-2 + 15e-1 * s * s, 6) AS q_vel, round(12e-2 * 12e-2 * (1 + pow(15e-1 / greatest(v, 2e-1), 2)), 6) AS r_heading, round(greatest(v - 2 * s, 0), 6) AS lo, round(v + 2 * s, 6) AS hi, round(greatest(4 * s, 15e-1), 6) AS radius, round(least(v * 36e-1 / 120 * 100, 100), 6) AS gauge, round(greatest(60 - value, 0), 6) AS countdown, round(CASE WHEN v > 1e-1 THEN greatest((v - s) / v * 100, 0) END, 6) AS gain,
    printf('%02d:%02d', CAST(floor(value / 60) AS INTEGER), CAST(floor(value % 60) AS INTEGER)) AS clock FROM x""", "x AS (SELECT event_id, value, value / 10 AS v, value / 97 AS s FROM events)")
def _(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value", (F.col("value") / 10).alias("v"), (F.col("value") / 97).alias("s"))
    v, s = F.col("v"), F.col("s")
    lo, hi = noise.band(v, s)
    return x.select("event_id", r6(noise.blend(s)).alias("blend"), r6(noise.velocity_noise(s)).alias("q_vel"), r6(noise.heading_noise(v)).alias("r_heading"), r6(lo).alias("lo"), r6(hi).alias("hi"), r6(noise.radius(s)).alias("radius"), r6(noise.gauge(v)).alias("gauge"), r6(noise.countdown(F.col("value"), F.lit(60.0))).alias("countdown"), r6(noise.gain_shown(v, s)).alias("gain"), noise.clock(F.col("value")).alias("clock"))


_PATHS = "'/data/' || CASE p_size % 6 WHEN 0 THEN 'Driver A/x' WHEN 1 THEN 'S-M' WHEN 2 THEN 'S-Y1' WHEN 3 THEN 'Vta3' WHEN 4 THEN 'S-S2' ELSE 'other' END || '.csv'"


@query("q33_driver_inference", " SELECT p_partkey, CASE WHEN contains(path, 'Driver A') OR contains(path, 'S-S') THEN 'A' WHEN contains(path, 'Driver B') OR contains(path, 'S-M') THEN 'B' WHEN contains(path, 'Driver D') OR contains(path, 'S-Y') THEN 'D' WHEN contains(path, 'Driver E') OR contains(path, 'Vf') OR contains(path, 'Vta') OR contains(path, 'Vtb') OR contains(path, 'Vw') THEN 'E' ELSE 'Unknown' END AS driver_id FROM x", f"x AS (SELECT p_partkey, {_PATHS} AS path FROM part)")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(_PATHS).alias("path")).select("p_partkey", drives.infer_driver(F.col("path")).alias("driver_id"))


@query("q34_biased_sensors", " SELECT drive_id, rn, round(acc_x + 15e-2, 6) + 0 AS acc_x, round(acc_y + 15e-2, 6) + 0 AS acc_y, round(gyro_z + 2e-2, 6) + 0 AS gyro_z FROM drives")
def _(spark, d):
    return models.perturb(models.perturb(drive_view(spark, d), "acc_bias"), "gyro_bias").select(*KEYS, r6("acc_x"), r6("acc_y"), r6("gyro_z"))


@query("q35_top_drives", ", x AS (SELECT drive_id, naive_exit, row_number() OVER (ORDER BY round(naive_exit, 6) DESC, drive_id) AS place FROM scored) SELECT place, drive_id, round(naive_exit, 6) AS naive_exit FROM x WHERE place <= 15", NAIVE_SQL + "," + _metrics_sql("naive", ("naive", "pos_error_m")))
def _(spark, d):
    top = _naive_metrics(spark, d).select("drive_id", r6("naive_exit")).orderBy(F.desc("naive_exit"), "drive_id").limit(15)
    return top.select(F.row_number().over(W.orderBy(F.desc("naive_exit"), "drive_id")).cast("long").alias("place"), "drive_id", "naive_exit")


@query("q36_content_hash", " SELECT l_orderkey, substr(sha256(string_agg(concat_ws(',', l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus), ';' ORDER BY l_linenumber, l_partkey, l_suppkey)), 1, 12) AS hash FROM lineitem GROUP BY l_orderkey", "x AS (SELECT 1)")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("s"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("a")).select("l_orderkey", F.substring(F.sha2(F.concat_ws(";", F.transform("a", lambda x: x["s"])), 256), 1, 12).alias("hash"))


def _fused(spark, d, params=ekf.FilterParams(), rule="context", first_dt=None) -> DataFrame:
    df = metrics.outage(_ai(spark, d), OUT_START, OUT_END).withColumn("style", context.driver_style(F.first("driver_id").over(drives.so_far())))
    return ekf.fuse(ekf.with_context(df, scale=0.0025), params, rule, first_dt)


def _matrix(f) -> str:
    return "[" + ", ".join(f(i, j) for i in range(6) for j in range(6)) + "]"


def _p(i: int, j: int) -> str:
    return f"p[{6 * i + j + 1}]"


def _measured_sql(states: list[int], gains: list[str], noise: list[str], innovation: list[str], cond: str) -> str:
    """x and p after a measurement of ``states`` with the columns ``gains`` (lists of six), in Joseph form, where ``cond`` holds."""
    m = lambda i, j: "(" + " - ".join([_p(i, j), *[f"{k}[{i + 1}] * {_p(s, j)}" for k, s in zip(gains, states, strict=True)]]) + ")"
    new = lambda i, j: m(i, j) + "".join(f" - {m(i, s)} * {k}[{j + 1}] + {r} * {k}[{i + 1}] * {k}[{j + 1}]" for k, s, r in zip(gains, states, noise, strict=True))
    x = ", ".join(f"x[{i + 1}]" + "".join(f" + {k}[{i + 1}] * ({y})" for k, y in zip(gains, innovation, strict=True)) for i in range(6))
    return f"CASE WHEN {cond} THEN [{x}] ELSE x END AS x, CASE WHEN {cond} THEN {_matrix(new)} ELSE p END AS p"


def _wrapped(a: str) -> str:
    return f"({a} - 2 * pi() * floor(({a} + pi()) / (2 * pi())))"


def _filter_sql(name: str = "", params: ekf.FilterParams = ekf.FilterParams(), rule: str = "context", heading: str = "heading") -> str:
    """CTEs from ``moded`` to ``fused<name>``: the filter as a recursion over rows, all drives at once. Five states are six without the fourth."""
    still, tunnel, dts = ("context_mode = 'STANDSTILL'", "context_mode = 'PREDICTIVE_TUNNEL_BLACKOUT'", "dts") if rule == "context" else (f"{str(params.zupt).lower()} AND abs(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) - 981e-2) < 25e-2 AND abs(gyro_z) < 5e-2 AND ai_speed < 4e-1", "false", f"coalesce(timestamp - lag(timestamp) {OVER}, 1e-1)")
    sigma = "ai_speed_std" if params.sigma is None else f"CAST({params.sigma!r} AS DOUBLE)"
    lateral = ("0e0", "0e0") if params.legacy else ("25e-2", "25e-4")
    turn = {(0, 0): "1e0", (1, 1): "1e0", (4, 4): "1e0", (5, 5): "1e0", (0, 2): "keep * sn * dts", (0, 3): "kl * cs * dts", (0, 4): "mv * north * dts", (0, 5): "-mv * north * dts * dts", (1, 2): "keep * cs * dts", (1, 3): "-kl * sn * dts", (1, 4): "-mv * east * dts", (1, 5): "mv * east * dts * dts", (2, 2): "keep", (3, 3): "kl", (4, 5): "-mv * dts"}
    dot = lambda terms: " + ".join(terms) or "0e0"
    q = ["25e-4", "25e-4", "CASE WHEN aggressive THEN 2e-1 ELSE 12e-2 END + 15e-1 * ai_speed_std * ai_speed_std", lateral[1], "9e-6", "CASE WHEN tunnel THEN 1e-14 ELSE 1e-12 END"]
    nhc = "CASE WHEN aggressive THEN 625e-4 ELSE 25e-4 END"
    column = lambda f, rows: "[" + ", ".join(f(i) if i in rows else "0e0" for i in range(6)) + "]"
    s = lambda i, j: f"s[{3 * i + j + 1}]"
    cof = lambda i, j: f"({s((i + 1) % 3, (j + 1) % 3)} * {s((i + 2) % 3, (j + 2) % 3)} - {s((i + 1) % 3, (j + 2) % 3)} * {s((i + 2) % 3, (j + 1) % 3)})"
    gps = lambda j: column(lambda i: "(" + " + ".join(f"{_p(i, k)} * {cof(j, k)}" for k in range(3)) + ") / det", {0, 1, 2, 3})
    two = [column(lambda i: f"({_p(i, 2)} * ({_p(3, 3)} + 16e-4) - {_p(i, 3)} * {_p(3, 2)}) / det", {2, 3}), column(lambda i: f"({_p(i, 3)} * ({_p(2, 2)} + 16e-4) - {_p(i, 2)} * {_p(2, 3)}) / det", {2, 3})]
    if params.legacy:
        two = [column(lambda i: f"{_p(i, 2)} / ({_p(2, 2)} + 16e-4)", {2}), "[0e0, 0e0, 0e0, 0e0, 0e0, 0e0]"]
    noise, used = ("144e-4", "NOT in_outage AND speed > 1") if params.legacy else ("144e-4 * (1 + pow(15e-1 / greatest(speed, 2e-1), 2))", "NOT in_outage")
    keep = "* EXCLUDE (x, p)"
    return f"""
    rows_in{name} AS (SELECT drive_id, rn, {dts} AS dts, ai_speed, {sigma} AS ai_speed_std, gyro_z, pos_x, pos_y, speed, {heading} AS heading, in_outage, aggressive, {still} AS still, {tunnel} AS tunnel FROM moded),
    ekf{name}(drive_id, rn, x, p, ox, oy) AS (
        SELECT drive_id, CAST(0 AS BIGINT), [pos_x, pos_y, speed, 0e0, heading, 0e0], [{", ".join(v if i == j else "0e0" for i, v in enumerate(("4e0", "4e0", "1e0", lateral[0], "5e-2", "1e-4")) for j in range(6))}], 0e0, 0e0 FROM rows_in{name} WHERE rn = 1
        UNION ALL
        SELECT drive_id, rn, CASE WHEN in_outage THEN x ELSE list_concat(x[1:4], [{_wrapped("x[5]")}, x[6]]) END, p, ox, oy FROM (
        SELECT {keep}, {_measured_sql([4], ["kh"], ["rh"], [_wrapped("(heading - x[5])")], used)} FROM (
        SELECT *, {column(lambda i: f"{_p(i, 4)} / ({_p(4, 4)} + rh)", {4, 5})} AS kh FROM (
        SELECT {keep}, {noise} AS rh, {_measured_sql([0, 1, 2], ["g0", "g1", "g2"], ["4e0", "4e0", "16e-2"], ["pos_x - x[1]", "pos_y - x[2]", "speed - x[3]"], "NOT in_outage")} FROM (
        SELECT *, {gps(0)} AS g0, {gps(1)} AS g1, {gps(2)} AS g2 FROM (
        SELECT *, {s(0, 0)} * {cof(0, 0)} + {s(0, 1)} * {cof(0, 1)} + {s(0, 2)} * {cof(0, 2)} AS det FROM (
        SELECT * EXCLUDE (det), x[1] AS ox, x[2] AS oy, [{", ".join(_p(i, j) + (" + " + ("4e0", "4e0", "16e-2")[i] if i == j else "") for i in range(3) for j in range(3))}] AS s FROM (
        SELECT {keep}, {_measured_sql([2, 3], ["z0", "z1"], ["16e-4", "16e-4"], ["-x[3]", "-x[4]"], "still" if params.zupt else "false")} FROM (
        SELECT *, {two[0]} AS z0, {two[1]} AS z1 FROM (
        SELECT *, ({_p(2, 2)} + 16e-4) * ({_p(3, 3)} + 16e-4) - {_p(2, 3)} * {_p(3, 2)} AS det FROM (
        SELECT {keep}, {_measured_sql([3], ["kn"], [nhc], ["-x[4]"], str(params.nhc).lower())} FROM (
        SELECT *, {column(lambda i: f"{_p(i, 3)} / ({_p(3, 3)} + {nhc})", {0, 1, 2, 3, 4})} AS kn FROM (
        SELECT {keep}, [x[1] + east * dts, x[2] + north * dts, v, lat, h, x[6]] AS x, {_matrix(lambda i, j: dot([f"fp[{6 * i + k + 1}] * ({turn[j, k]})" for k in range(6) if (j, k) in turn]) + (f" + {q[i]}" if i == j else ""))} AS p FROM (
        SELECT *, {_matrix(lambda i, j: dot([f"({turn[i, k]}) * {_p(k, j)}" for k in range(6) if (i, k) in turn]))} AS fp FROM (
        SELECT *, v * sn + lat * cs AS east, v * cs - lat * sn AS north FROM (
        SELECT *, sin(h) AS sn, cos(h) AS cs FROM (
        SELECT *, CASE WHEN still THEN 0e0 ELSE 1e0 END AS mv, keep * x[3] + a * ai_speed AS v, kl * x[4] AS lat, CASE WHEN still THEN x[5] ELSE {_wrapped("(x[5] + (gyro_z - x[6]) * dts)")} END AS h FROM (
        SELECT *, CASE WHEN still THEN 0e0 ELSE 1 - a END AS keep FROM (
        SELECT r.*, e.x, e.p, CASE WHEN still THEN 0e0 ELSE 9e-1 END AS kl, CASE WHEN still THEN 0e0 ELSE 25e-2 / (1 + 15e-1 * greatest(ai_speed_std, 0)) END AS a FROM ekf{name} e JOIN rows_in{name} r ON r.drive_id = e.drive_id AND r.rn = e.rn + 1
        ))))))))))))))))))),
    fused{name} AS (SELECT d.*, x[1] AS fused_pos_x, x[2] AS fused_pos_y, x[3] AS fused_velocity, x[4] AS fused_lat_velocity, x[5] AS fused_heading, x[6] AS fused_gyro_bias, ox AS open_loop_pos_x, oy AS open_loop_pos_y,
                     sqrt(pow(x[1] - pos_x, 2) + pow(x[2] - pos_y, 2)) AS fused_pos_error_m, sqrt(pow(ox - pos_x, 2) + pow(oy - pos_y, 2)) AS open_loop_error_m FROM moded d JOIN ekf{name} USING (drive_id, rn))"""


_MODED_SQL = f"""RECURSIVE {AI_SQL},
    way AS (SELECT drive_id, rn, speed, pos_x - coalesce(lag(pos_x) {OVER}, pos_x) AS dx, pos_y - coalesce(lag(pos_y) {OVER}, pos_y) AS dy FROM drives),
    smooth AS (SELECT drive_id, rn, speed, atan2(avg(dx) OVER c, avg(dy) OVER c) AS c FROM way WINDOW c AS (PARTITION BY drive_id ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    courses AS (SELECT drive_id, rn, coalesce(last_value(CASE WHEN speed > 4e-1 THEN c END IGNORE NULLS) {RUN}, first_value(c) {RUN}) AS course FROM smooth),
    seen AS (SELECT *, timestamp >= 195e-2 AND timestamp < 395e-2 AS in_outage, first_value(driver_id) {RUN} = 'E' AS aggressive, (var_pop(acc_x) OVER w + var_pop(acc_y) OVER w) * 25e-4 AS acc_var FROM ai JOIN courses USING (drive_id, rn) WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
    moded AS (SELECT *, CASE WHEN acc_var < 18e-3 AND abs(gyro_z) < 1e-2 AND least(ai_speed, speed) < 5e-1 THEN 'STANDSTILL' WHEN ambient_lux < 100 AND least(ai_speed, speed) > 4 THEN 'PREDICTIVE_TUNNEL_BLACKOUT' WHEN least(ai_speed, speed) > 18 THEN 'HIGHWAY_CRUISING' ELSE 'NORMAL_URBAN' END AS context_mode FROM seen)"""
FUSED_SQL = f"{_MODED_SQL},{_filter_sql()}"
_FUSED = (*ekf.STATE, "open_loop_pos_x", "open_loop_pos_y", "fused_pos_error_m", "open_loop_error_m")


@query("q37_fused_trajectory", f" SELECT drive_id, rn, context_mode, in_outage, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _FUSED)} FROM fused", FUSED_SQL)
def _(spark, d):
    return _fused(spark, d).select(*KEYS, "context_mode", "in_outage", *[r6(F.col(c) + 1e-9).alias(c) for c in _FUSED])


_FREE = {"nhc": False, "zupt": False}
_VARIANTS = [
    ekf.Variant("filter_constant", ekf.FilterParams(sigma=0.5, **_FREE), "rest", 0.1), ekf.Variant("filter_uncertainty", ekf.FilterParams(**_FREE), "rest", 0.1),
    ekf.Variant("filter_nhc", ekf.FilterParams(zupt=False), "rest", 0.1), ekf.Variant("filter_zupt", ekf.FilterParams(), "rest", 0.1), ekf.Variant("full"),
]


def _base_rows(spark, d) -> DataFrame:
    base = metrics.outage(_ai(spark, d), OUT_START, OUT_END).withColumn("style", context.driver_style(F.first("driver_id").over(drives.so_far())))
    return ekf.with_context(base, scale=0.0025)


def _per_variant(df: DataFrame, variants: list[ekf.Variant]) -> DataFrame:
    """Metrics per drive of all variants, from one pass of their filters."""
    return metrics.drive_metrics(ekf.fuse_variants(df, variants), {v.name: (f"{v.name}_pos_error_m", f"{v.name}_open_loop_error_m") for v in variants}, SETTLE)


def _variants_sql() -> str:
    """The metrics of all variants: a recursion for each, and their errors side by side."""
    cols = ", ".join(f"w_{v.name}.fused_pos_error_m AS {v.name}_e, w_{v.name}.open_loop_error_m AS {v.name}_o" for v in _VARIANTS)
    sides = " ".join(f"JOIN fused_{v.name} AS w_{v.name} USING (drive_id, rn)" for v in _VARIANTS)
    side = f"side AS (SELECT moded.* EXCLUDE (in_outage), {cols} FROM moded {sides})"
    return ",".join([_MODED_SQL, *[_filter_sql(f"_{v.name}", v.params, v.rule) for v in _VARIANTS], side, _metrics_sql("side", *[(v.name, f"{v.name}_e", f"{v.name}_o") for v in _VARIANTS])])


_SPREAD = [(c, n, f) for c in ("exit", "outage_peak", "settled", "rmse") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]


@query("q38_filter_variants", " UNION ALL ".join(f" SELECT '{v.name}' AS variant, " + ", ".join(f"round({'avg' if n == 'mean' else 'stddev_pop'}({v.name}_{c}), 6) + 0 AS fused_{c}_{n}" for c, n, _ in _SPREAD) + " FROM scored" for v in _VARIANTS), _variants_sql())
def _(spark, d):
    m = _per_variant(_base_rows(spark, d), _VARIANTS)
    one = m.agg(*[f(f"{v.name}_{c}").alias(f"{v.name}_{c}_{n}") for v in _VARIANTS for c, n, f in _SPREAD])
    each = [F.struct(F.lit(v.name).alias("variant"), *[r6(F.col(f"{v.name}_{c}_{n}")).alias(f"fused_{c}_{n}") for c, n, _ in _SPREAD]) for v in _VARIANTS]
    return one.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def _all_windows(spark, d) -> tuple[DataFrame, list[str]]:
    """All features of all drives, and their names."""
    f = features.features(drive_view(spark, d))
    return f, features.subset(f.columns, "all")


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to train on, and those of the held-out drives."""
    return df.where("drive_id % 3 <> 0"), df.where("drive_id % 3 = 0")


@query("q39_forest_with_deviation")
def _(spark, d):
    f, names = _all_windows(spark, d)
    train, test = _split(f)
    return models.SpeedModel(shared=True).train(train, names).predict(test).select(*KEYS, "y", "v_pred", "v_std")


@query("q40_permutation_importance")
def _(spark, d):
    f, names = _all_windows(spark, d)
    train, test = _split(f)
    fitted, _ = models.fit_together(train.withColumn("setting", F.lit(0)), names, {"boosted": models.BOOSTED})
    return models.permutation_importance(fitted["boosted"], test)


_DEVICE_SQL = f"""{DRIVES_SQL},
    given AS (SELECT *, avg(acc_y) OVER w AS mean_ay, greatest(avg(acc_y * acc_y) OVER w - avg(acc_y) OVER w * avg(acc_y) OVER w, 0) AS var_ay, avg(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z)) OVER w AS mean_mag,
                     coalesce(timestamp - lag(timestamp) {OVER}, lead(timestamp) {OVER} - timestamp, 1e-1) AS dts FROM drives WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS 14 PRECEDING)),
    ruled AS (SELECT *, var_ay < 2e-2 AND abs(gyro_z) < 12e-3 AS rests FROM given),
    sensed AS (SELECT *, rn >= 15 AS ready, rn >= 15 AND rests AS standstill, CASE WHEN rn < 15 OR rests THEN 0 ELSE greatest((mean_mag - 980665e-5) * 185e-2 + sqrt(var_ay) * 42e-1, 0) END AS predicted_speed,
                      CASE WHEN rn < 15 THEN 2e-1 WHEN rests THEN 4e-2 ELSE 15e-2 + sqrt(var_ay) * 35e-2 END AS sigma FROM ruled),
    engine(drive_id, rn, v, h, x, y, b, alert) AS (SELECT DISTINCT drive_id, CAST(0 AS BIGINT), 0e0, 0e0, 0e0, 0e0, 0e0, false FROM drives UNION ALL
        SELECT drive_id, rn, CASE WHEN fixed THEN v1 + 2e-1 * (speed - v1) ELSE v1 END, CASE WHEN turned THEN h1 + 1e-1 * err - 2 * pi() * floor((h1 + 1e-1 * err + pi()) / (2 * pi())) ELSE h1 END,
               CASE WHEN fixed THEN x1 + 15e-2 * (pos_x - x1) ELSE x1 END, CASE WHEN fixed THEN y1 + 15e-2 * (pos_y - y1) ELSE y1 END, CASE WHEN turned THEN b + 5e-3 * err ELSE b END, alert
        FROM (SELECT *, rn % 10 = 0 AS fixed, rn % 10 = 0 AND speed > 12e-1 AS turned, CASE WHEN ready THEN x + v1 * sin(h1) * dts ELSE x END AS x1, CASE WHEN ready THEN y + v1 * cos(h1) * dts ELSE y END AS y1, heading - h1 - 2 * pi() * floor((heading - h1 + pi()) / (2 * pi())) AS err
              FROM (SELECT s.*, e.x, e.y, e.b, ready AND ambient_lux < 100 AND e.v > 4 AS alert, CASE WHEN ready AND NOT standstill THEN 8e-1 * e.v + 2e-1 * predicted_speed ELSE e.v END AS v1, CASE WHEN ready THEN e.h + (gyro_z - e.b) * dts ELSE e.h END AS h1
                    FROM engine e JOIN sensed s ON s.drive_id = e.drive_id AND s.rn = e.rn + 1)))"""
_DEVICE = ("predicted_speed", "state_speed", "state_heading", "state_x", "state_y", "gyro_bias", "sigma")


@query("q41_device_replay", f" SELECT drive_id, rn, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _DEVICE)}, standstill, tunnel_alert FROM (SELECT s.drive_id, s.rn, predicted_speed, v AS state_speed, h AS state_heading, e.x AS state_x, e.y AS state_y, b AS gyro_bias, sigma, standstill, alert AS tunnel_alert FROM engine e JOIN sensed s USING (drive_id, rn))", "RECURSIVE " + _DEVICE_SQL)
def _(spark, d):
    out = device.replay(drive_view(spark, d).withColumn("dt", signals.step_dt()))
    return out.select(*KEYS, *[r6(F.col(c) + 1e-9).alias(c) for c in _DEVICE], "standstill", "tunnel_alert")  # headings often end in 5 at the seventh place


@query("q42_leave_one_driver_out")
def _(spark, d):
    f, names = _all_windows(spark, d)
    who = drive_view(spark, d).groupBy("drive_id").agg(F.min_by("driver_id", "rn").alias("driver_id"))
    return models.leave_one_out(f.join(who, "drive_id"), names)


_SIMULATED = f"""WITH RECURSIVE spec(drive_id, style, smooth, bias_x, bias_y, bias_turn) AS (VALUES (0, 'A', 92e-2, -3e-2, 5e-2, 15e-2), (1, 'B', 95e-2, -2e-2, 4e-2, 12e-2), (2, 'D', 88e-2, -3e-2, 5e-2, 15e-2), (3, 'E', 82e-2, -5e-2, 7e-2, 2e-1)),
    ts AS (SELECT *, i * 350e0 / 3499 AS t FROM spec, range(3500) AS r(i)),
    aims AS (SELECT *, CASE style
            WHEN 'A' THEN CASE WHEN t % 90 < 20 THEN 14 * (t % 90) / 20 WHEN t % 90 < 45 THEN 14 + 12e-1 * sin(2e-1 * t) WHEN t % 90 < 60 THEN 8 WHEN t % 90 < 75 THEN 16 ELSE 16 - 16 * (t % 90 - 75) / 15 END
            WHEN 'B' THEN 23 + 45e-1 * sin(2 * pi() * 12e-3 * t) + 12e-1 * cos(2 * pi() * 3e-2 * t)
            WHEN 'D' THEN CASE WHEN t % 50 < 15 THEN 0 WHEN t % 50 < 28 THEN 11 * (t % 50 - 15) / 13 WHEN t % 50 < 40 THEN 12 ELSE 12 - 12 * (t % 50 - 40) / 10 END
            ELSE CASE WHEN t % 70 < 12 THEN 24 * (t % 70) / 12 WHEN t % 70 < 30 THEN 25 + 3 * sin(4e-1 * t) WHEN t % 70 < 42 THEN 15 WHEN t % 70 < 52 THEN 18 - 18 * (t % 70 - 42) / 10 ELSE 0 END END AS aim,
        CASE style
            WHEN 'A' THEN CASE WHEN t % 90 < 20 THEN 0 WHEN t % 90 < 45 THEN 1e-2 * cos(15e-2 * t) WHEN t % 90 < 60 THEN CASE WHEN t % 180 < 90 THEN radians(6) ELSE -radians(6) END ELSE 0 END
            WHEN 'B' THEN 15e-3 * sin(2 * pi() * 2e-2 * t)
            WHEN 'D' THEN CASE WHEN t % 50 < 15 THEN 0 WHEN t % 50 < 28 THEN 1e-2 * sin(2e-1 * t) WHEN t % 50 < 40 THEN 3e-2 * cos(25e-2 * t) ELSE 0 END
            ELSE CASE WHEN t % 70 < 12 THEN 0 WHEN t % 70 < 30 THEN 4e-2 * cos(3e-1 * t) WHEN t % 70 < 42 THEN CASE WHEN t % 140 < 70 THEN radians(75e-1) ELSE -radians(75e-1) END ELSE 0 END END AS turn FROM ts),
    lists AS (SELECT drive_id, list(aim ORDER BY i) AS a, any_value(smooth) AS k FROM aims GROUP BY drive_id),
    run(drive_id, i, v) AS (SELECT drive_id, 0, (1 - k) * a[1] FROM lists UNION ALL SELECT r.drive_id, r.i + 1, k * r.v + (1 - k) * a[r.i + 2] FROM run r JOIN lists l ON l.drive_id = r.drive_id WHERE r.i < 3499),
    driven AS (SELECT aims.*, i + 1 AS rn, greatest(v, 0) AS speed, sum(CASE WHEN i > 0 THEN turn * 1e-1 ELSE 0 END) OVER (PARTITION BY drive_id ORDER BY i) AS way FROM aims JOIN run USING (drive_id, i)),
    moved AS (SELECT *, 5e-1 * (speed + lag(speed) {OVER}) AS vm, 5e-1 * (way + lag(way) {OVER}) AS hm, lag(speed) {OVER} AS sb, lead(speed) {OVER} AS sa, 2e-1 * speed / 25 + 3e-2 AS shake FROM driven),
    done AS (SELECT *, coalesce(sum(vm * sin(hm) * 1e-1) {RUN}, 0) AS pos_x, coalesce(sum(vm * cos(hm) * 1e-1) {RUN}, 0) AS pos_y, way - 2 * pi() * floor((way + pi()) / (2 * pi())) AS heading, t AS timestamp,
            speed * turn + bias_x + shake * cos(2 * pi() * 42e-1 * t) AS acc_x, CASE WHEN sb IS NULL THEN (sa - speed) / 1e-1 WHEN sa IS NULL THEN (speed - sb) / 1e-1 ELSE (sa - sb) / 2e-1 END + bias_y + shake * sin(2 * pi() * 35e-1 * t) AS acc_y,
            980665e-5 + 16e-1 * shake * sin(2 * pi() * 5 * t) AS acc_z, 0e0 AS gyro_x, 0e0 AS gyro_y, turn + radians(bias_turn) AS gyro_z FROM moved)"""


@query("q43_simulated_drives", f"{_SIMULATED} SELECT CAST(drive_id AS BIGINT) AS drive_id, rn, style AS driver_id, {s6('timestamp', 'pos_x', 'pos_y', 'speed', 'heading', *drives.SENSORS)}, 15e2 AS ambient_lux FROM done", "")
def _(spark, d):
    """Drives without noise."""
    v = simulate.simulate(spark, [("A", 350.0), ("B", 350.0), ("D", 350.0), ("E", 350.0)], seed=None)
    return v.select("drive_id", "rn", "driver_id", *[r6(c) for c in ("timestamp", "pos_x", "pos_y", "speed", "heading", *drives.SENSORS)], "ambient_lux")


_RAW_SIGNALS = {"ax": "acc_x", "ay": "acc_y", "az": "acc_z", "gx": "gyro_x", "gy": "gyro_y", "gz": "gyro_z"}
_ALL_SQL = f"""{SIGNALS_SQL.split("win AS")[0].rstrip().removesuffix(",")},
    twelve AS (SELECT sig.* EXCLUDE (ax, gz), {", ".join(f"{c} AS {k}" for k, c in _RAW_SIGNALS.items())} FROM sig JOIN drives USING (drive_id, rn)),
    wide AS (SELECT drive_id, rn, timestamp AS t_end, speed AS y, {", ".join(f"list({x}) OVER w AS {x}" for x in features.SIGNALS)} FROM twelve WINDOW w AS (PARTITION BY drive_id ORDER BY rn ROWS 14 PRECEDING)),
    ends AS (SELECT *, {", ".join(f"list_avg({x}) AS {x}_m, list_stddev_pop({x}) AS {x}_d, list_sort({x}) AS {x}_z" for x in features.SIGNALS)} FROM wide WHERE rn >= 15 AND (rn - 15) % 2 = 0),
    spec AS (SELECT *, {", ".join(f"list_transform(range(8), lambda k: {_dft(x, 'k', 15).replace(f'list_avg({x})', f'{x}_m')}) AS {x}_p" for x in features.SIGNALS)} FROM ends)"""


def _features_sql(x: str) -> str:
    """The features of one signal but zcr, which hangs on how a mean is rounded."""
    at = lambda q: f"({x}_z[{int(q * 14) + 1}] + ({x}_z[{min(int(q * 14) + 2, 15)}] - {x}_z[{int(q * 14) + 1}]) * {round(q * 14 - int(q * 14), 6)!r})"
    moment = lambda k: f"list_avg(list_transform({x}, lambda v: pow(v - {x}_m, {k}))) / pow({x}_d, {k})"
    cols = {
        "mean": f"{x}_m", "std": f"{x}_d", "min": f"list_min({x})", "max": f"list_max({x})", "p2p": f"list_max({x}) - list_min({x})", "rms": _RMS.format(s=x), "median": at(0.5), "iqr": f"{at(0.75)} - {at(0.25)}", "p10": at(0.1), "p90": at(0.9),
        "mad": f"list_aggregate({x}, 'mad')", "skew": f"(CASE WHEN {x}_d > 1e-6 THEN {moment(3)} ELSE 0 END)", "kurt": f"(CASE WHEN {x}_d > 1e-6 THEN {moment(4)} - 3 ELSE 0 END)",
    }
    return ", ".join(f"round({v} + 1e-9, 6) + 0 AS {x}_{k}" for k, v in cols.items()) + ", " + _spectral_sql(x)


_MIXED_SQL = f"round(acc_mag_d * {_RMS.format(s='acc_horiz')}, 6) AS vibration_power, round({_RMS.format(s='jerk_mag')} * (gyro_mag_m + 1e-2), 6) AS jerk_motion_intensity, round(abs(ax_m) / (abs(gz_m) + 5e-2), 6) AS curv_ratio"


@query("q44_all_features", f" SELECT drive_id, rn, round(t_end, 6) AS t_end, round(y, 6) AS y, {', '.join(_features_sql(x) for x in features.SIGNALS)}, {_MIXED_SQL} FROM spec", _ALL_SQL)
def _(spark, d):
    """All features but the twelve zcr, which ``q62_zero_crossings`` has where a mean's rounding doesn't decide."""
    return _shown_features(features.features(drive_view(spark, d)))


def _shown_features(f: DataFrame) -> DataFrame:
    plain = ("t_end", "y", *[k for k, _ in features.interactions(F.col).items()], *[f"{x}_{k}" for x in features.SIGNALS for k in ("spec_centroid", "dom_freq", "power_low", "power_high")])
    # moments of few distinct values are often exact in seven places and end in 5: a shift keeps engines from rounding such a tie apart
    return f.select(*KEYS, *[r6(c) if c in plain else r6(F.col(c) + 1e-9).alias(c) for c in f.columns if c not in KEYS and not c.endswith("_zcr")])


_BOTH = [f"{k}_{c}" for k in ("ai", "fused") for c in ("rmse", "max", "final", "outage_peak", "exit", "settled")]


@query("q45_fused_metrics", f" SELECT drive_id, n, {s6('duration', 'distance', 'outage_distance', *_BOTH)}, round(ai_drift_pct, 4) AS ai_drift_pct, round(fused_drift_pct, 4) AS fused_drift_pct FROM scored", FUSED_SQL + "," + _metrics_sql("(SELECT * EXCLUDE (in_outage) FROM fused)", ("ai", "ai_pos_error_m"), ("fused", "fused_pos_error_m", "open_loop_error_m")))
def _(spark, d):
    m = metrics.drive_metrics(_fused(spark, d), {"ai": ("ai_pos_error_m", "ai_pos_error_m"), "fused": ("fused_pos_error_m", "open_loop_error_m")}, SETTLE)
    return m.select("drive_id", "n", *[r6(c) for c in ("duration", "distance", "outage_distance", *_BOTH)], r6("ai_drift_pct", 4), r6("fused_drift_pct", 4))


def _model(spark, d) -> tuple[models.SpeedModel, DataFrame]:
    """A forest of the full size, trained on two thirds of the drives, and the other drives."""
    f, names = _all_windows(spark, d)
    return models.SpeedModel(shared=True).train(_split(f)[0], names), _split(drive_view(spark, d))[1]


@query("q46_robustness")
def _(spark, d):
    return models.robustness(*_model(spark, d), start=OUT_START, end=OUT_END, settle=SETTLE, scale=0.0025)


@query("q47_window_sweep", """ SELECT w AS window_rows, count(*) AS n_windows, count(DISTINCT drive_id) AS n_drives FROM drives, (VALUES (5), (10), (15), (20), (30)) AS s(w) WHERE rn >= w AND (rn - w) % 2 = 0 GROUP BY w""")
def _(spark, d):
    sizes = F.array(*[F.lit(features.rows_of(s, 10.0, 4)) for s in (0.5, 1.0, 1.5, 2.0, 3.0)])
    x = drive_view(spark, d).select("drive_id", "rn", F.explode(sizes).alias("window_rows")).where("rn >= window_rows and (rn - window_rows) % 2 = 0")
    return x.groupBy("window_rows").agg(F.count("*").alias("n_windows"), F.countDistinct("drive_id").alias("n_drives"))


@query("q48_speed_band", " SELECT drive_id, rn, round(greatest(ai_speed - 2 * ai_speed_std, 0), 6) AS lo, round(ai_speed + 2 * ai_speed_std, 6) AS hi, timestamp >= 195e-2 AND timestamp <= 395e-2 AS shaded FROM dense", STAND_IN_SQL)
def _(spark, d):
    df = motion.dense_speed(_stand_in(drive_view(spark, d)))
    lo, hi = noise.band(F.col("ai_speed"), F.col("ai_speed_std"))
    return df.select(*KEYS, r6(lo).alias("lo"), r6(hi).alias("hi"), ((F.col("timestamp") >= OUT_START) & (F.col("timestamp") <= OUT_END)).alias("shaded"))


@query("q49_driver_extremes", ", who AS (SELECT drive_id, arg_min(driver_id, rn) AS driver_id FROM drives GROUP BY drive_id) SELECT count(*) AS num_drives, round(min(naive_exit), 6) AS naive_exit_min, round(max(naive_exit), 6) AS naive_exit_max, round(min(naive_max), 6) AS naive_max_min, round(max(naive_max), 6) AS naive_max_max FROM scored JOIN who USING (drive_id) WHERE driver_id = 'E'", NAIVE_SQL + "," + _metrics_sql("naive", ("naive", "pos_error_m")))
def _(spark, d):
    who = drive_view(spark, d).groupBy("drive_id").agg(F.min_by("driver_id", "rn").alias("driver_id"))
    out = metrics.extremes(_naive_metrics(spark, d).join(who, "drive_id"), "E", ["naive_exit", "naive_max"])
    return out.select("num_drives", *[r6(c) for c in out.columns[1:]])


@query("q50_feature_labels", " SELECT p_partkey, array_to_string(list_transform(string_split(lower(replace(p_name, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part", "x AS (SELECT 1)")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", noise.label(F.col("p_name")).alias("label"))


_DOC = [("n", "n"), *[(c, f"CAST(round({c}, 4) AS DECIMAL(30, 4))") for c in (*_FIGURES, "naive_drift_pct")]]


@query("q51_metric_documents", " SELECT drive_id, '{' || " + " || ',' || ".join(f"'\"{c}\":' || {x}" for c, x in _DOC) + " || '}' AS document FROM scored", NAIVE_SQL + "," + _metrics_sql("naive", ("naive", "pos_error_m")))
def _(spark, d):
    return report.metric_documents(_naive_metrics(spark, d).select("drive_id", "n", *[r6(c, 4) for c in (*_FIGURES, "naive_drift_pct")]), 4)


@query("q52_error_reduction", " SELECT drive_id, round(100 * (naive_exit - naive_settled) / (naive_exit + 1e-5), 4) AS reduction_pct FROM scored", NAIVE_SQL + "," + _metrics_sql("naive", ("naive", "pos_error_m")))
def _(spark, d):
    return _naive_metrics(spark, d).select("drive_id", r6(metrics.improvement("naive_exit", "naive_settled"), 4).alias("reduction_pct"))


@query("q53_macro_average", " , per AS (SELECT drive_id, avg(abs(speed - ai_speed)) AS mae FROM dense GROUP BY drive_id) SELECT round(avg(mae), 6) AS macro_mae, (SELECT round(avg(abs(speed - ai_speed)), 6) FROM dense) AS pooled_mae FROM per", STAND_IN_SQL)
def _(spark, d):
    e = motion.dense_speed(_stand_in(drive_view(spark, d))).select("drive_id", F.abs(F.col("speed") - F.col("ai_speed")).alias("e"))
    per = e.groupBy("drive_id").agg(F.avg("e").alias("mae"), F.sum("e").alias("s"), F.count("e").alias("n"))
    return per.agg(F.avg("mae").alias("m"), (F.sum("s") / F.sum("n")).alias("p")).select(r6("m").alias("macro_mae"), r6("p").alias("pooled_mae"))


@query("q54_window_sweep_metrics")
def _(spark, d):
    return models.window_sweep(*_split(drive_view(spark, d)))


@query("q55_feature_ablation")
def _(spark, d):
    return models.feature_ablation(*_split(_all_windows(spark, d)[0]))


@query("q56_model_to_metrics")
def _(spark, d):
    """From features over a trained model, dense speeds and the filter to the metrics of held-out drives, with the drive's profile."""
    model, held_out = _model(spark, d)
    predicted = model.predict(features.features(held_out))
    who = held_out.groupBy("drive_id").agg(F.min_by("driver_id", "rn").alias("driver_id"))
    m = models.navigate(held_out, predicted, OUT_START, OUT_END, SETTLE, 0.0025).join(who, "drive_id")
    return m.select("*", context.profile_label(F.col("driver_id")).alias("profile"))


def _stages_sql() -> str:
    variants = ekf.stages()
    cols = ", ".join(f"w_{v.name}.fused_pos_error_m AS {v.name}_e, w_{v.name}.open_loop_error_m AS {v.name}_o, w_{v.name}.fused_gyro_bias AS {v.name}_b" for v in variants)
    sides = " ".join(f"JOIN fused_{v.name} AS w_{v.name} USING (drive_id, rn)" for v in variants)
    side = f"side AS (SELECT moded.* EXCLUDE (in_outage), {cols} FROM moded {sides}), ends AS (SELECT drive_id, {', '.join(f'arg_max({v.name}_b, rn) AS {v.name}_b' for v in variants)} FROM side GROUP BY drive_id)"
    return ",".join([_MODED_SQL, *[_filter_sql(f"_{v.name}", v.params, v.rule, v.heading) for v in variants], side, _metrics_sql("side", *[(v.name, f"{v.name}_e", f"{v.name}_o") for v in variants])])


@query("q57_filter_stages", " UNION ALL ".join(f" SELECT drive_id, '{v.name}' AS stage, round({v.name}_exit, 6) AS exit, round({v.name}_outage_peak, 6) AS peak, round({v.name}_b + 1e-9, 6) + 0 AS bias_end FROM scored JOIN ends USING (drive_id)" for v in ekf.stages()), _stages_sql())
def _(spark, d):
    """Exit and peak errors, and the gyroscope bias at the end, of each drive at three stages of the filter."""
    df, variants = signals.hold_course(_base_rows(spark, d)), ekf.stages()
    ends = tuple(F.max_by(f"{v.name}_gyro_bias", "rn").alias(f"{v.name}_bias") for v in variants)
    m = metrics.drive_metrics(ekf.fuse_variants(df, variants), {v.name: (f"{v.name}_pos_error_m", f"{v.name}_open_loop_error_m") for v in variants}, SETTLE, ends)
    each = F.array(*[F.struct(F.lit(v.name).alias("stage"), r6(f"{v.name}_exit").alias("exit"), r6(f"{v.name}_outage_peak").alias("peak"), r6(F.col(f"{v.name}_bias") + 1e-9).alias("bias_end")) for v in variants])
    return m.select("drive_id", F.explode(each).alias("s")).select("drive_id", "s.*")


_RAW_SQL = f""", raw AS (SELECT drive_id, rn, driver_id, acc_x, gyro_z, rn * 100 + CASE WHEN rn % 7 = 0 THEN 5000 ELSE 0 END - CASE WHEN rn % 11 = 0 THEN 300 ELSE 0 END AS ms, 524e-1 + pos_y / 1000 AS lat, -15e-1 + pos_x / 1000 AS lon, speed * 4 AS kmh, degrees(heading) + 360 * (rn % 3) AS course FROM drives),
    g AS (SELECT *, (ms - lag(ms) {OVER}) / 1e3 AS gap, first_value(lat) {OVER} AS lat0, first_value(lon) {OVER} AS lon0 FROM raw),
    std AS (SELECT drive_id, rn, driver_id, sum(CASE WHEN gap IS NULL THEN 0 WHEN gap <= 0 OR gap > 1 THEN 1e-1 ELSE gap END) {RUN} AS timestamp, radians(lon - lon0) * 6371000 * cos(radians(lat0)) AS pos_x, radians(lat - lat0) * 6371000 AS pos_y,
            least(greatest(kmh / 36e-1, 0), 45) AS speed, radians(course) - 2 * pi() * floor((radians(course) + pi()) / (2 * pi())) AS heading, acc_x, gyro_z FROM g),
    ramp AS (SELECT *, lag(speed) {OVER} AS vb, lead(speed) {OVER} AS va, timestamp - lag(timestamp) {OVER} AS step FROM std),
    typical AS (SELECT drive_id, CASE WHEN quantile_cont(step, 5e-1) > 0 THEN quantile_cont(step, 5e-1) ELSE 1e-1 END AS h FROM ramp GROUP BY drive_id)"""


@query("q58_standardized_logs", f"""{_RAW_SQL} SELECT drive_id, rn, driver_id, round(timestamp, 6) + 0 AS timestamp, round(pos_x, 3) + 0 AS pos_x, round(pos_y, 3) + 0 AS pos_y, round(speed, 6) + 0 AS speed, round(cos(heading), 6) + 0 AS cos_heading, round(acc_x, 6) + 0 AS acc_x,
    round(CASE WHEN vb IS NULL THEN (va - speed) / h WHEN va IS NULL THEN (speed - vb) / h ELSE (va - vb) / (2 * h) END, 6) + 0 AS acc_y, 980665e-5 AS acc_z, round(gyro_z, 6) + 0 AS gyro_z, 15e2 AS ambient_lux FROM ramp JOIN typical USING (drive_id)""")
def _(spark, d):
    """Logs in milliseconds, km/h and degrees, with steps back and gaps, and without a longitudinal accelerometer, standardized."""
    rn = F.col("rn")
    ms = rn * 100 + F.when(rn % 7 == 0, 5000).otherwise(0) - F.when(rn % 11 == 0, 300).otherwise(0)
    raw = drive_view(spark, d).select("drive_id", "rn", "driver_id", ms.alias("Time since start (ms)"), (F.col("pos_y") / 1000 + 52.4).alias("GPS latitude (degrees)"), (F.col("pos_x") / 1000 - 1.5).alias("GPS longitude (degrees)"), (F.col("speed") * 4).alias("GPS speed (kmh)"), (F.degrees("heading") + 360 * (rn % 3)).alias("GPS orientation (degrees)"), F.col("acc_x").alias("Accelerometer X"), F.col("gyro_z").alias("Gyroscope_yaw"))
    s = drives.standardize(raw)
    return s.select(*KEYS, "driver_id", r6("timestamp"), r6("pos_x", 3), r6("pos_y", 3), r6("speed"), r6(F.cos("heading")).alias("cos_heading"), r6("acc_x"), r6("acc_y"), "acc_z", r6("gyro_z"), "ambient_lux")


@query("q59_drive_summary", f", s AS (SELECT *, timestamp - lag(timestamp) {OVER} AS step FROM drives) SELECT drive_id, count(*) AS n, round(max(timestamp) - min(timestamp), 6) AS duration, round(quantile_cont(step, 5e-1), 6) AS median_dt, round(CASE WHEN quantile_cont(step, 5e-1) > 0 THEN 1 / quantile_cont(step, 5e-1) ELSE 10 END, 6) AS rate FROM s GROUP BY drive_id")
def _(spark, d):
    return metrics.drive_summary(drive_view(spark, d)).select("drive_id", "n", r6("duration"), r6("median_dt"), r6("rate"))


@query("q60_outage_rule", ", e AS (SELECT drive_id, least(max(timestamp) - min(timestamp) - 105e-2, 655e-2) AS out_end FROM drives GROUP BY drive_id) SELECT drive_id, round(out_end, 6) AS out_end, count(*) FILTER (timestamp >= 195e-2 AND timestamp < out_end) AS n_inside FROM drives JOIN e USING (drive_id) GROUP BY ALL")
def _(spark, d):
    """The end that an outage has where none is given, on short drives: a second before theirs, or the longest outage's."""
    o = metrics.outage(drive_view(spark, d), OUT_START, longest=6.55, spare=1.05)
    return o.groupBy("drive_id", r6("out_end").alias("out_end")).agg(F.count_if("in_outage").alias("n_inside"))


@query("q61_report_breakdown", ", who AS (SELECT drive_id, arg_min(driver_id, rn) AS driver_id FROM drives GROUP BY drive_id) SELECT drive_id, CASE driver_id WHEN 'E' THEN 'Driver E (Aggressive)' WHEN 'B' THEN 'Driver B (Highway)' WHEN 'D' THEN 'Driver D (Urban)' ELSE 'Driver A (Normal)' END AS profile, driver_id, round(distance, 6) AS distance_m, round(naive_drift_pct, 4) AS naive_drift_pct, round(naive_exit, 6) AS naive_exit_m FROM scored JOIN who USING (drive_id)", NAIVE_SQL + "," + _metrics_sql("naive", ("naive", "pos_error_m")))
def _(spark, d):
    who = drive_view(spark, d).groupBy("drive_id").agg(F.min_by("driver_id", "rn").alias("driver_id"))
    b = report.breakdown(_naive_metrics(spark, d).join(who, "drive_id"))
    return b.select("drive_id", "profile", "driver_id", r6("distance_m"), r6("naive_drift_pct", 4), r6("naive_exit_m"))


@query("q62_zero_crossings", " SELECT user_id, event_id, list_sum(list_transform(range(14), lambda i: CASE WHEN (k[i + 1] = m) <> (k[i + 2] = m) THEN 1e0 ELSE 0e0 END)) / 14 AS zcr FROM w", f"""v AS (SELECT user_id, event_id, row_number() OVER u AS rn, list(CAST(event_id % 4 AS DOUBLE)) OVER (u ROWS 14 PRECEDING) AS k FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    w AS (SELECT *, list_avg(k) AS m FROM v WHERE rn >= {SIZE})""")
def _(spark, d):
    """The rate at which signals leave or reach their window's mean, on values whose means are exact or plainly off."""
    u = W.partitionBy("user_id").orderBy("ts", "event_id")
    v = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.row_number().over(u).alias("rn"), F.collect_list((F.col("event_id") % 4).cast("double")).over(u.rowsBetween(-(SIZE - 1), 0)).alias("k")).where(F.col("rn") >= SIZE)
    v = v.withColumn("m", features.mean(F.col("k"), SIZE)).withColumn("c", features.centred(F.col("k"), F.col("m"))).withColumn("z", F.array_sort("k")).withColumn("q", features.quantile(F.col("z"), SIZE, 0.5))
    return v.select("user_id", "event_id", features.enhanced_stats(F.col("c"), F.col("z"), F.col("q"), F.lit(1.0), SIZE)["zcr"].alias("zcr"))


_WAYS = ("timestamp", "pos_x", "pos_y", "ai_pos_x", "ai_pos_y", "fused_pos_x", "fused_pos_y", "ai_pos_error_m", "fused_pos_error_m")


@query("q63_three_way_paths", f" SELECT drive_id, rn, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _WAYS)}, timestamp >= 195e-2 AND timestamp <= 395e-2 AS shaded FROM fused", FUSED_SQL)
def _(spark, d):
    w = report.three_way(_fused(spark, d), OUT_START, OUT_END)
    return w.select(*KEYS, *[r6(F.col(c) + 1e-9).alias(c) for c in _WAYS], "shaded")


@query("q64_naive_baseline", f" SELECT drive_id, rn, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in ('timestamp', 'pos_x', 'pos_y', 'naive_pos_x', 'naive_pos_y', 'speed', 'naive_velocity', 'pos_error_m'))} FROM naive", NAIVE_SQL)
def _(spark, d):
    b = report.baseline(motion.naive(drive_view(spark, d)))
    return b.select(*KEYS, *[r6(F.col(c) + 1e-9).alias(c) for c in b.columns if c not in KEYS])


#: rows of a block in the queries on blocked drives: their drives of 45 to 99 rows are several blocks each
_SHORT = 20


@query("q65_blocked_dead_reckoning", f" SELECT drive_id, rn, {s6('timestamp', 'heading', 'pos_x', 'pos_y', 'naive_heading', 'naive_velocity', 'naive_pos_x', 'naive_pos_y', 'pos_error_m', 'speed_error_mps')} FROM naive", NAIVE_SQL)
def _(spark, d):
    """From events to dead reckoning without a drive in one task: row numbers, time steps and running sums by blocks."""
    n = blocked.naive(blocked.drive_view(spark, d, _SHORT), _SHORT)
    return n.select(*KEYS, *[r6(c) for c in ("timestamp", "heading", "pos_x", "pos_y", "naive_heading", "naive_velocity", "naive_pos_x", "naive_pos_y", "pos_error_m", "speed_error_mps")])


@query("q66_blocked_model_reckoning", f", w AS (SELECT *, sqrt(pow(pos_x - lag(pos_x) {OVER}, 2) + pow(pos_y - lag(pos_y) {OVER}, 2)) AS st FROM ai) SELECT drive_id, rn, {s6('ai_heading', 'ai_pos_x', 'ai_pos_y', 'ai_pos_error_m')}, round(sum(coalesce(st, 0)) {RUN}, 6) + 0 AS cum_dist_m FROM w", AI_SQL)
def _(spark, d):
    dense = motion.dense_speed(_stand_in(drive_view(spark, d)))
    out = blocked.cumulative_distance(blocked.ai_dead_reckoning(dense, _SHORT), _SHORT)
    return out.select(*KEYS, *[r6(c) for c in ("ai_heading", "ai_pos_x", "ai_pos_y", "ai_pos_error_m", "cum_dist_m")])


@query("q67_blocked_features", ORACLES["q44_all_features"], "")
def _(spark, d):
    f = blocked.features(drive_view(spark, d), _SHORT)
    return _shown_features(f)


_TEXT = "CASE WHEN {c} IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_LEAVES = f"""rows_in AS (SELECT CAST(user_id AS VARCHAR) AS grp, CAST(floor(event_id / 512.0) AS BIGINT) AS idx, event_id AS o, sha256({' || '.join(_TEXT.format(c=c) for c in ('event_id', 'event_type', 'props'))}) AS hash FROM events),
    leaf AS (SELECT grp, idx, sha256(string_agg(hash, ',' ORDER BY o, hash)) AS hash, count(*) AS n FROM rows_in GROUP BY grp, idx)"""


@query("q68_hash_trees", " SELECT grp, sha256(string_agg(hash, ',' ORDER BY up, hash)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM (SELECT grp, CAST(floor(idx / 8.0) AS BIGINT) AS up, sha256(string_agg(hash, ',' ORDER BY idx, hash)) AS hash, sum(n) AS n FROM leaf GROUP BY ALL) GROUP BY grp", _LEAVES)
def _(spark, d):
    """Roots of the users' hash trees over blocks of events, of one level between leaves and roots."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return merkle.levels(merkle.leaves(e, "user_id", "event_id", ["event_type", "props"], span=512), 1, 8)[-1].select("grp", "hash", "n")


@query("q69_where_runs_differ", f", gone AS (SELECT user_id, min(event_id) AS o FROM events WHERE event_id % 97 = 0 GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS grp, o FROM gone", "x AS (SELECT 1)")
def _(spark, d):
    """Two runs of which one has other values for some events: the first such event of each user, found from the roots down."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "props")
    other = e.withColumn("props", F.when(F.col("event_id") % 97 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    return merkle.first_differences(e, other, "user_id", "event_id", ["event_type", "props"], span=64, fan=8)


_EDGES = ", ".join(f"quantile_disc(v, {k} / 32e0) AS e{k}" for k in range(1, 32))
_BINNED = f"""{ORACLES["q11_base_features"].removeprefix("WITH ").rsplit(" SELECT drive_id, rn, round(list_avg(acc_mag)", 1)[0]},
    f AS (SELECT drive_id, rn, round(y, 6) AS y, round(list_avg(acc_mag), 6) + 0 AS acc_mag_mean, round(list_max(gz), 6) + 0 AS gz_max, round(list_stddev_pop(jerk_mag), 6) + 0 AS jerk_mag_std FROM ends WHERE drive_id % 3 <> 0),
    long AS (UNPIVOT f ON acc_mag_mean, gz_max, jerk_mag_std INTO NAME feature VALUE v),
    edges AS (SELECT feature, list_sort(list_distinct([{", ".join(f"e{k}" for k in range(1, 32))}])) AS e FROM (SELECT feature, {_EDGES} FROM long GROUP BY feature)),
    placed AS (SELECT feature, 1 + len(list_filter(e, lambda x: x < v)) AS bin, y FROM long JOIN edges USING (feature))"""


@query("q70_split_histogram", " SELECT feature, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(sum((SELECT avg(y) FROM f) - y), 4) + 0 AS g FROM placed GROUP BY feature, bin", _BINNED)
def _(spark, d):
    """What trees of the shared trainer choose their first split by: gradients and counts by feature and bin, over the drives to train on."""
    f = _split(_windows(spark, d, _THREE))[0]
    f = f.select(*KEYS, r6("y"), r6(F.col("acc_mag__m")).alias("acc_mag_mean"), r6(F.array_max("gz")).alias("gz_max"), r6(_base("jerk_mag")["std"]).alias("jerk_mag_std"), F.lit(0).alias("setting")).persist()
    names = ["acc_mag_mean", "gz_max", "jerk_mag_std"]
    edges = trees.bin_edges(f, names, exact=True)
    data = trees.binned(f, names, edges)
    model = trees.fit(data, [trees.Spec("m", (0, 1, 2), "squared", trees=0)], names, edges)["m"]
    return trees.histograms(data, model).select("feature", "bin", F.col("n").cast("long").alias("n"), r6("g", 4))


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros(F.round((F.col("timestamp") + 1_000_000_000) * 1_000_000).cast("long")))


@query("q71_streamed_device", ORACLES["q41_device_replay"], "")
def _(spark, d):
    """The device engine as a stream: samples and fixes as events that arrive late and shuffled."""
    v = _timed(drive_view(spark, d).withColumn("dt", signals.step_dt()))
    happened = device.device_events(v, v.where("rn % 10 = 0"))
    out = run.to_the_end(spark, run.as_arrivals(happened, 5, 2), device.stream, device.OUT)
    return out.select(*KEYS, *[r6(F.col(c) + 1e-9).alias(c) for c in _DEVICE], "standstill", "tunnel_alert")


@query("q72_streamed_features", ORACLES["q44_all_features"], "")
def _(spark, d):
    """All features over a stream of samples that arrive late and shuffled."""
    v = _timed(drive_view(spark, d)).select("drive_id", "rn", "event_time", "timestamp", "speed", *drives.SENSORS)
    windows = "drive_id long, rn long, t_end double, y double, " + ", ".join(f"{x} array<double>" for x in features.SIGNALS)
    w = run.to_the_end(spark, run.as_arrivals(v, 5, 2), lambda s: sequences.windows_stream(s, SIZE, STEP), windows)
    return _shown_features(features.of_windows(w, SIZE))


@query("q73_streamed_filter", f" SELECT drive_id, rn, context_mode, {', '.join(f'round({c} + 1e-9, 6) + 0 AS {c}' for c in _FUSED)} FROM fused", FUSED_SQL)
def _(spark, d):
    """The fusion filter over a stream, with the variance that looks four rows ahead."""
    base = _timed(metrics.outage(_ai(spark, d), OUT_START, OUT_END).withColumn("style", context.driver_style(F.first("driver_id").over(drives.so_far()))))
    schema = "drive_id long, rn long, context_mode string, " + ", ".join(f"{c} double" for c in sequences.FUSED)
    out = run.to_the_end(spark, run.as_arrivals(base, 5, 2), lambda s: sequences.fuse_stream(s, scale=0.0025), schema)
    return out.select(*KEYS, "context_mode", *[r6(F.col(c) + 1e-9).alias(c) for c in _FUSED])


@query("q74_log_slices", " SELECT drive_id, rn, round(speed, 6) + 0 AS speed, round(acc_x, 6) + 0 AS acc_x, round(gyro_z, 6) + 0 AS gyro_z FROM drives WHERE rn > 10 AND rn <= 40")
def _(spark, d):
    """Rows 11 to 40 of each drive, from its log, by the bytes that hold them."""
    at = run.folder(spark)
    log_rows.write_logs(drive_view(spark, d).select(*KEYS, "speed", "acc_x", "gyro_z"), f"{at}/logs")
    log_rows.write_index(spark, f"{at}/logs", f"{at}/index", block=1 << 12, min_bytes=0)
    logs = log_rows.read_rows(spark, f"{at}/logs", f"{at}/index").where("rn > 10 AND rn <= 40")
    return logs.select(F.col("drive_id").cast("long").alias("drive_id"), "rn", *[r6(F.col(c).cast("double")).alias(c) for c in ("speed", "acc_x", "gyro_z")])
