"""Error metrics of trajectories and regressions, per drive and across drives, and the gates before training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from odolith.sources.drives import order

BANNED = ("speed", "pos_x", "pos_y", "heading", "lat", "lon")


def outage(df: DataFrame, start: float = 60.0, end: float | None = None, longest: float = 150.0, spare: float = 10.0) -> DataFrame:
    """Rows with out_start and out_end, and in_outage for start <= t < end; by default the end is ``longest`` or ``spare`` seconds before the drive's."""
    whole = W.partitionBy("drive_id")
    stop = F.lit(end) if end is not None else F.least(F.max("timestamp").over(whole) - F.min("timestamp").over(whole) - spare, F.lit(longest))
    return df.withColumn("out_start", F.lit(start)).withColumn("out_end", stop).withColumn("in_outage", (F.col("timestamp") >= F.col("out_start")) & (F.col("timestamp") < F.col("out_end")))


def _last(e: str, cond: Column | None = None) -> Column:
    return F.max_by(e, "rn") if cond is None else F.max_by(F.when(cond, F.col(e)), F.when(cond, F.col("rn")))


def drive_metrics(df: DataFrame, errors: dict[str, tuple[str, str]], settle: float = 8.0, extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row per drive: path lengths, and for each name in ``errors`` (error, error at the outage's exit) rmse, max, final, drift and outage figures.

    ``df`` has the truth, the errors, and what ``outage`` adds. Without rows in the outage its figures are 0. ``extra`` are further aggregates.
    """
    step = F.hypot(F.col("pos_x") - F.lag("pos_x").over(order()), F.col("pos_y") - F.lag("pos_y").over(order()))
    inside = W.partitionBy("drive_id", "in_outage").orderBy("rn")
    step_in = F.when(F.col("in_outage"), F.hypot(F.col("pos_x") - F.lag("pos_x").over(inside), F.col("pos_y") - F.lag("pos_y").over(inside)))
    d = df.select("*", F.coalesce(step, F.lit(0.0)).alias("step_"), F.coalesce(step_in, F.lit(0.0)).alias("step_in_"))
    is_in = F.col("in_outage")
    aggs = [F.count("*").alias("n"), (F.max("timestamp") - F.min("timestamp")).alias("duration"), F.sum("step_").alias("distance"), F.sum("step_in_").alias("outage_distance")]
    for name, (e, exit_e) in errors.items():
        late = F.col("timestamp") >= F.col("out_end") + settle
        aggs += [
            F.sqrt(F.avg(F.col(e) * F.col(e))).alias(f"{name}_rmse"), F.max(e).alias(f"{name}_max"), _last(e).alias(f"{name}_final"),
            F.coalesce(F.max(F.when(is_in, F.col(exit_e))), F.lit(0.0)).alias(f"{name}_outage_peak"), F.coalesce(_last(exit_e, is_in), F.lit(0.0)).alias(f"{name}_exit"),
            F.coalesce(F.min_by(F.when(late, F.col(e)), F.when(late, F.col("rn"))), _last(e)).alias(f"{name}_settled"),
        ]
    out = d.groupBy("drive_id").agg(*aggs, *extra)
    return out.select("*", *[(100 * F.col(f"{k}_final") / (F.col("distance") + 1e-5)).alias(f"{k}_drift_pct") for k in errors])


def improvement(base: str, other: str) -> Column:
    return 100 * (F.col(base) - F.col(other)) / (F.col(base) + 1e-5)


def across_drives(per_drive: DataFrame, cols: list[str], places: int = 2) -> DataFrame:
    """Mean and population deviation over drives of values rounded first."""
    r = [F.round(c, places) for c in cols]
    return per_drive.agg(F.count("*").alias("num_drives"), *[f(x).alias(f"{c}_{n}") for c, x in zip(cols, r, strict=True) for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def extremes(per_drive: DataFrame, driver: str, cols: list[str]) -> DataFrame:
    """Least and greatest of each figure over one driver's drives."""
    own = per_drive.where(F.col("driver_id") == driver)
    return own.agg(F.count("*").alias("num_drives"), *[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def regression(y: Column, p: Column) -> list[Column]:
    """mae, rmse, r2, medae and p95 as aggregates."""
    e = F.abs(y - p)
    sse, sst = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return [F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(sst > 0, 1 - sse / sst).alias("r2"), F.percentile(e, F.lit(0.5)).alias("medae"), F.percentile(e, F.lit(0.95)).alias("p95")]


def coverage(y: Column, p: Column, sigma: Column) -> list[Column]:
    out = []
    for level, z in ((90, 1.645), (95, 1.960)):
        lo, hi = F.greatest(p - z * sigma, F.lit(0.0)), p + z * sigma
        share = F.avg(((y >= lo) & (y <= hi)).cast("double"))
        out += [share.alias(f"cov_{level}"), F.avg(hi - lo).alias(f"width_{level}"), F.abs(share - level / 100).alias(f"cal_error_{level}")]
    return out


def order_statistic(df: DataFrame, value: str, keys: list[str], places: Callable[[Column], Column], step: float = 1 / 1024) -> DataFrame:
    """(keys, n, place, value): for each group the values at the 0-based ``places``, an array of a function of n, in ascending order; nulls don't count.

    Two counts, both aggregated before they move: of values by buckets of ``step``, and of the distinct values of the buckets that places fall in.
    No group is sorted in one task.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("value")).where("value is not null")
    bucket = F.floor(F.col("value") / step)
    ahead = W.partitionBy(*keys)
    counts = v.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("before", F.sum("c").over(ahead.orderBy("bucket")) - F.col("c")).withColumn("n", F.sum("c").over(ahead))
    wanted = counts.withColumn("place", F.explode(places(F.col("n")))).where("place >= before and place < before + c").select(*keys, "bucket", "before", "n", "place")
    own = wanted.select(*keys, "bucket").distinct()  # a row or a few for each group
    inside = v.withColumn("bucket", bucket).join(own, [*keys, "bucket"]).groupBy(*keys, "bucket", "value").agg(F.count("*").alias("c"))
    inside = inside.withColumn("below", F.sum("c").over(W.partitionBy(*keys, "bucket").orderBy("value")) - F.col("c"))
    hit = inside.join(wanted, [*keys, "bucket"]).where("place >= before + below and place < before + below + c")
    return hit.select(*keys, "n", "place", "value")


def exact_percentiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each of ``shares``): percentiles with linear interpolation, by ``order_statistic``."""
    at = {k: lambda n, p=p: (n - 1) * F.lit(p) for k, p in shares.items()}
    both = lambda n: F.array_distinct(F.array(*[f(a(n)).cast("long") for a in at.values() for f in (F.floor, F.ceil)]))
    got = order_statistic(df, value, keys, both).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("m"))  # two values for each share
    point = lambda a: F.element_at("m", F.floor(a).cast("long")) + (F.element_at("m", F.ceil(a).cast("long")) - F.element_at("m", F.floor(a).cast("long"))) * (a - F.floor(a))
    return got.select(*keys, *[point(a(F.col("n"))).alias(k) for k, a in at.items()])


def conformal_quantile(df: DataFrame, residual: str, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """For each group the residual at the 0-based place min(n - 1, ceil((n + 1) (1 - alpha))) in ascending order."""
    place = lambda n: F.array(F.least(n - 1, F.ceil((n + 1) * (1 - alpha))))
    return order_statistic(df, residual, keys, place).select(*keys, F.col("value").alias("q_hat"), "n")


def regimes(speed: Column, gyro: Column, acc: Column) -> dict[str, Column]:
    """Overlapping motion regimes."""
    return {
        "stationary": speed < 0.5, "low_speed": (speed >= 0.5) & (speed < 5.0), "cruise": speed >= 5.0, "fast": speed >= 5.56,
        "turning": F.abs(gyro) > 0.05, "accelerating": acc > 0.8, "braking": acc < -0.8,
    }


def by_regime(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` once for each regime they are in."""
    named = F.filter(F.array(*[F.when(c, k) for k, c in conds.items()]), lambda x: x.isNotNull())
    return df.select("*", F.explode(named).alias("regime"))


def target_audit(df: DataFrame) -> DataFrame:
    """Per drive: how the target moves, and whether it jumps."""
    dt = F.col("timestamp") - F.lag("timestamp").over(order())
    slope = F.coalesce((F.col("speed") - F.lag("speed").over(order())) / F.when(dt <= 0, 0.1).otherwise(dt), F.lit(0.0))
    d = df.select("drive_id", "timestamp", "speed", F.abs(slope).alias("a_"))
    return d.groupBy("drive_id").agg(
        F.count("*").alias("n"), (F.max("timestamp") - F.min("timestamp")).alias("duration"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"), F.avg("speed").alias("mean_speed"),
        F.percentile("speed", F.lit(0.5)).alias("median_speed"), F.stddev_pop("speed").alias("std_speed"), (100 * F.avg((F.col("speed") < 0.1).cast("double"))).alias("pct_stopped"),
        F.max("a_").alias("max_accel"), F.count_if(F.col("a_") > 8).alias("n_jumps"),
    )


def leakage_gate(features: list[str], train: DataFrame, test: DataFrame, y: str = "y") -> DataFrame:
    """One row: banned feature names, drives and drivers on both sides, and targets that are null or not a number."""
    bad = [c for c in features if c in BANNED]
    shared = lambda k: train.select(k).intersect(test.select(k)).agg(F.count("*").alias(f"shared_{k}"))
    broken = train.select(y).unionByName(test.select(y)).agg(F.count_if(F.col(y).isNull() | F.isnan(y)).alias("bad_targets"))
    return shared("drive_id").crossJoin(shared("driver_id")).crossJoin(broken).withColumn("banned", F.lit(len(bad)).cast("long"))


def check_no_leakage(features: list[str], train: DataFrame, test: DataFrame, y: str = "y") -> None:
    r = leakage_gate(features, train, test, y).first().asDict()
    if any(r.values()):
        raise ValueError(f"leakage gate: {r}")


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """Twelve hex digits for each group, the same whatever the order of its rows; of results, what tells that a run was repeated exactly."""
    cols = [c for c in df.columns if c not in keys]
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    return df.groupBy(*keys).agg(F.substring(F.sha2(F.concat_ws(",", F.count("*"), F.bit_xor(whole), F.sum(F.pmod(whole, F.lit(1 << 31)))), 256), 1, 12).alias("hash"))


def repeats_exactly(run: Callable[[], DataFrame], keys: list[str]) -> bool:
    """Whether two runs of ``run`` give the same rows in every group."""
    a, b = (content_hash(run(), keys) for _ in range(2))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def drive_summary(df: DataFrame) -> DataFrame:
    """Per drive: rows, duration, median time step, and the rate that follows, 10 where the step isn't positive."""
    d = df.select("drive_id", "timestamp", (F.col("timestamp") - F.lag("timestamp").over(order())).alias("dt_"))
    out = d.groupBy("drive_id").agg(F.count("*").alias("n"), (F.max("timestamp") - F.min("timestamp")).alias("duration"), F.percentile("dt_", F.lit(0.5)).alias("median_dt"))
    return out.withColumn("rate", F.when(F.col("median_dt") > 0, 1 / F.col("median_dt")).otherwise(10.0))
