"""Sequence operators on drives of any length: a drive is cut into blocks of rows, so that one long drive is many tasks.

Neighbours: a block gets copies of the rows next to it (``in_blocks``), as many as a frame reaches, and gives results for its own rows only. Running sums
are two-level scans (``running``): sums inside blocks, a scan of the blocks' totals, and the offsets joined back. Row numbers are made in the same way (``numbered``),
from buckets of the order's quantiles, so no drive is ever sorted in one task. A short drive is one block, and pays for a join with a table of a row for each block.

Row numbers count from 1 without gaps. Results equal the unblocked operators' up to the order in which sums are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from odolith.functions.geo import wrap
from odolith.operators import features as _features
from odolith.operators.signals import SIGNALS
from odolith.sources.drives import COLUMNS, event_rows, repaired_step

BLOCK = 100_000
#: buckets that the order of a drive with more than a block's rows is cut into
BUCKETS = 256


def _of(rn: Column, block: int) -> Column:
    return F.floor((rn - 1) / block)


def _local():
    return W.partitionBy("drive_id", "_block").orderBy("rn")


def in_blocks(df: DataFrame, block: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows with ``_block``, in their own block and as copies in those whose first row is at most ``before`` rows later, or last row ``after`` rows earlier."""
    if max(before, after) >= block:
        raise ValueError("a block must be longer than what it takes from its neighbours")
    rn = F.col("rn")
    if not before and not after:
        return df.withColumn("_block", _of(rn, block))
    return df.withColumn("_block", F.explode(F.sequence(F.greatest(_of(rn - after, block), F.lit(0)), _of(rn + before, block))))


def own(df: DataFrame, block: int) -> DataFrame:
    """Without the copies."""
    return df.where(F.col("_block") == _of(F.col("rn"), block))


def running(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Running sums over each drive of columns of rows with ``_block``, none of them a copy."""
    d = df.withColumns({f"_term_{k}": v for k, v in sums.items()})
    totals = d.groupBy("drive_id", "_block").agg(*[F.sum(f"_term_{k}").alias(f"_total_{k}") for k in sums])
    earlier = W.partitionBy("drive_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    offsets = totals.select("drive_id", "_block", *[F.coalesce(F.sum(f"_total_{k}").over(earlier), F.lit(0.0)).alias(f"_before_{k}") for k in sums])
    local = _local().rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = d.select("*", *[F.sum(f"_term_{k}").over(local).alias(f"_in_{k}") for k in sums])
    out = inside.join(offsets, ["drive_id", "_block"])
    return out.withColumns({k: F.col(f"_in_{k}") + F.col(f"_before_{k}") for k in sums}).drop(*[f"_{x}_{k}" for k in sums for x in ("term", "in", "before")])


def numbered(df: DataFrame, time: str, tie: str, block: int = BLOCK) -> DataFrame:
    """``df`` with rn, the place of a row in its drive by (time, tie), and no drive of over ``block`` rows sorted whole. ``time`` is a long."""
    shares = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    long = df.groupBy("drive_id").agg(F.count("*").alias("n"), F.percentile_approx(time, shares, 10000).alias("_cuts")).where(F.col("n") > block)
    long = long.select("drive_id", "_cuts")  # at most a row for each block of the table: Spark sees its size when it joins
    bucket = F.coalesce(F.aggregate("_cuts", F.lit(0), lambda acc, c: acc + F.when(c < F.col(time), 1).otherwise(0)), F.lit(0))
    d = df.join(long, "drive_id", "left").withColumn("_bucket", bucket).drop("_cuts")
    d = d.withColumn("_place", F.row_number().over(W.partitionBy("drive_id", "_bucket").orderBy(time, tie)))
    sizes = d.groupBy("drive_id", "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("drive_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("drive_id", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return d.join(before, ["drive_id", "_bucket"]).withColumn("rn", (F.col("_before") + F.col("_place")).cast("long")).drop("_bucket", "_place", "_before")


def _lag(c: str) -> Column:
    return F.lag(c).over(_local())


def drive_view(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> DataFrame:
    """``sources.drives.drive_view`` for users with any number of events."""
    e = event_rows(spark, sf_dir).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = in_blocks(numbered(e, "_us", "event_id", block), block, before=1)
    rows = own(rows.withColumn("dt", repaired_step(F.col("raw_t") - _lag("raw_t"))), block)
    turned = running(rows, {"timestamp": F.col("dt"), "_turned": F.col("gyro_z") * F.col("dt")}).withColumn("heading", wrap(F.col("_turned")))
    step = F.col("speed") * F.col("dt")
    return running(turned, {"pos_x": step * F.sin("heading"), "pos_y": step * F.cos("heading")}).select(COLUMNS)


def _steps(df: DataFrame, block: int) -> DataFrame:
    """Own rows in blocks with ``_dt``: the first row takes the next one's."""
    rows = in_blocks(df, block, before=1, after=1)
    dt = F.coalesce(F.col("timestamp") - _lag("timestamp"), F.lead("timestamp").over(_local()) - F.col("timestamp"), F.lit(0.1))
    return own(rows.withColumn("_dt", dt), block)


def _walked(d: DataFrame, v: Column, h: Column, x: str, y: str) -> DataFrame:
    """Positions from the first row's, by the mean speed and heading of each step."""
    first = F.col("rn") == 1
    term = lambda start, f: F.when(first, F.col(start)).otherwise(v * f(h) * F.col("_dt"))
    return running(d, {x: term("pos_x", F.sin), y: term("pos_y", F.cos)})


def naive(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``motion.naive`` on drives of any length. The row before is known from the sums' last terms, so no second look at neighbours is needed."""
    first = F.col("rn") == 1
    d = _steps(df, block).withColumn("_turn", F.col("gyro_z") * F.col("_dt")).withColumn("_gain", F.col("acc_y") * F.col("_dt"))
    d = running(d, {"naive_heading": F.when(first, F.col("heading")).otherwise(F.col("_turn")), "naive_velocity": F.when(first, F.col("speed")).otherwise(F.col("_gain"))})
    d = _walked(d, F.col("naive_velocity") - F.col("_gain") / 2, F.col("naive_heading") - F.col("_turn") / 2, "naive_pos_x", "naive_pos_y")
    d = d.withColumn("pos_error_m", F.hypot(F.col("naive_pos_x") - F.col("pos_x"), F.col("naive_pos_y") - F.col("pos_y"))).withColumn("speed_error_mps", F.abs(F.col("naive_velocity") - F.col("speed")))
    return d.drop("_block", "_dt", "_turn", "_gain")


def ai_dead_reckoning(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """``motion.ai_dead_reckoning`` on drives of any length."""
    rows = in_blocks(df, block, before=1, after=1)
    dt = F.coalesce(F.col("timestamp") - _lag("timestamp"), F.lead("timestamp").over(_local()) - F.col("timestamp"), F.lit(0.1))
    d = own(rows.withColumns({"_dt": dt, "_v": 0.5 * (_lag("ai_speed") + F.col("ai_speed"))}), block).withColumn("_turn", F.col("gyro_z") * F.col("_dt"))
    d = running(d, {"ai_heading": F.when(F.col("rn") == 1, F.col("heading")).otherwise(F.col("_turn"))})
    d = _walked(d, F.col("_v"), F.col("ai_heading") - F.col("_turn") / 2, "ai_pos_x", "ai_pos_y")
    return d.withColumn("ai_pos_error_m", F.hypot(F.col("ai_pos_x") - F.col("pos_x"), F.col("ai_pos_y") - F.col("pos_y"))).drop("_block", "_dt", "_v", "_turn")


def cumulative_distance(df: DataFrame, block: int = BLOCK, out: str = "cum_dist_m") -> DataFrame:
    """Metres driven up to each row."""
    rows = in_blocks(df, block, before=1)
    step = F.coalesce(F.hypot(F.col("pos_x") - _lag("pos_x"), F.col("pos_y") - _lag("pos_y")), F.lit(0.0))
    return running(own(rows.withColumn("_step", step), block), {out: F.col("_step")}).drop("_block", "_step")


def features(df: DataFrame, block: int = BLOCK, window_sec: float = 1.5, step_sec: float = 0.2, rate: float = 10.0, group: str = "all", signals: list[str] = SIGNALS, causal: bool = False) -> DataFrame:
    """``features.features`` on drives of any length: a block has the rows of its first windows before it, with one more for differences, and one after it."""
    n = _features.rows_of(window_sec, rate, 4)
    halo = in_blocks(df, block, before=n, after=1).withColumn("drive_id", F.struct("drive_id", F.col("_block").alias("block"))).drop("_block")
    f = _features.features(halo, window_sec, step_sec, rate, group, signals, causal)
    f = f.where(F.col("drive_id.block") == _of(F.col("rn"), block))
    return f.withColumn("drive_id", F.col("drive_id.drive_id"))
