"""Runs a stream over a table to its end: what a catch-up job does with files that have arrived."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset in the warehouse, or in local mode in a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        root = tempfile.mkdtemp(prefix="odolith-")
    return f"{root or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/.odolith'}/stream-{uuid.uuid4().hex}"


def as_arrivals(df: DataFrame, seconds: float, jitter: float) -> list[DataFrame]:
    """The rows of ``df`` (event_time) as they may arrive: in batches of some seconds, up to ``jitter`` seconds late, shuffled by a hash; and then a row of drive -1, a day later, that ends all drives."""
    late = F.pmod(F.xxhash64(*[c for c in df.columns if c in ("drive_id", "rn", "kind", "event_time")]), F.lit(1000)) / 1000 * jitter
    dealt = df.withColumn("_f", F.floor((F.unix_micros("event_time") / 1e6 + late) / seconds).cast("long")).persist()
    span = dealt.agg(F.min("_f"), F.max("_f"), F.max("event_time")).first()
    if span[0] is None:
        return []
    out = [dealt.where(F.col("_f") == f).drop("_f") for f in range(span[0], span[1] + 1)]
    last = dealt.drop("_f").limit(1).withColumn("drive_id", F.lit(-1).cast("long")).withColumn("event_time", F.lit(span[2]) + F.expr("interval 1 day"))
    return [*out, last]


def to_the_end(spark: SparkSession, arrivals: list[DataFrame], make: Callable[[DataFrame], DataFrame], schema: str, limit: float = 1800) -> DataFrame:
    """What the stream ``make`` gives has written once all ``arrivals`` are through: each is written as the files of its partitions, and then a run of the stream takes them in one trigger and goes on from
    the checkpoint of the run before."""
    if not arrivals:
        return spark.createDataFrame([], schema)
    at, kind, old, until = folder(spark), arrivals[0].schema, spark.conf.get(_PROVIDER), time.monotonic() + limit
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        for df in arrivals:
            df.write.mode("append").parquet(f"{at}/in")
            source = spark.readStream.schema(kind).parquet(f"{at}/in")
            q = make(source).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
            if not q.awaitTermination(max(1, int(until - time.monotonic()))):
                q.stop()
                raise TimeoutError("the stream did not end")
    finally:
        spark.conf.set(_PROVIDER, old)
    return spark.read.schema(schema).parquet(f"{at}/out").where("drive_id >= 0")
