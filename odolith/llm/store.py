"""Intermediate tables in the folder that all executors share.

``cut`` is how the operators end a lineage: a lost executor then costs a re-read of a file, never a recomputation that
could come out differently, and a table used twice is computed once.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: for each ``scratch`` that is open, the tables made in it
_MADE: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, the warehouse, or in local mode (tests) a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            root = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="odolith-"))
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.odolith"
    return f"{root.rstrip('/')}/{app}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _MADE:
        _MADE[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that are ``cut`` within it at its end: for callers that have written by then what they need."""
    _MADE.append([])
    try:
        yield
    finally:
        for df in _MADE.pop():
            release(df)


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` gives, as by ``cut``, with the tables it needed on the way deleted."""
    with scratch():
        out = cut(make(), tag)
        _MADE[-1].pop()  # the last one made is the one to keep
    if _MADE:
        _MADE[-1].append(out)
    return out


def release(df: DataFrame | None) -> None:
    """Deletes the table behind a ``cut`` that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Returns to the system what a Python worker's allocators hold without use; workers outlive their tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
