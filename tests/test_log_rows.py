"""Row ranges of logs by their bytes: against rows read in order, at any block size, and how many bytes they cost."""

import json

import pytest
from pyspark.sql import functions as F

from odolith.sources import drives, log_rows

HEAD = "Time since start (ms),GPS speed (kmh),note"
WANT = {"B/S-M": 500, "x": 7, "only head": 0}


def lines(name, n):
    out = [f'{k * 100},{k % 50},"{"é" * (k % 5)} , {name}{k}"' for k in range(1, n + 1)]
    if n > 20:
        out[9] = "1000,"  # a short row
        out[11] = "1200,,a,b"  # a long one
        out[13] = ",,"
    return out


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "B").mkdir()
    for name, n in WANT.items():
        eol = "\r\n" if name == "x" else "\n"
        text = eol.join([HEAD, *lines(name, n)]) + (eol * 3 if name != "x" else "")
        if name == "B/S-M":
            text = text.replace("\n", "\n\n", 30)
        (root / f"{name}.csv").write_bytes(text.encode("latin-1"))
    return root


def expected(name, n, k):
    if n > 20 and k in (10, 12, 14):
        return {10: ("1000", None, None), 12: ("1200", None, "a"), 14: (None, None, None)}[k]
    return str(k * 100), str(k % 50), f"{'é' * (k % 5)} , {name}{k}"


@pytest.mark.parametrize("block", [1, 7, 64, 1000, 1 << 22])
def test_rows_are_the_same_at_any_block_size(spark, logs, tmp_path, block):
    names = {"x": 7, "only head": 0} if block == 1 else WANT
    log_rows.write_index(spark, str(logs), str(tmp_path / "i"), block=block, min_bytes=0)
    df = log_rows.read_rows(spark, str(logs), str(tmp_path / "i"), part="3000")
    got = {(r[3], r[4]): tuple(r[:3]) for r in df.where(df.drive_id.isin(*names)).collect()}
    assert got == {(name, k): expected(name, n, k) for name, n in names.items() for k in range(1, n + 1)}
    few = df.where("drive_id = 'x' AND rn >= 3 AND rn < 6").select("rn", "driver_id").collect()
    assert sorted(tuple(r) for r in few) == [(k, "Unknown") for k in (3, 4, 5)]


def test_slices_equal_those_of_whole_logs(spark, logs, tmp_path):
    kind = "drive_id string, suffix string, split string, offset long, max_rows long"
    m = spark.createDataFrame([("B/S-M", "_train", "train", 100, 50), ("B/S-M", "", "test", 0, 30), ("B/S-M", "_end", "test", 480, 90), ("x", "", "test", 6, 5), ("absent", "", "test", 0, 5)], kind)
    log_rows.write_index(spark, str(logs), str(tmp_path / "i"), block=256, min_bytes=0)
    got = log_rows.read_slices(spark, str(logs), str(tmp_path / "i"), m)
    want = drives.slices(log_rows.read_rows(spark, str(logs), str(tmp_path / "i")), m)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(want) and got.count() == 50 + 30 + 20 + 1
    assert drives.standardize(got).columns == drives.COLUMNS


def test_bytes_read_follow_the_slice(spark, logs, tmp_path):
    log_rows.write_index(spark, str(logs), str(tmp_path / "i"), block=256, min_bytes=0)
    options = {"path": str(logs), "index": str(tmp_path / "i")}
    kind = spark.read.format("log_rows").options(index=str(tmp_path / "i")).load(str(logs)).schema

    def planned(filters=(), **more):
        r = log_rows.LogReader(options | more, kind)
        assert list(r.pushFilters(filters)) == list(filters)  # Spark keeps them all
        return r.partitions()

    cost = lambda parts: sum(p.stop - p.start for p in parts)
    whole = cost(planned())
    assert 0.9 * sum((logs / f"{n}.csv").stat().st_size for n in WANT) < whole
    some = planned([log_rows.GreaterThan(("rn",), 200), log_rows.LessThanOrEqual(("rn",), 210)])
    assert {p.path.split("/")[-1] for p in some} == {"S-M.csv"} and cost(some) <= 4 * 256 < whole / 10
    assert cost(planned(ranges=json.dumps([("x", 1, 3)]))) <= 512
    assert planned([log_rows.EqualTo(("drive_id",), "none")]) == [] == planned([log_rows.LessThan(("rn",), 0)])
    assert len(planned(part="1000")) > len(planned())


def test_pointers_and_no_logs(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "pointer.csv").write_text("version 1\n")
    log_rows.write_index(spark, str(tmp_path / "logs"), str(tmp_path / "i"))
    df = log_rows.read_rows(spark, str(tmp_path / "logs"), str(tmp_path / "i"))
    assert df.count() == 0 and df.columns == ["drive_id", "rn", "driver_id"]


def test_short_logs_share_tasks(spark, tmp_path):
    """Logs are written whole, drives longer than a batch too, and many short ones are few tasks."""
    rows = spark.range(30_000).select(F.when(F.col("id") < 15_000, F.lit(7)).otherwise(F.col("id") % 400 + 100).alias("drive_id"), F.col("id").alias("rn"), (F.col("id") / 7).alias("v"))
    log_rows.write_logs(rows, str(tmp_path / "logs"))
    log_rows.write_index(spark, str(tmp_path / "logs"), str(tmp_path / "i"), min_bytes=0)
    got = log_rows.read_rows(spark, str(tmp_path / "logs"), str(tmp_path / "i"))
    assert got.rdd.getNumPartitions() < 10
    want = rows.toPandas().sort_values(["drive_id", "rn"])
    back = got.select(F.col("drive_id").cast("long").alias("drive_id"), "rn", F.col("v").cast("double").alias("v")).toPandas().sort_values(["drive_id", "rn"])
    assert back["drive_id"].tolist() == want["drive_id"].tolist() and back["v"].tolist() == want["v"].tolist()
    assert (back.groupby("drive_id")["rn"].agg(["min", "max", "size"]).assign(d=lambda x: x["max"] - x["size"])[["min", "d"]] == [1, 0]).all(axis=None)
