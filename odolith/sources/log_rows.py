r"""Row ranges of CSV logs, reading only the bytes that hold them.

``write_index`` counts, once, the lines that begin in each block of each log and writes a row per block. The data source
``log_rows`` plans its partitions from that index: ranges of bytes of files, each with the number of its first row, and
ranges of rows or names of drives, as filters on rn and drive_id or as the manifest of ``read_slices``, leave the other blocks unread.
A log of any length is as many tasks as it has parts of ``PART`` bytes; short ones share a task, where each counts as ``OPENING`` bytes more.

Columns are strings (an empty field is null), named by the first log's header; other logs match by name. To these come drive_id (the log's path
below the root, without .csv), rn (from 1) and driver_id. A row is a line: fields with line breaks in them aren't supported; empty lines don't
count, short rows end in nulls, fields beyond the header's are left out. Logs are ISO-8859-1. Files of ``min_bytes`` or fewer are pointers and have no
rows. Files are opened by pyarrow, by local path or by a URI it knows, also on the executors; an index is right for as long as the files stay as they are.
"""

from __future__ import annotations

import csv
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .drives import infer_driver

BLOCK = 4 << 20
PART = 64 << 20
OPENING = 256 << 10
_INDEX = "path string, drive_id string, start long, stop long, first_rn long, rows long"
_ADDED = ("drive_id", "rn", "driver_id")
_ROWS = 10_000


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _read(file, start: int, stop: int) -> bytes:
    return file.read_at(stop - start, start)


def _begins(data: bytes) -> np.ndarray:
    """Places in ``data`` at which a line that isn't empty begins; the first byte belongs to the line before."""
    a = np.frombuffer(data, np.uint8)
    return np.flatnonzero((a[:-1] == 10) & (a[1:] != 10) & (a[1:] != 13)) + 1


def _lines(file, size: int, start: int, stop: int) -> bytes:
    """The lines that begin in [start, stop), whole."""
    data = _read(file, start - 1, stop) if start else b"\n" + _read(file, 0, stop)
    first = _begins(data)
    if not len(first):
        return b""
    parts, at = [data[first[0] :]], stop
    while at < size and not parts[-1].endswith(b"\n"):
        more = _read(file, at, min(size, at + (1 << 16)))
        end = more.find(b"\n") + 1
        parts.append(more[:end] if end else more)
        at += len(more)
    return b"".join(parts)


def _header(file, size: int) -> list[str]:
    text = ""
    for stop in (1 << 14, 1 << 20, size):
        text = _lines(file, size, 0, min(size, stop)).decode("latin-1")
        if "\n" in text.strip("\r\n") or stop >= size:
            break
    return next(csv.reader(text.splitlines()), [])


def write_index(spark: SparkSession, root: str, index: str, block: int = BLOCK, min_bytes: int = 1000) -> None:
    """Writes the index of the logs under ``root`` as Parquet, a row per block of ``block`` bytes."""
    fs, base = _fs(root)
    files = [(f.path, f.size) for f in fs.get_file_info(pa.fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(".csv") and f.size > min_bytes]
    listed = spark.createDataFrame(files, "path string, size long")
    blocks = listed.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(block))).alias("start")).select("path", "start", F.least("size", F.col("start") + block).alias("stop"))

    def count(batches):
        for b in batches:
            rows = []
            for p, s, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(p) as f:
                    rows.append(len(_begins(_read(f, s - 1, e) if s else b"\n" + _read(f, 0, e))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.int64())], ["path", "start", "stop", "lines"])

    total = max(1, sum(-(-size // block) for _, size in files))
    counted = blocks.repartition(min(total, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(count, "path string, start long, stop long, lines long")
    before = F.coalesce(F.sum("lines").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    name = F.regexp_replace(F.substring("path", len(base.rstrip("/")) + 2, 1 << 20), r"\.csv$", "")
    # the header is the first line: it is row 0
    out = counted.select("path", name.alias("drive_id"), "start", "stop", before.alias("first_rn"), F.col("lines").alias("rows"))
    out.where("rows > 0").repartitionByRange("drive_id", "start").sortWithinPartitions("drive_id", "start").write.mode("overwrite").parquet(index)


def write_logs(df: DataFrame, root: str) -> None:
    """Writes rows (drive_id, rn, values) as a log for each drive, named by it, in order of rn. A log appears once it is whole, so a task may be run again."""
    names = [c for c in df.columns if c not in ("drive_id", "rn")]
    fs, base = _fs(root)
    fs.create_dir(base, recursive=True)

    def write(batches):
        drive, file, part, done = None, None, "", 0
        for b in batches:
            ids, rows = b.column("drive_id").to_numpy(zero_copy_only=False), pa.table([b.column(c) for c in names], names)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                new = file is None or ids[i] != drive
                if new:
                    if file is not None:
                        file.close()
                        fs.move(part, f"{base}/{drive}.csv")
                    drive, part = ids[i], f"{base}/{ids[i]}.{uuid.uuid4().hex}.part"
                    file, done = fs.open_output_stream(part), done + 1
                pa.csv.write_csv(rows.slice(i, j - i), file, pa.csv.WriteOptions(include_header=new))
        if file is not None:
            file.close()
            fs.move(part, f"{base}/{drive}.csv")
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["logs"])

    df.repartition("drive_id").sortWithinPartitions("drive_id", "rn").mapInArrow(write, "logs long").agg(F.sum("logs")).first()


@dataclass
class Pieces(InputPartition):
    """``path`` is the first one's; ``stop`` less ``start`` is the bytes of all."""

    own: list
    path: str
    start: int = 0
    stop: int = 0


@dataclass
class Piece:
    path: str
    drive_id: str
    start: int
    stop: int
    first_rn: int
    ranges: list


class LogRows(DataSource):
    """Options: path (the root of the logs) and index (its index, in a folder that pyarrow opens); ranges is JSON of [drive_id, first, last], part the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "log_rows"

    def schema(self) -> str:
        fs, where = _fs(self.options["index"])
        head = pa.dataset.dataset(where, filesystem=fs, format="parquet").sort_by("path").head(1).to_pylist()
        names = []
        if head:
            files, _ = _fs(self.options["path"])
            with files.open_input_file(head[0]["path"]) as f:
                names = _header(f, f.size())
        if len(set(names)) < len(names) or set(names) & set(_ADDED):
            raise ValueError(f"the header names a column twice, or one of {_ADDED}")
        return ", ".join([*(f"`{n.replace('`', '``')}` string" for n in names), "drive_id string", "rn long", "driver_id string"])

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options), schema)


class LogReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names = options, [f.name for f in schema.fields if f.name not in _ADDED]
        self.low, self.high, self.drives = 1, (1 << 63) - 1, None
        self.part = int(options.get("part", PART))

    def pushFilters(self, filters):  # noqa: N802
        """Takes bounds on rn and names of drives to choose blocks by; all filters stay with Spark too."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("rn",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if column == ("rn",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            if column == ("drive_id",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.drives = named if self.drives is None else self.drives & named
            yield f

    def partitions(self) -> list[Pieces]:
        wanted = None
        if "ranges" in self.options:
            wanted = {}
            for drive, first, last in json.loads(self.options["ranges"]):
                wanted.setdefault(drive, []).append((first, last))
        fs, where = _fs(self.options["index"])
        c = pa.dataset.field
        cond = (c("first_rn") <= self.high) & (c("first_rn") + c("rows") > self.low)
        for names in (self.drives, wanted):
            if names is not None:
                cond = cond & c("drive_id").isin(pa.array(sorted(n for n in names if n is not None), pa.string()))
        blocks = pa.dataset.dataset(where, filesystem=fs, format="parquet").to_table(filter=cond).sort_by([("drive_id", "ascending"), ("start", "ascending")])
        out = []
        for path, drive, start, stop, first, rows in zip(*(blocks[n].to_pylist() for n in ("path", "drive_id", "start", "stop", "first_rn", "rows")), strict=True):
            ranges = [(max(a, self.low), min(b, self.high)) for a, b in (wanted[drive] if wanted is not None else [(self.low, self.high)])]
            if not any(a < first + rows and b >= first and a <= b for a, b in ranges):
                continue
            if out and out[-1].path == path and out[-1].stop == start and stop - out[-1].start <= self.part:
                out[-1].stop = stop
            else:
                out.append(Piece(path, drive, start, stop, first, ranges))
        tasks, size = [], 0
        for p in out:
            more = p.stop - p.start + OPENING
            if not tasks or size + more > self.part + OPENING:
                tasks.append(Pieces([], p.path))
                size = 0
            tasks[-1].own.append(p)
            tasks[-1].stop += p.stop - p.start
            size += more
        return tasks

    def read(self, partition: Pieces | None):
        if partition is None:  # what Spark makes of no partitions
            return
        fs, _ = _fs(self.options["path"])
        held, size = [], 0
        for piece in partition.own:
            rows = self._rows(fs, piece)
            if rows is not None:
                held.append(rows)
                size += rows.num_rows
            if size >= _ROWS:
                yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=_ROWS)
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=_ROWS)

    def _rows(self, fs: pa.fs.FileSystem, piece: Piece) -> pa.Table | None:
        with fs.open_input_file(piece.path) as f:
            size = f.size()
            header = _header(f, size)
            text = _lines(f, size, piece.start, piece.stop).decode("latin-1")
        if not text:
            return None
        own = _parsed(text, header)
        rn = piece.first_rn + np.arange(own.num_rows)
        keep = np.zeros(len(rn), bool)
        for a, b in piece.ranges:
            keep |= (rn >= max(a, 1)) & (rn <= b)
        none = pa.nulls(own.num_rows, pa.string())
        cols = [own[n].combine_chunks() if n in header else none for n in self.names]
        cols += [pa.array([piece.drive_id] * len(rn), pa.string()), pa.array(rn, pa.int64()), pa.array([piece.path] * len(rn), pa.string())]
        return pa.table(cols, [*self.names, *_ADDED]).filter(pa.array(keep))


def _parsed(text: str, header: list[str]) -> pa.Table:
    """The lines as columns of strings."""
    try:
        return pa.csv.read_csv(
            pa.BufferReader(text.encode()),
            pa.csv.ReadOptions(column_names=header, use_threads=False),
            pa.csv.ParseOptions(ignore_empty_lines=True),
            pa.csv.ConvertOptions(column_types={n: pa.string() for n in header}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True),
        )
    except pa.ArrowInvalid:  # rows of other lengths than the header's
        rows = [r[: len(header)] + [""] * (len(header) - len(r)) for r in csv.reader(line for line in text.split("\n") if line.strip("\r"))]
        return pa.table([pa.array([r[k] or None for r in rows], pa.string()) for k in range(len(header))], header)


def read_rows(spark: SparkSession, root: str, index: str, **options) -> DataFrame:
    """All rows of the logs; filters on rn and drive_id choose the bytes that are read."""
    spark.dataSource.register(LogRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("log_rows").options(index=index, **options).load(root).withColumn("driver_id", infer_driver(F.col("driver_id")))


def read_slices(spark: SparkSession, root: str, index: str, manifest: DataFrame) -> DataFrame:
    """What ``drives.slices`` gives for ``manifest``, a fixed list of row ranges, from the bytes of these alone."""
    from .drives import slices

    ranges = [(r["drive_id"], r["offset"] + 1, r["offset"] + r["max_rows"]) for r in manifest.collect()]
    return slices(read_rows(spark, root, index, ranges=json.dumps(ranges)), manifest)
