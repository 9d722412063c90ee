"""A store of immutable shards with size-tiered compaction and atomically committed, versioned manifests.

``append`` writes what arrives as it is partitioned, one small file a task and no shuffle. ``compact`` takes the shards of at most half
the target, deals those of one size tier into blocks of about ``BLOCK``, and within a block fills runs in order: a run is closed before the
shard that would take it over the target. Runs of ``fan_in`` shards or more, and those that fill over half a target, are rewritten as one file
each; all other shards stay untouched. So no file that compaction writes holds more than the target's bytes of input, each run is one
task, and the one shuffle, by run, has no hot key whatever the rows hold.

A change counts once its manifest has been renamed to the next version's name, which fails if that exists; before, the files that it adds
are counted in their folder. A job that dies leaves files that no manifest names; ``vacuum`` deletes these and what only old versions
name, once they are older than a limit that must exceed the longest commit. Sizes and counts come from file metadata and footers. DataFrame functions
only; the driver sees the paths of the files it has Spark read, as Spark's own file index does, and no rows.

Rows, nulls, repeats and columns are kept as they are, whatever the columns are called: names that the store adds get more underscores where
they would clash. All arrivals must have the first one's columns. An empty table makes a version without shards; a store without versions has nothing to compact
or to vacuum, and its snapshot is an error.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = 64 << 20
FAN_IN = 4
BASE = 64 << 10
BLOCK = 512
#: shards beyond which a plan is joined rather than broadcast; a row of one is two names made here, under 200 bytes
SMALL = 200_000
DAY = 86_400
MANIFEST = "batch string, file string, tier int, n_rows long, n_bytes long, columns string"


class CommitConflict(RuntimeError):
    """Another writer has committed this version, or files of the version are gone."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:]) for s in self._fs().globStatus(self._path("manifest/v*")) or [])

    def version(self) -> int:
        """The last committed version; 0 for a new store."""
        return max(self._versions(), default=0)

    def _whole_manifest(self, version: int) -> DataFrame:
        """The shards, and a row without file that has the columns of the data."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version:08d}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """(batch, file, tier, n_rows, n_bytes) of the live shards; n_bytes is the file's size."""
        version = version or self.version()
        if not version:
            return self._none(T.StructType.fromDDL(MANIFEST)).drop("columns")
        return self._whole_manifest(version).where("file is not null").drop("columns")

    def schema(self, version: int | None = None) -> T.StructType:
        version = version or self.version()
        if not version:
            raise LookupError(f"nothing has been committed to {self.root}")
        return T.StructType.fromJson(json.loads(self._whole_manifest(version).where("file is null").first()["columns"]))

    def _commit(self, shards: DataFrame, schema: T.StructType, after: int, added: str | None = None, n_added: int = 0) -> int:
        if added and n_added and len(self._fs().globStatus(self._path(f"data/{added}/part-*")) or []) < n_added:
            raise CommitConflict(f"files of {added} are gone")
        head = self.spark.range(1).select(*[F.lit(schema.json() if f.name == "columns" else None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(MANIFEST)])
        whole = head.unionByName(shards.withColumn("columns", F.lit(None).cast("string")))
        tmp = f"manifest/_{uuid.uuid4().hex}"
        whole.coalesce(8).write.parquet(f"{self.root}/{tmp}")
        jvm, gw = self.spark._jvm, self.spark.sparkContext._gateway
        fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self.spark._jsc.hadoopConfiguration())
        none = gw.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        if fc.util().exists(self._path(f"manifest/v{after + 1:08d}")):
            raise CommitConflict(f"version {after + 1} exists")
        fc.rename(self._path(tmp), self._path(f"manifest/v{after + 1:08d}"), none)
        return after + 1

    def _tier(self, size: str):
        return F.floor(F.log(float(self.fan_in), F.greatest(F.col(size) / F.lit(BASE), F.lit(1.0)))).cast("int")

    def _written(self, batch: str, rows: DataFrame) -> DataFrame:
        """Writes ``rows``; its shards as manifest rows. Files without rows are no shards."""
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{batch}")
        back = self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{batch}")
        meta = back.metadataColumn("_metadata")
        per_file = back.select(meta["file_name"].alias("file"), meta["file_size"].alias("n_bytes")).groupBy("file", "n_bytes").agg(F.count("*").alias("n_rows"))
        per_file = per_file.select(F.lit(batch).alias("batch"), "file", self._tier("n_bytes").alias("tier"), "n_rows", "n_bytes")
        return self._kept(per_file, f"plan/{batch}")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def append(self, rows: DataFrame) -> int:
        """Writes ``rows`` as small shards; the new version."""
        now = self.version()
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        if now and (held := self.schema(now)) != schema:
            raise ValueError(f"columns differ from the store's: {held.simpleString()}")
        batch = f"a-{uuid.uuid4().hex}"
        new = self._written(batch, rows)
        return self._commit(self.manifest(now).unionByName(new), schema, now, batch, new.count())

    def plan(self, manifest: DataFrame) -> DataFrame:
        """(batch, file, run) of the shards to merge; runs are numbered from 0 without gaps."""
        small = manifest.where(F.col("n_bytes") <= self.target / 2)
        blocks = small.groupBy("tier").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))  # a row for each tier
        dealt = small.join(F.broadcast(blocks), "tier").withColumn("block", F.pmod(F.xxhash64("batch", "file"), "n_blocks"))
        shard = F.struct("batch", "file", "n_bytes")
        lists = dealt.groupBy("tier", "block").agg(F.array_sort(F.collect_list(shard)).alias("shards"))
        fits = f"acc.bytes + x.n_bytes <= {self.target}"
        filled = F.expr(f"""aggregate(shards, named_struct('runs', cast(array() as array<struct<shards: array<struct<batch: string, file: string, n_bytes: bigint>>, bytes: bigint>>), 'shards', slice(shards, 1, 0), 'bytes', 0L),
            (acc, x) -> named_struct('runs', if({fits}, acc.runs, concat(acc.runs, array(named_struct('shards', acc.shards, 'bytes', acc.bytes)))), 'shards', if({fits}, concat(acc.shards, array(x)), array(x)), 'bytes', if({fits}, acc.bytes, 0L) + x.n_bytes),
            acc -> concat(acc.runs, array(named_struct('shards', acc.shards, 'bytes', acc.bytes))))""")
        good = F.filter("filled", lambda r: (F.size(r["shards"]) >= self.fan_in) | ((F.size(r["shards"]) > 1) & (r["bytes"] > self.target / 2)))
        runs = lists.withColumn("filled", filled).select("tier", "block", good.alias("runs"))
        # a row for each block: at most one for ``BLOCK`` shards and one for each tier
        places = runs.select("tier", "block", (F.sum(F.size("runs")).over(W.orderBy("tier", "block")) - F.size("runs")).alias("first"))
        each = runs.join(places, ["tier", "block"]).select("first", F.posexplode("runs").alias("k", "r"))
        return each.select((F.col("first") + F.col("k")).alias("run"), F.explode("r.shards").alias("s")).select("s.batch", "s.file", "run")

    def compact(self) -> int:
        """Merges runs until none is left to merge; the last version."""
        while now := self.version():
            manifest, schema = self.manifest(now), self.schema(now)
            batch = f"c-{uuid.uuid4().hex}"
            plan = self._kept(self.plan(manifest), f"plan/p-{batch}")
            n, n_runs = plan.agg(F.count("*"), F.max("run")).first()
            if not n:
                return now
            tags, run = self._names(schema, "batch", "file"), self._names(schema, "run")[0]
            own = plan.select(F.col("batch").alias(tags[0]), F.col("file").alias(tags[1]), F.col("run").alias(run))
            rows = self._rows(plan, schema, dict(zip(("batch", "file"), tags, strict=True))).join(F.broadcast(own) if n <= SMALL else own, tags).drop(*tags)
            # each run is a partition of its own, and so one file
            new = self._written(batch, rows.repartitionById(int(n_runs) + 1, F.col(run).cast("int")).drop(run))
            stay = manifest.join(plan.select("batch", "file"), ["batch", "file"], "left_anti")
            self._commit(stay.unionByName(new), schema, now, batch, new.count())
        return 0

    def _none(self, schema: T.StructType) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def _names(self, schema: T.StructType, *names: str) -> list[str]:
        """``names`` with as many underscores before them as no column has."""
        taken, out = {n.lower() for n in schema.names}, []
        for n in names:
            n = f"_{n}"
            while n in taken:
                n = f"_{n}"
            out.append(n)
        return out

    def _rows(self, shards: DataFrame, schema: T.StructType, names: dict[str, str]) -> DataFrame:
        """The rows of ``shards`` (batch, file), of which only the files are read, with where they lie under the given names."""
        paths = [f"{self.root}/data/{r['batch']}/{r['file']}" for r in shards.select("batch", "file").toLocalIterator()]
        if not paths:
            return self._none(schema).select("*", *[F.lit(None).cast("long" if k == "size" else "string").alias(v) for k, v in names.items()])
        rows = self.spark.read.schema(schema).parquet(*paths)
        m = rows.metadataColumn("_metadata")
        batch = F.element_at(F.split(m["file_path"], "/"), -2)
        of = {"batch": batch, "file": m["file_name"], "shard": F.concat_ws("/", batch, m["file_name"]), "size": m["file_size"]}
        return rows.select("*", *[of[k].alias(v) for k, v in names.items()])

    def snapshot(self, version: int | None = None, places: bool = False) -> DataFrame:
        """All rows of a version; with ``places`` also the shard they lie in (``_shard``) and its size in bytes (``_size``)."""
        schema = self.schema(version)
        names = dict(zip(("shard", "size"), self._names(schema, "shard", "size"), strict=True)) if places else {}
        return self._rows(self.manifest(version), schema, names)

    def vacuum(self, keep: int = 1, older_than: float = DAY) -> int:
        """Deletes versions before the last ``keep``, files that only they name, and what no version names; how many files and folders went.

        Nothing younger than ``older_than`` seconds goes, so that what another writer has yet to commit stays.
        """
        fs, versions = self._fs(), self._versions()
        before = (time.time() - older_than) * 1000
        old = lambda s: s.getModificationTime() <= before
        files = lambda some: reduce(DataFrame.unionByName, [self.manifest(v).select("batch", "file") for v in some], self._none(T.StructType.fromDDL("batch string, file string")))
        gone = 0
        named = {r["batch"] for r in files(versions).select("batch").distinct().toLocalIterator()}  # one for each append or round of compaction
        for r in files(versions[:-keep]).distinct().join(files(versions[-keep:]), ["batch", "file"], "left_anti").toLocalIterator():
            p = self._path(f"data/{r['batch']}/{r['file']}")
            if fs.exists(p) and old(fs.getFileStatus(p)):
                gone += fs.delete(p, False)
        for pattern in ("data/*", "plan/*", "manifest/_*", "manifest/v*"):
            for s in fs.globStatus(self._path(pattern)) or []:
                name = s.getPath().getName()
                if pattern == "manifest/v*":
                    dead = int(name[1:]) in versions[:-keep]
                elif pattern == "data/*":
                    dead = name not in named or not fs.globStatus(self._path(f"data/{name}/part-*"))
                else:
                    dead = True
                if dead and old(s):
                    gone += fs.delete(s.getPath(), True)
        return gone

