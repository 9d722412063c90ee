"""The shard store: round trips, targets, empty tables, clashing names, conflicts, and what vacuum leaves alone."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from odolith.llm import queries, sharding

DOCS = "doc_id long, text string, source string"
CLASH = "doc_id long, text string, to long, _shard string, _batch string, _file string, _size long, _metadata string, run long, tier int, `__shard` string"


def prose(rng, n, k=120):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(4000)]
    return [" ".join(rng.choices(words, k=rng.randint(1, k))) for _ in range(n)]


def all_rows(df):
    return Counter(tuple(r) for r in df.collect())


def store_at(spark, path, **k):
    return sharding.ShardStore(spark, str(path / "store"), **k)


def test_round_trip_versions_and_conflicts(spark, tmp_path):
    store = store_at(spark, tmp_path, target=60_000, fan_in=3)
    rng = random.Random(13)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(prose(rng, 300))], DOCS).repartition(12)
    extra = spark.createDataFrame([(None, "a", "s"), (5, None, None), (5, "", ""), (5, "", ""), (6, "x" * 100_000, "é")], DOCS)
    assert store.append(docs) == 1 and store.append(extra) == 2
    last = store.compact()
    assert last > 2 and store.manifest().count() < store.manifest(2).count()
    want = all_rows(docs.unionByName(extra))
    assert all_rows(store.snapshot()) == want and all_rows(store.snapshot(2)) == want and all_rows(store.snapshot(1)) == all_rows(docs)
    assert store.compact() == last and store.plan(store.manifest()).count() == 0
    assert store.manifest().agg(F.sum("n_rows")).first()[0] == docs.count() + extra.count()
    with pytest.raises(sharding.CommitConflict):
        store._commit(store.manifest(), store.schema(), last - 1)
    assert store.vacuum(older_than=0) > 0 and all_rows(store.snapshot()) == want
    files = [p for p in (tmp_path / "store" / "data").rglob("part-*.parquet")]
    assert len(files) == store.manifest().count()  # no dead file is left in any folder
    assert not list((tmp_path / "store" / "plan").iterdir()) and store._versions() == [last]
    with pytest.raises(ValueError, match="columns differ"):
        store.append(docs.drop("source"))


@pytest.mark.parametrize("block", [512, 3])
def test_files_keep_to_the_target(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK", block)
    store = store_at(spark, tmp_path, target=100_000)
    rng = random.Random(14)
    for n in (10, 30, 60, 150):
        store.append(spark.createDataFrame([(i, t, "s") for i, t in enumerate(prose(rng, n * 7))], DOCS).repartition(7))
    before = store.manifest().agg(F.sum("n_rows"), F.count("*")).first()
    store.compact()
    after = store.manifest().agg(F.sum("n_rows"), F.count("*"), F.max("n_bytes")).first()
    assert after[0] == before[0] and after[1] < before[1] and after[2] <= 100_000
    if block == 512:
        assert store.manifest().where("n_bytes <= 50000").groupBy("tier").count().where("count >= 4").count() == 0


def test_shards_of_the_top_tier_merge(spark, tmp_path):
    store = store_at(spark, tmp_path, target=1_000)
    m = spark.createDataFrame([("a", f"f{i}", 3, 1, 400) for i in range(5)] + [("a", "big", 3, 1, 501), ("a", "small", 0, 1, 10)], "batch string, file string, tier int, n_rows long, n_bytes long")
    runs = Counter(r["run"] for r in store.plan(m).collect())
    assert sorted(runs.values()) == [2, 2] and sorted(runs) == [0, 1]


def test_empty_tables_and_new_stores(spark, tmp_path):
    store = store_at(spark, tmp_path)
    assert store.version() == 0 and store.compact() == 0 and store.vacuum() == 0 and store.manifest().count() == 0
    with pytest.raises(LookupError):
        store.snapshot()
    none = spark.createDataFrame([], CLASH)
    assert store.append(none) == 1 and store.compact() == 1
    assert store.snapshot().count() == 0 and store.snapshot().columns == none.columns
    assert set(store.snapshot(places=True).columns) - set(none.columns) == {"___shard", "__size"}
    assert store.append(none) == 2 and store.manifest().count() == 0 and store.vacuum(older_than=0) > 0


def test_clashing_names_are_kept(spark, tmp_path):
    store = store_at(spark, tmp_path, target=1 << 20)
    rows = [(i, f"t{i}", i % 3, "mine", "b", "f", 7, "m", 1, 2, "k") for i in range(40)]
    store.append(spark.createDataFrame(rows, CLASH).repartition(8))
    assert store.compact() == 2
    got = store.snapshot(places=True)
    assert all_rows(got.select(*[f"`{c}`" for c in CLASH.replace("`", "").replace(",", "").split()[::2]])) == Counter(rows)
    assert got.select("___shard", "__size").distinct().count() == 1


def test_vacuum_leaves_a_commit_in_flight_alone(spark, tmp_path):
    store = store_at(spark, tmp_path)
    docs = spark.createDataFrame([(1, "a", "s")], DOCS)
    store.append(docs)
    new = store._written("a-in-flight", docs)
    assert store.vacuum() == 0  # younger than the limit
    assert store._commit(store.manifest().unionByName(new), store.schema(), 1, "a-in-flight", 1) == 2 and store.snapshot().count() == 2
    late = store._written("a-late", docs)
    assert store.vacuum(keep=2, older_than=0) > 0
    with pytest.raises(sharding.CommitConflict):
        store._commit(store.manifest().unionByName(late), store.schema(), 2, "a-late", 1)
    assert store.snapshot().count() == 2


def test_query_gives_every_row_back(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op10_sharding(spark, sf)
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5("text").alias("text_md5"), F.lit(True).alias("within_target"))
    assert all_rows(got) == all_rows(want)
