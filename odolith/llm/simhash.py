"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: A-Z lower-cased, words between ASCII white space, three-word shingles with repeats, XXH64 with seed 42 over
the space-joined UTF-8 bytes; a bit is 1 if it is set in over half of the hashes. Equal fingerprints are one class, so a
group of copies is one row from there on.

Self-join: fingerprints within the Hamming budget k agree on all but k of k + 2 equal blocks. For each choice of two
blocks that agree, a trie over the bits in the order "agreed blocks first" has a zero budget on its first levels: only
fingerprints under the same root path can pair, and a root path is a shuffle key. Below it node pairs are traversed
together, one level per step for all pairs at once, adding up the differing bits and pruning pairs over budget. A root path
with more than ``HOT`` fingerprints is passed on in a stream and descends once more by the same rule over its free bits,
so it is dealt out anew; a path of the second level fixes 48 bits, so it has at most 2^16 fingerprints. From each subtrie only a spanning forest of its links leaves, not its pairs.

Null texts count as empty; texts without words have fingerprint zero and link like any other. Rows that repeat, or share a
doc_id, each keep their own row. A component is named by its smallest non-null doc_id. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components, local_labels
from .store import cut

BUDGET = 2
HOT = 4096
SHINGLE = 3
_FRONTIER = 1_000_000
_ROUND = 65_536


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """64-bit fingerprint of UTF-8 text; zero for null and for texts without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n, count = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(flat[s:e], 42) for s, e in spans), np.uint64, n)
    for i in range(0, n, _ROUND):
        count += _bits(hashes[i : i + _ROUND])
    return int((2 * count > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def _as_long(values) -> np.ndarray:
    return np.fromiter(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long for every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for b in batches:
            fp = _as_long(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(group: np.ndarray, value: np.ndarray, bits: int, budget: int):
    """Yields index arrays (i, j): entries of one group whose values differ in at most ``budget`` of the low ``bits`` bits.

    ``group`` and, within a group, ``value`` (unsigned) ascend strictly, so a trie node is a range of entries. A frontier
    over ``_FRONTIER`` node pairs is halved and its halves finished one after another, so memory stays bounded.
    """
    n = len(value)
    if n < 2:
        return
    ones: dict[int, np.ndarray] = {}

    def split(bit, lo, hi):
        if bit not in ones:
            if len(ones) > 8:
                ones.clear()
            ones[bit] = np.concatenate([[0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        c = ones[bit]
        return hi - (c[hi] - c[lo])

    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(first[1:], n)
    big = last - first > 1
    first, last = first[big], last[big]
    stack = [(bits - 1, first, last, first, last, np.zeros(len(first), np.int8))]
    while stack:
        bit, al, ah, bl, bh, diff = stack.pop()
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = (i != j) & (np.bitwise_count(value[i] ^ value[j]) <= budget)
            yield i[near], j[near]
            al, ah, bl, bh, diff = (x[~leaf] for x in (al, ah, bl, bh, diff))
        if not len(al) or bit < 0:
            continue
        if len(al) > _FRONTIER:
            h = len(al) // 2
            stack += [(bit, *(x[:h] for x in (al, ah, bl, bh, diff))), (bit, *(x[h:] for x in (al, ah, bl, bh, diff)))]
            continue
        am, bm = split(bit, al, ah), split(bit, bl, bh)
        same = al == bl
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), (am, ah, bl, bm, diff + 1)]
        keep = [(am > al) & (bm > bl), (ah > am) & (bh > bm), (am > al) & (bh > bm) & (diff < budget), (ah > am) & (bm > bl) & (diff < budget) & ~same]
        nxt = [np.concatenate([p[k][m] for p, m in zip(parts, keep, strict=True)]) for k in range(5)]
        alone = (nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1)
        stack.append((bit - 1, *(x[~alone] for x in nxt)))


def _root_paths(budget: int) -> list[tuple[int, ...]]:
    """Pairs of the ``budget + 2`` blocks a root path fixes: a budget of k differing bits leaves at least two blocks alike."""
    return list(combinations(range(budget + 2), 2))


def _cuts(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of equal blocks over the low ``bits`` bits, highest first."""
    edge = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [(bits - hi, hi - lo) for lo, hi in zip(edge, edge[1:], strict=False)]


def _squeeze(value: np.ndarray, cuts: list[tuple[int, int]], which) -> tuple[np.ndarray, int]:
    out, width = np.zeros(len(value), np.uint64), 0
    for w in which:
        s, n = cuts[w]
        out = (out << np.uint64(n)) | ((value >> np.uint64(s)) & np.uint64((1 << n) - 1))
        width += n
    return out, width


def _join_task(budget: int, hot: int, descend: bool):
    """A task of the self-join: rows (path, choice, fp, free, bits) sorted by path and free bits; see ``links``.

    Yields (a, b, path, choice, fp, free, bits): links in a, b, or a fingerprint of a hot root path one level further down.
    """
    names = ["a", "b", "path", "fp", "free", "bits"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def links(path, fp, free, bits):
        for width in np.unique(bits):
            of = bits == width
            g, v, f = path[of], free[of].view(np.uint64), fp[of]
            first = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
            g, v, f = g[first], v[first], f[first]
            pairs = list(trie_pairs(g, v, int(width), budget))
            if pairs:
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                lab = local_labels(len(f), i, j)
                own = np.flatnonzero(lab != np.arange(len(f)))
                null = lambda k, own=own: pa.nulls(len(own), types[k])
                yield pa.RecordBatch.from_arrays([pa.array(f[own]), pa.array(f[lab[own]]), null(2), null(3), null(4), null(5)], names)

    def further(path, fp, free, bits):
        for width in np.unique(bits):
            of = bits == width
            p, f, v = path[of], fp[of], free[of].view(np.uint64)
            cuts = _cuts(int(width), budget + 2)
            for choice, (x, y) in enumerate(_root_paths(budget)):
                fixed, _ = _squeeze(v, cuts, (x, y))
                rest, left = _squeeze(v, cuts, [k for k in range(budget + 2) if k not in (x, y)])
                with np.errstate(over="ignore"):
                    key = (p.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + fixed * np.uint64(8) + np.uint64(choice + 1)) * np.uint64(0xD6E8FEB86659FD93)
                n = len(f)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, types[0]), pa.nulls(n, types[1]), pa.array(key.view(np.int64)), pa.array(f), pa.array(rest.view(np.int64)), pa.array(np.full(n, left, np.int32))], names)

    def run(batches):
        held = [np.empty(0, np.int64) for _ in range(3)] + [np.empty(0, np.int32)]
        passing = None  # the hot root path that streams through
        for b in batches:
            rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if passing is not None:
                of = rows[0] == passing
                if of.any():
                    yield from further(*(x[of] for x in rows))
                    rows = [x[~of] for x in rows]
                if len(rows[0]):
                    passing = None
            if not len(rows[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            open_path = held[0][-1]
            done = np.searchsorted(held[0], open_path)
            if done >= _ROUND or len(held[0]) - done > hot:
                for part in split_hot([x[:done] for x in held]):
                    yield from part
                held = [x[done:] for x in held]
                if descend and len(held[0]) > hot:
                    passing = open_path
                    yield from further(*held)
                    held = [x[:0] for x in held]
        for part in split_hot(held):
            yield from part

    def split_hot(rows):
        if len(rows[0]):
            if descend:
                first = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
                size = np.diff(np.append(first, len(rows[0])))
                over = np.repeat(size > hot, size)
                if over.any():
                    yield further(*(x[over] for x in rows))
                    rows = [x[~over] for x in rows]
            yield links(*rows)

    return run


def links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(a, b): links between the distinct signed 64-bit values of the first column of ``fps``, enough to span every component."""
    n_blocks, fp = budget + 2, F.col("fp")
    cuts = _cuts(64, n_blocks)
    block = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in cuts]

    def glued(which):
        out = F.lit(0).cast("long")
        for k in which:
            out = F.shiftleft(out, cuts[k][1]).bitwiseOR(block[k])
        return out

    choices = []
    for choice, (x, y) in enumerate(_root_paths(budget)):
        rest = [k for k in range(n_blocks) if k not in (x, y)]
        choices.append(F.struct(F.xxhash64(F.lit(choice), glued((x, y))).alias("path"), fp.alias("fp"), glued(rest).alias("free"), F.lit(sum(cuts[k][1] for k in rest)).cast("int").alias("bits")))
    schema = "a long, b long, path long, fp long, free long, bits int"
    rows = fps.select(F.col(fps.columns[0]).cast("long").alias("fp")).distinct().select(F.explode(F.array(*choices)).alias("r")).select("r.*")
    dealt = lambda df: df.repartition("path").sortWithinPartitions("path", "bits", "free")
    first = cut(dealt(rows).mapInArrow(_join_task(budget, hot, True), schema), "trie")
    second = dealt(first.filter("path is not null").select("path", "fp", "free", "bits")).mapInArrow(_join_task(budget, hot, False), schema)
    return first.filter("a is not null").select("a", "b").unionByName(second.filter("a is not null").select("a", "b"))


def _rooted(docs: DataFrame, budget: int) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row of ``docs``; root, a fingerprint, is a component's own key, which its name need not be."""
    fps = cut(fingerprints(docs), "fp")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = connected_components(links(fps.select("fp"), budget))
    classes = classes.join(comp, classes.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    low = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(classes.join(low, "root").select("fp", "component_id", "root"), "simhash")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def simhash_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; fp is the fingerprint as a signed long.

    Groups that share no link can share a name: all without a doc_id have none, and a repeated doc_id may be the smallest of several.
    """
    return _rooted(docs, budget).drop("root")


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` with one row left of each near-duplicate group: that of the smallest doc_id.

    Of rows that share this doc_id, one of the smallest fingerprint stays. A group whose doc_ids are all null keeps one row too.
    """

    def run(batches):
        for b in batches:
            text = b.column(at).cast(pa.string())
            fp = _as_long(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names)

    at, mark = docs.columns.index("text"), "_simhash"
    while mark in docs.columns:
        mark += "_"
    names = [*docs.columns, mark]
    groups = _rooted(docs.select("doc_id", "text"), budget)
    lowest = groups.filter("doc_id <=> component_id").groupBy("root", "fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    # a group of several fingerprints with a repeated doc_id keeps the row with the smallest of them
    chosen = lowest.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min_by("n", "fp").alias("n"))
    chosen = cut(chosen.select(F.col("doc_id").alias("_simhash_id"), F.col("fp").alias("_simhash_fp"), F.col("n").alias("_simhash_n")), "kept")
    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())]))
    kept = marked.join(chosen, marked["doc_id"].eqNullSafe(chosen["_simhash_id"]) & (marked[mark] == chosen["_simhash_fp"]))
    once = kept.filter(chosen["_simhash_n"] == 1).select(*[marked[c] for c in docs.columns])
    if chosen.filter("_simhash_n > 1").limit(1).count() == 0:
        return once
    return once.unionByName(kept.filter(chosen["_simhash_n"] > 1).dropDuplicates(["_simhash_id", "_simhash_fp"]).select(*[marked[c] for c in docs.columns]))

