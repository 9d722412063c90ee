"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on part of a sample of at most ``SAMPLE`` rows; their product is a
grid of cells of about ``PER_CELL`` vectors. Every vector lives in the nearest cell and visits others in the order of the multi-sequence traversal, until
a cell is farther than its own by more than a margin. The margin is found on the rest of the sample: of pairs exactly at the
threshold at least ``RECALL`` share a cell, as home of one and visited by the other; closer pairs do so more often. Vectors deep inside their cell so visit none.
Nothing bounds how many cells a vector visits.

In a cell, residents meet visitors and each other: single-precision products find candidates, and those near the threshold are decided in double precision.
A pair that could meet in two cells counts in the lower one only. No pairs leave a cell: only a count for each vector and a spanning
forest of the links. Vectors travel in the width they are stored in, once for each cell they visit. Equal vectors are one node for each batch they are read in, and one row of the
products in the cell that they share. A cell with more than ``BLOCK`` residents is dealt out in blocks, each with its own task and the cell's visitors in a stream.

Vectors of different lengths link with nothing of another length; a cell holds one length only, and for the choice of cells all are laid out at the sample's greatest length. Vectors that are null,
zero, or hold null or non-finite components link with nothing. Rows that share a vec_id are one node, and a null vec_id is one id
below all others. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components, local_labels
from .store import cut

THRESHOLD = 0.95
SAMPLE = 8192
RECALL = 0.97
PER_CELL = 1024
BLOCK = 8192
#: crowded cells that are broadcast, as rows of two longs
SMALL = 1_000_000
_NONE = -(1 << 63)
_DIM = 40  # bits of a cell's number below its vectors' length


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def laid_out(u: np.ndarray, size: int) -> np.ndarray:
    """Rows at another length: zeros after them, or what is over added on from the start. Near vectors stay near."""
    if u.shape[1] == size:
        return u
    wide = np.zeros((len(u), -(-u.shape[1] // size) * size))
    wide[:, : u.shape[1]] = u
    return wide.reshape(len(u), -1, size).sum(1)


def _codebook(z: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = z[rng.choice(len(z), min(k, len(z)), replace=False)].copy()
    for _ in range(8):
        near = np.argmin((c * c).sum(1) - 2 * z @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, z)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    def __init__(self, first: np.ndarray, second: np.ndarray, margin: float = 0.0):
        self.books, self.margin = (first, second), margin
        self.size = first.shape[1] + second.shape[1]

    def _gaps(self, u: np.ndarray) -> list[np.ndarray]:
        """How much farther each code of each half is than the nearest one, in squared distance."""
        u, half, out = laid_out(u, self.size), self.books[0].shape[1], []
        for z, c in zip((u[:, :half], u[:, half:]), self.books, strict=True):
            d = (c * c).sum(1) - 2 * z @ c.T
            out.append(d - d.min(1, keepdims=True))
        return out

    def homes(self, u: np.ndarray) -> np.ndarray:
        a, b = (g.argmin(1) for g in self._gaps(u))
        return a.astype(np.int64) * len(self.books[1]) + b

    def cells(self, u: np.ndarray) -> list[np.ndarray]:
        """The cells within the margin of each row, nearest first: the home cell, then the others as the traversal meets them."""
        order, gap = [], []
        for g in self._gaps(u):
            m = max(1, int((g <= self.margin).sum(1).max(initial=1)))  # no further place of this sequence is within the margin
            o = np.argsort(g, axis=1, kind="stable")[:, :m]
            order.append(o)
            gap.append(np.take_along_axis(g, o, axis=1))
        # multi-sequence traversal, all rows in step: a row's frontier has, for each place i of the first sequence, the next place j of the second;
        # its nearest cell is visited next, and the row ends when that is beyond the margin
        live, k = np.arange(len(u)), len(self.books[1])
        a, b = (np.pad(g, ((0, 0), (0, 1)), constant_values=np.inf) for g in gap)  # a place after the last is never near
        nxt = np.zeros((len(u), gap[0].shape[1]), np.int64)
        rows, cells = [], []
        first = True
        while len(live):
            reach = a[live, :-1] + np.take_along_axis(b[live], nxt[live], axis=1)
            reach[:, 1:][nxt[live][:, 1:] >= nxt[live][:, :-1]] = np.inf  # (i, j) is open once (i - 1, j) has been visited
            i = reach.argmin(1)
            r = np.arange(len(live))
            near = np.ones(len(live), bool) if first else reach[r, i] <= self.margin
            live, i, first = live[near], i[near], False
            j = nxt[live, i]
            rows.append(live)
            cells.append(order[0][live, i].astype(np.int64) * k + order[1][live, j])
            nxt[live, i] += 1
        if not rows:
            return []
        row, cell = np.concatenate(rows), np.concatenate(cells)
        by = np.argsort(row, kind="stable")
        return np.split(cell[by], np.cumsum(np.bincount(row, minlength=len(u)))[:-1])

    def gap_to(self, u: np.ndarray, home: np.ndarray) -> np.ndarray:
        """How far beyond its own cell each row has the given one."""
        a, b = self._gaps(u)
        r = np.arange(len(u))
        return a[r, home // len(self.books[1])] + b[r, home % len(self.books[1])]


def fit(u: np.ndarray, n_rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Index:
    """An index for ``n_rows`` unit vectors of which ``u`` is a sample. The margin is measured on a quarter of it that the codebooks don't see."""
    rng = np.random.default_rng(7)
    own = rng.permutation(len(u))
    test, train = u[own[: max(1, len(u) // 4)]], u[own[len(u) // 4 :]]
    k = int(max(2, min(2 ** round(np.log2(np.sqrt(n_rows / PER_CELL + 1))), len(train) // 8)))
    half = max(1, u.shape[1] // 2)
    index = Index(_codebook(train[:, :half], k, rng), _codebook(train[:, half:], k, rng))
    noise = rng.normal(size=test.shape)
    noise -= (noise * test).sum(1, keepdims=True) * test
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    other = threshold * test + np.sqrt(1 - threshold**2) * noise
    gap = np.minimum(index.gap_to(test, index.homes(other)), index.gap_to(other, index.homes(test)))
    index.margin = float(np.quantile(gap, recall, method="higher"))
    return index


CODED = "id long, node long, copies long, home long, visits array<long>, vec binary"


def _met(threshold: float, width: type):
    """A task: blocks of cells, residents before visitors. Yields (id, n, root)."""

    def finish(acc):
        ids, n, pairs = acc
        if not ids:
            return
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        nodes, inv = np.unique(np.concatenate([*ids, i, j]), return_inverse=True)
        at = len(inv) - 2 * len(i)
        lab = local_labels(len(nodes), inv[at : at + len(i)], inv[at + len(i) :])
        count = np.bincount(inv[:at], weights=np.concatenate(n), minlength=len(nodes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(count), pa.array(nodes[lab])], ["id", "n", "root"])

    class Side:
        """Vectors of one cell, equal ones once: their nodes lie in slices of ``ids``."""

        def __init__(self, ids, copies, home, own, visits, vec):
            keys = np.frombuffer(b"".join(vec), f"V{len(vec[0])}")
            _, first, inv = np.unique(keys, return_index=True, return_inverse=True)
            by = np.argsort(inv, kind="stable")
            self.ids, self.at = ids[by], np.concatenate([[0], np.cumsum(np.bincount(inv))])
            self.copies = np.bincount(inv, weights=copies).astype(np.int64)
            self.home, self.own, self.visits = home[first], own[first], [visits[k] for k in first.tolist()]
            self.u = unit(np.frombuffer(b"".join([vec[k] for k in first.tolist()]), width).reshape(len(first), -1))
            self.single = self.u.astype(np.float32)

        def nodes(self, k):
            """(place in k, node) for all nodes of the vectors k, each id of a vector once."""
            n = self.at[k + 1] - self.at[k]
            place = np.repeat(np.arange(len(k)), n)
            node = self.ids[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[k], n)]
            return np.unique(np.stack([place, node], 1), axis=0).T if len(place) else (place, node)

    def tell(acc, side, k, n):
        """Each node of vectors k has n more links."""
        place, node = side.nodes(k)
        acc[0].append(node)
        acc[1].append(n[place])

    def equal(res, acc):
        """Equal residents link with each other."""
        many = np.flatnonzero(res.copies > 1)
        if len(many):
            tell(acc, res, many, res.copies[many] - 1)
            place, node = res.nodes(many)
            acc[2].append((node, res.ids[res.at[many]][place]))

    def meet(res, vis, acc):
        """Residents against visitors; vis None: residents against each other."""
        other, step = (res if vis is None else vis), 1024
        slack = 1e-5 + 1e-6 * res.u.shape[1]
        for lo in range(0, len(other.u), step):
            cos = res.single @ other.single[lo : lo + step].T
            i, j = np.nonzero(cos >= threshold - slack)
            ok = i < j + lo if vis is None else np.ones(len(i), bool)
            i, j = i[ok], j[ok]
            close = np.flatnonzero(cos[i, j] < threshold + slack)
            j = j + lo
            sure = np.ones(len(i), bool)
            for c in range(0, len(close), 65_536):
                part = close[c : c + 65_536]
                sure[part] = (res.u[i[part]] * other.u[j[part]]).sum(1) >= threshold
            i, j = i[sure], j[sure]
            if vis is not None:
                # the same cell: by block, once; else the pair also meets in the visitor's home cell if the resident visits that
                home, there = other.home[j], res.home[i]
                back = np.fromiter((h in v for h, v in zip(home.tolist(), (res.visits[k] for k in i.tolist()), strict=True)), bool, len(i))
                ok = np.where(home == there, other.own[j] < res.own[i], ~back | (there < home))
                i, j = i[ok], j[ok]
            if len(i):
                for side, k, far, by in ((res, i, other, j), (other, j, res, i)):
                    own, inv = np.unique(k, return_inverse=True)
                    tell(acc, side, own, np.bincount(inv, weights=far.copies[by]).astype(np.int64))
                a, b = res.ids[res.at[i]], other.ids[other.at[j]]
                nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
                lab = local_labels(len(nodes), inv[: len(a)], inv[len(a) :])
                own = lab != np.arange(len(nodes))
                acc[2].append((nodes[own], nodes[lab[own]]))

    def run(batches):
        key, res, wait, acc = None, None, [], ([], [], [])

        def settled():
            side = Side(*(np.concatenate(x) if isinstance(x[0], np.ndarray) else sum(x, []) for x in zip(*wait, strict=True)))
            equal(side, acc)
            meet(side, None, acc)
            return side

        for batch in batches:
            cell, block, visitor = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6)] + [[None if v is None else set(v) for v in batch.column(7).to_pylist()], batch.column(8).to_pylist()]
            change = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (visitor[1:] != visitor[:-1])])) if len(cell) else []
            for s, e in zip(change, [*change[1:], len(cell)], strict=True):
                here = (cell[s], block[s])
                if here != key:
                    if wait:
                        settled()
                    yield from finish(acc)
                    key, res, wait, acc = here, None, [], ([], [], [])
                part = [x[s:e] for x in cols]
                if not visitor[s]:
                    wait.append(part)
                else:
                    if wait:
                        res, wait = settled(), []
                    if res is not None:
                        meet(res, Side(*part), acc)
                        if sum(map(len, acc[0])) > 1_000_000:  # what has gathered goes out; the rest of the block follows
                            yield from finish(acc)
                            acc = ([], [], [])
        if wait:
            settled()
        yield from finish(acc)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NONE)).alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", F.when(good, F.col("v")).alias("v"))
    usable = rows.where("v is not null")
    n = usable.count()
    got = [r[0] for r in usable.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").collect()]  # bounded by the sample
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if not got:
        return alone
    most = max(map(len, got))
    index = fit(np.concatenate([laid_out(unit(np.array([v for v in got if len(v) == k])), most) for k in sorted(set(map(len, got)))]), n, threshold, recall)
    sent, width = vectors.sparkSession.sparkContext.broadcast(index), np.float32 if single else np.float64

    def encode(batches):
        """All rows with their node, and with it, once for each vector of a batch, the node's cells and vector."""
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            size = np.array(lists.value_lengths().fill_null(0).to_pylist(), np.int64)
            node, copies, home, visits, vec = [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids)
            for dim in np.unique(size[size > 0]).tolist():
                of = np.flatnonzero(size == dim)
                x = lists.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).astype(width).reshape(len(of), dim) + width(0)  # -0 is 0
                _, first, inv = np.unique(np.frombuffer(x.tobytes(), f"V{dim * x.itemsize}"), return_index=True, return_inverse=True)
                low = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(low, inv, ids[of])
                n_of, base = np.bincount(inv), dim << _DIM
                for r, k in zip(of.tolist(), inv.tolist(), strict=True):
                    node[r] = int(low[k])
                for k, cells in enumerate(sent.value.cells(unit(x[first]))):
                    r = int(of[first[k]])
                    copies[r], home[r], visits[r], vec[r] = int(n_of[k]), base + int(cells[0]), (base + cells).tolist(), x[first[k]].tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip((node, copies, home, visits, vec), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True))], ["id", "node", "copies", "home", "visits", "vec"])

    coded = cut(rows.mapInArrow(encode, CODED), "cells")
    nodes = coded.where("vec is not null").select(F.col("node").alias("id"), "copies", "home", "visits", "vec")
    crowded = cut(nodes.groupBy("home").count().where(F.col("count") > BLOCK).select(F.col("home").alias("cell"), F.ceil(F.col("count") / BLOCK).alias("blocks")), "crowded")
    seen = nodes.select(F.explode("visits").alias("cell"), "*").join(F.broadcast(crowded) if crowded.count() <= SMALL else crowded, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    # equal vectors are residents of one block
    seen = seen.withColumn("own", F.when(F.col("cell") == F.col("home"), F.pmod(F.xxhash64("vec"), "blocks")).otherwise(F.lit(-1).cast("long")))
    met = seen.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # a resident is a visitor of the other blocks of its own cell, those after its own
    met = met.where("own < 0 or block >= own").withColumn("visitor", F.col("block") != F.col("own"))
    met = met.select("cell", "block", "visitor", "id", "copies", "home", "own", F.when(~F.col("visitor"), F.col("visits")).alias("visits"), "vec")
    found = cut(met.repartition("cell", "block").sortWithinPartitions("cell", "block", "visitor").mapInArrow(_met(threshold, width), "id long, n long, root long"), "links")
    # copies of a batch hang on their node, so that an id of several vectors is one node
    comp = connected_components(found.select("id", "root").unionByName(coded.where("id <> node").select("id", F.col("node").alias("root"))))
    counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    out = coded.select("id", "node").join(counts, "node", "left").join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    plain = lambda c: F.when(c != _NONE, c)
    return out.select(plain(F.col("id")).alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), plain(component).alias("component_id"), (F.col("id") == component).alias("kept"))
