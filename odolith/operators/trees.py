"""Many tree models at once, from rows whose features are binned once.

``fit`` grows the trees of all models it is given side by side: forests of any number of folds and settings, boosted trees by second-order gain, by squared error, or on quantiles. A round (all trees of
forests, the next tree of boosted models) goes level by level. Nodes with many rows share one aggregation a level: every task adds up histograms (gradients, Hessians, counts by feature and bin) of the nodes its rows
are in, the sums are shuffled by node and block of features, and the best split of each block comes to the driver. A node with at most ``SMALL`` rows goes with all below it to one task
that finishes the subtree. So the work is a pass a level over one table of bytes, whatever the number of models, and no task holds more than its histograms
or ``SMALL`` rows. Quantile models' predictions so far are recomputed from the trees that are sent. A lost executor costs a re-read.

Boosted models of squared error grow by levels alone, over rows kept as arrays with their residuals, which take in the trees of every ``KEPT`` rounds: a job a level, or for a model of at most ``WHOLE`` rows all rounds
in one task. Forests of few rows (``WHOLE_FOREST``) are grown in tasks that have all of them. For larger ones, up to ``COLUMNS`` rows, features are dealt out in place of rows: each task of one barrier stage has some
features of all rows, counts these alone, and learns from the others (``allGather``) which split is best and, a bit for each row, which side of it rows are on. So rows are shuffled once and sums never, however many
trees and nodes there are. An ``allGather`` takes a second whatever it sends, so many trees grow side by side.

Bins are quantiles, ``BINS`` of them, in which equal values stay together; a null or NaN is a bin of its own, and each split sends it where the gain is greater.
"""

from __future__ import annotations

import base64
import pickle
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 32
SMALL = 16384
#: nodes that are aggregated at once, and features of a block
NODES, BLOCK = 512, 32
#: values of a feature that stand for more of them in a sketch of its quantiles
RANKS = 10_000
LOSSES = ("forest", "second_order", "squared", "quantile")
#: losses whose Hessian is 1; rounds after which their rows' residuals are made anew
SQUARES, KEPT = ("second_order", "squared"), 5
#: rows up to which such a model grows in one task, and rows that are counted at once there
WHOLE, PIECE = 65_536, 8192
#: times ``SMALL``: rows of a forest's node that is finished in one task, and rows of a forest whose trees are grown whole, some in each task
NODE_OF_FOREST, WHOLE_FOREST = 8, 12
#: rows up to which a forest's features are dealt out, so that a task holds a few dozen bytes of each; rows of all trees that grow side by side then, and such trees
COLUMNS, TOGETHER = 12_000_000, (84_000_000, 48)
#: share of a node's score up to which gains tie: what the rounding of sums can make of equal ones
_TIE = 1e-10


@dataclass(frozen=True)
class Spec:
    """A model to fit. ``features`` are places among the binned ones; ``setting`` says which rows it sees, ``held`` which group of them it doesn't.

    forest: means of bootstrap samples. second_order: squared error with the regularised gain and leaf weights -G / (H + l2). squared: the same without regularisation.
    quantile: gradients of the pinball loss, leaves set to the quantile ``alpha`` of their residuals.
    """

    name: str
    features: tuple[int, ...]
    loss: str = "forest"
    trees: int = 100
    depth: int = 12
    step: float = 1.0
    l2: float = 0.0
    gamma: float = 0.0
    least: float = 1.0
    alpha: float = 0.5
    setting: int = 0
    held: str | None = None
    seed: int = 42

    @property
    def boosted(self) -> bool:
        return self.loss != "forest"


@dataclass
class Tree:
    """Nodes in any order, the root first: the feature split at (-1: a leaf), the greatest bin that goes left, whether nulls go left, both children, value, gain and rows' weight."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for name, v in (("feature", -1), ("bin", 0), ("null_left", False), ("left", 0), ("right", 0), ("value", 0.0), ("gain", 0.0), ("cover", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int, null_left: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.null_left[node], self.gain[node] = int(feature), int(at), bool(null_left), float(gain)
        self.left[node], self.right[node] = self.add(), self.add()
        return self.left[node], self.right[node]

    def graft(self, node: int, other: Tree) -> None:
        """Puts ``other`` in the place of a leaf."""
        to = [node, *(self.add() for _ in range(len(other.feature) - 1))]
        for k, at in enumerate(to):
            for name in ("feature", "bin", "null_left", "value", "gain", "cover"):
                getattr(self, name)[at] = getattr(other, name)[k]
            self.left[at], self.right[at] = to[other.left[k]], to[other.right[k]]

    def arrays(self) -> Walk:
        kinds = (("feature", np.int16), ("bin", np.int16), ("null_left", bool), ("left", np.int32), ("right", np.int32), ("value", float))
        return Walk(*(np.array(getattr(self, n), kind) for n, kind in kinds))


@dataclass
class Walk:
    feature: np.ndarray
    bin: np.ndarray
    null_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins: all rows go down a level at a time."""
        at, live = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(live):
            live = live[self.feature[at[live]] >= 0]
            k = at[live]
            c = codes[live, self.feature[k]]
            at[live] = np.where(np.where(c == 0, self.null_left[k], c <= self.bin[k]), self.left[k], self.right[k])
        return at

    def parts(self, column, n: int):
        """(node, its rows, which of them go left) of n rows, parents first; of leaves the last is None. ``column`` gives the bins of some rows (None: all) by feature."""
        todo: list[tuple[int, np.ndarray | None]] = [(0, None)]
        while todo:
            node, i = todo.pop()
            f, rows = int(self.feature[node]), np.arange(n) if i is None else i
            if f < 0:
                yield node, rows, None
                continue
            c = column(f, i)
            low = c <= self.bin[node]
            low[c == 0] = self.null_left[node]
            yield node, rows, low
            todo += [(int(self.left[node]), rows[low]), (int(self.right[node]), rows[~low])]

    def leaves(self, codes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, or of the rows ``at``, of bins by feature."""
        n = codes.shape[1] if at is None else len(at)
        out = np.zeros(n, np.int64)
        for node, rows, low in self.parts(lambda f, i: codes[f] if i is None and at is None else codes[f][at if i is None else i if at is None else at[i]], n):
            if low is None:
                out[rows] = node
        return out

    def moved(self, codes: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, feature, change of the value) where a row that takes the bin of one feature from ``other`` ends in another leaf: only what lies below the first node where it turns off is walked again."""
        n = len(codes)
        own, gone, turned = np.zeros(n), {}, []
        for node, rows, low in self.parts(lambda f, i: codes[:, f] if i is None else codes[i, f], n):
            if low is None:
                own[rows] = self.value[node]
                continue
            f = int(self.feature[node])
            z = other[rows, f]
            new = z <= self.bin[node]
            new[z == 0] = self.null_left[node]
            off = gone.setdefault(f, np.zeros(n, bool))
            use = np.flatnonzero((new != low) & ~off[rows])
            off[rows[use]] = True
            turned.append((rows[use], np.full(len(use), f), np.where(new[use], self.left[node], self.right[node])))
        if not turned:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        rows, swapped, at = (np.concatenate(x) for x in zip(*turned, strict=True))
        live = np.arange(len(rows))
        while len(live):
            live = live[self.feature[at[live]] >= 0]
            k, i = at[live], rows[live]
            f = self.feature[k]
            c = np.where(f == swapped[live], other[i, f], codes[i, f])
            at[live] = np.where(np.where(c == 0, self.null_left[k], c <= self.bin[k]), self.left[k], self.right[k])
        return rows, swapped, self.value[at] - own[rows]


@dataclass
class Ensemble:
    """A fitted model: what it starts from, and its trees, which are averaged (forest) or added up."""

    spec: Spec
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    edges: list[np.ndarray] = field(default_factory=list)

    def each(self, codes: np.ndarray) -> np.ndarray:
        """A row for each tree."""
        return np.stack([w.value[w.nodes(codes)] for w in self.walks()]) if self.trees else np.zeros((0, len(codes)))

    def walks(self) -> list[Walk]:
        if len(getattr(self, "_walks", ())) != len(self.trees):
            self._walks = [t if isinstance(t, Walk) else t.arrays() for t in self.trees]
        return self._walks

    def light(self) -> Ensemble:
        """The same for tasks that only predict: a forest's trees as arrays are a tenth of its lists."""
        return replace(self, trees=self.walks())

    def of(self, codes: np.ndarray) -> np.ndarray:
        got = self.each(codes)
        if not len(got):
            return np.full(len(codes), self.base)
        return self.base + (got.sum(0) if self.spec.boosted else got.mean(0))

    def importances(self) -> dict[str, float]:
        """Each feature's share of the gain of all splits (forest: of each tree's, averaged)."""
        total = np.zeros(len(self.names))
        for t in self.trees:
            own = np.zeros(len(self.names))
            np.add.at(own, [f for f in t.feature if f >= 0], [g for f, g in zip(t.feature, t.gain, strict=True) if f >= 0])
            total += own if self.spec.boosted else own / max(own.sum(), 1e-300)
        total /= max(total.sum(), 1e-300)
        return {self.names[f]: float(total[f]) for f in self.spec.features}

    def packed(self) -> dict:
        return {"spec": {**self.spec.__dict__, "features": list(self.spec.features)}, "base": self.base, "trees": [{k: np.asarray(v).tolist() for k, v in t.__dict__.items()} for t in self.trees], "names": self.names, "edges": [list(map(float, e)) for e in self.edges]}

    @classmethod
    def unpacked(cls, d: dict) -> Ensemble:
        return cls(Spec(**{**d["spec"], "features": tuple(d["spec"]["features"])}), d["base"], [Tree(**t) for t in d["trees"]], d["names"], [np.array(e) for e in d["edges"]])


def _values(names: list[str]) -> list[Column]:
    return [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in names]


def _array(names: list[str]) -> Column:
    """All values, NaN where there is none; one expression, as a column for each takes seconds to make."""
    each = ("coalesce(cast(`" + c.replace("`", "``") + "` AS double), double('NaN'))" for c in names)
    return F.expr(f"array({', '.join(each)})")


def bin_edges(df: DataFrame, names: list[str], bins: int = BINS, exact: bool = False) -> dict[int, list[np.ndarray]]:
    """For each setting (a column of few ints) and feature, the greatest values of all bins but the last: from one aggregation of sketches, whose ranks are off by a ten-thousandth
    at most, or ``exact`` from a count of each value, in the ranges that the sketches cut, so that no feature is sorted in one task."""
    share = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    sketched: dict[int, dict] = {}
    for r in _sketches(df, names, bins).collect():  # a row for each setting and feature
        sketched.setdefault(r["setting"], {"setting": r["setting"], **dict.fromkeys(names)})[names[r["f"]]] = r["q"]
    got = list(sketched.values())
    if exact:
        return _exact_edges(df.select("setting", *_values(names)), names, bins, got)
    return {r["setting"]: [np.unique(np.array(r[c] or [], float)) for c in names] for r in got}


def _sketches(df: DataFrame, names: list[str], bins: int) -> DataFrame:
    """(setting, f, q): the quantiles of each feature, null without values. Of every ``RANKS`` to 3 ``RANKS`` values or so that a task has sorted, at most ``RANKS`` go on, each for those up to it."""
    rows = df.select("setting", _array(names).alias("x"))

    def points(setting: int, x: np.ndarray):
        out = []
        for k in range(x.shape[1]):
            v = np.sort(x[:, k])
            v = v[: len(v) - int(np.isnan(v).sum())]
            at = np.unique(np.linspace(0, len(v), min(len(v), RANKS) + 1).astype(np.int64)[1:])  # counts of values up to each that goes on
            out.append((v[at - 1].tobytes(), np.diff(at, prepend=0).astype(np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), setting), pa.int32()), pa.array(np.arange(len(out)), pa.int32()), pa.array([v for v, _ in out], pa.binary()), pa.array([n for _, n in out], pa.binary())], ["setting", "f", "v", "n"])

    def cut(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(names))
            setting = b.column("setting").to_numpy(zero_copy_only=False)
            for s in np.unique(setting):
                held.setdefault(int(s), []).append(x[setting == s])
                if sum(map(len, held[int(s)])) >= 2 * RANKS:
                    yield points(int(s), np.concatenate(held.pop(int(s))))
        for s, own in held.items():
            yield points(s, np.concatenate(own))

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v, n = (np.concatenate([np.frombuffer(b, t) for b in table.column(c).to_pylist()]) for c, t in (("v", np.float64), ("n", np.int32)))
        order = np.argsort(v, kind="stable")
        up = n[order].cumsum(dtype=np.int64)
        q = [v[order][np.searchsorted(up, -(-k * int(up[-1]) // bins), "left")] for k in range(1, bins)] if len(v) else None
        return pa.table({"setting": pa.array([key[0].as_py()], pa.int32()), "f": pa.array([key[1].as_py()], pa.int32()), "q": pa.array([q], pa.list_(pa.float64()))})

    cuts = rows.mapInArrow(cut, "setting int, f int, v binary, n binary")
    return cuts.repartition(max(1, 2 * df.sparkSession.sparkContext.defaultParallelism), "setting", "f").groupBy("setting", "f").applyInArrow(merged, "setting int, f int, q array<double>")


def _exact_edges(df: DataFrame, names: list[str], bins: int, sketched: list) -> dict[int, list[np.ndarray]]:
    """The least values that at least k / ``bins`` of the rows don't exceed."""
    cuts = df.sparkSession.createDataFrame([(r["setting"], k, r[c] or []) for r in sketched for k, c in enumerate(names)], "setting int, f int, cuts array<double>")
    each = df.select("setting", F.posexplode(F.array(*names)).alias("f", "v")).where("v is not null").join(F.broadcast(cuts), ["setting", "f"])
    counts = each.groupBy("setting", "f", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"), "v").agg(F.count("*").alias("c")).persist()
    parts = counts.groupBy("setting", "f", "part").agg(F.sum("c").alias("c"))
    w = W.partitionBy("setting", "f")  # a row for each range
    before = parts.select("setting", "f", "part", (F.sum("c").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")).alias("before"), F.sum("c").over(w).alias("n"))
    up = F.sum("c").over(W.partitionBy("setting", "f", "part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before")
    ranked = counts.join(before, ["setting", "f", "part"]).select("setting", "f", "v", "n", up.alias("up"), (up - F.col("c")).alias("below"))
    reached = F.exists(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: (F.col("up") * bins >= k * F.col("n")) & (F.col("below") * bins < k * F.col("n")))
    out = {r["setting"]: [np.zeros(0)] * len(names) for r in sketched}
    for r in ranked.where(reached).groupBy("setting", "f").agg(F.array_sort(F.collect_list("v")).alias("e")).collect():  # at most a value for each bin
        out[r["setting"]][r["f"]] = np.array(r["e"])
    counts.unpersist()
    return out


def codes_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins from 1 on of values, in columns; 0 of NaN."""
    out = np.zeros(x.shape, np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(e, x[:, k], "left"))
    return out


def binned(df: DataFrame, names: list[str], edges: dict[int, list[np.ndarray]], group: str | None = None, keys: tuple[str, ...] = ("drive_id", "rn")) -> DataFrame:
    """(keys, setting, grp, y, k, b): a row's bins as bytes, and a hash of its keys, by which bootstrap samples are drawn."""
    rows = df.select(*keys, "setting", (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"), F.col("y").cast("double").alias("y"), F.xxhash64(*keys, "setting").alias("k"), _array(names).alias("x"))

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(names))
            setting, codes = b.column("setting").to_numpy(zero_copy_only=False), np.zeros(x.shape, np.uint8)
            for s in np.unique(setting):
                codes[setting == s] = codes_of(x[setting == s], edges[int(s)])
            at = b.schema.get_field_index("x")
            yield b.remove_column(at).append_column("b", pa.array([r.tobytes() for r in codes], pa.binary()))

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x")
    return rows.mapInArrow(run, f"{kept}, b binary")


def _weights(k: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample: a Poisson number by a hash of the row and the tree."""
    x = k.astype(np.uint64) ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    u = (x ^ (x >> np.uint64(33))) / 2.0**64
    return np.searchsorted(_POISSON, u, "right").astype(float)


_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


class _Rows:
    """A task's rows as arrays, and what each model makes of them."""

    def __init__(self, b: pa.RecordBatch):
        self.n = b.num_rows
        self.codes = np.frombuffer(b"".join(b.column("b").to_pylist()), np.uint8).reshape(self.n, -1)
        self.y, self.k = b.column("y").to_numpy(zero_copy_only=False), b.column("k").to_numpy(zero_copy_only=False)
        self.setting, self.grp = b.column("setting").to_numpy(zero_copy_only=False), np.array(b.column("grp").to_pylist(), object)
        self._made: dict = {}

    def seen(self, s: Spec) -> np.ndarray:
        own = (self.setting == s.setting) & ~np.isnan(self.y)
        return np.flatnonzero(own & (self.grp != s.held) if s.held is not None else own)

    def targets(self, i: int, m: Ensemble, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows that count, their gradients, Hessians and residuals."""
        s = m.spec
        rows = self.seen(s)
        if not s.boosted:
            w = _weights(self.k[rows], tree, s.seed)
            rows, w = rows[w > 0], w[w > 0]
            return rows, -w * self.y[rows], w, self.y[rows]
        if i not in self._made:
            self._made[i] = self.y[rows] - m.of(self.codes[rows])
        r = self._made[i]
        return rows, (np.where(r < 0, 1.0, 0.0) - s.alpha if s.loss == "quantile" else -r), np.ones(len(rows)), r


def best_splits(hist: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, ...]:
    """Of histograms (nodes, features, 1 + bins, [G, H, n]): gain, feature, bin, nulls left, and G, H, n of the left side, for each node's best split."""
    gain, f, at, null_left = _splits(np.ascontiguousarray(hist[..., 0]), np.ascontiguousarray(hist[..., 1]), l2, least)
    own = hist[np.arange(len(hist)), f]
    low = own[:, 1:].cumsum(1)[np.arange(len(hist)), at - 1]
    return gain, f, at, null_left, np.where(null_left[:, None], low + own[:, 0], low)


def _splits(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, ...]:
    """Gain, feature, bin and nulls left of each node's best split, the first of those that tie, of gradients and Hessians (nodes, features, 1 + bins). A row's Hessian is at least 1, so where there are rows there is one."""
    total_g, total_h = (x[:, 0].cumsum(1)[:, -1:, None] for x in (g, h))
    none = total_g**2 / np.maximum(total_h + l2, 1e-300)
    down_g, down_h = g[:, :, 1:-1].cumsum(2), h[:, :, 1:-1].cumsum(2)
    best = None
    with np.errstate(divide="ignore", invalid="ignore"):  # sides without rows don't count
        for null_left in (False, True) if h[:, :, 0].any() else (False,):
            low_g, low_h = (down_g + g[:, :, :1], down_h + h[:, :, :1]) if null_left else (down_g, down_h)
            high_g, high_h = total_g - low_g, total_h - low_h
            poor = np.minimum(low_h, high_h) < max(least, 1e-9)
            gain = low_g * low_g
            gain /= low_h + l2 if l2 else low_h
            high_g *= high_g
            high_g /= np.add(high_h, l2, out=high_h) if l2 else high_h
            gain += high_g
            gain -= none
            gain /= 2
            gain[poor] = -np.inf
            flat = gain.reshape(len(g), -1)
            top = flat.max(1)
            k = (flat >= (top - _TIE * (np.abs(top) + none[:, 0, 0]))[:, None]).argmax(1)
            new = (flat[np.arange(len(g)), k], k // gain.shape[2], k % gain.shape[2] + 1, np.full(len(g), null_left))
            best = new if best is None else tuple(np.where(new[0] > best[0] + _TIE * (np.abs(best[0]) + none[:, 0, 0]), x, y) for x, y in zip(new, best, strict=True))
    return best


def _histograms(codes: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, bins: int) -> np.ndarray:
    out, base = np.empty((slots, codes.shape[1], bins, 3)), slot * bins
    for f, c in enumerate(codes.T):
        cell = base + c
        for k, weights in enumerate((g, h, None)):
            out[:, f, :, k] = np.bincount(cell, weights, slots * bins).reshape(slots, bins)
    return out


#: cells of histograms whose splits are judged at once, so that they stay in a core's cache; cells that are counted at once; and cells that are kept for the level below
_CELLS, _COUNTED, _PARENTS = 30_000, 2_000_000, 8_000_000


def _runs(n: int, cells: int, most: int):
    """Runs of n things of so many cells, of about ``most`` cells or of single things."""
    step = max(1, most // max(cells, 1))
    return [(k, min(k + step, n)) for k in range(0, n, step)]


def _leaf(s: Spec, g: float, h: float, residuals: np.ndarray | None = None) -> float:
    if s.loss == "quantile":
        return s.step * float(np.quantile(residuals, s.alpha, method="inverted_cdf")) if residuals is not None and len(residuals) else 0.0
    return -s.step * g / (h + s.l2) if h + s.l2 > 0 else 0.0


def _added_up(by_feature: np.ndarray, rows: list[np.ndarray], g: np.ndarray, h: np.ndarray | None, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and Hessians (None: all 1) by node, feature and bin, of nodes with these rows."""
    own, place = np.concatenate(rows), np.repeat(np.arange(len(rows)) * bins, [len(i) for i in rows])
    size, shape = len(rows) * bins, (len(rows), bins)
    sums = tuple(np.empty((len(rows), len(by_feature), bins)) for _ in range(2))
    g, h = g[own], None if h is None else h[own]
    for f, c in enumerate(by_feature):
        cell = place + c[own]
        sums[0][:, f] = np.bincount(cell, g, size).reshape(shape)
        sums[1][:, f] = np.bincount(cell, h, size).reshape(shape)
    return sums


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, r: np.ndarray, depth: int, s: Spec, bins: int) -> Tree:
    """A whole subtree, level by level; ``codes`` has the model's own features only.

    Of two nodes with one parent only the one with fewer rows is counted; the other's sums are what is left of the parent's, while a level's sums are at most ``_PARENTS`` cells.
    """
    tree = Tree()
    by_feature, cells = np.ascontiguousarray(codes.T), codes.shape[1] * bins
    weights = None if (h == 1).all() else h
    level, rows = [0], [np.arange(len(codes))]
    parents: list | None = None  # for each pair of nodes their parent's sums; the root has none
    for left in range(depth, -1, -1):
        each, size = np.concatenate(rows), np.array([len(i) for i in rows])
        first = np.cumsum(size) - size
        weight = np.add.reduceat(h[each], first)
        for node, i, t in zip(level, rows, weight.tolist(), strict=True):
            tree.cover[node], tree.value[node] = t, _leaf(s, float(g[i].sum()), t, r[i])
        if not left:
            break
        spread = np.maximum.reduceat(r[each], first) > np.minimum.reduceat(r[each], first)
        open_ = (size > 1) & (weight >= 2 * s.least) & spread
        keep = left > 1 and len(level) * cells <= _PARENTS
        nxt, below, kept = [], [], []
        pairs = [(j,) for j in range(len(level))] if parents is None else [(j, j + 1) for j in range(0, len(level), 2)]
        pairs = [p for p in pairs if open_[list(p)].any()]
        for k, until in _runs(len(pairs), 2 * cells, _COUNTED):
            part = pairs[k:until]
            least = [min(p, key=lambda j: size[j]) for p in part]
            sums = _added_up(by_feature, [rows[j] for j in least], g, weights, bins)
            nodes, where = [], []  # nodes to split, and for each the place of its pair and whether its sums are the counted ones
            for at, (p, few) in enumerate(zip(part, least, strict=True)):
                for j in p:
                    if open_[j]:
                        nodes.append(j)
                        where.append((at, j == few))
            for a, z in _runs(len(nodes), cells, _CELLS):
                hist = [np.stack([one[at] if counted else parents[part[at][0] // 2][c] - one[at] for at, counted in where[a:z]]) for c, one in enumerate(sums)]
                for q, j, gain, f, b, null_left in zip(range(z - a), nodes[a:z], *(x.tolist() for x in _splits(*hist, s.l2, s.least)), strict=True):
                    if gain <= max(s.gamma, 1e-12):
                        continue
                    i = rows[j]
                    nxt += tree.split(level[j], s.features[f], b, null_left, gain)
                    c = by_feature[f][i]
                    low = np.where(c == 0, null_left, c <= b)
                    below += [i[low], i[~low]]
                    if keep:
                        kept.append((hist[0][q].copy(), hist[1][q].copy()))
        level, rows, parents = nxt, below, kept if keep else None
        if not level:
            break
    return tree


def _sums(data: DataFrame, sent, nodes: list[tuple[int, int]], bins: int, make, schema: str) -> DataFrame:
    """What ``make`` gives of the histograms (node, block of features, array) of ``nodes`` (place in the trees sent, node), each added up over all rows."""
    by_tree: dict[int, list[int]] = {}
    for j, (q, _) in enumerate(nodes):
        by_tree.setdefault(q, []).append(j)
    names = ["node", "block", "h"]

    def count(batches):
        models, trees = sent.value
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            rows = _Rows(b)
            for q, own in by_tree.items():
                i, t, walk = trees[q]
                at, g, h, _ = rows.targets(i, models[i], t)
                leaf = walk.nodes(rows.codes[at])
                slot = np.full(len(walk.feature), -1)
                slot[[nodes[j][1] for j in own]] = np.arange(len(own))
                use = np.flatnonzero(slot[leaf] >= 0)
                f = np.array(models[i].spec.features)
                codes = np.ascontiguousarray(rows.codes[np.ix_(at[use], f)].T)
                for k in range(0, len(f) if len(use) else 0, BLOCK):
                    got = _histograms(codes[k : k + BLOCK].T, slot[leaf[use]], g[use], h[use], len(own), bins)
                    for j, x in zip(own, got, strict=True):
                        if x[..., 2].any():
                            key = (j, k // BLOCK)
                            held[key] = held[key] + x if key in held else x
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], names)

    def add_up(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for j, k, h in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                x = np.frombuffer(h).reshape(-1, bins, 3)
                held[j, k] = held[j, k] + x if (j, k) in held else x
        yield make(held)

    return data.mapInArrow(count, "node int, block int, h binary").repartition("node", "block").mapInArrow(add_up, schema)


def histograms(data: DataFrame, m: Ensemble) -> DataFrame:
    """(node, feature, bin, g, h, n) of the next tree's root, by feature name, for the model so far."""
    sent = data.sparkSession.sparkContext.broadcast(([m], [(0, len(m.trees), Tree().arrays())]))
    names = [m.names[f] for f in m.spec.features]

    def rows(held):
        out = [(j, names[k * BLOCK + f], b, *map(float, x[f, b])) for (j, k), x in held.items() for f, b in zip(*np.nonzero(x[..., 2]), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), *[pa.float64()] * 3), strict=True)], ["node", "feature", "bin", "g", "h", "n"])

    return _sums(data, sent, [(0, 0)], 2 + max(len(e) for e in m.edges), rows, "node int, feature string, bin int, g double, h double, n double")


def _big_nodes(data: DataFrame, models: list[Ensemble], grown: list[tuple[int, int, Tree]], nodes: list[tuple[int, int]], bins: int) -> pd.DataFrame:
    """For each of ``nodes`` (place in ``grown``, node) its sums and the best split of each block of features."""
    sent = data.sparkSession.sparkContext.broadcast((models, [(i, t, tree.arrays()) for i, t, tree in grown]))
    out = ["node", "block", "gain", "feature", "bin", "null_left", "g", "h", "n", "gl", "hl", "nl"]
    kind = pa.schema([("node", pa.int32()), ("block", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()), ("null_left", pa.bool_()), *[(c, pa.float64()) for c in out[6:]]])

    def choose(held):
        models, trees = sent.value
        rows = []
        for (j, k), x in held.items():
            s = models[trees[nodes[j][0]][0]].spec
            gain, f, at, null_left, low = best_splits(x[None], s.l2, s.least)
            rows.append((j, k, float(gain[0]), int(f[0]) + k * BLOCK, int(at[0]), bool(null_left[0]), *map(float, x[0].sum(0)), *map(float, low[0])))
        return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=out), schema=kind, preserve_index=False)

    schema = "node int, block int, gain double, feature int, bin int, null_left boolean, " + ", ".join(f"{c} double" for c in out[6:])
    return _sums(data, sent, nodes, bins, choose, schema).toPandas()  # a row for each node and block of features


def _small_nodes(data: DataFrame, models: list[Ensemble], grown: list[tuple[int, int, Tree]], nodes: list[tuple[int, int, int]], bins: int) -> dict[int, Tree]:
    """The finished subtrees of ``nodes`` (place in ``grown``, node, levels left), each made in one task."""
    sent = data.sparkSession.sparkContext.broadcast((models, [(i, t, tree.arrays()) for i, t, tree in grown]))
    by_tree: dict[int, list[int]] = {}
    for j, (q, _, _) in enumerate(nodes):
        by_tree.setdefault(q, []).append(j)
    names = ["node", "b", "g", "h", "r"]

    def deal(batches):
        models, trees = sent.value
        for b in batches:
            rows = _Rows(b)
            for q, own in by_tree.items():
                i, t, walk = trees[q]
                at, g, h, r = rows.targets(i, models[i], t)
                to = np.full(len(walk.feature), -1)
                to[[nodes[j][1] for j in own]] = own
                leaf = to[walk.nodes(rows.codes[at])]
                use = np.flatnonzero(leaf >= 0)
                if len(use):
                    c = np.ascontiguousarray(rows.codes[at[use]][:, np.array(models[i].spec.features)])
                    size = c.shape[1]
                    whole = pa.py_buffer(c.tobytes())
                    blobs = pa.Array.from_buffers(pa.binary(), len(use), [None, pa.py_buffer((np.arange(len(use) + 1) * size).astype(np.int32).tobytes()), whole])
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[use], pa.int32()), blobs, *(pa.array(v[use]) for v in (g, h, r))], names)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        models, trees = sent.value
        j = int(pdf["node"].iloc[0])
        g, h, r = (pdf[c].to_numpy() for c in ("g", "h", "r"))
        order = np.lexsort((g, r))  # sums don't hang on the order in which rows came: those that are left in it have the same gradient
        codes = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(pdf), -1)[order]
        tree = grow(codes, g[order], h[order], r[order], nodes[j][2], models[trees[nodes[j][0]][0]].spec, bins)
        return pd.DataFrame({"node": [j], **{k: [np.array(v, float)] for k, v in tree.__dict__.items()}})

    cols = list(Tree().__dict__)
    parts = max(1, min(len(nodes), 2 * data.sparkSession.sparkContext.defaultParallelism))
    dealt = data.mapInArrow(deal, "node int, b binary, g double, h double, r double").repartition(parts, "node")
    got = dealt.groupBy("node").applyInPandas(finish, "node int, " + ", ".join(f"{c} array<double>" for c in cols)).collect()  # the trees
    kinds = {"feature": int, "bin": int, "null_left": bool, "left": int, "right": int}
    return {r["node"]: Tree(**{c: [kinds.get(c, float)(v) for v in r[c]] for c in cols}) for r in got}


def _round(data: DataFrame, models: list[Ensemble], grown: list[tuple[int, int, Tree]], counts: list[int], bins: int) -> None:
    """Grows all trees of ``grown`` (place of the model, number of the tree, an empty tree); ``counts`` are the rows that each sees."""
    few = [SMALL * (1 if models[i].spec.boosted else NODE_OF_FOREST) for i, _, _ in grown]
    big = [(q, 0, models[i].spec.depth) for q, (i, _, _) in enumerate(grown) if counts[q] > few[q]]
    small = [(q, 0, models[i].spec.depth) for q, (i, _, _) in enumerate(grown) if 0 < counts[q] <= few[q]]
    leaves: list[tuple[int, int]] = []
    while big:
        nxt = []
        for k in range(0, len(big), NODES):
            part = big[k : k + NODES]
            got = _big_nodes(data, models, grown, [(q, node) for q, node, _ in part], bins)
            top, none = got.groupby("node")["gain"].transform("max"), got["g"] ** 2 / np.maximum(got["h"], 1e-300)
            got = got[got["gain"] >= top - _TIE * (top.abs() + none)].sort_values(["node", "feature"]).drop_duplicates("node")
            for r in got.itertuples():
                q, node, left = part[r.node]
                tree, s = grown[q][2], models[grown[q][0]].spec
                tree.cover[node], tree.value[node] = r.h, _leaf(s, r.g, r.h)
                if r.gain <= max(s.gamma, 1e-12):
                    leaves.append((q, node))
                    continue
                for child, gs, hs, n in zip(tree.split(node, s.features[r.feature], r.bin, r.null_left, r.gain), (r.gl, r.g - r.gl), (r.hl, r.h - r.hl), (r.nl, r.n - r.nl), strict=True):
                    tree.cover[child], tree.value[child] = hs, _leaf(s, gs, hs)
                    if left == 1:
                        leaves.append((q, child))
                    else:
                        (small if n <= few[q] else nxt).append((q, child, left - 1))
        big = nxt
    if small:
        for j, sub in _small_nodes(data, models, grown, small, bins).items():
            grown[small[j][0]][2].graft(small[j][1], sub)
    wanted = [(q, node) for q, node in leaves if models[grown[q][0]].spec.loss == "quantile"]
    if wanted:
        _leaf_quantiles(data, models, grown, wanted)


def _leaf_quantiles(data: DataFrame, models: list[Ensemble], grown: list[tuple[int, int, Tree]], leaves: list[tuple[int, int]]) -> None:
    """Leaves with many rows are set to quantiles of their residuals from mergeable sketches."""
    sent = data.sparkSession.sparkContext.broadcast((models, [(i, t, tree.arrays()) for i, t, tree in grown]))
    place = {key: j for j, key in enumerate(leaves)}

    def residuals(batches):
        models, trees = sent.value
        for b in batches:
            rows = _Rows(b)
            for q in {q for q, _ in leaves}:
                i, t, walk = trees[q]
                at, _, _, r = rows.targets(i, models[i], t)
                leaf = np.array([place.get((q, n), -1) for n in range(len(walk.feature))])[walk.nodes(rows.codes[at])]
                use = leaf >= 0
                yield pa.RecordBatch.from_arrays([pa.array(leaf[use], pa.int32()), pa.array(r[use])], ["leaf", "r"])

    shares = sorted({models[grown[q][0]].spec.alpha for q, _ in leaves})
    got = data.mapInArrow(residuals, "leaf int, r double").groupBy("leaf").agg(F.percentile_approx("r", F.array(*map(F.lit, shares)), 10000).alias("v")).collect()  # a row for each leaf
    for r in got:
        q, node = leaves[r["leaf"]]
        s = models[grown[q][0]].spec
        grown[q][2].value[node] = s.step * float(r["v"][shares.index(s.alpha)])


def _packed(data: DataFrame, models: list[Ensemble], apart: bool) -> RDD:
    """The rows of ``binned`` as pieces, a batch each: bins by feature, and for each model its rows' places (None: all) and residuals. ``apart``: (model, (its rows' bins, residuals and hashes)) instead."""

    def pack(batches):
        for b in batches:
            rows, own = _Rows(b), []
            for i, m in enumerate(models):
                at = rows.seen(m.spec)
                if apart and len(at):
                    own.append((i, pickle.dumps((rows.codes[np.ix_(at, np.array(m.spec.features))], rows.y[at] - m.base, rows.k[at]), 5)))
                elif not apart:
                    own.append((None if len(at) == rows.n else at, rows.y[at] - m.base))
            if not apart:
                own = [(0, pickle.dumps((np.ascontiguousarray(rows.codes.T), own), 5))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], ["model", "piece"])

    return data.mapInArrow(pack, "model int, piece binary").rdd


def _after(piece: tuple, since: list[list[Walk]]) -> tuple:
    """A piece whose residuals are those after the trees of ``since``."""
    codes, own = piece
    done = []
    for (at, r), walks in zip(own, since, strict=True):
        for w in walks:
            r = r - w.value[w.leaves(codes, at)]
        done.append((at, r))
    return codes, done


#: a model, its next tree so far, the open nodes of a level; and of each node None, or the place of its parent among the nodes of the level above and that of its sibling, where its sums are what the sibling leaves of the parent's
_Open = tuple[int, Walk, list[int], list[tuple[int, int] | None]]
_Sums = tuple[np.ndarray, np.ndarray]


def _counted(pieces, since: list[list[Walk]], open_: list[_Open], specs: list[Spec], bins: int) -> dict[tuple[int, int], _Sums]:
    """Sums of gradients, and rows, by feature, node and bin, of the nodes that are to be counted, for each place in ``open_`` and block of features."""
    total: dict[tuple[int, int], _Sums] = {}
    for piece in pieces:
        codes, own = _after(piece, since)
        for q, (i, walk, nodes, rest) in enumerate(open_):
            at, r = own[i]
            slot = np.full(len(walk.feature), -1)
            count = [n for n, x in zip(nodes, rest, strict=True) if x is None]
            slot[count] = np.arange(len(count))
            node = slot[walk.leaves(codes, at)]
            use = np.flatnonzero(node >= 0)
            if not len(use):
                continue
            if len(use) < len(node):
                node, r, at = node[use], r[use], use if at is None else at[use]
            base, size, g = node * bins, len(count) * bins, -r
            for k in range(0, len(specs[i].features), BLOCK):
                block = specs[i].features[k : k + BLOCK]
                if (q, k) not in total:
                    total[q, k] = np.zeros((len(block), size)), np.zeros((len(block), size), np.int64)
                sums, rows = total[q, k]
                for j, f in enumerate(block):
                    cell = base + (codes[f] if at is None else codes[f][at])
                    sums[j] += np.bincount(cell, g, size)
                    rows[j] += np.bincount(cell, minlength=size)
    return total


def _completed(sums: _Sums, above: _Sums | None, rest: list[tuple[int, int] | None], bins: int) -> _Sums:
    """Sums of all nodes, from those of the counted ones and of the level above."""
    if above is None or not any(rest):
        return sums
    counted = [j for j, x in enumerate(rest) if x is None]
    out = []
    for one, old in zip(sums, above, strict=True):
        own, old = one.reshape(len(one), -1, bins), old.reshape(len(one), -1, bins)
        new = np.empty((len(one), len(rest), bins), one.dtype)
        new[:, counted] = own
        for j, x in enumerate(rest):
            if x:
                new[:, j] = old[:, x[0]] - new[:, x[1]]
        out.append(new.reshape(len(one), -1))
    return out[0], out[1]


def _chosen(q: int, k: int, sums: np.ndarray, rows: np.ndarray, open_: list[_Open], specs: list[Spec], bins: int):
    """Of a block's sums ((place, node), best split) for nodes with rows: gain, feature, bin, nulls left, gradients and rows of the node and of its left side. A row's Hessian is 1."""
    i, _, nodes, _ = open_[q]
    g, n = (x.astype(float).reshape(-1, len(nodes), bins).transpose(1, 0, 2) for x in (sums, rows))
    hist = np.stack([g, n, n], -1)
    gain, f, at, null_left, low = best_splits(hist, specs[i].l2, specs[i].least)
    whole = hist[:, 0].sum(1)
    for j in np.flatnonzero(whole[:, 2]):
        yield (q, nodes[j]), (float(gain[j]), int(f[j]) + k, int(at[j]), bool(null_left[j]), *map(float, (*whole[j, :2], *low[j, :2])))


def _level(pieces: RDD, since: list[list[Walk]], open_: list[_Open], specs: list[Spec], bins: int, above: RDD | None) -> tuple[list, RDD]:
    """The best splits of all blocks, and the blocks' sums: tasks' sums of a block meet in one task, which adds them in the order of the tasks. ``above`` are the sums of the level above, None without nodes that need them."""
    blocks = [(i, k) for i, s in enumerate(specs) for k in range(0, len(s.features), BLOCK)]
    place = {i: q for q, (i, _, _, _) in enumerate(open_)}

    def count(part: int, own):
        for (q, k), (sums, rows) in _counted(own, since, open_, specs, bins).items():
            yield blocks.index((open_[q][0], k)), (part, sums, rows.astype(np.int32))

    def add_up(got):
        held: dict[int, list] = {}
        for b, x in got:
            held.setdefault(b, []).append(x)
        for b, parts in held.items():
            parts.sort(key=lambda x: x[0])
            new, old = [p for p in parts if p[0] >= 0], [p[1:] for p in parts if p[0] < 0]
            if new:
                sums = _completed((sum(p[1] for p in new), sum(p[2] for p in new)), old[0] if old else None, open_[place[blocks[b][0]]][3], bins)
                yield b, (-1, *sums)

    def choose(got):
        for b, (_, sums, rows) in got:
            i, k = blocks[b]
            yield from _chosen(place[i], k, sums, rows, open_, specs, bins)

    tasks = min(len(blocks), pieces.getNumPartitions())
    parts = pieces.mapPartitionsWithIndex(count)
    summed = (parts if above is None else parts.union(above)).partitionBy(tasks, lambda b: b).mapPartitions(add_up).persist(StorageLevel.MEMORY_AND_DISK)
    return summed.mapPartitions(choose).collect(), summed  # a row for each node and block of features


def _rest(tree: Tree, nodes: list[int], above: list[int] | None) -> list[tuple[int, int] | None]:
    """For each of a level's nodes None if it is to be counted, or else the places of its parent among ``above`` and of its sibling."""
    rest: list[tuple[int, int] | None] = [None] * len(nodes)
    at = {node: j for j, node in enumerate(nodes)}
    for p, parent in enumerate(above or ()):
        if tree.feature[parent] >= 0 and tree.left[parent] in at:
            a, b = at[tree.left[parent]], at[tree.right[parent]]
            few, many = (a, b) if tree.cover[nodes[a]] <= tree.cover[nodes[b]] else (b, a)
            rest[many] = p, few
    return rest


def _rounds(specs: list[Spec], level, taken_in) -> list[list[Tree]]:
    """All trees of boosted models of squared error. ``level`` gives best splits of nodes after the trees since rows last took trees in, which ``taken_in`` makes them do.

    Of two nodes with one parent only the one with fewer rows is counted, where both levels are done at once: ``level`` keeps the sums of its last call.
    """
    most = max(2, NODES - NODES % 2)
    trees: list[list[Tree]] = [[] for _ in specs]
    since: list[list[Walk]] = [[] for _ in specs]
    for t in range(max(s.trees for s in specs)):
        if t and t % KEPT == 0:
            taken_in(since)
            since = [[] for _ in specs]
        grown = {i: Tree() for i, s in enumerate(specs) if t < s.trees}
        nodes, above = [(i, 0, specs[i].depth) for i in grown], {}
        while nodes:
            nxt = []
            for k in range(0, len(nodes), most):
                left_of = {(i, node): left for i, node, left in nodes[k : k + most]}
                by_model = {i: [node for j, node in left_of if j == i] for i in sorted({i for i, _ in left_of})}
                open_ = [(i, grown[i].arrays(), own, _rest(grown[i], own, above.get(i) if len(nodes) <= most else None)) for i, own in by_model.items()]
                best: dict[tuple[int, int], tuple] = {}
                for key, x in level(since, open_):
                    if key not in best or (x[0], -x[1]) > (best[key][0], -best[key][1]):
                        best[key] = x
                for (q, node), (gain, f, at, null_left, g, h, gl, hl) in sorted(best.items()):
                    i = open_[q][0]
                    tree, s, left = grown[i], specs[i], left_of[i, node]
                    tree.cover[node], tree.value[node] = h, _leaf(s, g, h)
                    if not left or gain <= max(s.gamma, 1e-12):
                        continue
                    for child, gs, hs in zip(tree.split(node, s.features[f], at, null_left, gain), (gl, g - gl), (hl, h - hl), strict=True):
                        tree.cover[child], tree.value[child] = hs, _leaf(s, gs, hs)
                        if left > 1:
                            nxt.append((i, child, left - 1))
            above = by_model if len(nodes) <= most else {}
            nodes = nxt
        for i, tree in grown.items():
            trees[i].append(tree)
            since[i].append(tree.arrays())
    return trees


def _boost(data: DataFrame, models: list[Ensemble], bins: int) -> None:
    """Adds all trees to boosted models of squared error, in jobs of a level each, over pieces that are kept with their residuals."""
    specs, held, old, above = [m.spec for m in models], [], [], []
    held.append(_packed(data, models, False).coalesce(data.sparkSession.sparkContext.defaultParallelism).map(lambda r: pickle.loads(r[1])).persist(StorageLevel.MEMORY_AND_DISK))

    def level(since, open_):
        got, sums = _level(held[0], since, open_, specs, bins, above[0] if any(x for *_, rest in open_ for x in rest) else None)
        above.append(sums)
        while len(above) > 1:
            above.pop(0).unpersist()
        while old:
            old.pop().unpersist()  # what took its place is there now
        return got

    def taken_in(since):
        old.append(held.pop())
        held.append(old[0].map(partial(_after, since=since)).persist(StorageLevel.MEMORY_AND_DISK))

    for m, grown in zip(models, _rounds(specs, level, taken_in), strict=True):
        m.trees.extend(grown)
    held[0].unpersist()
    for sums in above:
        sums.unpersist()


def _boost_apart(data: DataFrame, models: list[Ensemble], bins: int) -> None:
    """Adds all trees to boosted models of squared error with at most ``WHOLE`` rows, a task for each: the same levels, without a job for each of them."""
    specs = [m.spec for m in models]

    def run(i: int, got):
        blobs = [pickle.loads(b) for _, b in got]
        codes, r, k = (np.concatenate([b[c] for b in blobs]) for c in range(3))
        order = np.lexsort((*codes.T[::-1], r, k)) if len(np.unique(k)) < len(k) else np.argsort(k)  # sums don't hang on the order in which rows came
        own = [replace(specs[i], features=tuple(range(codes.shape[1])))]
        held = [(np.ascontiguousarray(codes[order[a : a + PIECE]].T), [(None, r[order[a : a + PIECE]])]) for a in range(0, len(r), PIECE)]

        above: dict[int, _Sums] = {}

        def level(since, open_):
            for (q, b), sums in _counted(held, since, open_, own, bins).items():
                above[b] = _completed(sums, above.get(b), open_[q][3], bins)
                yield from _chosen(q, b, *above[b], open_, own, bins)

        def taken_in(since):
            held[:] = [_after(p, since) for p in held]

        for t in _rounds(own, level, taken_in)[0]:
            t.feature = [specs[i].features[f] if f >= 0 else -1 for f in t.feature]
            yield i, t

    dealt = _packed(data, models, True).map(lambda r: (r[0], bytes(r[1]))).partitionBy(len(models), lambda i: i)
    for i, t in dealt.mapPartitionsWithIndex(run).collect():  # the trees, in their order
        models[i].trees.append(t)


def _forests_apart(data: DataFrame, models: list[Ensemble], bins: int) -> None:
    """Adds all trees to forests of at most ``WHOLE_FOREST`` times ``SMALL`` rows: a task has all rows of a forest and grows some of its trees."""
    specs = [m.spec for m in models]
    each = -(-4 * data.sparkSession.sparkContext.defaultParallelism // len(models))
    tasks = [(i, range(k, s.trees, min(each, s.trees))) for i, s in enumerate(specs) for k in range(min(each, s.trees))]
    to = [[q for q, (i, _) in enumerate(tasks) if i == own] for own in range(len(models))]

    def run(q: int, got):
        i, numbers = tasks[q]
        blobs = [pickle.loads(b) for _, b in got]
        codes, y, k = (np.concatenate([b[c] for b in blobs]) for c in range(3))
        del blobs
        order = np.lexsort((y, k))  # sums don't hang on the order in which rows came
        y, k = y[order], k[order]
        own = replace(specs[i], features=tuple(range(codes.shape[1])))
        for t in numbers:
            w = _weights(k, t, own.seed)
            at = np.flatnonzero(w)
            tree = grow(codes[order[at]], -w[at] * y[at], w[at], y[at], own.depth, own, bins) if len(at) else Tree()
            tree.feature = [specs[i].features[f] if f >= 0 else -1 for f in tree.feature]
            yield i, t, tree

    dealt = _packed(data, models, True).flatMap(lambda r: [(q, bytes(r[1])) for q in to[r[0]]]).partitionBy(len(tasks), lambda q: q)
    for i, _, tree in sorted(dealt.mapPartitionsWithIndex(run).collect(), key=lambda x: x[:2]):  # the trees
        models[i].trees.append(tree)

class _Growing:
    """A forest's tree that all tasks grow alike, each from its features: ``at`` are its rows, ``w`` how often they are in its sample, ``y`` the targets of all rows."""

    def __init__(self, spec: Spec, y: np.ndarray, at: np.ndarray, w: np.ndarray):
        self.spec, self.y, self.at, self.w = spec, y, at.astype(np.int32), w.astype(np.uint8)
        self.slot = np.zeros(len(at), np.uint16 if spec.depth < 16 else np.int32)  # the node of the level that a row is in
        self.levels: list[dict[str, np.ndarray]] = []
        self.nodes, self.first = 1, 0  # nodes of this level, and the number of the first
        self.sums: list | None = None  # of the level's nodes, and of their parents
        self.parents: list | None = None

    def weigh(self, left: int) -> bool:
        """Takes down the nodes of a level; False if none can be split."""
        n, s, slot, y = self.nodes, self.spec, self.slot.astype(np.int64), self.y[self.at]
        self.size, self.total, self.weight = np.bincount(slot, minlength=n), np.bincount(slot, -(self.w * y), n), np.bincount(slot, self.w, n)
        below = self.weight + s.l2
        kinds = (("feature", np.int16), ("bin", np.int16), ("null_left", bool), ("left", np.int32), ("right", np.int32), ("gain", float))
        self.levels.append({c: np.zeros(n, kind) for c, kind in kinds} | {"value": -s.step * self.total / np.where(below > 0, below, 1.0), "cover": self.weight})
        self.levels[-1]["feature"] -= 1
        open_ = (self.size > 1) & (self.weight >= 2 * s.least) if left else np.zeros(n, bool)
        if left:
            one = np.zeros(n)
            one[slot] = y
            open_ &= np.bincount(slot[y != one[slot]], minlength=n) > 0
        self.which = np.flatnonzero(open_)
        return len(self.which) > 0

    def best(self, codes: np.ndarray, places: np.ndarray, bins: int, keep: int) -> tuple[np.ndarray, ...]:
        """Gain, feature, bin and nulls left of each open node's best split among the features in these rows of ``codes``. Of two nodes with one parent only the smaller one is counted, as in ``grow``, while a level's sums are at most ``keep`` cells."""
        n, cells, s = len(self.which), len(places) * bins, self.spec
        out = np.full(n, -np.inf), np.zeros(n, np.int16), np.zeros(n, np.int16), np.zeros(n, bool)
        if not len(places):
            return out
        if self.parents is None:
            pair, few = self.which, np.arange(self.nodes)
        else:
            pair, few = self.which // 2, 2 * np.arange(self.nodes // 2) + (self.size[1::2] < self.size[::2])
        pairs = np.unique(pair)
        self.sums = [np.zeros((self.nodes, len(places), bins)) for _ in range(2)] if self.nodes * cells <= keep else None
        for a, z in _runs(len(pairs), cells, _COUNTED):
            to = np.full(self.nodes, -1, np.int32)
            to[few[pairs[a:z]]] = np.arange(z - a)
            place = to[self.slot]
            use = np.flatnonzero(place >= 0)
            rows, w, place = self.at[use].astype(np.int64), self.w[use].astype(float), place[use].astype(np.int64) * bins
            g = -w * self.y[rows]
            sums = [np.empty((z - a, len(places), bins)) for _ in range(2)]
            for k, f in enumerate(places):
                cell = place + codes[f][rows]
                for one, weights in zip(sums, (g, w), strict=True):
                    one[:, k] = np.bincount(cell, weights, (z - a) * bins).reshape(z - a, bins)
            lo, hi = np.searchsorted(pair, [pairs[a], pairs[z - 1] + 1])
            for x, y in _runs(hi - lo, cells, _CELLS):
                own = slice(lo + x, lo + y)
                at, rest = np.searchsorted(pairs[a:z], pair[own]), self.which[own] != few[pair[own]]
                hist = [one[at] for one in sums]
                for c in range(2) if rest.any() else ():
                    hist[c][rest] = self.parents[c][pair[own][rest]] - hist[c][rest]
                for c in range(2) if self.sums else ():
                    self.sums[c][self.which[own]] = hist[c]
                for o, v in zip(out, _splits(*hist, s.l2, s.least), strict=True):
                    o[own] = v
        return out

    def choose(self, found: list[tuple[np.ndarray, ...]]) -> None:
        """Takes the best of the tasks' splits, of those that tie the first as ``_splits`` has them."""
        gain, feature, at, null_left = (np.stack(x) for x in zip(*found, strict=True))
        top, none = gain.max(0), self.total[self.which] ** 2 / np.maximum(self.weight[self.which] + self.spec.l2, 1e-300)
        task = np.where(gain >= top - _TIE * (np.abs(top) + none), feature.astype(np.int64) + (null_left.astype(np.int64) << 20), 1 << 30).argmin(0)
        good = gain[task, np.arange(len(task))] > max(self.spec.gamma, 1e-12)
        task, nodes, each = task[good], self.which[good], np.flatnonzero(good)
        for name, x in (("feature", feature), ("bin", at), ("null_left", null_left), ("gain", gain)):
            self.levels[-1][name][nodes] = x[task, each]
        self.task = np.full(self.nodes, -1, np.int16)  # whose split it is
        self.task[nodes] = task

    def sides(self, me: int, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which rows of the nodes that this task's features split go left, as bits; ``place`` has the rows of ``codes`` of features."""
        level, use = self.levels[-1], np.flatnonzero((self.task == me)[self.slot])
        slot = self.slot[use]
        c = codes[place[level["feature"]][slot], self.at[use]]
        return np.packbits(np.where(c == 0, level["null_left"][slot], c <= level["bin"][slot]))

    def part(self, bits: list[np.ndarray]) -> None:
        """Sends rows to the next level by the bits of all tasks."""
        owner, low = self.task[self.slot], np.zeros(len(self.slot), bool)
        for p, b in enumerate(bits):
            if len(b):
                use = np.flatnonzero(owner == p)
                low[use] = np.unpackbits(b, count=len(use)).view(bool)
        split, live, level = self.task >= 0, owner >= 0, self.levels[-1]
        n, to = int(split.sum()), 2 * (np.cumsum(split, dtype=np.int32) - 1)
        level["left"][split] = self.first + self.nodes + 2 * np.arange(n)
        level["right"][split] = level["left"][split] + 1
        slot = (to[self.slot] + ~low).astype(self.slot.dtype)
        if live.all():
            self.slot = slot
        else:
            self.slot, self.at, self.w = slot[live], self.at[live], self.w[live]
        self.parents, self.sums = self.sums and [x[split] for x in self.sums], None
        self.first, self.nodes = self.first + self.nodes, 2 * n

    def done(self) -> Tree:
        return Tree(**{c: np.concatenate([x[c] for x in self.levels]) for c in Tree().__dict__})


def _grown(trees: list[_Growing], own: list[int], codes: np.ndarray, me: int, share, bins: int) -> None:
    """Grows trees side by side: ``own`` are the features of this task, number ``me``, in the order of ``codes``; ``share`` gives what all tasks have sent."""
    place = np.zeros(1 + max(*own, *(f for t in trees for f in t.spec.features)), np.int64)
    place[own] = np.arange(len(own))
    mine = [np.array([f for f in own if f in set(t.spec.features)], np.int16) for t in trees]
    left, live = [t.spec.depth for t in trees], list(range(len(trees)))
    while live := [q for q in live if trees[q].nodes and trees[q].weigh(left[q])]:
        found = []
        for q in live:
            gain, f, b, null_left = trees[q].best(codes, place[mine[q]], bins, 2 * _PARENTS // len(trees) if left[q] > 1 else 0)
            found.append((gain, mine[q][f] if len(mine[q]) else f, b, null_left))
        for q, *each in zip(live, *share(found), strict=True):
            trees[q].choose(each)
        for q, *each in zip(live, *share([trees[q].sides(me, codes, place) for q in live]), strict=True):
            trees[q].part(each)
            left[q] -= 1


def _by_columns(data: DataFrame, models: list[Ensemble], bins: int) -> None:
    """Adds all trees to forests of one setting, in a barrier stage of tasks that have some features of all rows each."""
    specs = [m.spec for m in models]
    wanted = sorted({f for s in specs for f in s.features})
    tasks = min(data.sparkSession.sparkContext.defaultParallelism, len(wanted))
    own = [wanted[p::tasks] for p in range(tasks)]
    numbers = [(i, t) for i, s in enumerate(specs) for t in range(s.trees)]

    def pack(batches):
        part = TaskContext.get().partitionId()
        for n, b in enumerate(batches):
            rows = _Rows(b)
            use = np.flatnonzero((rows.setting == specs[0].setting) & ~np.isnan(rows.y))
            if len(use):
                seen = [None if s.held is None else np.packbits(rows.grp[use] != s.held) for s in specs]
                codes = np.ascontiguousarray(rows.codes[use].T)
                pieces = [pickle.dumps((part, n, codes[f], rows.y[use], rows.k[use], seen), 5) for f in own]
                yield pa.RecordBatch.from_arrays([pa.array(range(tasks), pa.int32()), pa.array(pieces, pa.binary())], ["task", "piece"])

    def run(got):
        team = BarrierTaskContext.get()
        me = team.partitionId()

        def share(x):
            return [x] if tasks == 1 else [pickle.loads(base64.b64decode(m)) for m in team.allGather(base64.b64encode(pickle.dumps(x, 5)).decode())]

        pieces = sorted((pickle.loads(x) for _, x in got), key=lambda x: x[:2])  # the same order of rows in all tasks
        y, k = (np.concatenate([x[c] for x in pieces]) for c in (3, 4))
        seen = [None if s.held is None else np.concatenate([np.unpackbits(x[5][i], count=len(x[3])).view(bool) for x in pieces]) for i, s in enumerate(specs)]
        order = np.lexsort((y, k))  # sums don't hang on the order in which rows came
        codes = np.empty((len(own[me]), len(y)), np.uint8)
        for f in range(len(codes)):
            codes[f] = np.concatenate([x[2][f] for x in pieces])[order]
        del pieces
        y, k, seen = y[order], k[order], [None if x is None else x[order] for x in seen]
        groups = -(-len(numbers) // max(1, min(TOGETHER[0] // len(y), TOGETHER[1])))
        for group in range(groups):
            trees = []
            for i, t in numbers[group::groups]:
                w = _weights(k, t, specs[i].seed)
                at = np.flatnonzero(w if seen[i] is None else w * seen[i])
                trees.append(_Growing(specs[i], y, at, w[at]))
            _grown(trees, own[me], codes, me, share, bins)
            if not me:
                yield from ((i, t, tree.done()) for (i, t), tree in zip(numbers[group::groups], trees, strict=True))

    dealt = data.mapInArrow(pack, "task int, piece binary").rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(tasks, lambda p: p)
    for i, _, tree in sorted(dealt.barrier().mapPartitions(run).collect(), key=lambda x: x[:2]):  # the trees
        models[i].trees.append(tree)


def fit(data: DataFrame, specs: list[Spec], names: list[str], edges: dict[int, list[np.ndarray]]) -> dict[str, Ensemble]:
    """The models of all ``specs`` from the rows of ``binned``, which should be persisted."""
    return _fit(data, specs, names, edges)


def forest(data: DataFrame, spec: Spec, names: list[str], edges: dict[int, list[np.ndarray]]) -> Ensemble:
    """One forest from the rows of ``binned``."""
    return _fit(data, [spec], names, edges)[spec.name]


def _fit(data: DataFrame, specs: list[Spec], names: list[str], edges: dict[int, list[np.ndarray]]) -> dict[str, Ensemble]:
    if any(s.loss not in LOSSES for s in specs):
        raise ValueError(f"losses are {LOSSES}")
    if not specs:
        return {}
    bins = 2 + max((len(e) for one in edges.values() for e in one), default=0)
    models = [Ensemble(s, names=names, edges=edges.get(s.setting, [np.zeros(0)] * len(names))) for s in specs]
    seen = [reduce(lambda a, b: a & b, [F.col("setting") == s.setting, F.col("y").isNotNull(), ~F.isnan("y"), *([F.coalesce(F.col("grp") != s.held, F.lit(True))] if s.held is not None else [])]) for s in specs]
    first = data.agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(seen)], *[(F.percentile_approx(F.when(c, F.col("y")), s.alpha, 10000) if s.loss == "quantile" else F.avg(F.when(c, F.col("y")))).alias(f"b{k}") for k, (c, s) in enumerate(zip(seen, specs, strict=True))]).first()
    for k, m in enumerate(models):
        m.base = float(first[f"b{k}"] or 0.0) if m.spec.boosted else 0.0
    apart = [m for k, m in enumerate(models) if not m.spec.boosted and m.spec.trees and 0 < first[f"n{k}"] <= WHOLE_FOREST * SMALL]
    if apart:
        _forests_apart(data, apart, bins)
    if data.sparkSession.conf.get("spark.dynamicAllocation.enabled", "false") != "true":  # or else a barrier stage isn't to be had
        for setting in sorted({s.setting for s in specs}):
            wide = [m for k, m in enumerate(models) if not m.spec.boosted and m.spec.setting == setting and m.spec.trees and not m.trees and m.spec.features and 0 < first[f"n{k}"] <= COLUMNS]
            if wide:
                _by_columns(data.where(F.col("setting") == setting), wide, bins)
    forests = [(k, t, Tree()) for k, m in enumerate(models) if not m.spec.boosted and not m.trees for t in range(m.spec.trees)]
    if forests:
        _round(data, models, forests, [first[f"n{k}"] for k, _, _ in forests], bins)
        for k, _, tree in forests:
            models[k].trees.append(tree)
    square = [(m, first[f"n{k}"]) for k, m in enumerate(models) if m.spec.loss in SQUARES and m.spec.trees and first[f"n{k}"]]
    for boost, own in ((_boost_apart, [m for m, n in square if n <= WHOLE]), (_boost, [m for m, n in square if n > WHOLE])):
        if own:
            boost(data, own, bins)
    for t in range(max((m.spec.trees for m in models if m.spec.boosted), default=0)):
        own = [(k, t, Tree()) for k, m in enumerate(models) if m.spec.boosted and t < m.spec.trees and len(m.trees) == t]
        if not own:
            break
        _round(data, models, own, [first[f"n{k}"] for k, _, _ in own], bins)
        for k, _, tree in own:
            models[k].trees.append(tree)
    return {m.spec.name: m for m in models}


def predictions(data: DataFrame, models: dict[str, Ensemble], keep: list[str], held: bool = False) -> DataFrame:
    """``keep`` of the binned rows with ``p_<name>`` for each model, where a row is of the model's setting (``held``: and of the group that the model didn't see); null elsewhere."""
    sent = data.sparkSession.sparkContext.broadcast({n: m.light() for n, m in models.items()})
    names = list(models)

    def run(batches):
        for b in batches:
            rows = _Rows(b)
            cols = []
            for n in names:
                m = sent.value[n]
                own = (rows.setting == m.spec.setting) & (rows.grp == m.spec.held if held else True)
                p = np.full(rows.n, np.nan)
                p[own] = np.maximum(m.of(rows.codes[own]), 0.0)
                cols.append(pa.array(p, mask=~own))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *(f"p_{n}" for n in names)])

    kept = [f"{c} {data.schema[c].dataType.simpleString()}" for c in keep]
    return data.mapInArrow(run, ", ".join([*kept, *(f"`p_{n}` double" for n in names)]))
