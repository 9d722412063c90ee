"""Whitening of embeddings by upper-triangle column aggregates.

A component c counts as the long floor(64 * c) + 1000000. The fit list has each distinct vector of these once. One generated SQL aggregation over it sums the
products of every pair of dimensions, each centred before multiplying (more than ``PAIRS`` of them: several aggregations); the covariance is put together from the
sums on the driver, a table of the square of the dimensions, and LAPACK decomposes it. Rows are then projected where they lie; the covariance of the
projections of the fit list, again aggregated pair by pair, says how far it is from the identity.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Vectors of each length are whitened on their own, in a run for each length. Entries beyond 2**62 / 64 count as
that. Components whose eigenvalue is not above rounding (all of them, where there is one distinct vector) can't be scaled to one and are left out, so a row has 16 components or
as many as its fit list spans. Rows that repeat, also under one id, each have their own results; a null vec_id stays null. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut

SCALE, SHIFT, FAR = 64, 1_000_000, 1 << 62
KEPT = 16
#: sums of one aggregation: all pairs of up to 90 dimensions
PAIRS = 4096


@dataclass
class Fit:
    """What is learned from the fit list of one length: its size, sums, the projection (a column for each component, scaled), each component's share of the variance."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as longs where they fit, else as Python's integers."""
        s = np.array(self.sums, object)
        if self.n * max(int(np.abs(x).max(initial=0)), 1) >= FAR or max(map(abs, self.sums), default=0) >= FAR:
            return x.astype(object) * self.n - s
        return x * self.n - s.astype(np.int64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.projection


def valid(e: Column) -> Column:
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(fine & (F.size(e) > 0), F.lit(False))


def _fixed(e: Column) -> Column:
    return F.transform(e, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-FAR)), F.lit(FAR)) + F.lit(SHIFT))


def fixed_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that are kept."""
    rows = vectors.select("vec_id", F.col("embedding").alias("e")).where(valid(F.col("e")))
    return rows.select("vec_id", _fixed(F.col("e")).alias("x"))


def _totals(df: DataFrame, expressions: list[str]) -> list:
    """Values of aggregates over ``df``, ``PAIRS`` at a time."""
    out = []
    for k in range(0, len(expressions), PAIRS):
        out += list(df.selectExpr(*expressions[k : k + PAIRS]).first())
    return out


def _upper(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _symmetric(values: list[float], d: int) -> np.ndarray:
    m = np.zeros((d, d))
    for (i, j), v in zip(_upper(d), values, strict=True):
        m[i, j] = m[j, i] = v
    return m


def fit(distinct: DataFrame, d: int, kept: int = KEPT) -> Fit:
    """From the distinct vectors ``x`` of length d."""
    n, *sums = _totals(distinct, ["count(*) n", *[f"sum(cast(x[{i}] as decimal(20, 0))) s{i}" for i in range(d)]])
    sums = [int(s) for s in sums]
    centred = distinct.selectExpr(*[f"x[{i}] - {s / n!r}D AS d{i}" for i, s in enumerate(sums)])
    covariance = _symmetric(_totals(centred, [f"sum(d{i} * d{j}) p{i}_{j}" for i, j in _upper(d)]), d) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values[:kept] > d * np.finfo(float).eps * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    trace = float(np.trace(covariance))
    out = Fit(n, sums, vectors[:, :real] / np.sqrt(values[:real]), [float(v / trace) for v in values[:real]])
    if real:
        white = _projected(distinct.select(F.lit(None).cast("long").alias("vec_id"), "x"), {d: out}, "long", "w array<double>", lambda ids, dev, w, f: [_lists(w)])
        spread = _symmetric(_totals(white, [f"covar_pop(w[{i}], w[{j}]) c{i}_{j}" for i, j in _upper(real)]), real)
        out.identity_error = float(np.abs(spread - np.eye(real)).max())
    return out


def _lists(w: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))


def _long(v: int) -> int | None:
    return int(v) if -(1 << 63) <= v < 1 << 63 else None


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where one is beyond a long."""
    top = int(np.abs(centred).max(initial=0))
    if top * top * centred.shape[1] < 1 << 63:
        return (centred.astype(np.int64) ** 2).sum(1).tolist()
    return [_long(v) for v in (centred.astype(object) ** 2).sum(1)]


def _projected(rows: DataFrame, fits: dict[int, Fit], id_type: str, schema: str, make) -> DataFrame:
    """``make`` of the ids, deviations, whitened values and fit of each batch of (vec_id, x), by the length of x."""
    fields = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches):
        for b in batches:
            ids, x = b.column(0), b.column(1)
            size = np.diff(x.offsets.to_numpy())
            for d in np.unique(size).tolist():
                f = fits.get(d)
                if f is None or not f.projection.shape[1]:
                    continue
                own = pa.array(np.flatnonzero(size == d))
                centred = f.centred(x.take(own).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                yield pa.RecordBatch.from_arrays(make(ids.take(own), centred, f.whiten(centred), f), fields)

    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, kept: int = KEPT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each kept row and component of ``vectors`` (vec_id, embedding).

    deviation is null where it is beyond a long.
    """
    rows = fixed_rows(vectors)
    distinct = cut(rows.select("x").distinct(), "whitening")
    lengths = [r[0] for r in distinct.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]  # a row for each length of vectors
    fits = {d: fit(distinct.where(F.size("x") == d) if len(lengths) > 1 else distinct, d, kept) for d in lengths}
    kind = rows.schema["vec_id"].dataType.simpleString()

    def make(ids, centred, w, f):
        k, m = w.shape[1], len(w)
        again = pa.array(np.repeat(np.arange(m), k))
        return [
            ids.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)), pa.array(_deviations(centred), pa.int64()).take(again),
            pa.array(w.ravel()), pa.array(np.tile(f.explained, m)), pa.array(np.full(m * k, f.identity_error)),
        ]

    return _projected(rows, fits, kind, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double", make)
