"""Codes of vectors by product quantization, its codebooks learned by the filtering form of Lloyd's rounds.

A component c counts as the integer floor(256 * c), and a vector is cut into ``PARTS`` equal consecutive parts. Each part position's codebook starts as that part of the
``ENTRIES`` smallest vec_ids' vectors. In a round every partition builds kd-trees over its parts, ``CHUNK`` rows at a time, one tree for each position, whose nodes hold
their bounding box, sum and count. Going down a tree, an entry is out where its box lies wholly nearer to another entry; once one entry is left, the whole subtree goes to it by
its cached sum and count. Points are compared one by one only in leaves. The partitions' sums are added up by an aggregation, so the driver gets a row for each entry. The last
pass assigns in the same way and keeps each row's entries.

All arithmetic is exact: integers below 2**53 as doubles where no sum can leave that range, else Python's. Of entries at equal distances the lower index is taken, also
when boxes are compared.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of each length have codebooks of their own, in a run for each length; a length that isn't a multiple of
``PARTS`` counts as filled up with zeros. An id with several vectors gives its smallest one to the first codebook and a code to each; fewer ids make smaller codebooks, and
null ids give none (without any other id there are no codes to give, and no rows). Components beyond 2**53 / 256 count as that; an error, or a sum of errors, beyond a long is null. An empty
table gives no rows. Columns other than vec_id, embedding and label are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

SCALE, FAR = 256, 1 << 53
PARTS, ENTRIES, ROUNDS = 16, 64, 2
CHUNK, LEAF, BLOCK = 32768, 16, 4096


class Tree:
    """A kd-tree over points as a list of levels, from the root down; a level has equally long runs of the points in their order."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        depth = max(0, int(np.log2(max(n, 1) / LEAF)))
        size = -(-n // (1 << depth)) << depth
        self.at = np.concatenate([np.arange(n), np.full(size - n, n - 1)])  # the last point fills up, without weight
        self.real = np.arange(size) < n
        self.points = points[self.at]
        self.levels = []
        for level in range(depth + 1):
            runs = self.points.reshape(1 << level, -1, points.shape[1])
            lo, hi = runs.min(1), runs.max(1)
            if level < depth:
                wide = (hi - lo).argmax(1)
                length = runs.shape[1]
                key = runs[np.arange(len(runs))[:, None], np.arange(length)[None, :], wide[:, None]]
                order = (np.argpartition(key, length // 2, axis=1) + length * np.arange(len(runs))[:, None]).ravel()
                self.at, self.real, self.points = self.at[order], self.real[order], self.points[order]
            self.levels.append((lo, hi))
        leaves = (self.points * self.real[:, None]).reshape(1 << depth, -1, points.shape[1])
        sums, counts = [leaves.sum(1)], [self.real.reshape(1 << depth, -1).sum(1)]
        for _ in range(depth):
            sums.append(sums[-1].reshape(-1, 2, points.shape[1]).sum(1))
            counts.append(counts[-1].reshape(-1, 2).sum(1))
        self.levels = [(lo, hi, s, c) for (lo, hi), s, c in zip(self.levels, reversed(sums), reversed(counts), strict=True)]

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point's entry, in the points' order here (-1 where a subtree was given away whole: see ``filled``), and sums and counts by entry."""
        k, w = book.shape
        sums, counts = np.zeros_like(book), np.zeros(k, np.int64)
        code = np.full(len(self.at), -1)
        norm = (book * book).sum(1)
        nodes, live = np.zeros(1, np.int64), np.ones((1, k), bool)
        for depth, (lo, hi, total, count) in enumerate(self.levels):
            self._narrow(lo[nodes], hi[nodes], live, book, norm)
            one = live.sum(1) == 1
            if one.any():
                to, own = live[one].argmax(1), nodes[one]
                np.add.at(sums, to, total[own])
                np.add.at(counts, to, count[own])
                length = len(self.at) >> depth
                code.reshape(-1, length)[own] = to[:, None]
            nodes, live = nodes[~one], live[~one]
            if depth + 1 < len(self.levels):
                nodes, live = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(live, 2, 0)
        length = len(self.at) >> (len(self.levels) - 1)
        step = max(1, BLOCK // length)
        for i in range(0, len(nodes), step):
            own = nodes[i : i + step]
            y, r = self.points.reshape(-1, length, w)[own], self.real.reshape(-1, length)[own]
            d = norm - 2 * (y @ book.T)
            to = _least(d, np.broadcast_to(live[i : i + step, None, :], d.shape))
            code.reshape(-1, length)[own] = to
            np.add.at(sums, to[r], y[r])
            np.add.at(counts, to[r], 1)
        return code, sums, counts

    @staticmethod
    def _narrow(lo: np.ndarray, hi: np.ndarray, live: np.ndarray, book: np.ndarray, norm: np.ndarray) -> None:
        """Takes the entries out of ``live`` that no point of a box can have: the entry nearest to its middle is nearer to every point, or as near and of a lower index."""
        for i in range(0, len(lo), 1024):
            at = slice(i, i + 1024)
            best = _least(2 * norm - 2 * ((lo[at] + hi[at]) @ book.T), live[at])  # twice the squared distances from the middle, less what all have
            away = book[None] - book[best][:, None]
            corner = np.where(away > 0, hi[at][:, None], lo[at][:, None])  # where the other entry does best
            lead = norm[None] - norm[best][:, None] - 2 * (corner * away).sum(2)
            live[at] &= ~((lead > 0) | ((lead == 0) & (np.arange(len(book))[None] > best[:, None])))

    def filled(self, code: np.ndarray) -> np.ndarray:
        """Codes in the order of the points that the tree was made of."""
        out = np.zeros(int(self.real.sum()), np.int64)
        out[self.at[self.real]] = code[self.real]
        return out


def _least(d: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The first live place of the smallest value."""
    if d.dtype == object:
        top = d.max(initial=0) + 1
        return np.where(live, d, top).argmin(-1).astype(np.int64)
    return np.where(live, d, np.inf).argmin(-1)


def _numbers(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if their sums of squares stay exact so, else as Python's integers."""
    top = max(float(np.abs(x).max(initial=0)), float(max((abs(v) for v in book.ravel().tolist()), default=0)))
    if 16 * max(x.shape[-1], 1) * top * top < FAR and top * len(x) < FAR:
        return x, book.astype(np.float64)
    return x.astype(np.int64).astype(object), book


def _parts(values: np.ndarray, n: int, d: int) -> np.ndarray:
    """(n, PARTS, width) of the integers, as doubles that hold them exactly."""
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(values.astype(np.float64).reshape(n, d) * SCALE), -float(FAR), float(FAR))
    wide = max(1, -(-d // PARTS)) * PARTS
    return np.concatenate([x, np.zeros((n, wide - d))], 1).reshape(n, PARTS, -1)


def _chunks(batches, d: int):
    """(record batches, their parts) of about ``CHUNK`` rows; the vectors are the second column."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            take = min(b.num_rows, CHUNK - n)
            held.append(b.slice(0, take))
            b, n = b.slice(take), n + take
            if n == CHUNK:
                yield held, np.concatenate([_parts(x.column(1).flatten().to_numpy(zero_copy_only=False), x.num_rows, d) for x in held])
                held, n = [], 0
    if n:
        yield held, np.concatenate([_parts(x.column(1).flatten().to_numpy(zero_copy_only=False), x.num_rows, d) for x in held])


def _first_books(rows: DataFrame, d: int) -> np.ndarray | None:
    """The parts of the smallest ids' vectors: every task gives its own ``ENTRIES`` smallest ids."""
    schema = rows.select("vec_id", "x").schema

    def run(batches):
        best = {}
        for b in batches:
            ids = b.column(0)
            for k in np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable").tolist():
                i = ids[k].as_py()
                if i not in best and len(best) >= ENTRIES and i > max(best):
                    break
                v = b.column(1)[k].as_py()
                best[i] = min(best.get(i, v), v)
                if len(best) > ENTRIES:
                    del best[max(best)]
        order = sorted(best)
        yield pa.RecordBatch.from_arrays([pa.array(order, ids_type), pa.array([best[i] for i in order], x_type)], ["vec_id", "x"])

    from pyspark.sql.pandas.types import to_arrow_type

    ids_type, x_type = to_arrow_type(schema["vec_id"].dataType), to_arrow_type(schema["x"].dataType)
    own = rows.where(F.col("vec_id").isNotNull()).select("vec_id", "x").mapInArrow(run, schema)
    first = own.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(ENTRIES).collect()
    if not first:
        return None
    parts = _parts(np.array([r["x"] for r in first], np.float64), len(first), d)
    return parts.transpose(1, 0, 2).astype(np.int64).astype(object)


def _round(rows: DataFrame, books: np.ndarray, d: int) -> np.ndarray:
    """The codebooks after one more round."""
    width = books.shape[2]
    fields = ["part", "entry", "n", *[f"s{j}" for j in range(width)]]

    def run(batches):
        sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for _, x in _chunks(batches, d):
            for p in range(PARTS):
                y, book = _numbers(x[:, p], books[p])
                _, s, c = Tree(y).assign(book)
                sums[p] += np.array([[int(v) for v in r] for r in s.tolist()], object).reshape(s.shape)
                counts[p] += c
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), *[pa.array([_decimal(v) for v in sums[part, entry, j]], pa.decimal128(38, 0)) for j in range(width)]], fields
        )

    schema = ", ".join(["part int", "entry int", "n long", *[f"s{j} decimal(38, 0)" for j in range(width)]])
    total = rows.select("vec_id", "x").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    out = books.copy()
    for r in total.collect():  # a row for each entry that is used
        out[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return out


def _decimal(v: int):
    from decimal import Decimal

    return Decimal(int(v))


def _coded(rows: DataFrame, books: np.ndarray, d: int) -> DataFrame:
    """``rows`` with code and error in place of x."""
    names = ["vec_id", "label", "code", "error"]
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()

    def run(batches):
        for held, x in _chunks(batches, d):
            code, error = np.zeros((len(x), PARTS), np.int64), np.zeros(len(x), object)
            for p in range(PARTS):
                y, book = _numbers(x[:, p], books[p])
                tree = Tree(y)
                code[:, p] = tree.filled(tree.assign(book)[0])
                off = ((y - book[code[:, p]]) ** 2).sum(1)
                error += np.array([int(v) for v in off.tolist()], object) if off.dtype == object else off.astype(np.int64).astype(object)
            hexed = code.astype(np.uint8).tobytes().hex()
            texts = [hexed[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(x))]
            ids, labels = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts, pa.string()), pa.array([v if v < 1 << 63 else None for v in error.tolist()], pa.int64())], names)

    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    out = rows.select("vec_id", "x", "label").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")
    return out.withColumn("codebooks_sha256", F.lit(digest))


def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of ``vectors`` (vec_id, embedding, label) that is kept."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(finite, F.lit(False))).select("vec_id", e.alias("x"), "label")
    out = None
    for r in rows.select(F.size("x").alias("d")).distinct().orderBy("d").collect():  # a row for each length of vectors
        own = rows.where(F.size("x") == r["d"])
        books = _first_books(own, r["d"])
        if books is None:
            continue
        for _ in range(ROUNDS):
            books = _round(own, books, r["d"])
        one = _coded(own, books, r["d"])
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.where(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    done = cut(out, "codes")
    total = F.sum(F.col("error").cast("decimal(38, 0)"))
    by = done.groupBy("label").agg(F.when(F.count("error") == F.count("*"), total).alias("s")).select(F.col("label").alias("own"), F.expr("try_cast(s as bigint)").alias("label_error"))
    return done.join(by, done["label"].eqNullSafe(by["own"])).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
