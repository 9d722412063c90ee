"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, runs of two and three words, and pairs of words one and two apart. The learner keeps per-coordinate
learning rates and soft-thresholds weights (L1), so most stay at exactly zero; what remains is a short list of
(index, weight) that is broadcast. It is bounded by the number of buckets, whatever the corpus.

Labels are learned from a sample of at most ``TRAIN_ROWS`` labelled documents with at most ``TRAIN_FEATURES`` features in all, those of the smallest hash of doc_id, the same in any
partitioning. Features are made on all executors; one task, which holds the sample's features and nothing else, runs the
passes, because the learner is sequential. Scoring reads every whole text once and shuffles nothing.

Rows with crc32(doc_id as text) mod 4 = 2 are held out from learning, and from the choice of the learner's parameters, which ``cross_validate`` makes on the other
three remainders. Null and empty texts get the score of the bias. A
null doc_id is never labelled and not held out. Of several labels of one document the largest counts; null labels are not
labels. Without any label every score is 0. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, give_back

THRESHOLD = 0.3
BUCKET_BITS = 22
TRAIN_ROWS, TRAIN_FEATURES = 20_000, 48_000_000
PASSES = 4
ALPHA, BETA, L1, L2 = 4.0, 1.0, 12.0, 0.5
_WORD = re.compile(r"\w+")
_CACHE = 200_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "replace"))
        if len(self) >= _CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_hash = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (h ^ (h >> np.uint32(15))) >> np.uint32(32 - BUCKET_BITS)


def features(text: str | None) -> np.ndarray:
    """Bucket numbers, with repeats."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_hash.__getitem__, words), np.uint32, len(words))
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
    with np.errstate(over="ignore"):
        pairs = h[:-1] * a + h[1:] * b
        triples = pairs[:-1] * c + h[2:] * np.uint32(0x27D4EB2F)
        return _mix(np.concatenate([h, pairs + np.uint32(1), triples + np.uint32(2), h[:-2] * a + h[2:] * b + np.uint32(3), h[:-3] * a + h[3:] * b + np.uint32(4)]))


def ftrl(rows: list[tuple[np.ndarray, int]], passes: int = PASSES, alpha: float = ALPHA, l1: float = L1) -> tuple[np.ndarray, np.ndarray, float]:
    """(indexes, weights, bias) from [(distinct buckets, label)], in the order given."""
    z, n = np.zeros(1 << BUCKET_BITS, np.float32), np.zeros(1 << BUCKET_BITS, np.float32)
    zb = nb = 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / alpha + L2))

    for _ in range(passes):
        for idx, y in rows:
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            b = -zb / ((BETA + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -35, 35))) - y
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - step * w
            n[idx] = ni + g * g
            zb += g - (((nb + g * g) ** 0.5 - nb**0.5) / alpha) * b
            nb += g * g
    w = weight(z, n)
    own = np.flatnonzero(w)
    return own, w[own], float(-zb / ((BETA + nb**0.5) / alpha))


def held_out():
    """Column: whether doc_id's row is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(o, y, fold, f) of the documents to learn from: order, label, remainder and distinct buckets."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    sample = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumn("o", F.xxhash64("doc_id")).orderBy("o").limit(train_rows)
    sample = cut(sample, "sample")  # at most train_rows rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.select("o", "y", (F.crc32(F.col("doc_id").cast("string")) % 4).cast("int").alias("fold"), "text")

    def featurize(batches):
        for b in batches:
            f = [np.unique(features(t)).astype("<u4").tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(f, pa.binary())], ["o", "y", "fold", "f"])
        _hash.clear()
        give_back()

    return texts.mapInArrow(featurize, "o long, y int, fold int, f binary")


def _bounded(rows, most: int) -> list[tuple[np.ndarray, int]]:
    """[(buckets, label)] of sorted (order, label, buckets) for as long as they have at most ``most`` buckets in all."""
    out, size = [], 0
    for _, y, f in rows:
        size += len(f) // 4
        if size > most:
            break
        out.append((np.frombuffer(f, "<u4"), y))
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_features: int = TRAIN_FEATURES) -> list[tuple[int, float]]:
    """[(bucket, weight)], with the bias under -1; empty without labels."""

    def learn(batches):
        # sorted by order and text, so what is beyond the bound is only read
        rows = _bounded(((o, y, f) for b in batches for o, y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), train_features)
        for _ in batches:
            pass
        if rows:
            idx, w, bias = ftrl(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(idx, -1), pa.int64()), pa.array(np.append(w, bias), pa.float64())], ["bucket", "weight"])
        del rows
        give_back()

    got = _sample(docs, labels, train_rows).select("o", "y", "f").repartition(1).sortWithinPartitions("o", "y", "f").mapInArrow(learn, "bucket long, weight double")
    return [(r[0], r[1]) for r in got.collect()]  # the non-zero weights: fewer than there are buckets


def cross_validate(docs: DataFrame, labels: DataFrame, settings: list[tuple[float, float]], train_rows: int = 6_000) -> DataFrame:
    """(alpha, l1, fold, n, log_loss, caught, flagged, toxic) for each setting and each remainder that isn't held out, learned on the other two.

    ALPHA and L1 were chosen so on the supplied tables, among 16 settings: the least mean log loss where at least 0.99 of what is flagged is
    toxic. Held-out rows take no part.
    """
    spark = docs.sparkSession
    sample = cut(_sample(docs, labels, train_rows), "folds")
    grid = spark.createDataFrame([(float(a), float(b), k) for a, b in settings for k in (0, 1, 3)], "alpha double, l1 double, of int")

    def one(t: pa.Table) -> pa.Table:
        alpha, l1, fold = (t.column(c)[0].as_py() for c in ("alpha", "l1", "of"))
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("o", "y", "fold", "f")), strict=True))
        idx, w, bias = ftrl([(np.frombuffer(f, "<u4"), y) for _, y, k, f in rows if k != fold], alpha=alpha, l1=l1)
        dense = np.zeros(1 << BUCKET_BITS, np.float32)
        dense[idx] = w
        test = [(np.frombuffer(f, "<u4"), y) for _, y, k, f in rows if k == fold]
        s = np.array([1 / (1 + np.exp(-np.clip(bias + dense[f].sum(), -35, 35))) for f, _ in test])
        y = np.array([y for _, y in test])
        loss = float(-np.log(np.where(y == 1, s, 1 - s)).mean()) if len(y) else 0.0
        out = (alpha, l1, fold, len(y), loss, int(((s >= THRESHOLD) & (y == 1)).sum()), int((s >= THRESHOLD).sum()), int((y == 1).sum()))
        return pa.table([[x] for x in out], pa.schema([("alpha", pa.float64()), ("l1", pa.float64()), ("of", pa.int32()), ("n", pa.int64()), ("log_loss", pa.float64()), *[(c, pa.int64()) for c in ("caught", "flagged", "toxic")]]))

    schema = "alpha double, l1 double, of int, n long, log_loss double, caught long, flagged long, toxic long"
    each = sample.join(F.broadcast(grid))  # a copy of the sample, of train_rows rows, for each learner
    return each.groupBy("alpha", "l1", "of").applyInArrow(one, schema).withColumnRenamed("of", "fold")


def _scorer(spark: SparkSession, weights: list[tuple[int, float]]):
    sent = spark.sparkContext.broadcast((np.array([w[0] for w in weights], np.int64), np.array([w[1] for w in weights], np.float32)))

    def load():
        idx, w = sent.value
        dense, bias = np.zeros(1 << BUCKET_BITS, np.float32), -40.0
        if len(idx):
            own = idx >= 0
            dense[idx[own]] = w[own]
            bias = float(w[~own][0])
        return dense, bias

    return load


def score_text(text: str | None, dense: np.ndarray, bias: float) -> float:
    f = features(text)
    f = np.unique(f[dense[f] != 0])
    return float(1 / (1 + np.exp(-np.clip(bias + dense[f].sum(dtype=np.float64), -35, 35)))) if bias > -40 else 0.0


def score(docs: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
    """(doc_id, held_out, score) for every row of ``docs`` (doc_id, text)."""
    load = _scorer(docs.sparkSession, weights)

    def run(batches):
        model = load()
        for b in batches:
            s = [score_text(t.as_py(), *model) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])
        _hash.clear()  # an idle worker keeps no words
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def drop_toxic(docs: DataFrame, weights: list[tuple[int, float]], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    load, at = _scorer(docs.sparkSession, weights), docs.columns.index("text")

    def run(batches):
        model = load()
        for b in batches:
            yield b.filter(pa.array([score_text(t.as_py(), *model) < threshold for t in b.column(at)], pa.bool_()))
        _hash.clear()
        give_back()

    return docs.mapInArrow(run, docs.schema)
