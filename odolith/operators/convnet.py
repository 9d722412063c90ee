"""A small convolutional speed regressor, trained data-parallel in one barrier stage.

Every task holds its share of the rows and all weights; which batch a row is in follows from a hash of its keys and the epoch, not from where it lies. In a step each task works on its rows of the
batch; the sums that batch normalisation and the gradients need are added up over all tasks (``allGather``), so all make the same step and end with the same weights, whatever their number. A lost task makes Spark run
the stage anew, from the same start. A task holds at most about ``ROWS`` rows.

Layers: linear to 32, two convolutions of width 3 (16 and 32 channels) with batch normalisation, average pooling to 8, linear to 32, linear to 1, all with max(0, x). Huber loss,
Adam with weight decay. Features are centred and scaled by their moments on the training rows; a null or NaN counts as the mean.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 200_000
# fixed values: layers, training
HIDDEN, CHANNELS, POOL, HEAD, WIDTH = 32, (16, 32), 8, 32, 3
EPOCHS, BATCH, RATE, DECAY, DELTA, MOMENTUM, EPS = 40, 64, 0.003, 1e-4, 1.0, 0.1, 1e-5
BETAS, ADAM_EPS = (0.9, 0.999), 1e-8


def start(n_features: int, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights within one over the root of the number of inputs."""
    rng = np.random.default_rng(seed)
    draw = lambda n, *shape: rng.uniform(-1, 1, shape) / np.sqrt(max(n, 1))
    a, b = CHANNELS
    shapes = {"in": (n_features, (n_features, HIDDEN), HIDDEN), "c1": (WIDTH, (WIDTH, a), a), "c2": (a * WIDTH, (a * WIDTH, b), b), "h1": (b * POOL, (b * POOL, HEAD), HEAD), "h2": (HEAD, (HEAD, 1), 1)}
    out = {}
    for k, (n, shape, bias) in shapes.items():
        out[f"{k}_w"], out[f"{k}_b"] = draw(n, *shape), draw(n, bias)
    for k, c in (("n1", a), ("n2", b)):
        out[f"{k}_w"], out[f"{k}_b"] = np.ones(c), np.zeros(c)
    return out


def _patches(x: np.ndarray) -> np.ndarray:
    """(rows, length, channels) to (rows, length, WIDTH * channels), zeros beyond the ends."""
    wide = np.pad(x, ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
    return np.concatenate([wide[:, k : k + x.shape[1]] for k in range(WIDTH)], 2)


def _unpatched(g: np.ndarray, channels: int) -> np.ndarray:
    n, length, _ = g.shape
    wide = np.zeros((n, length + WIDTH - 1, channels))
    for k in range(WIDTH):
        wide[:, k : k + length] += g[:, :, k * channels : (k + 1) * channels]
    return wide[:, WIDTH // 2 : WIDTH // 2 + length]


def _normal(x: np.ndarray, w: dict, k: str, add, moments: dict | None):
    """Batch normalisation over rows and places; with ``moments`` by those."""
    if moments is not None:
        mean, var, n = moments[f"{k}_m"], moments[f"{k}_v"], 0.0
    else:
        c = x.shape[2]
        total = add(np.concatenate([[x.shape[0] * x.shape[1]], x.sum((0, 1))]))
        n, mean = total[0], total[1 : 1 + c] / max(total[0], 1)
        var = add(((x - mean) ** 2).sum((0, 1))) / max(n, 1)
    scale = 1 / np.sqrt(var + EPS)
    hat = (x - mean) * scale
    return hat * w[f"{k}_w"] + w[f"{k}_b"], (hat, scale, n, mean, var)


def forward(x: np.ndarray, w: dict, add=lambda v: v, moments: dict | None = None) -> tuple[np.ndarray, dict]:
    """Speeds, and what ``backward`` needs. ``add`` sums an array over all tasks."""
    s = {"x": x}
    s["a0"] = np.maximum(x @ w["in_w"] + w["in_b"], 0)
    s["p1"] = _patches(s["a0"][:, :, None])
    z, s["n1"] = _normal(s["p1"] @ w["c1_w"] + w["c1_b"], w, "n1", add, moments)
    s["a1"] = np.maximum(z, 0)
    s["p2"] = _patches(s["a1"])
    z, s["n2"] = _normal(s["p2"] @ w["c2_w"] + w["c2_b"], w, "n2", add, moments)
    s["a2"] = np.maximum(z, 0)
    s["f"] = s["a2"].reshape(len(x), POOL, HIDDEN // POOL, CHANNELS[1]).mean(2).transpose(0, 2, 1).reshape(len(x), CHANNELS[1] * POOL)
    s["a3"] = np.maximum(s["f"] @ w["h1_w"] + w["h1_b"], 0)
    s["out"] = np.maximum(s["a3"] @ w["h2_w"] + w["h2_b"], 0)[:, 0]
    return s["out"], s


def huber(out: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses and their slopes."""
    r = out - y
    return np.where(np.abs(r) <= DELTA, r * r / 2, DELTA * (np.abs(r) - DELTA / 2)), np.clip(r, -DELTA, DELTA)


def backward(slope: np.ndarray, s: dict, w: dict, add=lambda v: v) -> dict[str, np.ndarray]:
    """This task's share of the gradients; ``slope`` is that of the loss by the output."""
    g = {}

    def linear(k, x, d):
        g[f"{k}_w"], g[f"{k}_b"] = x.reshape(-1, x.shape[-1]).T @ d.reshape(-1, d.shape[-1]), d.reshape(-1, d.shape[-1]).sum(0)
        return d @ w[f"{k}_w"].T

    def normal(k, d):
        hat, scale, n, _, _ = s[k]
        g[f"{k}_w"], g[f"{k}_b"] = (d * hat).sum((0, 1)), d.sum((0, 1))
        own = d * w[f"{k}_w"]
        total = add(np.stack([own.sum((0, 1)), (own * hat).sum((0, 1))]))
        return scale * (own - (total[0] + hat * total[1]) / max(n, 1))

    d = linear("h2", s["a3"], (slope * (s["out"] > 0))[:, None]) * (s["a3"] > 0)
    d = linear("h1", s["f"], d).reshape(len(slope), CHANNELS[1], POOL).transpose(0, 2, 1)
    d = np.repeat(d, HIDDEN // POOL, 1) * POOL / HIDDEN * (s["a2"] > 0)
    d = _unpatched(linear("c2", s["p2"], normal("n2", d)), CHANNELS[0]) * (s["a1"] > 0)
    d = _unpatched(linear("c1", s["p1"], normal("n1", d)), 1)[:, :, 0] * (s["a0"] > 0)
    linear("in", s["x"], d)
    return g


def train_rows(x: np.ndarray, y: np.ndarray, key: np.ndarray, n: int, epochs: int, batch: int, seed: int, add) -> tuple[dict, dict, list[float]]:
    """(weights, moments, mean loss of each epoch) of ``n`` rows in all, of which these are a task's."""
    w = start(x.shape[1], seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    moments = {f"{k}_{m}": np.full(c, v) for k, c in (("n1", CHANNELS[0]), ("n2", CHANNELS[1])) for m, v in (("m", 0.0), ("v", 1.0))}
    steps, losses, t = max(1, round(n / batch)), [], 0
    for epoch in range(epochs):
        mixed = (key.astype(np.uint64) + np.uint64(epoch + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        of = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(steps)).astype(np.int64)
        order = np.lexsort((key, of))
        ends = np.searchsorted(of[order], np.arange(steps + 1))
        loss = np.zeros(2)
        for b in range(steps):
            own = order[ends[b] : ends[b + 1]]
            out, s = forward(x[own], w, add)
            lost, slope = huber(out, y[own])
            g = backward(slope, s, w, add)
            total = add(np.concatenate([[len(own), lost.sum()], *[v.ravel() for v in g.values()]]))
            if not total[0]:
                continue
            loss += total[:2]
            t, at = t + 1, 2
            for k, v in g.items():
                d = total[at : at + v.size].reshape(v.shape) / total[0] + DECAY * w[k]
                at += v.size
                first[k] = BETAS[0] * first[k] + (1 - BETAS[0]) * d
                second[k] = BETAS[1] * second[k] + (1 - BETAS[1]) * d * d
                w[k] = w[k] - RATE * (first[k] / (1 - BETAS[0] ** t)) / (np.sqrt(second[k] / (1 - BETAS[1] ** t)) + ADAM_EPS)
            for k in ("n1", "n2"):
                _, _, count, mean, var = s[k]
                moments[f"{k}_m"] = (1 - MOMENTUM) * moments[f"{k}_m"] + MOMENTUM * mean
                moments[f"{k}_v"] = (1 - MOMENTUM) * moments[f"{k}_v"] + MOMENTUM * var * count / max(count - 1, 1)
        losses.append(float(loss[1] / max(loss[0], 1)))
    return w, moments, losses


@dataclass
class ConvSpeedModel:
    """v_pred >= 0 of the network; v_std is the calibrated quantile of absolute residuals over 1.645, 0.20 at least, where there are ``calibration`` rows."""

    names: list[str] = field(default_factory=list)
    weights: dict[str, np.ndarray] = field(default_factory=dict, repr=False)
    moments: dict[str, np.ndarray] = field(default_factory=dict, repr=False)
    centre: list[float] = field(default_factory=list, repr=False)
    scale: list[float] = field(default_factory=list, repr=False)
    losses: list[float] = field(default_factory=list)
    q_hat: float = 0.5

    def train(self, df: DataFrame, names: list[str], calibration: DataFrame | None = None, epochs: int = EPOCHS, batch: int = BATCH, seed: int = 42, tasks: int | None = None) -> ConvSpeedModel:
        from odolith.operators.metrics import conformal_quantile

        self.names = names
        known = df.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
        plain = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        first = known.agg(F.count("*").alias("n"), *[F.avg(plain(c)).alias(f"m{k}") for k, c in enumerate(names)], *[F.stddev_pop(plain(c)).alias(f"s{k}") for k, c in enumerate(names)]).first()
        self.centre = [first[f"m{k}"] or 0.0 for k in range(len(names))]
        self.scale = [first[f"s{k}"] if (first[f"s{k}"] or 0) > 1e-9 else 1.0 for k in range(len(names))]
        n, d = first["n"], len(names)
        rows = known.select(F.xxhash64("drive_id", "rn").alias("k"), F.col("y").cast("double").alias("y"), self._inputs().alias("x"))
        tasks = tasks or max(1, -(-n // ROWS))

        def run(batches):
            held = [b for b in batches if b.num_rows]
            key, y = (np.concatenate([b.column(c).to_numpy() for b in held]) if held else np.zeros(0, np.int64 if c == "k" else float) for c in ("k", "y"))
            x = np.concatenate([b.column("x").flatten().to_numpy().reshape(-1, d) for b in held]) if held else np.zeros((0, d))
            context = BarrierTaskContext.get()

            def add(v):
                if tasks == 1:
                    return v
                sent = context.allGather(base64.b64encode(np.ascontiguousarray(v, np.float64).tobytes()).decode())
                return np.sum([np.frombuffer(base64.b64decode(m)).reshape(v.shape) for m in sent], axis=0)

            w, moments, losses = train_rows(x, y, key, n, epochs, batch, seed, add)
            if context.partitionId() == 0:
                packed = {"w": {k: v.tolist() for k, v in w.items()}, "m": {k: v.tolist() for k, v in moments.items()}, "l": losses}
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(packed)])], ["model"])

        got = json.loads(rows.repartition(tasks, "k").mapInArrow(run, "model string", barrier=True).collect()[0]["model"])  # one row: the weights
        self.weights, self.moments = ({k: np.array(v) for k, v in got[c].items()} for c in ("w", "m"))
        self.losses = got["l"]
        if calibration is not None:
            r = self.predict(calibration).select(F.lit(0).alias("g"), F.abs(F.col("y") - F.col("v_pred")).alias("r"))
            row = conformal_quantile(r, "r", ["g"]).first()
            self.q_hat = float(row["q_hat"]) if row else self.q_hat
        return self

    def _inputs(self):
        one = lambda c, m, s: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), (F.col(c).cast("double") - F.lit(m)) / F.lit(s)), F.lit(0.0))
        return F.array(*[one(c, m, s) for c, m, s in zip(self.names, self.centre, self.scale, strict=True)])

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with v_pred and v_std."""
        sent = df.sparkSession.sparkContext.broadcast((self.weights, self.moments))

        @F.pandas_udf("double")
        def of(x: pd.Series) -> pd.Series:
            return pd.Series(forward(np.stack(x.to_numpy()), sent.value[0], moments=sent.value[1])[0] if len(x) else np.zeros(0))

        return df.withColumn("v_pred", of(self._inputs())).withColumn("v_std", F.lit(max(0.20, self.q_hat / 1.645)))

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {**self.__dict__, "weights": {k: v.tolist() for k, v in self.weights.items()}, "moments": {k: v.tolist() for k, v in self.moments.items()}}
        spark.createDataFrame([(json.dumps(plain),)], "value string").write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ConvSpeedModel:
        d = json.loads(spark.read.text(path).first()[0])
        return ConvSpeedModel(**{**d, "weights": {k: np.array(v) for k, v in d["weights"].items()}, "moments": {k: np.array(v) for k, v in d["moments"].items()}})
