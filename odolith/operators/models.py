"""Speed regressors with uncertainty on Spark ML, and the studies made with them."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from odolith.operators import context, ekf, features, metrics, motion, trees
from odolith.operators.metrics import conformal_quantile, regression
from odolith.sources.drives import so_far

METHODS = ("ensemble", "quantile", "conformal")
KINDS = {
    "random_forest": lambda k: RandomForestRegressor(labelCol="y", numTrees=k.get("trees", 100), maxDepth=k.get("depth", 12), featureSubsetStrategy="all", seed=42),
    "boosted": lambda k: GBTRegressor(labelCol="y", maxIter=k.get("trees", 100), maxDepth=min(k.get("depth", 6), 8), stepSize=k.get("step", 0.08), seed=42),
}
#: kinds of the shared trainer: regularised second-order boosting; and squared error with quantile models beside it
SHARED = {
    "second_order": lambda k: [trees.Spec("point", (), "second_order", k.get("trees", 100), min(k.get("depth", 6), 8), k.get("step", 0.08), 1.0)],
    "hist": lambda k: [
        trees.Spec("point", (), "squared", k.get("trees", 150), k.get("depth", 8), k.get("step", 0.1), least=k.get("least", 20)),
        *[trees.Spec(f"q{int(100 * a)}", (), "quantile", k.get("trees", 100), k.get("depth", 8), k.get("step", 0.1), least=k.get("least", 20), alpha=a) for a in (0.05, 0.95)],
    ],
}


@dataclass
class SpeedModel:
    """Predictions v_pred >= 0 and deviations v_std.

    'ensemble': population deviation over a forest's trees, 0.05 at least. 'conformal': the calibrated quantile over 1.645, 0.10 at least; it needs ``calibration`` rows other than those to train on.
    'quantile': for kind 'hist' the distance of its 5 and 95 % models; for others half the 5 to 95 % spread of residuals of the ``calibration`` rows in the prediction's bin; over 1.645.
    """

    kind: str = "random_forest"
    method: str = "ensemble"
    options: dict = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    model: PipelineModel | None = None
    q_hat: float = 0.5
    bins: list[float] = field(default_factory=list)
    trees: list | None = field(default=None, repr=False, compare=False)
    fitted: dict[str, trees.Ensemble] = field(default_factory=dict, repr=False, compare=False)
    #: a random forest grown by the shared trainer, to the size and from the seed that Spark ML's has here; Spark ML's sums up every node's bins over all tasks, which at this size doesn't end
    shared: bool = False

    @property
    def _is_shared(self) -> bool:
        return self.kind in SHARED or self.shared

    def train(self, df: DataFrame, names: list[str], calibration: DataFrame | None = None) -> SpeedModel:
        if self.kind not in {**KINDS, **SHARED} or self.method not in METHODS or (self.method == "ensemble" and self.kind != "random_forest"):
            raise ValueError(f"no {self.method} uncertainty for {self.kind}")
        if self.shared and self.kind != "random_forest":
            raise ValueError(f"{self.kind} is not grown as a shared forest")
        calibrated = self.method == "conformal" or (self.method == "quantile" and self.kind != "hist")
        if calibrated and calibration is None:
            raise ValueError(f"{self.method} uncertainty is calibrated on rows of its own")
        self.names, self.trees = names, None
        if self.kind in SHARED:
            self.fitted = fit_together(df.withColumn("setting", F.lit(0)), names, {s.name: s for s in SHARED[self.kind](self.options)})[0]
        elif self.shared:
            asked, data = KINDS[self.kind](self.options), df.withColumn("setting", F.lit(0)).persist()
            edges = trees.bin_edges(data, names)
            rows = trees.binned(data, names, edges).persist()
            spec = trees.Spec("point", tuple(range(len(names))), trees=asked.getNumTrees(), depth=asked.getMaxDepth(), seed=asked.getSeed())
            self.fitted = {"point": trees.forest(rows, spec, names, edges)}
            rows.unpersist()
            data.unpersist()
        else:
            regressor = KINDS[self.kind](self.options)
            self.model = PipelineModel([VectorAssembler(inputCols=names, outputCol="features"), regressor.fit(VectorAssembler(inputCols=names, outputCol="features").transform(df.select("y", *names)))])
        if calibrated:
            held = self._point(calibration).withColumn("r", F.abs(F.col("y") - F.col("v_pred"))).withColumn("g", F.lit(0))
            row = conformal_quantile(held.select("g", "r"), "r", ["g"]).first()
            self.q_hat = float(row["q_hat"]) if row else 0.5
            spread = held.withColumn("b", F.least(F.floor("v_pred"), F.lit(45))).groupBy("b").agg(F.percentile_approx(F.col("y") - F.col("v_pred"), F.array(F.lit(0.05), F.lit(0.95)), 10000).alias("q")).collect()  # 46 bins at most
            of = {int(r["b"]): r["q"][1] - r["q"][0] for r in spread}
            self.bins = [float(of.get(k, 2 * self.q_hat)) for k in range(46)]
        return self

    def _shared(self, df: DataFrame) -> DataFrame:
        """v_pred, and the quantiles where there are such models, from the features' values."""
        sent = df.sparkSession.sparkContext.broadcast({n: m.light() for n, m in self.fitted.items()})

        @F.pandas_udf(", ".join(f"{n} double" for n in self.fitted))
        def of(x: pd.Series) -> pd.DataFrame:
            m = sent.value
            codes = trees.codes_of(np.stack(x.to_numpy()).astype(float), m["point"].edges) if len(x) else np.zeros((0, len(m["point"].names)), np.uint8)
            return pd.DataFrame({n: np.maximum(one.of(codes), 0.0) for n, one in m.items()})

        out = df.withColumn("_p", of(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.names])))
        return out.withColumns({"v_pred" if n == "point" else f"v_{n}": F.col(f"_p.{n}") for n in self.fitted}).drop("_p")

    def _point(self, df: DataFrame) -> DataFrame:
        if self._is_shared:
            return self._shared(df)
        return self.model.transform(df).withColumn("v_pred", F.greatest("prediction", F.lit(0.0))).drop("prediction")

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with v_pred and v_std."""
        if self.method == "ensemble":
            return self._over_trees(df)
        out = self._point(df)
        if self.method == "conformal":
            return out.withColumn("v_std", F.lit(max(0.10, self.q_hat / 1.645))).drop("features")
        if self.kind == "hist":
            return out.withColumn("v_std", F.greatest(F.col("v_q95") - F.col("v_q5"), F.lit(0.10)) / (2 * 1.645))
        spread = F.get(F.array(*[F.lit(b) for b in self.bins]), F.least(F.floor("v_pred"), F.lit(45)).cast("int"))
        return out.withColumn("v_std", F.greatest(spread, F.lit(0.10)) / (2 * 1.645)).drop("features")

    def _over_trees(self, df: DataFrame) -> DataFrame:
        """Mean and deviation over a forest's trees, in one pass over broadcast trees rather than a transformer for each."""
        if self.trees is None and not self.shared:
            self.trees = [_nodes(t.toDebugString) for t in self.model.stages[1].trees]  # text of the model's size
        shared, names = self.shared, self.names
        sent = df.sparkSession.sparkContext.broadcast(self.fitted["point"].light() if shared else self.trees)

        @F.pandas_udf("v_pred double, v_std double")
        def over(x: pd.Series) -> pd.DataFrame:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(names)))
            if shared:
                got = sent.value.each(trees.codes_of(rows.astype(float), sent.value.edges)) if len(rows) else np.zeros((1, 0))
            else:
                got = np.stack([_walk(t, rows) for t in sent.value]) if len(rows) else np.zeros((1, 0))
            return pd.DataFrame({"v_pred": np.maximum(got.mean(0), 0.0), "v_std": np.maximum(got.std(0), 0.05)})

        out = df.withColumn("_p", over(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) if shared else F.col(c).cast("double") for c in names])))
        return out.withColumn("v_pred", F.col("_p.v_pred")).withColumn("v_std", F.col("_p.v_std")).drop("_p")

    def evaluate(self, df: DataFrame) -> dict:
        p = self.predict(df).select("y", "v_pred", "v_std", F.abs(F.col("y") - F.col("v_pred")).alias("e")).persist()
        out = p.agg(*regression(F.col("y"), F.col("v_pred"))[:3], F.avg("v_std").alias("mean_std")).first().asDict()
        places = metrics.exact_percentiles(p, "e", [], {"medae": 0.5, "p95": 0.95}).first()
        p.unpersist()
        return out | (places.asDict() if places else {"medae": None, "p95": None})

    def importances(self, top: int | None = None) -> list[tuple[str, float]]:
        shares = self.fitted["point"].importances().items() if self._is_shared else zip(self.names, self.model.stages[1].featureImportances.toArray().tolist(), strict=True)
        got = sorted(shares, key=lambda x: (-x[1], x[0]))
        return got[:top]

    def schema_json(self) -> str:
        """What an embedding of the model needs to know."""
        return json.dumps({"features": self.names, "model_type": self.kind, "num_features": len(self.names)})

    def save(self, spark: SparkSession, path: str) -> None:
        if self._is_shared:
            spark.createDataFrame([(n, json.dumps(m.packed())) for n, m in self.fitted.items()], "name string, model string").write.mode("overwrite").parquet(f"{path}/trees")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        side = json.dumps({"kind": self.kind, "method": self.method, "options": self.options, "names": self.names, "q_hat": self.q_hat, "bins": self.bins, "shared": self.shared})
        spark.createDataFrame([(side,)], "value string").write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SpeedModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        if about["kind"] in SHARED or about.get("shared"):
            return SpeedModel(fitted={r["name"]: trees.Ensemble.unpacked(json.loads(r["model"])) for r in spark.read.parquet(f"{path}/trees").collect()}, **about)
        return SpeedModel(model=PipelineModel.load(f"{path}/model"), **about)

    def size_kb(self, spark: SparkSession, path: str) -> float:
        """Size of a saved model."""
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() / 1024


def _nodes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, threshold or value, left, right) of the nodes of a tree of numeric splits, from its description, which lists them in pre-order."""
    feature, value, left, right, open_ = [], [], [], [], []
    for line in text.splitlines()[1:]:
        word = line.split()
        if word[0] == "Else":
            right[open_.pop()] = len(feature)
            continue
        split = word[0] == "If"
        feature.append(int(word[2]) if split else -1)
        value.append(float(word[4].rstrip(")") if split else word[1]))
        left.append(len(feature) if split else 0)
        right.append(0)
        if split:
            open_.append(len(feature) - 1)
    return np.array(feature), np.array(value), np.array(left), np.array(right)


def _walk(tree: tuple, rows: np.ndarray) -> np.ndarray:
    """A tree's prediction for each row: all rows go down a level at a time."""
    feature, value, left, right = tree
    at, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
    while len(live):
        live = live[feature[at[live]] >= 0]
        k = at[live]
        at[live] = np.where(rows[live, feature[k]] <= value[k], left[k], right[k])
    return value[at]


def _specs_of(names: list[str], wanted: dict[str, trees.Spec]) -> list[trees.Spec]:
    return [replace(spec, name=k, features=spec.features or tuple(range(len(names)))) for k, spec in wanted.items()]


def fit_together(train: DataFrame, names: list[str], wanted: dict[str, trees.Spec], group: str | None = None) -> tuple[dict[str, trees.Ensemble], dict]:
    """All models of ``wanted`` from rows (drive_id, rn, y, ``names``, setting) whose features are binned once; and the bins' edges. A spec without features has all."""
    edges = trees.bin_edges(train, names)
    data = trees.binned(train, names, edges, group).persist()
    out = trees.fit(data, _specs_of(names, wanted), names, edges)
    data.unpersist()
    return out, edges


FOREST = trees.Spec("forest", (), "forest", trees=100, depth=12)
BOOSTED = trees.Spec("boosted", (), "second_order", trees=100, depth=6, step=0.08, l2=1.0)


def leave_one_out(df: DataFrame, names: list[str], key: str = "driver_id", spec: trees.Spec = replace(FOREST, depth=10)) -> DataFrame:
    """For each value of ``key`` (few: drivers), metrics on its rows of a model fitted on all others; all folds' trees grow together."""
    spark, df = df.sparkSession, df.withColumn("setting", F.lit(0)).persist()
    folds = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).collect()]
    fitted, edges = fit_together(df, names, {f"fold{k}": replace(spec, held=v) for k, v in enumerate(folds)}, key)
    p = trees.predictions(trees.binned(df, names, edges, key), fitted, ["grp", "y"], held=True)
    own = F.coalesce(*[F.when(F.col("grp") == v, F.col(f"p_fold{k}")) for k, v in enumerate(folds)])
    out = p.where(F.col("grp").isNotNull()).groupBy(F.col("grp").alias(key)).agg(F.count("*").alias("n"), *regression(F.col("y"), own)[:3]).orderBy(key).collect()
    df.unpersist()
    return spark.createDataFrame([(r[key], r["n"], r["mae"], r["rmse"], r["r2"]) for r in out], f"{key} string, n long, mae double, rmse double, r2 double")


def permutation_importance(model: trees.Ensemble, df: DataFrame, names: list[str] | None = None, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Rise of the MAE when one feature's values are dealt out anew among rows: mean and deviation over repeats.

    A repeat pairs each row with another one, by a join of two rankings in buckets, one of them by a hash, so no column is gathered. Within a batch, features take the other row's bins in turn, and
    only rows that turn off at a split on the feature walk on, from there: rows are never multiplied by features.
    """
    spark, wanted = df.sparkSession, names or [model.names[f] for f in model.spec.features]
    rows = trees.binned(df.withColumn("setting", F.lit(model.spec.setting)), model.names, {model.spec.setting: model.edges}).select("k", "y", "b").where("y is not null").persist()
    each = rows.withColumn("repeat", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
    buckets = 1 + rows.count() // 50_000  # few rows of a bucket would be paired with themselves
    each = each.withColumn("bucket", F.pmod(F.xxhash64("k", "repeat", F.lit(seed)), F.lit(buckets)))
    rank = lambda *by: F.row_number().over(W.partitionBy("repeat", "bucket").orderBy(*by))
    each = each.withColumn("i", rank("k", "y")).withColumn("j", rank(F.xxhash64("k", "repeat", F.lit(seed + 1)), F.col("y")))
    dealt = each.select("repeat", "bucket", "i", "y", "b").join(each.select("repeat", "bucket", F.col("j").alias("i"), F.col("b").alias("z")), ["repeat", "bucket", "i"])
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "repeat", "bucket", "i")  # heavy in work, not in bytes: a bucket has a repeat's rows
    sent, places = spark.sparkContext.broadcast(model), [model.names.index(c) for c in wanted]

    def swap(batches):
        m = sent.value
        walks, at = m.walks(), np.full(len(m.names), -1)
        at[places] = np.arange(len(places))
        for b in batches:
            codes, other = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("b", "z"))
            y, repeat = b.column("y").to_numpy(), b.column("repeat").to_numpy()
            shape = (lambda total: m.base + (total if m.spec.boosted else total / max(len(walks), 1)))
            plain = m.each(codes).sum(0)
            change = np.zeros((len(places), b.num_rows))
            for w in walks:
                rows, f, more = w.moved(codes, other)
                use = at[f] >= 0
                change[at[f[use]], rows[use]] += more[use]  # a row once for each feature
            gains = np.abs(y - np.maximum(shape(plain + change), 0.0)) - np.abs(y - np.maximum(shape(plain), 0.0))
            for r in np.unique(repeat):
                use = repeat == r
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(places)), pa.int32()), pa.array(np.full(len(places), r), pa.int32()), pa.array(gains[:, use].sum(1)), pa.array(np.full(len(places), use.sum()), pa.int64())], ["f", "repeat", "s", "n"])

    per = dealt.mapInArrow(swap, "f int, repeat int, s double, n long").groupBy("f", "repeat").agg((F.sum("s") / F.sum("n")).alias("gain"))
    of = per.groupBy("f").agg(F.avg("gain").alias("m"), F.stddev_pop("gain").alias("s")).collect()  # a row for each feature
    rows.unpersist()
    got = {r["f"]: (r["m"], r["s"]) for r in of}
    return spark.createDataFrame([(c, *got.get(k, (0.0, 0.0))) for k, c in enumerate(wanted)], "feature string, importance_mean double, importance_std double")


def _over_drives(predicted: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """MAE, RMSE and R2 as means over drives."""
    per = predicted.groupBy("drive_id", *by).agg(*regression(F.col("y"), F.col(p))[:3])
    return per.groupBy(*by).agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"))


def window_sweep(train: DataFrame, test: DataFrame, seconds=(0.5, 1.0, 1.5, 2.0, 3.0), spec: trees.Spec = FOREST) -> DataFrame:
    """For each window length a forest on all features of ``train``'s drives, with its metrics on those of ``test``."""
    of = lambda drives, k: features.features(drives, window_sec=seconds[k]).withColumn("setting", F.lit(k))
    fitted, edges, counts, names = {}, {}, {}, []
    for k in range(len(seconds)):
        f = of(train, k).persist()  # of one length at a time, as features take eight times the room of their bins
        names = features.subset([c for c in f.columns if c != "setting"], "all")
        one, own = fit_together(f, names, {f"s{k}": replace(spec, setting=k)})
        fitted, edges, counts = fitted | one, edges | own, counts | {k: f.count()}
        f.unpersist()
    tested = reduce(DataFrame.unionByName, [of(test, k) for k in range(len(seconds))])
    p = trees.predictions(trees.binned(tested, names, edges), fitted, ["drive_id", "setting", "y"])
    got = {r["setting"]: r for r in _over_drives(p.withColumn("p", F.coalesce(*[F.col(f"p_{n}") for n in fitted])), ["setting"]).collect()}
    out = [(float(s), len(names), counts.get(k, 0), *((got[k]["mae"], got[k]["rmse"], got[k]["r2"]) if k in got else (None,) * 3)) for k, s in enumerate(seconds)]
    return train.sparkSession.createDataFrame(out, "window_sec double, n_features int, train_windows long, mae double, rmse double, r2 double")


def feature_ablation(train: DataFrame, test: DataFrame, spec: trees.Spec = BOOSTED) -> DataFrame:
    """For each subset of the features boosted trees on ``train``'s windows, with their metrics on ``test``'s. A round of all subsets is one job."""
    names = features.subset(train.columns, "all")
    own = {kind: features.subset(names, kind) for kind in features.SUBSETS}
    fitted, edges = fit_together(train.withColumn("setting", F.lit(0)), names, {kind: replace(spec, features=tuple(names.index(c) for c in cols)) for kind, cols in own.items()})
    p = trees.predictions(trees.binned(test.withColumn("setting", F.lit(0)), names, edges), fitted, ["drive_id", "y"]).persist()
    got = [(kind, len(own[kind]), *_over_drives(p, [], f"p_{kind}").first()) for kind in own]
    p.unpersist()
    return train.sparkSession.createDataFrame(got, "subset string, n_features int, mae double, rmse double, r2 double")


# fixed values: deviations of the noise on acc_x, acc_y and on gyro_z, constant errors of both, and the share of windows lost
NOISE_ACC, NOISE_GYRO, BIAS_ACC, BIAS_GYRO, LOST = 0.05, 0.01, 0.15, 0.02, 0.05


def perturb(df: DataFrame, case: str, seed: int = 42) -> DataFrame:
    """Sensor faults, seeded: clean, noise, acc_bias, gyro_bias; dropout leaves the samples as they are (``lose_windows`` takes windows)."""
    noise = lambda c, s, k: (F.col(c) + F.randn(seed + k) * s).alias(c)
    if case == "noise":
        return df.withColumns({"acc_x": noise("acc_x", NOISE_ACC, 0), "acc_y": noise("acc_y", NOISE_ACC, 1), "gyro_z": noise("gyro_z", NOISE_GYRO, 2)})
    if case == "acc_bias":
        return df.withColumns({"acc_x": F.col("acc_x") + BIAS_ACC, "acc_y": F.col("acc_y") + BIAS_ACC})
    if case == "gyro_bias":
        return df.withColumn("gyro_z", F.col("gyro_z") + BIAS_GYRO)
    if case in ("clean", "dropout"):
        return df
    raise ValueError(f"unknown case {case!r}")


def lose_windows(windows: DataFrame, share: float = LOST, seed: int = 42) -> DataFrame:
    """``windows`` without a share of them that a hash of drive and row chooses."""
    return windows.where(F.pmod(F.xxhash64("drive_id", "rn", F.lit(seed)), F.lit(1_000_000)) >= share * 1_000_000)


def on_rows(drives: DataFrame, predicted: DataFrame) -> DataFrame:
    """``drives`` with ai_speed and ai_speed_std on all rows, from v_pred and v_std of ``predicted`` at window ends; both are keyed by drive and row."""
    return motion.dense_speed(drives.join(predicted.select("drive_id", "rn", "v_pred", "v_std"), ["drive_id", "rn"], "left"))


def navigate(drives: DataFrame, predicted: DataFrame, start: float = 60.0, end: float | None = None, settle: float = 8.0, scale: float = 1.0) -> DataFrame:
    """The drive level: metrics per drive of naive, model and fused trajectories, with the model's speeds of ``predicted`` in place of a meter's."""
    return metrics.drive_metrics(trajectories(drives, predicted, start, end, scale), {"naive": ("pos_error_m", "pos_error_m"), "ai": ("ai_pos_error_m", "ai_pos_error_m"), "fused": ("fused_pos_error_m", "open_loop_error_m")}, settle)


def trajectories(drives: DataFrame, predicted: DataFrame, start: float = 60.0, end: float | None = None, scale: float = 1.0) -> DataFrame:
    """``drives`` with naive, model and fused trajectories."""
    df = metrics.outage(motion.ai_dead_reckoning(on_rows(motion.naive(drives), predicted)), start, end)
    df = df.withColumn("style", context.driver_style(F.first("driver_id").over(so_far())))
    return ekf.fuse(ekf.with_context(df, scale=scale))


def robustness(model: SpeedModel, drives: DataFrame, cases=("clean", "noise", "acc_bias", "gyro_bias", "dropout"), **outage) -> DataFrame:
    """For each sensor fault the model's MAE on features of the disturbed sensors, as a mean over drives, and the exit error of the filter that is fed its speeds.

    The filter's own sensors are undisturbed, so what changes is what the model makes of its features.
    """
    out, predicted = None, {}
    for case in cases:
        of = "clean" if case == "dropout" else case  # the same samples, with fewer windows
        if of not in predicted:
            predicted[of] = model.predict(features.features(perturb(drives, of))).select("drive_id", "rn", "y", "v_pred", "v_std").persist()
        p = lose_windows(predicted[of]) if case == "dropout" else predicted[of]
        mae = p.groupBy("drive_id").agg(F.avg(F.abs(F.col("y") - F.col("v_pred"))).alias("mae"))
        one = navigate(drives, p, **outage).join(mae, "drive_id").agg(F.lit(case).alias("case"), F.avg("mae").alias("mae"), F.avg("fused_exit").alias("exit_mean"), F.stddev_pop("fused_exit").alias("exit_std"), F.avg("fused_rmse").alias("rmse_mean"))
        out = one if out is None else out.unionByName(one)
    return out


def latency_ms(model: SpeedModel, drives: DataFrame) -> dict[str, float]:
    """Wall milliseconds a window: of its features, and of features and prediction."""
    n = features.features(drives).count()
    took = {}
    for name, df in (("features", features.features(drives)), ("end_to_end", model.predict(features.features(drives)))):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took[name] = 1000 * (time.perf_counter() - began) / max(n, 1)
    return took
