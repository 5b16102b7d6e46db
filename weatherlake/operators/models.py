"""Forecast models whose fitting and scoring are table jobs (O-ML-01..10)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from weatherlake.functions.stats import z
from weatherlake.operators.ranks import exact_quantiles
from weatherlake.session import materialise

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def q_name(q: float) -> str:
    return f"q{round(q * 100):02d}"


def persistence(train: DataFrame, test: DataFrame, keys: Sequence[str], order: Sequence[str], y: str) -> DataFrame:
    """The last training value, repeated for every row and quantile."""
    last = train.groupBy(*keys).agg(F.max_by(y, F.struct(*order)).alias("yhat"))
    return test.join(last, list(keys), "left").withColumns({q_name(q): F.col("yhat") for q in QUANTILES})


def climatology_forecast(
    train: DataFrame, test: DataFrame, keys: Sequence[str], ts: str, y: str, shift: bool = False
) -> DataFrame:
    """Day-of-year mean, mean of daily means for unseen days; normal quantiles from the day's deviation.

    With ``shift`` the last training anomaly is added. Days never seen use a deviation of 1.
    """
    train = train.withColumn("doy", F.dayofyear(ts))
    clim = train.groupBy(*keys, "doy").agg(
        F.avg(y).alias("_m"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("_s"),
        F.max(ts).alias("_last"),
        F.max_by(y, ts).alias("_last_y"),
    )
    base = clim.groupBy(*keys).agg(
        F.avg("_m").alias("_fallback"), F.max_by(F.col("_last_y") - F.col("_m"), "_last").alias("_shift")
    )
    out = (
        test.withColumn("doy", F.dayofyear(ts))
        .join(clim.drop("_last", "_last_y"), [*keys, "doy"], "left")
        .join(base, list(keys), "left")
    )
    yhat = F.coalesce("_m", "_fallback") + (F.col("_shift") if shift else F.lit(0.0))
    sd = F.coalesce("_s", F.lit(1.0))
    out = out.withColumn("yhat", yhat)
    return out.withColumns({q_name(q): F.col("yhat") + sd * z(q) for q in QUANTILES}).drop(
        "doy", "_m", "_s", "_fallback", "_shift"
    )


def rmse_by_model(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pred`` is long: keys, model, y, yhat."""
    e = F.col("y") - F.col("yhat")
    return pred.groupBy(*keys, "model").agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def bma_weights(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Softmax of minus RMSE over the models of a key."""
    w = Window.partitionBy(*keys)
    e = F.exp(-(F.col("rmse") - F.min("rmse").over(w)))
    r = rmse_by_model(pred, keys).withColumn("_e", e)
    return r.select(*keys, "model", "rmse", (F.col("_e") / F.sum("_e").over(w)).alias("weight"))


def blend(pred: DataFrame, weights: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Weighted forecast per row and the population deviation between models."""
    j = pred.join(weights.select(*keys, "model", "weight"), [*keys, "model"])
    return j.groupBy(*keys, *row).agg(
        (F.sum(F.col("weight") * F.col("yhat")) / F.sum("weight")).alias("blended"),
        F.stddev_pop("yhat").alias("inter_model_std"),
    )


def blend_quantiles(pred_q: DataFrame, weights: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """``pred_q`` is long: keys, row, model, q, value."""
    j = pred_q.join(weights.select(*keys, "model", "weight"), [*keys, "model"])
    return j.groupBy(*keys, *row, "q").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))


def reweight(history: DataFrame, current: DataFrame, keys: Sequence[str], decay: float = 0.9) -> DataFrame:
    """Blend weights from past skill (exp of minus rmse, normalised) with current ones; rank by current RMSE."""
    w = Window.partitionBy(*keys)
    h = history.select(*keys, "model", F.exp(-F.col("rmse")).alias("_h")).select(
        *keys, "model", (F.col("_h") / F.sum("_h").over(w)).alias("_h")
    )
    b = current.join(h, [*keys, "model"]).withColumn(
        "_b", F.col("_h") * decay + F.col("weight") * (1 - decay)
    )
    return b.select(
        *keys,
        "model",
        (F.col("_b") / F.sum("_b").over(w)).alias("weight"),
        F.rank().over(w.orderBy("rmse", "model")).alias("rank"),
    )


def moment_columns(x: Sequence[str], y: str) -> list[Column]:
    """Sums that determine a least-squares fit: n, means and all products, as one array column."""
    cols = [F.col(c) for c in x] + [F.col(y)]
    prods = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]
    return [F.array(F.count("*").cast("double"), *[F.sum(c) for c in cols], *prods).alias("moments")]


def _unpack(m: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    n, s = m[0], m[1 : k + 2]
    full = np.zeros((k + 1, k + 1))
    full[np.triu_indices(k + 1)] = m[k + 2 :]
    return n, s, full + np.triu(full, 1).T


def linear_solver(k: int, ridge: float = 0.0, centred: bool = True):
    """Arrow UDF: moments -> [intercept, coefficients]; each row is one group's k x k system.

    ``centred`` is ordinary least squares. Otherwise the slopes come from the raw products with a ridge
    term and the intercept is mean(y) - mean(x).b, the stacking rule.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(moments: pd.Series) -> pd.Series:
        out = []
        for m in moments:
            n, s, p = _unpack(np.asarray(m, float), k)
            if centred:
                p = p - np.outer(s, s) / n
            a, b = p[:k, :k] + ridge * np.eye(k), p[:k, k]
            try:
                coef = np.linalg.solve(a, b)
            except np.linalg.LinAlgError:
                out.append(None)
                continue
            out.append([float(s[k] / n - s[:k] @ coef / n), *map(float, coef)])
        return pd.Series(out, dtype=object)

    return solve


def fit_linear(
    df: DataFrame, keys: Sequence[str], x: Sequence[str], y: str, ridge: float = 0.0, centred: bool = True
) -> DataFrame:
    """One linear model per key in a single aggregation pass over complete rows."""
    solve = linear_solver(len(x), ridge, centred)
    g = df.dropna(subset=[*x, y]).groupBy(*keys).agg(*moment_columns(x, y))
    return g.select(*keys, solve("moments").alias("coef"))


def apply_linear(df: DataFrame, fitted: DataFrame, keys: Sequence[str], x: Sequence[str], out: str = "yhat") -> DataFrame:
    value = F.col("coef")[0]
    for i, c in enumerate(x):
        value = value + F.col("coef")[i + 1] * F.col(c)
    return df.join(fitted, list(keys), "left").withColumn(out, value).drop("coef")


def direct_multi_step(
    df: DataFrame, keys: Sequence[str], ts: str, x: Sequence[str], y: str, steps: int
) -> DataFrame:
    """A model per key and horizon h, fitted on y shifted by h, applied to the last row (daily frame)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    leads = F.array(*[F.struct(F.lit(h).alias("h"), F.lead(y, h).over(w).alias("target")) for h in range(1, steps + 1)])
    long = df.withColumn("_l", leads).select(*keys, *x, F.inline("_l"))
    fitted = fit_linear(long, [*keys, "h"], x, "target")
    last = df.groupBy(*keys).agg(*[F.max_by(c, ts).alias(c) for c in x])
    every = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return apply_linear(every, fitted, [*keys, "h"], x).select(*keys, "h", "yhat")


def multi_output(df: DataFrame, keys: Sequence[str], ts: str, x: Sequence[str], y: str, steps: int) -> DataFrame:
    """All horizons fitted on the same rows: those whose every target up to ``steps`` is known."""
    w = Window.partitionBy(*keys).orderBy(ts)
    leads = F.array(*[F.struct(F.lit(h).alias("h"), F.lead(y, h).over(w).alias("target")) for h in range(1, steps + 1)])
    known = df.withColumn("_l", leads).withColumn("_ok", F.lead(y, steps).over(w).isNotNull()).filter("_ok")
    fitted = fit_linear(known.select(*keys, *x, F.inline("_l")), [*keys, "h"], x, "target")
    last = df.groupBy(*keys).agg(*[F.max_by(c, ts).alias(c) for c in x])
    every = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return apply_linear(every, fitted, [*keys, "h"], x).select(*keys, "h", "yhat")


_STEP = StructType(
    [StructField("values", ArrayType(DoubleType())), StructField("uncertainties", ArrayType(DoubleType()))]
)


def rollout(
    state: DataFrame,
    keys: Sequence[str],
    steps: int = 168,
    method: str = "recursive",
    momentum: float = 0.98,
    decay_rate: float = 0.01,
    blur_growth: float = 0.02,
    clip: tuple[float, float] | None = None,
) -> DataFrame:
    """Autoregressive rollout of one row per series: ``window`` (oldest first), ``coef``, ``anchor``.

    Each step depends on the last, so the step loop is sequential; it runs over all series of an Arrow
    batch at once. Output: keys, step, value, uncertainty.
    """

    @F.pandas_udf(_STEP)
    def roll(window: pd.Series, coef: pd.Series, anchor: pd.Series) -> pd.DataFrame:
        x = np.vstack(window.to_numpy()).astype(float)
        c = np.vstack(coef.to_numpy()).astype(float)
        a = anchor.to_numpy(float).copy()
        got = np.empty((len(x), steps))
        smooth = None
        for h in range(steps):
            raw = c[:, 0] + np.einsum("ij,ij->i", x, c[:, 1:])
            if method == "momentum":
                a = np.where(np.isnan(a), raw, a)
                smooth = raw if smooth is None else smooth
                smooth = momentum * smooth + (1 - momentum) * raw
                raw = smooth + (a - smooth) * (1 - np.exp(-decay_rate * (h + 1)))
            if clip is not None:
                raw = np.clip(raw, *clip)
            got[:, h] = raw
            x = np.hstack([x[:, 1:], raw[:, None]])
        blur = [blur_growth * (h + 1) for h in range(steps)]
        return pd.DataFrame({"values": list(got), "uncertainties": [blur] * len(got)})

    r = state.withColumn("_r", roll("window", "coef", F.col("anchor").cast("double")))
    return r.select(*keys, F.posexplode(F.arrays_zip("_r.values", "_r.uncertainties")).alias("step", "_v")).select(
        *keys, (F.col("step") + 1).alias("step"), F.col("_v.values").alias("value"), F.col("_v.uncertainties").alias("uncertainty")
    )


def optimise_threshold(df: DataFrame, keys: Sequence[str], score: str, y: str, metric: str = "f1") -> DataFrame:
    """Best of 201 thresholds in [0, 1], the first best winning.

    Rows are counted once per grid cell; the sums over scores >= threshold then run on at most 202
    rows per key.
    """
    step = 0.005
    k = F.floor(F.col(score) / step)
    k = F.when(k * step > F.col(score), k - 1).when((k + 1) * step <= F.col(score), k + 1).otherwise(k)
    cell = F.least(F.greatest(k, F.lit(-1)), F.lit(200)).cast("int")
    got = (
        df.dropna(subset=[score, y])
        .groupBy(*keys, cell.alias("k"))
        .agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_q"))
    )
    every = got.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(200))))
    full = every.join(got, [*keys, "k"], "left").fillna(0, ["_p", "_q"])
    above = Window.partitionBy(*keys).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    t = full.select(
        *keys,
        "k",
        F.sum("_p").over(above).alias("tp"),
        F.sum("_q").over(above).alias("fp"),
        F.sum("_p").over(whole).alias("pos"),
        F.sum("_q").over(whole).alias("neg"),
    ).filter("k >= 0")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp")
    tiny = F.lit(1e-12)
    prec, rec = tp / F.greatest(tp + fp, tiny), tp / F.greatest(tp + fn, tiny)
    value = {
        "accuracy": (tp + F.col("neg") - fp) / F.greatest(F.col("pos") + F.col("neg"), F.lit(1.0)),
        "precision": prec,
        "recall": rec,
        "f1": 2 * prec * rec / F.greatest(prec + rec, tiny),
    }[metric]
    t = t.withColumn("score", value)
    return t.groupBy(*keys).agg(
        (F.max_by("k", F.struct("score", -F.col("k"))) * step).alias("threshold"), F.max("score").alias("score")
    )


def weighted_ensemble(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of members with normal quantiles from their sample deviation."""
    g = df.groupBy(*keys).agg(
        (F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("member_std"),
    )
    sd = F.greatest(F.col("member_std"), F.lit(1e-12))
    return g.withColumns({q_name(q): F.col("mean") + sd * z(q) for q in QUANTILES})


def boosted_fit(
    train: DataFrame,
    validation: DataFrame,
    x: Sequence[str],
    targets: Sequence[str],
    rounds: int = 1000,
    depth: int = 6,
    rate: float = 0.05,
    patience: int = 50,
    sample: float = 0.8,
    stage: int = 70,
) -> dict[str, Boosted]:
    """One gradient-boosted model per target (MLlib), stopped by its loss on ``validation``.

    Trees are grown in stages of ``stage``, 2 ``stage``, ... rounds, up to ``rounds``. After a stage the loss of every
    prefix of the tree sequence is taken on the validation part; when the best one is more than ``patience`` rounds
    old, growing ends, and the model keeps the trees of the best prefix only. MLlib's own stop ends at the first
    round without gain and would keep what came before a plateau.

    MLlib follows twice the residual under squared loss, so half the rate is its step; the first tree has full weight.
    Rows and (per node) features are sampled at ``sample``.
    """
    out = {}
    share = "all" if sample >= 1 else str(sample)
    for y in targets:
        assemble = VectorAssembler(inputCols=list(x), outputCol="_features", handleInvalid="skip")
        fit_on, test_on = (assemble.transform(d.dropna(subset=[*x, y])).select("_features", F.col(y).cast("double").alias(y)) for d in (train, validation))
        fit_on, test_on = materialise(fit_on, "boost-train"), materialise(test_on, "boost-validation")
        n = min(stage, rounds)
        while True:
            grown = GBTRegressor(
                featuresCol="_features", labelCol=y, predictionCol="yhat", maxIter=n, maxDepth=depth, stepSize=rate / 2,
                subsamplingRate=sample, featureSubsetStrategy=share, seed=7,
            ).fit(fit_on)
            losses = grown.evaluateEachIteration(test_on, "squared")
            best = min(range(n), key=losses.__getitem__)
            if n == rounds or n - 1 - best >= patience:
                break
            n = min(2 * n, rounds)
        out[y] = Boosted(assemble, first_trees(grown, best + 1), best + 1, n, losses)
    return out


@dataclass(frozen=True)
class Boosted:
    """Assembler, the model of the best prefix, its number of trees, the trees grown, and the loss of every prefix."""

    assemble: VectorAssembler
    trees: GBTRegressionModel
    kept: int
    grown: int
    losses: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(self.assemble.transform(df))


def first_trees(model: GBTRegressionModel, k: int) -> GBTRegressionModel:
    """The model made of the first ``k`` trees of a sequence."""
    spark = SparkSession.getActiveSession()
    ml = spark._jvm.org.apache.spark.ml.regression
    java = model._java_obj
    trees = spark._sc._gateway.new_array(ml.DecisionTreeRegressionModel, k)
    weights = spark._sc._gateway.new_array(spark._jvm.double, k)
    for i in range(k):
        trees[i], weights[i] = java.trees()[i], float(model.treeWeights[i])
    cut = GBTRegressionModel(ml.GBTRegressionModel(java.uid(), trees, weights))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def feature_importance(spark, models: dict[str, Boosted], x: Sequence[str]) -> DataFrame:
    """Normalised, ranked importances: one row per target and feature, with the number of trees kept."""
    rows = []
    for target, m in models.items():
        v = m.trees.featureImportances.toArray()
        total = v.sum() or 1.0
        ranked = sorted(zip(x, v / total, strict=True), key=lambda t: -t[1])
        rows += [(target, i + 1, name, float(s), m.kept) for i, (name, s) in enumerate(ranked)]
    return spark.createDataFrame(rows, "target string, rank int, feature string, importance double, trees int")


def boosted_predict(model: Boosted, df: DataFrame, residuals: DataFrame | None, bucket: str, y: str) -> DataFrame:
    """Point forecasts plus quantiles: the forecast shifted by residual quantiles of its bucket.

    MLlib has no quantile loss; empirical residual quantiles stand in for it.
    """
    p = model.transform(df).drop("_features")
    if residuals is None:
        return p
    r = residuals.withColumn("_res", F.col(y) - F.col("yhat"))
    q = exact_quantiles(r, [bucket], "_res", {f"_{q_name(v)}": v for v in QUANTILES})
    j = p.join(q, bucket, "left")
    return j.withColumns({q_name(v): F.col("yhat") + F.col(f"_{q_name(v)}") for v in QUANTILES}).drop(
        *[f"_{q_name(v)}" for v in QUANTILES]
    )
