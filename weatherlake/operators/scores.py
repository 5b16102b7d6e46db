"""Forecast verification and ensemble diagnostics as grouped aggregates (O-VF-01..10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.operators.ranks import cumulative_counts, mean_rank_columns


def _pairs(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def point_scores(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """RMSE, MAE, bias and both MAPE forms; zero truths are left out of the MAPE."""
    e = F.col(p) - F.col(y)
    rel = F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y))))
    return (
        _pairs(df, y, p)
        .groupBy(*keys)
        .agg(
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            rel.alias("mape"),
            (rel * 100).alias("mape_pct"),
            F.avg(e).alias("bias"),
        )
    )


def anomaly_correlation(df: DataFrame, keys: Sequence[str], y: str, p: str, clim: str) -> DataFrame:
    """``acc`` against an external climatology (NULL when degenerate) and ``acc_centered`` about mean(y) (0)."""
    a, b = F.col(y) - F.col(clim), F.col(p) - F.col(clim)
    g = (
        _pairs(df, y, p, clim)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.sum(a * b).alias("ab"),
            F.sum(a * a).alias("aa"),
            F.sum(b * b).alias("bb"),
            F.avg(y).alias("my"),
            F.avg(p).alias("mp"),
            F.covar_pop(y, p).alias("cyp"),
            F.var_pop(y).alias("vy"),
            F.var_pop(p).alias("vp"),
        )
    )
    den = F.sqrt(F.col("aa") * F.col("bb"))
    shift = F.col("mp") - F.col("my")
    den_c = F.sqrt(F.col("vy") * (F.col("vp") + shift * shift))
    return g.select(
        *keys,
        F.when((F.col("n") >= 2) & (den >= 1e-15), F.col("ab") / den).alias("acc"),
        F.when(den_c > 0, F.col("cyp") / den_c).otherwise(0.0).alias("acc_centered"),
    )


def brier(df: DataFrame, keys: Sequence[str], p: str, o: str, climatology: float) -> DataFrame:
    ref = F.avg(F.pow(F.lit(climatology) - F.col(o), 2))
    g = _pairs(df, p, o).groupBy(*keys).agg(F.avg(F.pow(F.col(p) - F.col(o), 2)).alias("brier"), ref.alias("_ref"))
    return g.select(
        *keys, "brier", F.when(F.col("_ref") >= 1e-15, 1 - F.col("brier") / F.col("_ref")).alias("brier_skill")
    )


def edge_index(x: Column, bins: int) -> Column:
    """Bin of x under edges k * (1 / bins), comparing with the rounded edges themselves."""
    step = 1.0 / bins
    k = F.floor(x * bins)
    k = F.when(k * step > x, k - 1).when((k + 1) * step <= x, k + 1).otherwise(k)
    return k.cast("int")


def reliability(df: DataFrame, keys: Sequence[str], p: str, o: str, bins: int = 10) -> DataFrame:
    """Calibration bins; the last one is closed, empty bins show their centre, p outside [0, 1] is dropped."""
    inside = _pairs(df, p, o).filter(F.col(p).between(0.0, 1.0))
    got = (
        inside.withColumn("bin", F.least(edge_index(F.col(p), bins), F.lit(bins - 1)))
        .groupBy(*keys, "bin")
        .agg(F.avg(o).alias("_f"), F.avg(p).alias("_p"), F.count("*").alias("_n"))
    )
    every = got.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    centre = (F.col("bin") + 0.5) / bins
    return every.join(got, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        F.coalesce("_f", centre).alias("observed_freq"),
        F.coalesce("_p", centre).alias("predicted_prob"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str], p: str, o: str) -> DataFrame:
    """Rank-sum AUC with mean ranks for tied scores; NULL without both classes."""
    c = cumulative_counts(
        _pairs(df, p, o), keys, p, {"_n": F.lit(1), "_pos": (F.col(o) == 1).cast("int")}
    )
    g = c.groupBy(*keys).agg(
        F.sum(F.col("_pos") * mean_rank_columns()).alias("_rs"),
        F.sum("_pos").alias("_p"),
        (F.sum("_n") - F.sum("_pos")).alias("_q"),
    )
    auc = (F.col("_rs") - F.col("_p") * (F.col("_p") + 1) / 2.0) / (F.col("_p") * F.col("_q"))
    return g.select(*keys, F.when((F.col("_p") > 0) & (F.col("_q") > 0), auc).alias("auc"))


def discrimination(df: DataFrame, keys: Sequence[str], p: str, o: str, bins: int = 10) -> DataFrame:
    """Density histograms of the forecast probability for events and non-events."""
    inside = _pairs(df, p, o).filter(F.col(p).between(0.0, 1.0))
    g = (
        inside.withColumn("bin", F.least(edge_index(F.col(p), bins), F.lit(bins - 1)))
        .groupBy(*keys, "bin")
        .agg(F.count_if(F.col(o) == 1).alias("_e"), F.count_if(F.col(o) == 0).alias("_x"))
    )
    whole = Window.partitionBy(*keys)
    return g.select(
        *keys,
        "bin",
        (F.col("_e") * float(bins) / F.nullif(F.sum("_e").over(whole), F.lit(0))).alias("event_density"),
        (F.col("_x") * float(bins) / F.nullif(F.sum("_x").over(whole), F.lit(0))).alias("no_event_density"),
    )


def ensemble_crps(df: DataFrame, keys: Sequence[str], case: str, x: str, obs: str) -> DataFrame:
    """Mean CRPS per key over rows (case, member value, observation).

    The pairwise term is 2 * sum((2i - n - 1) x_(i)) over sorted members: O(n log n), no self-join.
    A case holds one row per member, so its window is bounded by the ensemble size.
    """
    w = Window.partitionBy(*keys, case).orderBy(x)
    n = F.count("*").over(Window.partitionBy(*keys, case))
    r = _pairs(df, x, obs).withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
    per_case = r.groupBy(*keys, case).agg(
        F.avg(F.abs(F.col(x) - F.col(obs))).alias("_a"),
        (F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col(x)) / F.pow(F.first("_n"), 2)).alias("_b"),
    )
    return per_case.groupBy(*keys).agg(F.avg(F.col("_a") - F.col("_b")).alias("crps"), F.count("*").alias("cases"))


def ensemble_spread(df: DataFrame, keys: Sequence[str], case: str, x: str) -> DataFrame:
    per_case = df.groupBy(*keys, case).agg(F.stddev_samp(x).alias("_s"))
    return per_case.groupBy(*keys).agg(F.avg("_s").alias("spread"))


def calibration_error(df: DataFrame, keys: Sequence[str], p: str, o: str, bins: int = 10) -> DataFrame:
    """Expected calibration error for 0/1 outcomes (outer bins absorb out-of-range p), else mean |p - o|."""
    b = F.least(F.greatest(edge_index(F.col(p), bins), F.lit(0)), F.lit(bins - 1))
    g = (
        _pairs(df, p, o)
        .groupBy(*keys, b.alias("_b"))
        .agg(
            F.count("*").alias("_w"),
            F.avg(p).alias("_p"),
            F.avg(o).alias("_o"),
            F.sum(F.abs(F.col(p) - F.col(o))).alias("_abs"),
            F.count_if(~F.col(o).isin(0, 1)).alias("_other"),
        )
    )
    weighted = F.sum(F.col("_w") * F.abs(F.col("_p") - F.col("_o"))) / F.sum("_w")
    plain = F.sum("_abs") / F.sum("_w")
    return g.groupBy(*keys).agg(F.when(F.sum("_other") == 0, weighted).otherwise(plain).alias("ece"))


def sharpness(df: DataFrame, keys: Sequence[str], q: str, value: str) -> DataFrame:
    """Last minus first quantile per key, NULL with fewer than two."""
    d = F.max_by(value, q) - F.min_by(value, q)
    return _pairs(df, value).groupBy(*keys).agg(F.when(F.count("*") >= 2, d).alias("sharpness"))


def coverage(df: DataFrame, keys: Sequence[str], lo: str, hi: str, obs: str) -> DataFrame:
    return (
        _pairs(df, lo, hi, obs)
        .groupBy(*keys)
        .agg(F.avg(F.col(obs).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"))
    )
