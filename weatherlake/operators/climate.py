"""Degree days, climatologies, anomalies and standardised precipitation (O-TS-08..21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.functions import stats, thermal
from weatherlake.operators.windows import daily, trailing


def degree_days(df: DataFrame, keys: Sequence[str], t: str, base: float = 18.3) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(thermal.hdd(F.col(t), base)).alias("hdd"), F.sum(thermal.cdd(F.col(t), base)).alias("cdd")
    )


def market_degree_days(df: DataFrame, keys: Sequence[str], t: str, base_f: float = 65.0) -> DataFrame:
    """Degree days in Fahrenheit; a daily series that never reaches 40 is read as Celsius."""
    top = F.max(t).over(Window.partitionBy(*keys))
    f = F.when(top < 40, thermal.to_fahrenheit(F.col(t))).otherwise(F.col(t))
    return df.withColumn("hdd_f", thermal.hdd(f, base_f)).withColumn("cdd_f", thermal.cdd(f, base_f))


def growing_degree_days(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(thermal.gdd(F.col(t))).alias("gdd"), F.sum(thermal.gdd_seasonal(F.col(t))).alias("gdd_season")
    )


def dry_day_fraction(
    df: DataFrame, keys: Sequence[str], ts: str, precip: str, threshold: float = 1.0, days: int = 30
) -> DataFrame:
    """Share of dry days in the trailing window; a missing value counts as not dry."""
    dry = F.coalesce(F.col(precip) < threshold, F.lit(False)).cast("double")
    return df.withColumn("dry_fraction", F.avg(dry).over(trailing(daily(keys, ts), days)))


def frost_days(df: DataFrame, keys: Sequence[str], t: str, threshold: float = 0.0) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col(t) <= threshold).alias("frost_days"), F.count("*").alias("days")
    )


def climatology(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Mean and sample deviation per key (0 with a single value); keys include the calendar position."""
    return df.groupBy(*keys).agg(
        F.avg(t).alias("clim_mean"), F.coalesce(F.stddev_samp(t), F.lit(0.0)).alias("clim_std")
    )


def anomaly(df: DataFrame, clim: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Departure from normal and z-score against a climatology; a deviation of 0 gives NULL."""
    dep = F.col(t) - F.col("clim_mean")
    sd = F.when(F.col("clim_std") > 0, F.col("clim_std"))
    return df.join(clim, list(keys), "left").withColumn("departure", dep).withColumn("zscore", dep / sd)


def day_of_year_anomaly(train: DataFrame, df: DataFrame, series: Sequence[str], ts: str, t: str) -> DataFrame:
    """Anomaly from the training day-of-year mean; a day without history uses the series' own mean."""
    clim = climatology(train.withColumn("doy", F.dayofyear(ts)), [*series, "doy"], t)
    grand = df.groupBy(*series).agg(F.avg(t).alias("_grand"))
    out = df.withColumn("doy", F.dayofyear(ts)).join(clim, [*series, "doy"], "left").join(grand, list(series), "left")
    out = out.withColumn("clim_mean", F.coalesce("clim_mean", "_grand")).drop("_grand")
    return out.withColumn("anomaly", F.col(t) - F.col("clim_mean"))


def split_label(ts: Column, train: tuple[int, int], val: int, test_from: int) -> Column:
    y = F.year(ts)
    return F.when(y.between(*train), "train").when(y == val, "val").when(y >= test_from, "test")


def scaler(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fitted mean and population deviation (0 becomes 1) per key and column."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_std") for c in columns],
    )


def standardise(df: DataFrame, fitted: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    j = df.join(fitted, list(keys), "left")
    for c in columns:
        j = j.withColumn(f"{c}_scaled", (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
    return j


def unstandardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse of ``standardise`` on a frame that still carries the fitted columns."""
    for c in columns:
        df = df.withColumn(f"{c}_restored", F.col(f"{c}_scaled") * F.col(f"{c}_std") + F.col(f"{c}_mean"))
    return df


def spi(
    df: DataFrame, keys: Sequence[str], ts: str, precip: str, days: int = 30, fit_days: int = 365
) -> DataFrame:
    """Standardised precipitation index from trailing data only (daily frame).

    The gamma fit needs only the count, mean and mean logarithm of the positive accumulations in the
    trailing fit window; those are window aggregates, and one Arrow batch step does the distribution.
    """
    w = daily(keys, ts)
    acc = df.withColumn("_acc", F.sum(precip).over(trailing(w, days)))
    pos = F.when(F.col("_acc") > 0, F.col("_acc"))
    f = trailing(w, fit_days)
    acc = acc.withColumns(
        {"_n": F.count(pos).over(f), "_mean": F.avg(pos).over(f), "_log": F.avg(F.log(pos)).over(f)}
    )
    ready = (F.col("_acc") > 0) & (F.col("_n") >= max(10, days))
    score = stats.fitted_gamma_score(
        F.when(ready, F.col("_acc")), F.when(ready, F.col("_mean")), F.when(ready, F.col("_log"))
    )
    acc = acc.withColumn("_score", score)
    return acc.withColumn("spi", F.when(F.col("_acc") <= 0, 0.0).otherwise(F.col("_score"))).drop(
        "_acc", "_n", "_mean", "_log", "_score"
    )


def drought_moments(df: DataFrame, keys: Sequence[str], ts: str, precip: str, days: int = 90) -> DataFrame:
    """Moments of full-window accumulations and the latest one, per key (daily frame)."""
    w = trailing(daily(keys, ts), days)
    full = df.withColumn("_acc", F.sum(precip).over(w)).withColumn("_rows", F.count("*").over(w))
    return (
        full.filter(F.col("_rows") == days)
        .groupBy(*keys)
        .agg(
            F.avg("_acc").alias("mean"),
            F.var_samp("_acc").alias("var"),
            F.max_by("_acc", ts).alias("latest"),
            F.count("*").alias("windows"),
        )
    )


def drought_index(df: DataFrame, keys: Sequence[str], ts: str, precip: str, days: int = 90) -> DataFrame:
    """Method-of-moments index of the latest window; degenerate moments give 0."""
    m = drought_moments(df, keys, ts, precip, days)
    usable = (F.col("windows") >= 2) & (F.col("mean") > 0) & (F.col("var") > 0)
    p = stats.gamma_probability(
        F.when(usable, F.col("latest")),
        F.when(usable, F.col("mean") * F.col("mean") / F.col("var")),
        F.when(usable, F.col("var") / F.col("mean")),
    )
    m = m.withColumn("_p", p)
    # a dry latest window has probability 0 and is clamped like any other tail
    clamped = thermal.clip(F.when(usable, F.coalesce("_p", F.lit(0.0))), 1e-6, 1 - 1e-6)
    return m.withColumn("drought_index", F.coalesce(stats.normal_quantile(clamped), F.lit(0.0))).drop("_p")
