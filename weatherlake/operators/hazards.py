"""Grouped hazard targets (O-HZ-01..20); point formulas live in ``functions``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherlake.functions import thermal
from weatherlake.operators.asof import asof

FREEZE_K = 273.15


def freeze_probability(
    df: DataFrame, keys: Sequence[str], day: str, t: str, method: str = "ensemble_mean", threshold: float = 0.0
) -> DataFrame:
    """Rows are (key, day, member); a day's ensemble is small, days are reduced in a second step."""
    d = df.groupBy(*keys, day).agg(
        F.avg((F.col(t) <= threshold).cast("double")).alias("_share"), F.percentile(t, F.lit(0.1)).alias("_q10")
    )
    value = {
        "ensemble_mean": F.avg("_share"),
        "quantile_10": F.avg((F.col("_q10") <= threshold).cast("double")),
        "worst_case": F.max("_share"),
    }[method]
    return d.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("freeze_probability"))


def diurnal_range(df: DataFrame, keys: Sequence[str], t_max: str, t_min: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(t_max) - F.col(t_min)).alias("diurnal_range"))


def precipitation_total(df: DataFrame, keys: Sequence[str], rate: str, hours: int) -> DataFrame:
    """Sum of evenly spaced rates times hours / (n - 1); a single step gives 0."""
    total = F.greatest(F.sum(rate) * F.lit(float(hours)) / (F.count("*") - 1), F.lit(0.0))
    return df.groupBy(*keys).agg(F.when(F.count("*") > 1, total).otherwise(0.0).alias("accumulation"))


def snow_probability(df: DataFrame, keys: Sequence[str], t: str, precip: str, threshold: float = 0.0) -> DataFrame:
    share = F.avg(F.when(F.col(precip) > 0, thermal.snow_share(F.col(t), threshold)))
    return df.groupBy(*keys).agg(F.coalesce(share, F.lit(0.0)).alias("snow_probability"))


def rain_day_probability(df: DataFrame, keys: Sequence[str], precip: str, threshold: float = 1.0) -> DataFrame:
    wet = F.coalesce(F.col(precip) >= threshold, F.lit(False)).cast("double")
    return df.groupBy(*keys).agg(F.avg(wet).alias("rain_day_probability"))


def earlier_value(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int, tie: str, out: str
) -> DataFrame:
    """The value known ``seconds`` before each row (as-of), for tendencies and 24-hour drops."""
    back = F.timestamp_micros(F.unix_micros(ts) - seconds * 1_000_000)
    r = df.select(*keys, ts, tie, F.col(value).alias(out))
    return asof(df, r, keys, back, F.col(ts), [out], tie=[tie], long=True)


def farm_output(df: DataFrame, keys: Sequence[str], power: str, capacity: str) -> DataFrame:
    """Sum of turbine power after wake losses, at most the farm's capacity."""
    return df.groupBy(*keys).agg(F.least(F.sum(power) * 0.78, F.max(capacity)).alias("farm_mw"))


def publish_time(date: Column, hour: int = 12, latency_minutes: int = 210) -> Column:
    return date.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(latency_minutes))


def cycle_features(
    cells: DataFrame, keys: Sequence[str], hour: int = 12, horizon_hours: int = 48, freeze_k: float = FREEZE_K
) -> DataFrame:
    """Per cycle: cold-cell share, minimum and first time of it within [publish, publish + horizon].

    ``keys`` include ``date``. Cells out of the horizon only count towards ``grid_cells`` and, when the
    horizon is empty, the minimum. All measures are partial aggregates of the cell rows.
    """
    pub = publish_time(F.col("date"), hour)
    x = cells.withColumn("publish_time", pub)
    end = F.col("publish_time") + F.make_dt_interval(hours=F.lit(horizon_hours))
    inside = (F.col("valid_time") >= F.col("publish_time")) & (F.col("valid_time") <= end)
    x = x.withColumn("_in", F.coalesce(inside, F.lit(False)))
    seen = F.when(F.col("_in") & F.col("t2m").isNotNull(), F.struct("t2m", "valid_time"))
    g = x.groupBy(*keys, "publish_time").agg(
        F.count_if(F.col("_in") & (F.col("t2m") < freeze_k)).alias("_cold"),
        F.count_if("_in").alias("horizon_cells"),
        F.count("*").alias("grid_cells"),
        F.min(seen).alias("_first"),
        F.min("t2m").alias("_any"),
        F.max(F.when(F.col("_in"), F.col("valid_time"))).alias("_latest"),
    )
    t_min = F.coalesce("_first.t2m", "_any")
    return g.select(
        *keys,
        "publish_time",
        F.coalesce("_first.valid_time", "_latest").alias("event_peak_time"),
        (t_min - FREEZE_K).alias("temperature_min"),
        (F.col("_cold") / F.greatest("horizon_cells", F.lit(1))).alias("freeze_prob"),
        t_min.alias("t2m_min_k"),
        "grid_cells",
        "horizon_cells",
    )


def worst_per_group(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias(out))


