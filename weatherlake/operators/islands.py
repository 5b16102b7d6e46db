"""Runs of consecutive rows (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.operators.windows import daily, running


def mark_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, long: bool = False
) -> DataFrame:
    """Add ``_flag`` and ``_run``: the number of unflagged rows so far, constant inside a run.

    Without ``long`` the frame must be daily; with it, raw rows of any length are scanned in ranges.
    """
    df = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    off = F.when(F.col("_flag"), 0).otherwise(1)
    if not long:
        w = daily(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_run", F.sum(off).over(w))
    return running(df, keys, order, {"_run": ("sum", off)})


def in_long_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, at_least: int) -> DataFrame:
    """Daily frame plus ``in_run``: the row belongs to a run of ``at_least`` flagged rows."""
    m = mark_runs(df, keys, order, flag)
    n = F.count_if(F.col("_flag")).over(Window.partitionBy(*keys, "_run"))
    return m.withColumn("in_run", F.col("_flag") & (n >= at_least)).drop("_flag", "_run")


def longest_run(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, long: bool = False
) -> DataFrame:
    """Longest flagged run per key (0 when none); both steps are partial aggregates."""
    m = mark_runs(df, keys, order, flag, long)
    per_run = m.groupBy(*keys, "_run").agg(F.count_if("_flag").alias("_len"))
    return per_run.groupBy(*keys).agg(F.max("_len").alias("longest_run"))
