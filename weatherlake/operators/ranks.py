"""Ranks, exact quantiles and counts below a value, without a single sorted partition.

Equal values are counted first (map-side combined), so a value shared by a third of all rows is one
row; the distinct values are then scanned in ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherlake.operators.windows import running


def cumulative_counts(
    df: DataFrame, keys: Sequence[str], value: str, weights: dict[str, Column]
) -> DataFrame:
    """One row per key and distinct value: each weight summed (``x``), running (``x_le``) and in all (``x_all``)."""
    per_value = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    )
    specs = {}
    for n in weights:
        specs[f"{n}_le"] = ("sum", F.col(n))
        specs[f"{n}_all"] = ("total", F.col(n))
    return running(per_value, keys, [value], specs)


def percentile_rank(
    queries: DataFrame, history: DataFrame, keys: Sequence[str], value: str, out: str = "pct_rank"
) -> DataFrame:
    """Rank percentage of each query value in the historical sample; ties count half, plus one half.

    (count(<x) + count(<=x) + [1 if x occurs]) * 50 / n; NULL where the key has no history.
    """
    both = history.select(*keys, value, F.lit(1).alias("_h")).unionByName(
        queries.select(*keys, value, F.lit(0).alias("_h"))
    )
    c = cumulative_counts(both, keys, value, {"_n": F.col("_h")})
    le, lt = F.col("_n_le"), F.col("_n_le") - F.col("_n")
    rank = (lt + le + F.when(F.col("_n") > 0, 1).otherwise(0)) * 50.0 / F.nullif(F.col("_n_all"), F.lit(0))
    return queries.join(c.select(*keys, value, rank.alias(out)), [*keys, value], "left")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per key, equal to numpy's default, by locating order statistics."""
    c = cumulative_counts(df, keys, value, {"_n": F.lit(1)})
    first = F.col("_n_le") - F.col("_n")
    aggs = []
    for name, q in qs.items():
        h = (F.col("_n_all") - 1) * F.lit(q)
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("_n_all") - 1)
        aggs += [
            F.max(F.when((first <= lo) & (lo < F.col("_n_le")), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi < F.col("_n_le")), F.col(value))).alias(f"_hi_{name}"),
            F.max(h - lo).alias(f"_f_{name}"),
        ]
    got = c.groupBy(*keys).agg(*aggs)
    return got.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in qs
        ],
    )


def mean_rank_columns(n: str = "_n") -> Column:
    """Mean rank (1-based) of a distinct value from its counts."""
    return F.col(f"{n}_le") - (F.col(n) - 1) / 2.0
