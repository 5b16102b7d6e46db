"""As-of joins as a sorted union and a last / first non-NULL scan (no range join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.operators.windows import running


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: Column,
    right_ts: Column,
    columns: Sequence[str],
    long: bool = False,
    tie: Sequence[str] = (),
    forward: bool = False,
) -> DataFrame:
    """Add ``columns`` of the last right row at or before each left row (``forward``: first at or after).

    ``tie`` are right columns that order rows of equal time. Without ``long`` both sides must be daily
    frames; with it raw rows of any length work.
    """
    n = len(tie)
    match = F.struct(*[F.col(c) for c in columns])
    r = right.select(
        *keys, right_ts.alias("_t"), F.lit(int(forward)).alias("_side"), match.alias("_r"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)]
    )
    ltie = [F.lit(None).cast(right.schema[c].dataType).alias(f"_tie{i}") for i, c in enumerate(tie)]
    l = left.select(*keys, left_ts.alias("_t"), F.lit(int(not forward)).alias("_side"), F.struct("*").alias("_l"), *ltie)
    u = l.unionByName(r, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_tie{i}" for i in range(n)]]
    if not long:
        # forward matches scan backwards, so both directions use a growing frame (linear time)
        point = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
        w = Window.partitionBy(*keys).orderBy(*point).rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    else:
        u = running(u, keys, order, {"_m": ("last", F.col("_r"))}, reverse=forward)
    hit = u.filter(F.col("_l").isNotNull())
    return hit.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in columns])
