"""Ordered computations that stay balanced when one series holds most rows.

A plain ``Window.partitionBy(series).orderBy(ts)`` sends a whole series to one task. That is right
for daily frames (one row per key and day: a century is 36,525 rows) and wrong for raw observations.
Raw rows are range-partitioned once by (key, order) instead, so that a hot key, a burst or a single
timestamp is cut anywhere its tie columns allow; ranges have near-equal numbers of rows by Spark's
sampling. The ranges are written once with each row's range and place, which the steps after that
build on:

``running``     prefix aggregates: totals per (key, range), a carry for keys that go on in the next
                range (at most one per range), rows windowed inside (key, range).
``over_tiles``  bounded ROWS frames: the row number is the place in the range plus the carry; equal
                tiles of row numbers, with the last ``before`` rows of a tile copied into the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weatherlake.session import materialise

POS = "_pos"
TILE = "_tile"
#: Range of a row, and its place in the range.
RANGE, PLACE = "_range", "_place"


def daily(keys: Sequence[str], ts: str, *tie: str) -> WindowSpec:
    """Ordered window over a frame already reduced to one row per key and calendar day."""
    return Window.partitionBy(*keys).orderBy(ts, *tie)


def trailing(w: WindowSpec, size: int) -> WindowSpec:
    return w.rowsBetween(-(size - 1), 0)


def _total(kind: str, x: Column) -> Column:
    present = F.when(x.isNotNull(), F.col(PLACE))
    return {
        "sum": F.sum(x),
        "total": F.sum(x),
        "count": F.count(x),
        "size": F.count(x),
        "product": F.product(x),
        "max": F.max(x),
        "min": F.min(x),
        "last": F.max_by(x, present),
        "first": F.min_by(x, present),
    }[kind]


def _over(kind: str, x: Column, w: WindowSpec) -> Column:
    return {
        "sum": F.sum,
        "count": F.sum,
        "product": F.product,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
        "first": lambda c: F.first(c, ignorenulls=True),
    }[kind](x).over(w)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
    if kind == "product":
        return F.when(carry.isNull(), local).otherwise(carry * F.coalesce(local, F.lit(1.0)))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def left_join(left: DataFrame, right: DataFrame, cols: Sequence[str], small: bool = False) -> DataFrame:
    """Left join on columns in which NULL equals NULL; the columns appear once. ``small`` broadcasts the right side."""
    names = {c: f"_r_{c}" for c in cols}
    renamed = right.withColumnsRenamed(names)
    on = reduce(and_, [left[c].eqNullSafe(renamed[r]) for c, r in names.items()])
    return left.join(F.broadcast(renamed) if small else renamed, on, "left").drop(*names.values())


def sorted_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in ranges of (keys, order), sorted, with ``_range`` (ascending) and ``_place`` (in the range, from 0)."""
    x = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return x.withColumns({RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``sorted_ranges``, stored: the cut depends on a sample, so every step must read the same one."""
    return materialise(sorted_ranges(df, keys, order), "ranges")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    reverse: bool = False,
    ranged: bool = False,
    keep_ranges: bool = False,
) -> DataFrame:
    """Inclusive running aggregates per ``keys`` in ``order``.

    ``specs`` maps an output name to (kind, input); kinds are sum, count, product, max, min, last and
    first (NULLs skipped), plus ``total`` / ``size``: the sum / count over the whole series. With
    ``reverse`` the scan runs from the end, so ``last`` means the next non-NULL value. NULL keys
    form a series of their own and rows with a NULL order come first; ``order`` must be unique per key. A second
    scan of the same frame can pass ``ranged`` when the first one kept its ranges.
    """
    names = list(specs)
    ins = {n: f"_in_{n}" for n in names}
    src = df.withColumns({ins[n]: specs[n][1] for n in names})
    if not ranged:
        src = in_ranges(src, keys, order)
    by = [*keys, RANGE]
    flip = {"last": "first", "first": "last"} if reverse else {}
    part = src.groupBy(*by).agg(*[_total(flip.get(specs[n][0], specs[n][0]), F.col(ins[n])).alias(f"_t_{n}") for n in names])
    direction = lambda c: F.col(c).desc() if reverse else F.col(c).asc()
    prior = Window.partitionBy(*keys).orderBy(direction(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    overall = [n for n in names if specs[n][0] in ("total", "size")]
    columns = [(F.sum(f"_t_{n}").over(whole) if n in overall else _over(specs[n][0], F.col(f"_t_{n}"), prior)).alias(f"_c_{n}") for n in names]
    carry = part.select(*by, *columns, F.count("*").over(prior).alias("_before"))
    if not overall:
        # only keys that began in another range: one per range at most, so the table is small at any size
        carry = carry.filter("_before > 0")
    joined = left_join(src, carry.drop("_before"), by, small=not overall)
    inside = Window.partitionBy(*by).orderBy(direction(PLACE)).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n in names:
        kind, c = specs[n][0], F.col(f"_c_{n}")
        if n in overall:
            out[n] = c
        else:
            local = F.count(F.col(ins[n])).over(inside) if kind == "count" else _over(kind, F.col(ins[n]), inside)
            out[n] = _merge(kind, c, local)
    return joined.withColumns(out).drop(*([] if keep_ranges else [RANGE, PLACE]), *ins.values(), *[f"_c_{n}" for n in names])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str | None = None) -> DataFrame:
    """Add ``_pos`` (1-based row number per key), and the series length when ``size`` names it.

    No sort beyond that of the ranges: a row's number is its place less the key's first place in the range, plus the
    key's rows in earlier ranges.
    """
    src = in_ranges(df, keys, order)
    by = [*keys, RANGE]
    prior = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    part = src.groupBy(*by).agg(F.min(PLACE).alias("_first"), F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(prior), F.lit(0)) - F.col("_first") + 1
    total = [F.sum("_n").over(Window.partitionBy(*keys)).alias(size)] if size else []
    joined = left_join(src, part.select(*by, offset.alias("_offset"), *total), by)
    return joined.withColumn(POS, F.col(PLACE) + F.col("_offset")).drop("_offset", RANGE, PLACE)


def over_tiles(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    tile: int = 16384,
    size: str | None = None,
    keep_pos: bool = False,
) -> DataFrame:
    """Run ``build(df, window)`` where frames reach at most ``before`` / ``after`` rows.

    Every task sees at most ``tile + before + after`` rows of a key, whatever the series length.
    """
    tile = max(tile, before, after)
    numbered = number_rows(df, keys, order, size)
    off = (F.col(POS) - 1) % tile
    home = F.floor((F.col(POS) - 1) / tile)
    copies = [home]
    if before:
        copies.append(F.when(off >= tile - before, home + 1))
    if after:
        copies.append(F.when((off < after) & (home > 0), home - 1))
    spread = numbered.withColumn(TILE, F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy(*keys, TILE).orderBy(POS)
    out = build(spread, w).filter(F.col(TILE) == home).drop(TILE)
    return out if keep_pos else out.drop(POS)
