"""Sampling, regridding, fields, circulation indices and cloud motion on long grids (O-SP-08, 09, 13..17, 20..26)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from weatherlake.functions.geo import KM_PER_DEGREE

#: Parts of the frames that a point is joined to apart from each other, at least; frames in a part; points in a run.
SHARES, FRAMES, RUN = 16, 1024, 256


@dataclass(frozen=True)
class Axis:
    """Regular ascending axis: value of index k is start + k * step."""

    start: float
    step: float
    n: int

    @staticmethod
    def spanning(lo: float, hi: float, step: float) -> Axis:
        """Inclusive axis: the end is kept when it lies within half a step."""
        if lo > hi or step <= 0:
            raise ValueError("axis needs lo <= hi and a positive step")
        return Axis(lo, step, math.ceil((hi + step * 0.5 - lo) / step))

    def values(self) -> list[float]:
        return [self.start + k * self.step for k in range(self.n)]


def regular_grid(spark: SparkSession, lat: Axis, lon: Axis) -> DataFrame:
    """Cells of a target grid from one ranged scan: id, i, j, lat, lon."""
    i, j = F.floor(F.col("id") / lon.n), F.col("id") % lon.n
    return spark.range(lat.n * lon.n).select(
        "id",
        i.cast("long").alias("i"),
        j.alias("j"),
        (i * lat.step + lat.start).alias("lat"),
        (j * lon.step + lon.start).alias("lon"),
    )


def data_axes(df: DataFrame) -> tuple[Axis, Axis]:
    """Axes spanned by the data; one tiny aggregate is read back (six numbers)."""
    r = df.agg(
        F.min("lat"), F.max("lat"), F.count_distinct("lat"), F.min("lon"), F.max("lon"), F.count_distinct("lon")
    ).first()
    def axis(lo, hi, n):
        return Axis(lo, (hi - lo) / max(n - 1, 1) or 1.0, n)
    return axis(*r[:3]), axis(*r[3:])


def _corner(frac: Column, n: int) -> Column:
    return F.least(F.greatest(F.floor(frac), F.lit(0)), F.lit(n - 2)).cast("long")


def _shares(grid: DataFrame) -> Column:
    """Parts that frames are dealt over: one number, counted in the same job."""
    n = grid.groupBy("i", "j").count().agg(F.greatest(F.lit(SHARES), F.ceil(F.max("count") / FRAMES)).cast("int"))
    return n.scalar()


def _product(points: DataFrame, cells: DataFrame, key: Sequence[str], place: Sequence[str], by: Sequence[str], shares: Column) -> DataFrame:
    """Every point (key, place, id) with every frame of its cell (by, key and values).

    The result has a row per frame and point, and is far larger than both sides. Points of a cell are therefore joined as
    runs, arrays of at most RUN points in the order of their place: all frames of a share meet one run, then the next. So a
    frame and its values stay the same for a run, the ids come again soon, and columnar files store all of them small. There
    are as many tasks as shuffle partitions, as the sizes that Spark could merge them by are those of the two sides.
    """
    spark, keys = points.sparkSession, [*key, "_share"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.row_number().over(Window.partitionBy(*key).orderBy(*place, "id"))
    runs = points.withColumn("_k", F.floor((row - 1) / RUN)).groupBy(*key, "_k")
    runs = runs.agg(F.sort_array(F.collect_list(F.struct(*place, "id"))).alias("_run"))
    runs = runs.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).repartition(n, *keys)
    cells = cells.withColumn("_share", F.pmod(F.xxhash64(*by), shares).cast("int")).repartition(n, *keys)
    # asked for, as Spark's size estimate leaves the copies of a run out and would broadcast them
    both = runs.hint("merge").join(cells, keys)
    return both.select(*[c for c in cells.columns if c not in keys], F.inline("_run"))


def bilinear(
    grid: DataFrame, points: DataFrame, lat: Axis, lon: Axis, by: Sequence[str] = ("time",), include_edge: bool = False
) -> DataFrame:
    """Bilinear values of every frame at points (id, lat, lon); out of bounds or a missing corner is NULL.

    Point sampling leaves the last row and column out; regridding includes them (``include_edge``).
    The four cells around a spot are first put into one row per frame, so that a point takes its value from one row and
    the product of frames and points, which is the result, passes no shuffle. Points at one place follow each other, with
    one value a frame. Only the points of an id that occurs more than once are added up after the join.
    """
    fi, fj = (F.col("lat") - lat.start) / lat.step, (F.col("lon") - lon.start) / lon.step
    if include_edge:
        ok = fi.between(0, lat.n - 1) & fj.between(0, lon.n - 1)
    else:
        ok = (fi >= 0) & (fi < lat.n - 1) & (fj >= 0) & (fj < lon.n - 1)
    i0, j0 = _corner(fi, lat.n), _corner(fj, lon.n)
    p = points.filter(ok).select("id", i0.alias("_i"), j0.alias("_j"), (fi - i0).alias("_wi"), (fj - j0).alias("_wj"))
    p = p.withColumn("_same", F.count("*").over(Window.partitionBy("id")))
    blocks, shares = _blocks(grid, lat.n, lon.n, by), _shares(grid)
    wi, wj = F.col("_wi"), F.col("_wj")
    parts = [u * v * F.coalesce(f"_v{a}{b}", F.lit(0.0)) for a, u in ((0, 1 - wi), (1, wi)) for b, v in ((0, 1 - wj), (1, wj))]

    def at(some: DataFrame) -> DataFrame:
        rows = _product(some.drop("_same"), blocks, ["_i", "_j"], ["_wi", "_wj"], by, shares)
        return rows.select(*by, "id", "_n", reduce(add, parts).alias("_s"))

    once = at(p.filter("_same = 1")).select(*by, "id", F.when(F.col("_n") == 4, F.col("_s")).alias("value"))
    more = at(p.filter("_same > 1")).groupBy(*by, "id").agg(F.when(F.sum("_n") == 4, F.sum("_s")).alias("value"))
    return once.unionAll(more)


def _blocks(grid: DataFrame, n_lat: int, n_lon: int, by: Sequence[str]) -> DataFrame:
    """(by, _i, _j): the four cells from index (_i, _j) on, as ``_v00`` .. ``_v11``, and how many have a value, ``_n``."""
    def first(k: Column, n: int) -> Column:
        low = min(n - 2, 0)
        return F.when(k.between(low, n - 1), F.sequence(F.greatest(k - 1, F.lit(low)), F.least(k, F.lit(n - 2))))
    x = grid.select(*by, "i", "j", "v")
    x = x.withColumn("_i", F.explode(first(F.col("i"), n_lat))).withColumn("_j", F.explode(first(F.col("j"), n_lon)))
    v = lambda a, b: F.when((F.col("i") == F.col("_i") + a) & (F.col("j") == F.col("_j") + b), F.col("v"))
    return x.groupBy(*by, "_i", "_j").agg(F.count("v").alias("_n"), *[F.sum(v(a, b)).alias(f"_v{a}{b}") for a in (0, 1) for b in (0, 1)])


def nearest(
    grid: DataFrame, points: DataFrame, lats: Sequence[float], lons: Sequence[float], by: Sequence[str] = ("time",)
) -> DataFrame:
    """Value of the cell nearest along each axis (first on ties); axes may be irregular.

    The result has a row per frame and point, which leaves the join run by run; no points are gathered in the driver.
    """
    def index(axis: Sequence[float], x: Column) -> Column:
        a = F.array(*[F.lit(float(v)) for v in axis])
        best = F.array_min(F.transform(a, lambda v, k: F.struct(F.abs(v - x).alias("d"), k.alias("k"))))
        return best["k"].cast("long")
    p = points.select("id", index(lats, F.col("lat")).alias("i"), index(lons, F.col("lon")).alias("j"))
    rows = _product(p, grid.select(*by, "i", "j", "v"), ["i", "j"], [], by, _shares(grid))
    return rows.select(*by, "id", F.col("v").alias("value"))


def regrid_to_resolution(grid: DataFrame, resolution: float, by: Sequence[str] = ("time",), method: str = "bilinear") -> DataFrame:
    """(by, i, j, lat, lon, value): every frame on a regular grid of ``resolution`` degrees over the data's own extent.

    Both axes come from one aggregate of the data (six numbers); ``method`` is bilinear (edges included) or nearest.
    """
    src_lat, src_lon = data_axes(grid)
    lat = Axis.spanning(src_lat.start, src_lat.start + src_lat.step * (src_lat.n - 1), resolution)
    lon = Axis.spanning(src_lon.start, src_lon.start + src_lon.step * (src_lon.n - 1), resolution)
    target = regular_grid(grid.sparkSession, lat, lon)
    if method == "bilinear":
        got = bilinear(grid, target, src_lat, src_lon, by, include_edge=True)
    elif method == "nearest":
        got = nearest(grid, target, src_lat.values(), src_lon.values(), by)
    else:
        raise ValueError(f"unknown method {method!r}")
    return got.join(target, "id").select(*by, "i", "j", "lat", "lon", "value")


def conservative(
    grid: DataFrame, src_lat: Axis, src_lon: Axis, lat: Axis, lon: Axis, by: Sequence[str] = ("time",)
) -> DataFrame:
    """Area-overlap mean onto a target grid, weighted by cos(source lat); missing cells carry no weight.

    Each source cell computes the target indices it overlaps, so there is no join at all.
    """
    def hits(x: Column, s: Axis, t: Axis, name: str) -> Column:
        lo, hi = x - s.step / 2, x + s.step / 2
        base = t.start - t.step / 2
        first = F.greatest(F.floor((lo - base) / t.step) - 1, F.lit(0))
        last = F.least(F.floor((hi - base) / t.step) + 1, F.lit(t.n - 1))
        def part(k: Column) -> Column:
            c = k * t.step + t.start
            w = F.least(hi, c + t.step / 2) - F.greatest(lo, c - t.step / 2)
            return F.struct(k.alias(f"t{name}"), (w / t.step).alias(f"_w{name}"))
        some = F.transform(F.sequence(first, F.greatest(last, first)), part)
        return F.filter(some, lambda s: (s[f"_w{name}"] > 0) & (s[f"t{name}"] < t.n))
    x = grid.filter(F.col("v").isNotNull()).select(
        *by, "lat", "lon", "v", F.explode(hits(F.col("lat"), src_lat, lat, "i")).alias("_a")
    )
    x = x.select(*by, "lat", "v", "_a", F.explode(hits(F.col("lon"), src_lon, lon, "j")).alias("_b"))
    w = F.col("_a._wi") * F.col("_b._wj") * F.cos(F.radians("lat"))
    return x.groupBy(*by, F.col("_a.ti").alias("i"), F.col("_b.tj").alias("j")).agg(
        (F.sum(F.col("v") * w) / F.sum(w)).alias("value")
    )


def _derivative(v: str, x: str, w) -> Column:
    """Second-order difference with unequal spacing inside, one-sided at the ends (per degree)."""
    a, b = F.lag(v).over(w), F.lead(v).over(w)
    hs, hd = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    f = F.col(v)
    inner = (hs * hs * b + (hd * hd - hs * hs) * f - hd * hd * a) / (hs * hd * (hd + hs))
    return F.when(hs.isNull(), (b - f) / hd).when(hd.isNull(), (f - a) / hs).otherwise(inner)


def _per_km(keys: Sequence[str], dx_km: float | None):
    """Windows along one row and one column of a frame (bounded by the axis lengths), and km per unit of lon and lat.

    With ``dx_km`` a degree is that many km in both directions, without the shrinking towards the poles.
    """
    along_lon = Window.partitionBy(*keys, "lat").orderBy("lon")
    along_lat = Window.partitionBy(*keys, "lon").orderBy("lat")
    if dx_km is not None:
        if dx_km <= 0:
            raise ValueError("dx_km must be positive")
        return along_lon, along_lat, F.lit(float(dx_km)), F.lit(float(dx_km))
    dx = F.cos(F.radians("lat")) * KM_PER_DEGREE
    return along_lon, along_lat, F.when(F.abs(dx) > 1e-6, dx).otherwise(1e-6), F.lit(KM_PER_DEGREE)


def gradient(grid: DataFrame, keys: Sequence[str] = ("time",), v: str = "v", dx_km: float | None = None) -> DataFrame:
    along_lon, along_lat, dx, dy = _per_km(keys, dx_km)
    g = grid.withColumn("d_dx", _derivative(v, "lon", along_lon) / dx).withColumn(
        "d_dy", _derivative(v, "lat", along_lat) / dy
    )
    return g.withColumn("magnitude", F.sqrt(F.col("d_dx") ** 2 + F.col("d_dy") ** 2)).withColumn(
        "direction", F.atan2("d_dy", "d_dx")
    )


def divergence(
    grid: DataFrame, keys: Sequence[str] = ("time",), u: str = "u", v: str = "v", dx_km: float | None = None
) -> DataFrame:
    along_lon, along_lat, dx, dy = _per_km(keys, dx_km)
    d = _derivative(u, "lon", along_lon) / dx + _derivative(v, "lat", along_lat) / dy
    return grid.withColumn("divergence", d).withColumn("convergence", -F.col("divergence"))


def cloud_fraction(grid: DataFrame, keys: Sequence[str], t: str, threshold: float = 260.0) -> DataFrame:
    return grid.groupBy(*keys).agg(
        F.avg(F.coalesce(F.col(t) < threshold, F.lit(False)).cast("double")).alias("cloud_fraction")
    )


# Circulation indices. After the cell aggregate there is one row per time step, so a window over the
# time axis is bounded by the calendar, not by the data volume.


def _box_mean(box: Column) -> Column:
    w = F.when(box & F.col("v").isNotNull(), F.cos(F.radians("lat")))
    return F.sum(F.col("v") * w) / F.sum(w)


def nino34(grid: DataFrame, keys: Sequence[str] = (), anomalous: bool = True) -> DataFrame:
    box = F.col("lat").between(-5, 5) & F.col("lon").between(-170, -120)
    t = grid.filter(box).groupBy(*keys, "time").agg(_box_mean(box).alias("nino34"))
    if anomalous:
        t = t.withColumn("nino34", F.col("nino34") - F.avg("nino34").over(Window.partitionBy(*keys, F.month("time"))))
    return t


def nao(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    lon = F.col("lon").between(-22, -18)
    az, ice = lon & F.col("lat").between(36, 40), lon & F.col("lat").between(63, 67)
    t = grid.filter(az | ice).groupBy(*keys, "time").agg(
        (_box_mean(az) - _box_mean(ice)).alias("_d")
    )
    m = Window.partitionBy(*keys, F.month("time"))
    sd = F.stddev_pop("_d").over(m)
    return t.select(
        *keys, "time", ((F.col("_d") - F.avg("_d").over(m)) / F.when(sd > 0, sd).otherwise(1.0)).alias("nao")
    )


def pdo(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    box = F.col("lat").between(20, 60) & F.col("lon").between(-170, -115)
    t = grid.filter(box).groupBy(*keys, "time").agg(_box_mean(box).alias("_m"))
    t = t.withColumn("_a", F.col("_m") - F.avg("_m").over(Window.partitionBy(*keys, F.month("time"))))
    sd = F.stddev_pop("_a").over(Window.partitionBy(*keys))
    return t.select(*keys, "time", (F.col("_a") / F.when(sd > 0, sd).otherwise(1.0)).alias("pdo"))


def mjo(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Amplitude and phase of the tropical anomaly, 10S-10N from 60E over the date line to 150W.

    The formula is kept as published by the original: the second component is a scaled copy of the
    first, so after standardising both are equal and the phase is 2 or 6. The longitude range wraps.
    """
    box = F.col("lat").between(-10, 10) & ((F.col("lon") >= 60) | (F.col("lon") <= -150))
    cell_day = Window.partitionBy(*keys, "lat", "lon", F.dayofyear("time"))
    a = grid.filter(box).withColumn("_a", (F.col("v") - F.avg("v").over(cell_day)) * F.cos(F.radians("lat")))
    t = a.groupBy(*keys, "time").agg(F.avg("_a").alias("_r"))
    sd = F.stddev_pop("_r").over(Window.partitionBy(*keys))
    scale = F.when(sd > 0, sd).otherwise(1.0)
    half = F.when(sd > 0, sd / 2).otherwise(1.0)
    t = t.select(*keys, "time", (F.col("_r") / scale).alias("rmm1"), (F.col("_r") * 0.5 / half).alias("rmm2"))
    angle = F.pmod(F.degrees(F.atan2("rmm2", "rmm1")) + 360.0, F.lit(360.0))
    return t.withColumn("amplitude", F.sqrt(F.col("rmm1") ** 2 + F.col("rmm2") ** 2)).withColumn(
        "mjo_phase", (F.bround(angle / 45.0).cast("int") % 8 + 1).cast("int")
    )


_SHIFT = StructType(
    [StructField("dx", IntegerType()), StructField("dy", IntegerType()), StructField("corr", DoubleType())]
)


def cloud_motion(
    pixels: DataFrame, height: int, width: int, block: int = 32, reach: int = 8, minutes: int = 60
) -> DataFrame:
    """Best shift of every full block between consecutive frames (frame, y, x, v).

    A block (block^2 values) and its search area ((block + 2 reach)^2) are tiles of fixed size, gathered
    per (frame, block); numpy then scores all shifts of a tile. A pixel is copied only into the search
    areas it belongs to. Shifts that leave the frame are skipped, the first best wins, and a block
    without positive correlation has confidence 0. Frames without a successor yield no rows; the wind
    columns keep the original's degree-per-hour proxy.
    """
    ny, nx = height // block, width // block
    cell = F.struct("y", "x", "v")
    blocks = (
        pixels.withColumn("block_y", F.floor(F.col("y") / block).cast("int"))
        .withColumn("block_x", F.floor(F.col("x") / block).cast("int"))
        .filter((F.col("block_y") < ny) & (F.col("block_x") < nx))
        .groupBy("frame", "block_y", "block_x")
        .agg(F.array_sort(F.collect_list(cell)).alias("tile"))
    )
    def owners(p: str, n: int) -> Column:
        first = F.greatest(F.floor((F.col(p) - block - reach) / block) + 1, F.lit(0))
        last = F.least(F.floor((F.col(p) + reach) / block), F.lit(n - 1))
        return F.sequence(first, F.greatest(first, last)).cast("array<int>")
    area = (
        pixels.withColumn("block_y", F.explode(owners("y", ny)))
        .withColumn("block_x", F.explode(owners("x", nx)))
        .filter((F.col("block_y") < ny) & (F.col("block_x") < nx))
        .filter((F.col("y") < (F.col("block_y") + 1) * block + reach) & (F.col("x") < (F.col("block_x") + 1) * block + reach))
        .groupBy((F.col("frame") - 1).alias("frame"), "block_y", "block_x")
        .agg(F.array_sort(F.collect_list(cell)).alias("area"))
    )

    @F.pandas_udf(_SHIFT)
    def best_shift(tile: pd.Series, area: pd.Series, by: pd.Series, bx: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, i, j in zip(tile, area, by, bx, strict=True):
            y0, x0 = int(i) * block, int(j) * block
            ref = np.full((block, block), np.nan)
            for p in t:
                ref[p["y"] - y0, p["x"] - x0] = np.nan if p["v"] is None else p["v"]
            big = np.full((block + 2 * reach, block + 2 * reach), np.nan)
            for p in a:
                big[p["y"] - y0 + reach, p["x"] - x0 + reach] = np.nan if p["v"] is None else p["v"]
            r = ref - ref.mean()
            best = (0, 0, -1.0)
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    if y0 + dy < 0 or x0 + dx < 0 or y0 + dy + block > height or x0 + dx + block > width:
                        continue
                    s = big[reach + dy : reach + dy + block, reach + dx : reach + dx + block]
                    s = s - s.mean()
                    den = np.sqrt((r * r).sum() * (s * s).sum())
                    c = (r * s).sum() / den if den > 0 else np.nan
                    if c > best[2]:
                        best = (dx, dy, c)
            out.append((best[0], best[1], max(best[2], 0.0)))
        return pd.DataFrame(out, columns=["dx", "dy", "corr"])

    j = blocks.join(area, ["frame", "block_y", "block_x"]).withColumn("_s", best_shift("tile", "area", "block_y", "block_x"))
    scale = block * 0.14 * 60.0 / minutes
    return j.select(
        "frame",
        "block_y",
        "block_x",
        F.col("_s.dx").alias("dx"),
        F.col("_s.dy").alias("dy"),
        (F.col("_s.dx") * scale).alias("u_cloud_motion"),
        (F.col("_s.dy") * scale).alias("v_cloud_motion"),
        F.col("_s.corr").alias("confidence"),
    )
