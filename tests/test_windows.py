"""Range scans and tiles against pandas, with one series holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weatherlake.operators import islands, ranks, series, windows


def frame(n=900, seed=3):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    x = rng.normal(10, 5, n).round(3)
    x[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"k": key, "t": np.sort(rng.integers(0, 400, n)), "id": np.arange(n), "x": x})


def to_spark(spark, pdf):
    rows = [(r.k, int(r.t), int(r.id), None if np.isnan(r.x) else float(r.x)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "k string, t long, id long, x double")


@pytest.fixture(params=["few ranges", "many ranges"])
def ranges(spark, request):
    """Ranges as few as Spark likes, or cut every few rows."""
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    if request.param == "many ranges":
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


@pytest.mark.parametrize("reverse", [False, True])
def test_running_kinds(spark, ranges, reverse):
    pdf = frame()
    x = F.col("x")
    specs = {k: (k, x) for k in ("sum", "count", "product", "max", "min", "last", "first")}
    specs["product"] = ("product", F.when(x.isNotNull(), 1 + x / 1000))
    specs["total"] = ("total", x)
    got = windows.running(to_spark(spark, pdf), ["k"], ["t", "id"], specs, reverse).toPandas().set_index("id")
    for _, g in pdf.groupby("k"):
        g = g[::-1] if reverse else g
        s = g.x
        r = got.loc[g.id]
        np.testing.assert_allclose(r["sum"], s.fillna(0).cumsum().where(s.notna().cummax()), rtol=1e-9)
        assert list(r["count"]) == list(s.notna().cumsum())
        np.testing.assert_allclose(r["product"], (1 + s / 1000).fillna(1).cumprod().where(s.notna().cummax()), rtol=1e-9)
        np.testing.assert_allclose(r["max"], s.cummax().ffill())
        np.testing.assert_allclose(r["min"], s.cummin().ffill())
        np.testing.assert_allclose(r["last"], s.ffill())
        first = s.dropna().iloc[0]
        np.testing.assert_allclose(r["first"], np.where(s.notna().cummax(), first, np.nan))
        np.testing.assert_allclose(r["total"], s.sum())


@pytest.mark.parametrize("tile", [7, 40, 10_000])
def test_tiles_match_whole_series(spark, ranges, tile):
    pdf = frame()

    def build(df, w):
        return df.withColumns({"lag3": F.lag("x", 3).over(w), "ahead": F.lead("x", 2).over(w), "m5": F.avg("x").over(w.rowsBetween(-4, 0))})

    out = windows.over_tiles(to_spark(spark, pdf), ["k"], ["t", "id"], build, before=5, after=2, tile=tile)
    got = out.toPandas().set_index("id")
    assert len(got) == len(pdf)
    for _, g in pdf.groupby("k"):
        r = got.loc[g.id]
        np.testing.assert_allclose(r.lag3, g.x.shift(3))
        np.testing.assert_allclose(r.ahead, g.x.shift(-2))
        np.testing.assert_allclose(r.m5, g.x.rolling(5, min_periods=1).mean())


def test_ema_of_several_variables_with_gaps(spark, ranges):
    """NULLs anywhere, series of any length over any cut, two variables and spans from 1 to 200 in one pass."""
    rng = np.random.default_rng(6)
    rows = []
    for k, n in (("hot", 900), ("b", 40), (None, 30), ("gone", 5)):
        for t in range(n):
            x = None if k == "gone" or rng.random() < 0.3 else float(rng.normal(0, 50))
            rows.append((k, t, len(rows), x, None if rng.random() < 0.8 else float(rng.normal(5, 1))))
    rows = [(k, t, i, None if k == "hot" and 200 < t < 420 else x, y) for k, t, i, x, y in rows]
    df = spark.createDataFrame(rows, "k string, t long, id long, x double, y double")
    out = series.ema(df, ["k"], ["t", "id"], ["x", "y"], spans=(1, 3, 12, 200))
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        for v, at in (("x", 3), ("y", 4)):
            for s in (1, 3, 12, 200):
                level = None
                for r in (r for r in rows if r[0] == k):
                    value, mine = r[at], got[r[2]][f"{v}_ema_{s}"]
                    if value is None:
                        assert mine is None
                        continue
                    level = value if level is None else level + 2 / (s + 1) * (value - level)
                    assert mine == pytest.approx(level, rel=1e-9, abs=1e-9)


def test_plans_grow_with_the_variables_and_read_the_source_twice_at_most(spark):
    df = to_spark(spark, frame())
    for v in "abcdef":
        df = df.withColumn(v, F.col("x") + 1)
    leaves = lambda d: d._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    args = (["k"], ["t", "id"])
    assert leaves(series.features(df, *args, ["x"], stats=("lag",), windows=())) <= 2
    assert leaves(windows.running(df, *args, {"n": ("count", F.lit(1))})) <= 2
    assert leaves(series.ema(df, *args, list("abcdef"))) == leaves(series.ema(df, *args, ["a"])) <= 2


def test_a_million_rows_of_one_time(spark):
    """One key and one timestamp: the tie column alone cuts it into ranges of near-equal size."""
    n = 1_000_000
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n).select(F.lit("k").alias("k"), F.lit(7).alias("t"), (F.col("id") * 7919 % n).alias("id"))
        out = windows.running(df, ["k"], ["t", "id"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("id"))}, keep_ranges=True)
        facts = out.groupBy("_range").agg(F.count("*").alias("rows"), F.count_if((F.col("n") != F.col("id") + 1) | (F.col("s") != F.col("id") * F.col("n") / 2)).alias("wrong")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(facts) == 4 and sum(r.rows for r in facts) == n and not sum(r.wrong for r in facts)
    assert max(r.rows for r in facts) < 0.4 * n


def test_features_match_pandas_and_ignore_the_future(spark):
    pdf = frame()
    args = (["k"], ["t", "id"], ["x"])
    opts = {"lags": (1, 24), "windows": (6, 24, 48)}
    got = series.features(to_spark(spark, pdf), *args, **opts).toPandas().set_index("id").sort_index()
    for _, g in pdf.groupby("k"):
        r = got.loc[g.id]
        for w in (6, 24, 48):
            roll = g.x.rolling(w, min_periods=max(1, w // 2))
            np.testing.assert_allclose(r[f"x_rollmean_{w}"], roll.mean(), rtol=1e-9)
            np.testing.assert_allclose(r[f"x_rollstd_{w}"], roll.std(), rtol=1e-7)
            np.testing.assert_allclose(r[f"x_rollmin_{w}"], roll.min())
            np.testing.assert_allclose(r[f"x_rollmax_{w}"], roll.max())
            z = (g.x - roll.mean()) / roll.std().replace(0, np.nan)
            np.testing.assert_allclose(r[f"x_anomaly_{w}"], z, rtol=1e-6, atol=1e-9)
            full = g.x.rolling(w).mean()
            np.testing.assert_allclose(r[f"x_rolling_{w}"], full, rtol=1e-9)
            for i in range(w - 1, len(g), 37):
                y = g.x.iloc[i - w + 1 : i + 1].to_numpy()
                ok = ~np.isnan(y)
                want = np.polyfit(np.arange(w)[ok], y[ok], 1)[0]
                assert abs(r[f"x_trend_{w}"].iloc[i] - want) < 1e-7
    past = pdf[pdf.t < 250]
    sizes = pdf[pdf.t < 250].groupby("k").size()
    early = series.features(to_spark(spark, past), *args, **opts).toPandas().set_index("id").sort_index()
    keep = early[early.k.map(sizes) >= 48]
    pd.testing.assert_frame_equal(keep, got.loc[keep.index], check_exact=False, rtol=1e-9)


def test_constant_series_has_no_zscore(spark):
    rows = [("c", i, i, 2.5) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, t long, id long, x double")
    out = series.features(df, ["k"], ["t", "id"], ["x"], stats=("anomaly",), windows=(6, 12)).toPandas()
    assert out.x_anomaly_6.isna().all() and not out.x_is_anomaly_6.any()


def test_long_windows_are_dropped_for_short_series(spark):
    df = spark.createDataFrame([("s", i, i, float(i)) for i in range(20)], "k string, t long, id long, x double")
    out = series.features(df, ["k"], ["t", "id"], ["x"], stats=("window",), windows=(6, 24)).toPandas()
    assert out.x_rollmean_24.isna().all() and out.x_rollmean_6.notna().sum() == 18


def test_ema_equals_recursion_over_many_ranges(spark, ranges):
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"k": "hot", "t": np.arange(n), "id": np.arange(n), "x": rng.normal(0, 10, n)})
    got = series.ema(to_spark(spark, pdf), ["k"], ["t", "id"], "x", spans=(3, 12, 48)).toPandas().sort_values("id")
    for s in (3, 12, 48):
        want = pdf.x.ewm(span=s, adjust=False).mean()
        np.testing.assert_allclose(got[f"x_ema_{s}"], want, rtol=1e-9, atol=1e-11)


def test_ema_keeps_rows_without_a_value(spark):
    rows = [("s", i, i, None if i % 3 == 1 else float(i)) for i in range(12)] + [("gone", i, 100 + i, None) for i in range(2)]
    df = spark.createDataFrame(rows, "k string, t long, id long, x double")
    got = {r.id: r.x_ema_3 for r in series.ema(df, ["k"], ["t", "id"], "x", spans=(3, 12, 48)).collect()}
    want, last = {}, None
    for _, _, i, x in rows:
        last = last if x is None else x if last is None else last + (x - last) / 2
        want[i] = None if x is None else pytest.approx(last)
    assert got == want


def test_sequences_pad_with_first_row(spark):
    df = spark.createDataFrame([("s", i, i, float(i)) for i in range(5)], "k string, t long, id long, x double")
    out = series.sequences(df, ["k"], ["t", "id"], ["x"], length=3).orderBy("id").collect()
    assert [[v.x for v in r.sequence] for r in out][:3] == [[0, 0, 0], [0, 0, 1], [0, 1, 2]]


def test_longest_run_with_and_without_ranges(spark):
    pdf = frame()
    df = to_spark(spark, pdf)
    flag = F.col("x") > 9
    got = {r.k: r.longest_run for r in islands.longest_run(df, ["k"], ["t", "id"], flag, long=True).collect()}
    plain = {r.k: r.longest_run for r in islands.longest_run(df, ["k"], ["t", "id"], flag).collect()}
    want = {}
    for k, g in pdf.groupby("k"):
        best = cur = 0
        for v in g.x:
            cur = cur + 1 if v > 9 else 0
            best = max(best, cur)
        want[k] = best
    assert got == plain == want


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(8)
    pdf = frame()
    pdf["x"] = np.where(rng.random(len(pdf)) < 0.4, 0.0, rng.normal(0, 1e3, len(pdf)).round(2))
    q = ranks.exact_quantiles(to_spark(spark, pdf), ["k"], "x", {"a": 0.05, "b": 0.5, "c": 0.9}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(q.loc[k], np.percentile(g.x, [5, 50, 90]), rtol=1e-12, atol=1e-12)


def test_percentile_rank_counts_ties_half(spark):
    h = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3)], "k string, x double")
    q = spark.createDataFrame([("a", 2.0), ("a", 2.5), ("a", 0.0), ("b", 1.0)], "k string, x double")
    got = {(r.k, r.x): r.pct_rank for r in ranks.percentile_rank(q, h, ["k"], "x").collect()}
    assert got == {("a", 2.0): 62.5, ("a", 2.5): 75.0, ("a", 0.0): 0.0, ("b", 1.0): None}


def test_bursts_and_null_keys(spark, ranges):
    """A second with most of the rows, a NULL key and a NULL time."""
    import datetime as dt

    from pyspark.sql import functions as F

    from weatherlake.operators import windows

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(microseconds=i), i) for i in range(4000)] + [("a", t0 + dt.timedelta(hours=h), 4000 + h) for h in range(1, 9)]
    rows += [(None, t0 + dt.timedelta(days=i), 5000 + i) for i in range(6)] + [("b", None, 6000), ("b", t0, 6001)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long")
    out = windows.running(df, ["k"], ["ts", "i"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("i"))})
    want = {}
    for key in ("a", None, "b"):
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or t0, r[2])), 1):
            total += r[2]
            want[r[2]] = (n, total)
    assert {r.i: (r.n, r.s) for r in out.collect()} == want


def test_features_need_no_window_per_step(spark):
    """The doubling frames of a tile are arrays: the plan's windows don't grow with variables or sizes, and tiles of
    many keys share a batch."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 60, 3000), "t": rng.permutation(3000), "x": rng.normal(size=3000)})
    df = spark.createDataFrame(pdf)
    out = series.features(df, ["k"], ["t"], ["x"], stats=("lag", "window"), lags=(1, 6), windows=(6, 24))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2
    got = out.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = pdf.sort_values(["k", "t"]).reset_index(drop=True).groupby("k").x
    np.testing.assert_allclose(got.x_lag_6, g.shift(6))
    for size in (6, 24):
        r = g.rolling(size, min_periods=size // 2)
        np.testing.assert_allclose(got[f"x_rollmean_{size}"], r.mean().to_numpy(), atol=1e-12)
        np.testing.assert_allclose(got[f"x_rollstd_{size}"], r.std().to_numpy(), atol=1e-9)
        np.testing.assert_array_equal(got[f"x_rollmax_{size}"], r.max().to_numpy())
