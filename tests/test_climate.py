import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherlake.functions import stats, thermal
from weatherlake.operators import climate, islands


def days(spark, values, key="r"):
    d0 = date(2020, 1, 1)
    rows = [(key, d0 + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "region string, d date, x double")


def test_gamma_functions():
    a = np.array([1.0, 2.0, 0.5, 30.0])
    x = np.array([1.0, 2.0, 0.25, 40.0])
    want = [1 - math.exp(-1), 1 - 3 * math.exp(-2), math.erf(0.5)]
    np.testing.assert_allclose(stats.gamma_cdf(a, x)[:3], want, rtol=1e-12)
    upper = math.exp(-40) * sum(40.0**k / math.factorial(k) for k in range(30))
    np.testing.assert_allclose(stats.gamma_cdf(a, x)[3], 1 - upper, rtol=1e-10)
    rng = np.random.default_rng(1)
    s = rng.gamma(3.0, 2.0, 5000)
    k = stats.gamma_shape(np.array([s.mean()]), np.array([np.log(s).mean()]))[0]

    def loglik(k):
        th = s.mean() / k
        return ((k - 1) * np.log(s) - s / th).sum() - len(s) * (math.lgamma(k) + k * math.log(th))

    assert loglik(k) >= max(loglik(k * 1.001), loglik(k * 0.999))


def test_spi_uses_no_future_rows(spark):
    rng = np.random.default_rng(42)
    v = rng.gamma(0.6, 5, 150)
    v[rng.random(150) < 0.4] = 0
    long = climate.spi(days(spark, v), ["region"], "d", "x", days=10).orderBy("d").toPandas()
    short = climate.spi(days(spark, v[:90]), ["region"], "d", "x", days=10).orderBy("d").toPandas()
    np.testing.assert_allclose(short.spi, long.spi[:90], rtol=1e-9)
    assert long.spi[9:].notna().any() and long.spi.dropna().abs().max() < 5


def test_spi_zero_accumulation_is_normal(spark):
    out = climate.spi(days(spark, [0.0] * 40), ["region"], "d", "x", days=5).toPandas()
    assert (out.spi == 0).all()


def test_drought_index_of_flat_record_is_zero(spark):
    assert climate.drought_index(days(spark, [2.0] * 60), ["region"], "d", "x", days=30).first().drought_index == 0.0


def test_normal_quantile_approximation(spark):
    got = spark.range(1).select(stats.normal_quantile(F.lit(0.975)).alias("a"), stats.normal_quantile(F.lit(0.2)).alias("b")).first()
    assert abs(got.a - 1.959964) < 5e-4 and abs(got.b + 0.841621) < 5e-4


def test_dry_fraction_counts_missing_as_not_dry(spark):
    out = climate.dry_day_fraction(days(spark, [0.0, None, 5.0, 0.0]), ["region"], "d", "x").orderBy("d").toPandas()
    np.testing.assert_allclose(out.dry_fraction, [1, 0.5, 1 / 3, 0.5])


def test_heatwave_membership(spark):
    v = [36, 36, 30, 36, 36, 36, 36, 35]
    out = islands.in_long_run(days(spark, v), ["region"], ["d"], F.col("x") > 35, 3).orderBy("d").toPandas()
    assert list(out.in_run) == [False] * 3 + [True] * 4 + [False]


@pytest.mark.parametrize("t,expected", [([10.0, 20.0], True), ([10.0, 80.0], False)])
def test_market_units_detected_per_series(spark, t, expected):
    out = climate.market_degree_days(days(spark, t), ["region"], "x").orderBy("d").toPandas()
    f = [x * 9 / 5 + 32 if expected else x for x in t]
    np.testing.assert_allclose(out.hdd_f, [max(65 - x, 0) for x in f])


def test_heat_index_and_wind_chill_ranges(spark):
    r = spark.range(1).select(
        thermal.heat_index(F.lit(20.0), F.lit(50.0)).alias("mild"),
        thermal.heat_index(F.lit(35.0), F.lit(60.0)).alias("hot"),
        thermal.wind_chill(F.lit(-10.0), F.lit(30.0)).alias("cold"),
        thermal.wind_chill(F.lit(15.0), F.lit(30.0)).alias("warm"),
    ).first()
    assert r.mild < 21 and 44 < r.hot < 46 and -20.5 < r.cold < -19 and r.warm == 15.0


def test_scaler_roundtrip_and_constant_column(spark):
    df = days(spark, [1, 2, 3]).withColumn("c", F.lit(4.0))
    fit = climate.scaler(df, ["region"], ["x", "c"])
    out = climate.unstandardise(climate.standardise(df, fit, ["region"], ["x", "c"]), ["x", "c"]).toPandas()
    np.testing.assert_allclose(out.x_restored, out.x)
    assert (out.c_scaled == 0).all() and (fit.first().c_std == 1.0)
