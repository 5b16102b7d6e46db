"""Queries that run their operators over all windows, lags, draws and days."""

import os

import pytest

import __spark_entry__ as entry
from test_queries import DIR, con, test_query_matches_sql as matches_sql  # noqa: F401
from weatherlake.operators import series

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are absent")
STATS = ("rollmean", "rollstd", "rollmin", "rollmax", "trend", "anomaly", "is_anomaly", "rolling")
EVERY = {f"{v}_{s}_{k}" for v in ("temp_c", "precip") for s in STATS for k in series.WINDOWS}
EVERY |= {f"{v}_lag_{k}" for v in ("temp_c", "precip") for k in series.LAGS}
EVERY |= {f"{v}_ema_{k}" for v in ("temp_c", "precip") for k in series.EMA_SPANS}
WHOLE = {
    "ts_rolling_trend_all": {f"temp_c_trend_{k}" for k in series.WINDOWS},
    "ts_rolling_zscore_all": {f"temp_c_{s}_{k}" for s in ("anomaly", "is_anomaly") for k in series.WINDOWS},
    "ts_full_mean_all": {f"temp_c_rolling_{k}" for k in series.WINDOWS},
    "ts_feature_builder_all": EVERY,
}


@pytest.mark.parametrize("name", WHOLE)
def test_all_windows(spark, con, name):  # noqa: F811
    assert set(entry.queries()[name](spark, DIR).columns) == {"event_id", *WHOLE[name]}
    matches_sql(spark, con, name)


def test_sequences_have_all_rows(spark, con):  # noqa: F811
    assert entry.queries()["ts_sequences_all"](spark, DIR).first().n == 168
    matches_sql(spark, con, "ts_sequences_all")


def test_units_of_all_years(spark, con):  # noqa: F811
    got = entry.queries()["dq_missing_units_all"](spark, DIR)
    assert {r[0] for r in got.selectExpr("substr(date, 1, 4)").distinct().collect()} >= {str(y) for y in range(1995, 2002)}
    matches_sql(spark, con, "dq_missing_units_all")
    matches_sql(spark, con, "dq_gates_all")


def test_bootstrap_has_all_resamples(spark):
    p = [r.p_value * 10_001 for r in entry.queries()["ev_bootstrap"](spark, DIR).collect()]
    assert p and p == pytest.approx([round(x) for x in p], abs=1e-6)
