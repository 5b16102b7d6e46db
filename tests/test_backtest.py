"""Hand-computed backtest, trades, folds and the paper ledger."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherlake.operators import backtest

CLOSES = [100, 100, 110, 121, 121, 121, 133.1, 133.1, 133.1, 146.41]
SIZES = {1: 0.5, 2: 0.5, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0, 8: 0, 9: 0}


def weekdays(n, start=date(2023, 1, 2)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def known(spark):
    rows = [("x", d, float(c), float(SIZES.get(i, 0))) for i, (d, c) in enumerate(zip(weekdays(10), CLOSES))]
    df = spark.createDataFrame(rows, "instrument string, session date, close double, position double")
    return backtest.equity_curve(df, ["instrument"], "session", commission_bps=5, slippage_bps=10)


def test_known_value_summary(known):
    s = backtest.summary(known, ["instrument"], "session").first()
    assert s.total_return == pytest.approx(0.2073014870963630, rel=1e-12)
    assert s.max_drawdown == pytest.approx(0.0015, rel=1e-9)
    assert s.win_rate == 1.0 and s.profit_factor is None and s.n_trades == 2


def test_known_value_trades(spark):
    rows = [("x", d, float(c), float(SIZES.get(i, 0))) for i, (d, c) in enumerate(zip(weekdays(10), CLOSES))]
    df = spark.createDataFrame(rows, "instrument string, session date, close double, position double")
    e = backtest.equity_curve(df, ["instrument"], "session", capital=100_000.0, commission_bps=5, slippage_bps=10)
    t = backtest.trades(e, ["instrument"], "session").orderBy("entry_idx").toPandas()
    np.testing.assert_allclose(t.pnl, [10242.3125, 10991.95599851015625], rtol=1e-12)
    assert list(t.entry_idx) == [1, 5] and list(t.exit_idx) == [3, 7]
    np.testing.assert_allclose(t.costs_bps, [15.0, 30.0])


def test_round_trip_cost(spark):
    d = weekdays(4)
    rows = [("x", s, 100.0, p) for s, p in zip(d, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "instrument string, session date, close double, position double")
    e = backtest.equity_curve(df, ["instrument"], "session", capital=100_000.0, commission_bps=5, slippage_bps=10)
    assert e.orderBy(F.col("bar").desc()).first().equity == pytest.approx(99_700.225)


def test_open_trade_closes_at_last_bar_without_cost(spark):
    rows = [("x", s, c, 1.0) for s, c in zip(weekdays(3), [100.0, 100.0, 110.0])]
    df = spark.createDataFrame(rows, "instrument string, session date, close double, position double")
    t = backtest.trades(backtest.equity_curve(df, ["instrument"], "session"), ["instrument"], "session").first()
    assert t.exit_idx == 2 and t.costs_incurred == pytest.approx(0.0007) and t["return"] == pytest.approx(0.1)


def test_short_series_give_nothing(spark):
    df = spark.createDataFrame([("x", date(2023, 1, 2), 1.0, 1.0)], "instrument string, session date, close double, position double")
    assert backtest.equity_curve(df, ["instrument"], "session").count() == 0


def test_folds_and_training_rows(spark):
    rows = [("x", date(2020, 1, 1) + timedelta(days=i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "instrument string, session date, close double")
    f = backtest.walk_forward_folds(df, ["instrument"], "session", 10, 5).toPandas()
    assert f.groupby("fold").close.min().to_dict() == {0: 10, 1: 15, 2: 20, 3: 25}
    t = backtest.walk_forward_training(df, ["instrument"], "session", 10, 5).toPandas()
    g = t.groupby("fold").close
    assert g.min().to_dict() == {0: 0, 1: 5, 2: 10, 3: 15} and (g.count() == 10).all()
    one = backtest.walk_forward_folds(df, ["instrument"], "session", 28, 5)
    assert one.count() == 30 and one.select("fold").distinct().count() == 1


def test_var_and_cvar(spark):
    r = np.random.default_rng(123).normal(0.0005, 0.01, 252)
    df = spark.createDataFrame([("x", float(v)) for v in r], "k string, r double")
    out = backtest.value_at_risk(df, ["k"], "r").first()
    cut = np.percentile(r, 5)
    assert out["var"] == pytest.approx(-cut) and out.cvar == pytest.approx(-r[r <= cut].mean())


def test_paper_ledger(spark):
    rows = [
        ("a", 1, "OJ", "LONG", 0.1, 100.0),
        ("a", 2, "OJ", "LONG", 0.1, 110.0),
        ("a", 3, "OJ", "CLOSE_LONG", 0.0, 120.0),
        ("a", 4, "OJ", "CLOSE_LONG", 0.0, 120.0),
        ("a", 5, "OJ", "FLAT", 0.0, 120.0),
        ("b", 1, "NG", "SHORT", 0.2, 50.0),
        ("b", 2, "NG", "CLOSE_SHORT", 0.0, 40.0),
    ]
    df = spark.createDataFrame(rows, "account string, seq long, instrument string, action string, size double, price double")
    out = backtest.paper_ledger(df, ["seq"], 10_000.0).orderBy("account", "seq").toPandas()
    assert list(out.status) == ["opened", "added", "closed", "none", "flat", "opened", "closed"]
    q2 = 0.1 * 10_100 / 110
    entry = (100 * 10 + 110 * q2) / (10 + q2)
    assert out.pnl[2] == pytest.approx((120 - entry) * (10 + q2))
    assert out.equity[2] == pytest.approx(10_000 + out.pnl[2])
    assert out.pnl[6] == pytest.approx(40 * 10.0) and out.cash[6] == pytest.approx(10_400)
