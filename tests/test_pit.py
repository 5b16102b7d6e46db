"""Rolls, episodes, cutoffs, event statistics and replay on hand-made cases."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherlake.operators import events as ev
from weatherlake.operators import pit as P
from weatherlake.operators import quality

K = ["instrument"]


def weekdays(start, n):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def prices(spark, days, closes):
    return spark.createDataFrame([("OJ", d, float(c)) for d, c in zip(days, closes)], "instrument string, session date, close double")


def contracts(spark):
    rows = [
        ("OJ", "Mar26", date(2026, 3, 2), date(2026, 2, 26)),
        ("OJ", "May26", date(2026, 5, 1), date(2026, 4, 28)),
        ("OJ", "Jul26", date(2026, 7, 1), date(2026, 6, 29)),
    ]
    return spark.createDataFrame(rows, "instrument string, month_name string, first_notice_day date, last_trading_day date")


def test_front_month_rules(spark):
    d = [date(2026, 2, 26), date(2026, 2, 27), date(2026, 3, 2), date(2026, 5, 1), date(2026, 12, 1)]
    s = spark.createDataFrame([("OJ", x) for x in d], "instrument string, session date")
    fnd = {r.session: r.contract_month for r in P.front_month(s, contracts(spark), K, "first_notice_day").collect()}
    ltd = {r.session: r.contract_month for r in P.front_month(s, contracts(spark), K, "last_trading_day", "LTD").collect()}
    assert [fnd[x] for x in d] == ["Mar26", "Mar26", "May26", "Jul26", "Jul26"]
    assert [ltd[x] for x in d] == ["Mar26", "May26", "May26", "Jul26", "Jul26"]


def test_back_adjustment_of_a_modest_gap(spark):
    days = weekdays(date(2026, 2, 2), 40)
    closes = [100.0 if d < date(2026, 3, 2) else 120.0 for d in days]
    cal = P.session_calendar(prices(spark, days, closes), K)
    rolls = P.roll_table(cal, contracts(spark), K, "first_notice_day")
    r = rolls.collect()
    assert len(r) == 1 and r[0].factor == pytest.approx(1.2) and not r[0].flagged
    assert r[0].contract_from == "" and r[0].contract_to == "Mar26"
    out = P.back_adjust(cal, rolls, K).toPandas()
    np.testing.assert_allclose(out.close_adj, 120.0)


def test_flagged_gap_is_left_alone(spark):
    days = weekdays(date(2026, 2, 2), 40)
    closes = [100.0 if d < date(2026, 3, 2) else 300.0 for d in days]
    cal = P.session_calendar(prices(spark, days, closes), K)
    rolls = P.roll_table(cal, contracts(spark), K, "first_notice_day")
    assert rolls.first().flagged and rolls.first().adjustment_type == "none"
    assert P.back_adjust(cal, rolls, K).filter("adjustment_factor <> 1").count() == 0
    jumps = P.roll_jumps(cal, rolls, K).collect()
    assert [j.session for j in jumps] == [date(2026, 3, 2)]


def pit_rows(spark, rows):
    schema = "instrument string, date date, pos int, freeze_prob double, temperature_min double"
    return spark.createDataFrame([("OJ", d, p, f, t) for d, p, f, t in rows], schema)


def test_episodes_join_within_two_sessions(spark):
    d0 = date(2024, 1, 1)
    spec = [(0, 0.1), (1, 0.0), (2, 0.2), (5, 0.3), (7, 0.3), (None, 0.4), (None, 0.5)]
    x = pit_rows(spark, [(d0 + timedelta(days=i), p, f, -1.0) for i, (p, f) in enumerate(spec)])
    out = P.episodes(x, None, K).orderBy("date").collect()
    assert [r.episode_id for r in out] == [1, 0, 1, 2, 2, 3, 4]
    assert [r.episode_start for r in out] == [True, False, False, True, False, True, True]
    s = {r.episode_id: (r.n_rows, r.entry_freeze_prob) for r in P.episode_summary(P.episodes(x, None, K), K).collect()}
    assert s == {1: (2, 0.2), 2: (2, 0.3), 3: (1, 0.4), 4: (1, 0.5)}


def test_appending_future_rows_changes_no_episode(spark):
    rng = np.random.default_rng(2)
    d0 = date(2024, 1, 1)
    rows = [(d0 + timedelta(days=i), i, float(p), -1.0) for i, p in enumerate(np.where(rng.random(60) < 0.4, 0.3, 0.0))]
    full = [(r.date, r.episode_id) for r in P.episodes(pit_rows(spark, rows), None, K).orderBy("date").collect()]
    part = [(r.date, r.episode_id) for r in P.episodes(pit_rows(spark, rows[:35]), None, K).orderBy("date").collect()]
    assert full[:35] == part


def test_fold_thresholds_expand_and_missing_history_never_fires(spark):
    d = [date(2020, 1, 1), date(2020, 6, 1), date(2021, 6, 1)]
    x = pit_rows(spark, [(d[0], 0, 0.0, -1.0), (d[1], 1, 0.4, -1.0), (d[2], 2, 0.3, -1.0)])
    folds = [("f1", "2020-05-01", "2020-12-31"), ("f2", "2021-01-01", "2021-12-31")]
    th = P.fold_thresholds(x, K, [("f1", "2020-04-30"), ("f2", "2020-12-31")])
    assert {r.fold: r.theta_p for r in th.collect()} == {"f2": 0.4}
    fired = {r.date: r.candidate_fire for r in P.firing(x, th, K, folds).collect()}
    assert not any(fired.values())


def test_decision_cutoff_follows_new_york_clock(spark):
    df = spark.createDataFrame([(date(2024, 1, 15),), (date(2024, 7, 15),)], "s date")
    got = [r.c for r in df.select(F.date_format(P.decision_cutoff(F.col("s")), "HH:mm").alias("c")).collect()]
    assert got == ["19:00", "18:00"]


def test_hold_schedule_merges_overlaps(spark):
    cal = P.session_calendar(prices(spark, weekdays(date(2024, 1, 1), 6), range(1, 7)), K)
    e = spark.createDataFrame([("OJ", 1), ("OJ", 2), ("OJ", 5)], "instrument string, pos int")
    out = [r.position for r in P.hold_schedule(e, cal, K).orderBy("pos").collect()]
    assert out == [0, 1, 1, 1, 0, 1]


def test_vintage_drift_and_missing(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "date string, sha256 string")
    cyc = spark.createDataFrame([("a",), ("b",), ("c",)], "date string")
    v = P.vintage_violations(cyc, frame([("a", "1"), ("b", "2")]), frame([("a", "1"), ("b", "9")]), ["date"])
    assert {(r.date, r.reason) for r in v.collect()} == {("c", "missing"), ("b", "hash_drift")}


def test_event_statistics(spark):
    x = np.array([0.02, -0.01, 0.03, 0.01, -0.02, 0.04, 0.0, 0.015, -0.005])
    d0 = date(2024, 1, 1)
    rows = [("OJ", d0 + timedelta(days=9 * i), d0 + timedelta(days=9 * i), float(v), float(v), float(v)) for i, v in enumerate(x)]
    led = spark.createDataFrame(rows, "instrument string, entry_cycle date, entry_session date, gross double, net double, net_of_benchmark double")
    m = ev.event_metrics(led, K, 2.0).first()
    assert m.net_of_benchmark_sharpe == pytest.approx(x.mean() / x.std(ddof=1) * np.sqrt(len(x) / 2))
    num = ev.numbered(led, K, "entry_cycle", "net_of_benchmark")
    nw = ev.newey_west(num, K).first()
    n = len(x)
    lag = max(1, min(int(4 * (n / 100) ** (2 / 9)), n // 2))
    dm = x - x.mean()
    lr = dm @ dm / n + sum(2 * (1 - j / (lag + 1)) * (dm[j:] @ dm[:-j]) / n for j in range(1, lag + 1))
    assert nw.lag == lag and nw.se == pytest.approx(np.sqrt(lr / n))
    b = ev.bootstrap_sharpes(num, K, 2.0, resamples=2000)
    s = ev.bootstrap_summary(b, K).first()
    rng = np.random.default_rng(0)
    ref = [(lambda y: y.mean() / y.std(ddof=1) * np.sqrt(n / 2))(x[rng.integers(0, n, n)]) for _ in range(4000)]
    assert s.p50 == pytest.approx(np.median(ref), abs=0.15)
    assert s.p_value == pytest.approx((1 + np.sum(np.array(ref) <= 0)) / 4001, abs=0.04)
    o = ev.overlaps(led, K).first()
    assert o.n_overlapping == 0 and not o.purging_needed


def test_decision_gate(spark):
    rows = [(0, 0.0, 0.0), (7, 9.0, 9.0), (8, 1.5, 0.1), (8, 1.5, -0.1)]
    df = spark.createDataFrame(rows, "n int, s double, c double")
    got = [r.d for r in df.select(ev.decision(F.col("n"), F.col("s"), F.col("c")).alias("d")).collect()]
    assert got == ["ZERO_TRADES", "UNDER_POWERED", "PASS", "FAIL_PIVOT"]


def test_cycle_validation_reasons(spark):
    def cells(day, lead, n, t=280.0):
        return [("s", day, "12", lead, float(k), t) for k in range(n)]
    d = [date(2024, 1, i) for i in range(1, 5)]
    rows = cells(d[0], 0, 3) + cells(d[0], 12, 3) + cells(d[1], 0, 3) + cells(d[2], 0, 3) + cells(d[2], 12, 2)
    rows += cells(d[3], 0, 3, None) + cells(d[3], 12, 3, None)
    df = spark.createDataFrame(rows, "site string, date date, cycle string, lead int, latitude double, t2m double")
    got = {r.date: r.reason for r in quality.validate_cycles(df, ["site"], (0, 12), 3).collect()}
    assert got == {d[0]: None, d[1]: "missing_leads", d[2]: "wrong_cell_count", d[3]: "no_temperature"}


def test_staleness_window(spark):
    rows = [(date(2024, 1, 10), datetime(2024, 1, 10, h, m)) for h, m in ((15, 29), (15, 30))]
    rows += [(date(2024, 1, 9), datetime(2024, 1, 10, 16, 0)), (date(2024, 1, 8), datetime(2024, 1, 10, 16, 0))]
    df = spark.createDataFrame(rows, "d date, now timestamp")
    got = [r.v for r in df.select(quality.staleness(F.col("d"), F.col("now")).alias("v")).collect()]
    assert got == ["not_published", None, None, "stale"]


def test_duplicate_gate(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [(r.k, r.n) for r in quality.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
