"""Audit chains, metering, reconciliation and sources."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherlake.operators import audit, metering, relational
from weatherlake.sources import readers, writers

T0 = datetime(2024, 1, 1)


def sealed(spark, n=60):
    rows = [("t0" if i % 3 else "t1", i, T0 + timedelta(hours=7 * i), f'{{"i": {i}}}') for i in range(n)]
    df = spark.createDataFrame(rows, "tenant_id string, id long, ts timestamp, payload string")
    return audit.seal_chains(df, "tenant_id", ["ts", "id"])


def verify(df):
    v = audit.verify_chains(df, ["tenant_id"], ["ts", "id"])
    return {r.tenant_id: (r.ok, r.first_bad) for r in v.collect()}


def test_chain_seals_and_detects_tampering(spark):
    s = sealed(spark)
    assert verify(s) == {"t0": (True, None), "t1": (True, None)}
    changed = s.withColumn("payload", F.when(F.col("id") == 9, "x").otherwise(F.col("payload")))
    assert verify(changed)["t1"] == (False, 3) and verify(changed)["t0"] == (True, None)
    assert verify(s.filter("id <> 9"))["t1"] == (False, 3)
    assert verify(s.filter("id <> 0"))["t1"] == (False, 0)


def test_omissions_only_for_mutating_paths(spark):
    log = spark.createDataFrame([("a", "/v1/backtests"), ("b", "/v1/signals/x"), ("c", "/v1/admin/keys/1")], "request_id string, path string")
    aud = spark.createDataFrame([("a",)], "request_id string")
    assert [r.request_id for r in audit.omissions(log, aud).collect()] == ["c"]


def brute_sessions(events):
    queue, out = [], []
    for ts, _, action in sorted(events):
        if action == "feed.connect":
            queue.append(ts)
        elif queue:
            out.append((queue.pop(0), ts))
    return out


def test_feed_sessions_match_a_queue_with_orphans(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for s in range(12):
        ev = []
        for i in range(int(rng.integers(1, 60))):
            up = rng.random() < (0.3 if s % 2 else 0.6)
            ev.append((T0 + timedelta(minutes=int(rng.integers(0, 6000))), i, "feed.connect" if up else "feed.disconnect"))
        want[s] = sorted(brute_sessions(ev))
        rows += [("t", s, *e) for e in ev]
    df = spark.createDataFrame(rows, "tenant_id string, session_id int, ts timestamp, id int, action string")
    got = {s: [] for s in want}
    for r in metering.feed_sessions(df, ["tenant_id", "session_id"], "id").collect():
        got[r.session_id].append((r.connected, r.disconnected))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_feed_hours_floor_and_minimum(spark):
    rows = [("a", T0, T0 + timedelta(minutes=90)), ("b", T0, T0 + timedelta(minutes=20)), (None, T0, T0 + timedelta(hours=30))]
    df = spark.createDataFrame(rows, "tenant_id string, connected timestamp, disconnected timestamp")
    got = {r.tenant_id: r.feed_hours for r in metering.feed_hours(df, "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()}
    assert got == {"a": 1.0, "internal": 24.0}


def test_drift_ladder(spark):
    names = ["same", "two", "twenty", "ghost", "meter"]
    chain = spark.createDataFrame([("same", 100), ("two", 100), ("twenty", 100), ("meter", 100)], "tenant_id string, chain_calls long")
    log = spark.createDataFrame([("same", 100), ("two", 102), ("twenty", 120), ("ghost", 5), ("meter", 100)], "tenant_id string, log_calls long")
    roll = spark.createDataFrame([("same", 100), ("two", 100), ("twenty", 100), ("meter", 99)], "tenant_id string, rollup_calls long")
    r = {x.tenant_id: (x.state, x.actions) for x in metering.reconcile(chain, roll, log).collect()}
    assert r == {
        "same": ("normal", []),
        "two": ("drift", ["log-drift"]),
        "twenty": ("extreme", ["log-drift"]),
        "ghost": ("extreme", []),
        "meter": ("drift", ["rollup-mismatch"]),
    } and set(names) == set(r)


def test_severity_by_whole_words(spark):
    texts = ["The API is DOWN", "a countdown began", "slow page", "how to start", "échec", "nothing", "failéd fail"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(metering.severity(F.col("t")).alias("s")).collect()]
    assert got == ["S1", "S3", "S2", "S3", "S3", "S3", "S2"]


def test_error_budget_ignores_fail_closed(spark):
    rows = [("d", 500, False)] + [("d", 503, True)] * 5 + [("d", 200, False)] * 1994
    df = spark.createDataFrame(rows, "day string, status int, fail_closed boolean")
    assert metering.error_budget(df, ["day"]).first().remaining_fraction == pytest.approx(0.5)


def test_batches_split_large_cycles(spark):
    rows = [("c1" if i < 25 else "c2", T0 + timedelta(minutes=i), i, "LONG") for i in range(30)]
    df = spark.createDataFrame(rows, "forecast_cycle_id string, ts timestamp, id int, action string").withColumn("publication_ts", F.lit("p"))
    b = relational.signal_batches(df, ["ts", "id"], ["action", "id"], part_size=10)
    assert {(r.cycle_id, r.part, r.n_signals) for r in b.collect()} == {("c1", 0, 10), ("c1", 1, 10), ("c1", 2, 5), ("c2", 0, 5)}


def test_access_log_drops_unparseable_lines(spark):
    good = '10.0.0.1 r7 "GET /v1/x?y=1 HTTP/1.1" 200 5'
    df = spark.createDataFrame([(good,), ("junk",), ("",)], "value string")
    assert [tuple(r) for r in readers.parse_access_log(df).collect()] == [("r7", "GET", "/v1/x?y=1", 200)]


def test_cycle_files_take_identity_from_name(spark, tmp_path):
    t = datetime(2024, 1, 2, 12)
    cells = spark.createDataFrame([(t, t, 25.0, -80.0, 271.0), (t, t, 26.0, -80.0, float("nan"))], "time timestamp, valid_time timestamp, latitude double, longitude double, t2m double")
    for lead in (0, 12):
        cells.coalesce(1).write.parquet(str(tmp_path / f"stage{lead}"))
        (part,) = (tmp_path / f"stage{lead}").glob("part-*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"gfs_20240102_12z_f{lead:03d}_box.parquet").write_bytes(part.read_bytes())
    out = readers.read_cycle_files(spark, str(tmp_path / "in"))
    assert {(r.date, r.cycle, r.lead) for r in out.collect()} == {("20240102", "12", 0), ("20240102", "12", 12)}
    assert out.filter("t2m is null").count() == 2


def test_cycle_writer_resumes(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("d1", "12", 0, 1.0), ("d1", "12", 12, 2.0), ("d2", "12", 0, 3.0)], "date string, cycle string, lead int, t2m double")
    writers.write_cycles(spark, df.filter("date = 'd1'"), path)
    writers.write_cycles(spark, df, path)
    writers.write_cycles(spark, df, path)
    got = readers.read_cycle_store(spark, path)
    assert got.count() == 3
    plan = readers.read_cycle_store(spark, path, leads=[12])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lead" in plan


def test_upsert_prefers_new_and_later(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 4, "n"), ("c", 1, "n")], "k string, v int, s string")
    got = {r.k: r.s for r in writers.upsert(old, new, ["k"], F.col("v")).collect()}
    assert got == {"a": "n", "b": "y", "c": "n"}


def test_price_and_contract_csv(spark, tmp_path):
    (tmp_path / "OJ.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,1,2,0.5,,0\n")
    r = readers.read_prices(spark, str(tmp_path / "OJ.csv")).orderBy("Date").collect()
    assert r[0].ticker == "OJ" and r[0].Close == 1.5 and r[1].Close is None
    (tmp_path / "c.csv").write_text("contract,month_name,first_notice_day,last_trading_day\nOJH26,Mar26,2026-03-02,2026-02-26\n")
    assert readers.read_contracts(spark, str(tmp_path / "c.csv")).first().month_name == "Mar26"


def test_weather_documents(spark):
    one = '{"latitude": 1.5, "timezone": "GMT", "hourly": {"time": ["2024-01-01T00:00"], "t2": [3.5]}, "daily": {"time": ["2024-01-01"], "mx": [9]}}'
    df = spark.createDataFrame([("a", one), ("b", f"[{one},{one}]")], "doc string, value string")
    h, d = readers.parse_weather(df, ["t2"], ["mx"], keep=["doc"])
    assert sorted((r.doc, r.location, r.t2, r.latitude) for r in h.collect()) == [("a", 0, 3.5, 1.5), ("b", 0, 3.5, 1.5), ("b", 1, 3.5, 1.5)]
    assert {r.daily_mx for r in d.collect()} == {9.0}


@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
@pytest.mark.parametrize("steps", [1, 2, 64])
def test_chunks_hold_whole_steps(spark, batch, steps):
    """Every chunk has whole steps and, but for the last of a partition, the number asked for, at any batch size."""
    rows = [(t, float(i)) for t in [None, 0, 1, 2, 3, 4, 5] for i in range(1 if t == 3 else 11)]
    df = spark.createDataFrame(rows, "t long, v double").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:

        def seen(pdf):
            per = pdf.groupby("t", dropna=False).v.agg(["count", "sum"]).reset_index()
            return per.rename(columns={"count": "n", "sum": "total"}).assign(steps=len(per))

        got = writers.chunked_map(df, "t", seen, "t double, n long, total double, steps long", partitions=1, steps=steps).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((r.t is None or math.isnan(r.t), r.t or 0.0, r.n, r.total) for r in got) == sorted(
        (t is None, float(t or 0), 1 if t == 3 else 11, 0.0 if t == 3 else 55.0) for t in [None, 0, 1, 2, 3, 4, 5]
    )
    assert all(r.steps <= steps for r in got) and sum(r.steps < min(steps, 7) for r in got) < max(steps, 2)


def test_price_lines_that_do_not_fit_are_set_aside(spark, tmp_path):
    (tmp_path / "OJ.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,x,2,1,1,1\n2024-01-04,1,2,1,NaN,5\n")
    (tmp_path / "KC.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,9.5,10\n")
    good, bad = readers.split_prices(spark, str(tmp_path))
    assert sorted((r.ticker, str(r.Date), r.Close) for r in good.collect()) == [("KC", "2024-01-02", 9.5), ("OJ", "2024-01-02", 1.5), ("OJ", "2024-01-04", None)]
    assert [(r.ticker, r.line) for r in bad.collect()] == [("OJ", "2024-01-03,x,2,1,1,1")]


def test_units_from_file_names_skip_files(spark, tmp_path):
    """Identity from names; files outside the dates and leads are not opened, so a broken one there does no harm."""
    for name in ("gfs_20240101_12z_f000", "gfs_20240101_12z_f024", "gfs_20240102_12z_f000"):
        spark.createDataFrame([(name, 1.0)], "src string, t2m double").coalesce(1).write.parquet(str(tmp_path / name) + ".parquet")
    (tmp_path / "gfs_20230101_12z_f000.parquet").write_bytes(b"broken")
    (tmp_path / "notes.parquet").write_bytes(b"broken")
    x = readers.read_cycle_files(spark, str(tmp_path), "src string, t2m double", first="20240101", leads=[0])
    assert sorted((r.date, r.cycle, r.lead, r.src) for r in x.collect()) == [
        ("20240101", "12", 0, "gfs_20240101_12z_f000"), ("20240102", "12", 0, "gfs_20240102_12z_f000")
    ]
