"""Streams over several files: late and repeated cycles, run state across batches, batch equality."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weatherlake.operators import metering, relational
from weatherlake.plans.stream_queries import rocksdb
from weatherlake.streaming import jobs

T0 = datetime(2024, 1, 1)


def land(df, folder, n):
    """One file per call, in arrival order."""
    df.coalesce(1).write.parquet(f"{folder}/f{n}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet"
    ).parquet(folder)


def test_late_and_repeated_cycles_are_dropped(spark, tmp_path):
    schema = "cycle_id string, publication_ts timestamp"
    root = str(tmp_path / "in")
    land(spark.createDataFrame([("c1", T0), ("c1", T0), ("c2", T0 + timedelta(days=3))], schema), root, 0)
    land(spark.createDataFrame([("c2", T0 + timedelta(days=3))], schema), root, 1)
    # a batch drops what was late before it began: the watermark of the batch before it
    land(spark.createDataFrame([("c2", T0 + timedelta(days=3)), ("old", T0 + timedelta(hours=1)), ("c3", T0 + timedelta(days=3))], schema), root, 2)
    s = jobs.fresh_cycles(stream(spark, root, schema), "publication_ts", "cycle_id")
    out = jobs.drain(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.cycle_id for r in out.collect()) == ["c1", "c2", "c3"]


def test_run_state_survives_batches(spark, tmp_path):
    schema = "location string, day date, hit boolean"
    root = str(tmp_path / "in")
    d = [date(2024, 7, i) for i in range(1, 9)]
    land(spark.createDataFrame([("a", d[1], True), ("a", d[0], True), ("b", d[0], False)], schema), root, 0)
    land(spark.createDataFrame([("a", d[2], True), ("b", d[1], True)], schema), root, 1)
    land(spark.createDataFrame([("a", d[3], False), ("a", d[1], True), ("b", d[2], True), ("b", d[5], True)], schema), root, 2)
    with rocksdb(spark):
        s = jobs.run_length_alerts(stream(spark, root, schema), 2)
        out = jobs.drain(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r.location, r.day, r.length) for r in out.collect()) == [("a", d[1], 2), ("a", d[2], 3), ("b", d[2], 2)]


@pytest.mark.parametrize("order", ["in order", "reversed", "shuffled"])
def test_late_days_join_and_bridge_runs(spark, tmp_path, order):
    """One file a day, in any order: after corrections, the batch answer."""
    schema = "location string, day date, hit boolean"
    root, first = str(tmp_path / "in"), date(2024, 7, 1)
    hits = {"a": "1110111110011", "b": "0000000000000", "c": "1010111011111"}
    files = list(range(13))
    if order == "reversed":
        files.reverse()
    elif order == "shuffled":
        random.Random(4).shuffle(files)
    for n, i in enumerate(files):
        land(spark.createDataFrame([(k, first + timedelta(days=i), h[i] == "1") for k, h in hits.items()], schema), root, n)
    with rocksdb(spark):
        out = jobs.drain(jobs.run_length_alerts(stream(spark, root, schema), 2), str(tmp_path / "out"), str(tmp_path / "ck"))
    want = []
    for k, h in hits.items():
        n = 0
        for i, x in enumerate(h):
            n = n + 1 if x == "1" else 0
            if n >= 2:
                want.append((k, first + timedelta(days=i), n))
    assert sorted((r.location, r.day, r.length) for r in jobs.latest_lengths(out).collect()) == sorted(want)


def test_days_before_the_horizon_leave_as_late(spark, tmp_path):
    schema = "location string, day date, hit boolean"
    root, first = str(tmp_path / "in"), date(2024, 7, 1)
    for n, days in enumerate(([0, 1], [40, 41], [2], [39])):
        land(spark.createDataFrame([("a", first + timedelta(days=i), True) for i in days], schema), root, n)
    with rocksdb(spark):
        out = jobs.drain(jobs.run_length_alerts(stream(spark, root, schema), 1, horizon=10), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(((r.day - first).days, r.length, r.late) for r in jobs.latest_lengths(out).collect())
    assert got == [(0, 1, False), (1, 2, False), (2, 1, True), (39, 1, False), (40, 2, False), (41, 3, False)]


def cells(site, day, leads, value=1.0):
    return [(site, day, lead, datetime(day.year, day.month, day.day, 1) + timedelta(minutes=lead), value + lead) for lead in leads]


def test_a_cycle_over_three_files_comes_out_once(spark, tmp_path):
    """One file per trigger: parts of a cycle come in three files, another one never gets its last part, a third one
    gets rows after it was complete. The accepted features and signals are those of one batch over all cells."""
    schema = "site string, date date, lead int, ts timestamp, t2m double"
    root, d1, d9 = str(tmp_path / "in"), date(2024, 1, 1), date(2024, 1, 9)
    files = [
        cells("a", d1, [0]) + cells("b", d1, [0, 12]) + cells("c", d1, [0, 12, 24]),
        cells("a", d1, [12]),
        cells("a", d1, [24], 5.0) + cells("c", d1, [0], 9.0),
        cells("z", d9, [0, 12, 24]),
        cells("z", d9 + timedelta(days=3), [0]),
    ]
    for n, rows in enumerate(files):
        land(spark.createDataFrame(rows, schema), root, n)
    keys = ["site", "date"]
    features = lambda c: c.groupBy(*keys).agg(F.min("t2m").alias("low"), F.count("*").alias("n"))
    verdict = lambda c: c.select(*keys).distinct().withColumn("reason", F.lit(None).cast("string"))
    signal = lambda f: f.select(*keys, F.when(F.col("low") < 2, "LONG").otherwise("FLAT").alias("action"))
    good, bad, out = (str(tmp_path / x) for x in ("good", "bad", "signals"))
    with rocksdb(spark):
        s = jobs.whole_cycles(stream(spark, root, schema), keys, "ts", F.date_add("date", 1), F.col("lead"), [0, 12, 24])
        jobs.cycle_intake(s, features, verdict, keys, good, bad, str(tmp_path / "ck"), signal, out).awaitTermination()
    got = sorted((r.site, r.date, r.low, r.n) for r in spark.read.parquet(good).collect())
    batch = spark.createDataFrame(cells("a", d1, [0, 12]) + cells("a", d1, [24], 5.0) + cells("c", d1, [0, 12, 24]) + cells("z", d9, [0, 12, 24]), schema)
    assert got == sorted((r.site, r.date, r.low, r.n) for r in features(batch).collect())
    assert sorted((r.site, r.action) for r in spark.read.parquet(out).collect()) == [("a", "LONG"), ("c", "LONG"), ("z", "LONG")]
    assert sorted((r.site, r.date, r.reason) for r in spark.read.parquet(bad).collect()) == [
        ("b", d1, "missing parts: 24"), ("c", d1, "arrived after completion")
    ]


@pytest.mark.parametrize("marked", [False, True])
def test_signals_of_a_cycle_are_published_once(spark, tmp_path, marked):
    """Signals over three micro-batches: one numbered run of parts, at the row that ends the cycle or at its deadline."""
    schema = "forecast_cycle_id string, ts timestamp, event_id long, action string, last boolean"
    root = str(tmp_path / "in")
    rows = [("c1", T0 + timedelta(minutes=i), i, "LONG", i == 8) for i in range(9)]
    for n in range(3):
        land(spark.createDataFrame(rows[n * 3 : n * 3 + 3], schema), root, n)
    land(spark.createDataFrame([("c2", T0 + timedelta(days=2), 99, "FLAT", False)], schema), root, 3)
    s = stream(spark, root, schema).withColumn("publication_ts", F.lit("2024-01-01 15:30:00"))
    due = F.to_date("ts") + F.expr("interval 1 day")
    with rocksdb(spark):
        whole = jobs.whole_cycles(s, ["forecast_cycle_id"], "ts", due, ends=F.col("last") if marked else None, release=True)
        out = str(tmp_path / "out")
        jobs.publish_batches(whole, lambda x: relational.signal_batches(x, ["ts", "event_id"], ["event_id"], part_size=4), out, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema("cycle_id string, part long, payload string").json(out).collect()
    assert sorted((r.cycle_id, r.part) for r in got) == [("c1", 0), ("c1", 1), ("c1", 2)]
    ids = [x["event_id"] for r in sorted(got, key=lambda r: r.part) for x in json.loads(r.payload)["signals"]]
    assert ids == list(range(9))


def test_feed_sessions_across_batches_equal_batch(spark, tmp_path):
    schema = "tenant_id string, session_id long, ts timestamp, id long, action string"
    minutes = [(0, "c"), (10, "d"), (12, "d"), (60, "c"), (70, "c"), (200, "d"), (300, "d"), (301, "d"), (900, "c"), (2000, "d")]
    rows = [("t", 1, T0 + timedelta(minutes=m), i, "feed.connect" if a == "c" else "feed.disconnect") for i, (m, a) in enumerate(minutes)]
    root = str(tmp_path / "in")
    for n, part in enumerate((rows[:2][::-1], rows[2:5], rows[5:8], rows[8:], [("t", 2, T0 + timedelta(days=9), 99, "feed.connect")])):
        land(spark.createDataFrame(part, schema), root, n)
    with rocksdb(spark):
        s = jobs.feed_sessions(stream(spark, root, schema), "ts", "id", F.col("action") == "feed.connect", delay="30 minutes")
        out = jobs.drain(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r.connected_ms, r.disconnected_ms) for r in out.collect())
    batch = metering.feed_sessions(spark.createDataFrame(rows, schema), ["tenant_id", "session_id"], "id")
    want = sorted((r.a, r.b) for r in batch.select(F.unix_millis("connected").alias("a"), F.unix_millis("disconnected").alias("b")).collect())
    assert got == want and len(got) == 4


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_window_statistics_equal_batch(spark, tmp_path, slide):
    schema = "k string, ts timestamp, v double"
    rows = [("a", T0 + timedelta(minutes=7 * i), float(i % 13)) for i in range(120)]
    root = str(tmp_path / "in")
    for n in range(3):
        land(spark.createDataFrame(rows[n * 40 : n * 40 + 40], schema), root, n)
    x = jobs.window_statistics(stream(spark, root, schema), ["k"], "ts", "v", "1 hour", slide, delay="10 minutes")
    out = jobs.drain(x, str(tmp_path / "out"), str(tmp_path / "ck"))
    mark = rows[-1][1] - timedelta(minutes=10)
    batch = jobs.window_statistics(spark.createDataFrame(rows, schema), ["k"], "ts", "v", "1 hour", slide)
    key = lambda df: sorted((r.start, round(r.mean, 9), r.n) for r in df.collect())
    assert key(out) == key(batch.filter(F.col("end") <= F.lit(mark)))


def test_rejected_cycles_go_to_the_side_output(spark, tmp_path):
    schema = "site string, lead int, t2m double"
    root = str(tmp_path / "in")
    land(spark.createDataFrame([("a", 0, 1.0), ("a", 12, 2.0), ("b", 0, 3.0)], schema), root, 0)

    def verdict(c):
        g = c.groupBy("site").agg(F.count_distinct("lead").alias("n"))
        return g.withColumn("reason", F.when(F.col("n") < 2, "missing_leads"))

    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    q = jobs.cycle_intake(
        stream(spark, root, schema), lambda c: c.groupBy("site").agg(F.min("t2m").alias("m")), verdict, ["site"], good, bad, str(tmp_path / "ck")
    )
    q.awaitTermination()
    assert [(r.site, r.m) for r in spark.read.parquet(good).collect()] == [("a", 1.0)]
    assert [(r.site, r.reason) for r in spark.read.parquet(bad).collect()] == [("b", "missing_leads")]
