"""Queries for O-STR: streams over the event table, drained with availableNow, against their batch twins."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from weatherlake.operators import quality, relational, signals
from weatherlake.operators.hazards import cycle_features
from weatherlake.plans.registry import query
from weatherlake.plans.signal_queries import SIGNAL_LOG, kelly
from weatherlake.plans.standins import EVENT_SCHEMA, OBS
from weatherlake.session import scratch_path
from weatherlake.streaming import jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, jobs.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def event_stream(spark, d):
    # the files store timestamps without zone; they are read as such and become UTC instants
    schema = EVENT_SCHEMA.replace("ts timestamp", "ts timestamp_ntz")
    # a pattern, because a stream takes one file only by pattern; it matches a folder of part files as well
    return jobs.file_stream(spark, f"{d}/[e]vents.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _paths(spark, name):
    p = scratch_path(spark, name)
    return f"{p}/out", f"{p}/checkpoint"


_MARK = "(select max(ts) - interval 1 hour as m from events)"


@query(
    "str_window_statistics",
    "O-STR-03",
    f"""select station, cast(epoch(s) as bigint) as start, avg(value) as mean, stddev_samp(value) as std, count(*) as n,
 coalesce(greatest(max(value)-avg(value), avg(value)-min(value))/nullif(stddev_samp(value),0) > 2, false) as is_anomaly
 from (select station, value, date_trunc('day', ts) as s from {OBS}) where s + interval 1 day <= date_trunc('milliseconds', (select m from {_MARK})) group by 1, 2""",
    {"mean": 6, "std": 5},
)
def str_window_statistics(spark, d):
    s = event_stream(spark, d).select(F.col("user_id").alias("station"), "ts", "value")
    x = jobs.drain(jobs.window_statistics(s, ["station"], "ts", "value", "1 day"), *_paths(spark, "windows"))
    return jobs.flag_anomalies(x, 2.0).select(
        "station", F.unix_timestamp("start").alias("start"), "mean", "std", "n", "is_anomaly"
    )


@query(
    "str_sliding_statistics",
    "O-STR-03",
    f"""select cast(epoch(s) as bigint) as start, avg(value) as mean, max(value) as max, count(*) as n from
 (select value, to_timestamp(floor(epoch(ts)/43200)*43200 - k*43200)::timestamp as s from (select *, unnest([0, 1]) as k from {OBS}))
 where s + interval 1 day <= (select m from {_MARK}) group by 1""",
    {"mean": 6, "max": 6},
)
def str_sliding_statistics(spark, d):
    s = event_stream(spark, d).select("ts", "value")
    x = jobs.drain(jobs.window_statistics(s, [], "ts", "value", "1 day", "12 hours"), *_paths(spark, "sliding"))
    return x.select(F.unix_timestamp("start").alias("start"), "mean", "max", "n")


@query(
    "str_fresh_cycles",
    "O-STR-02",
    "select count(distinct user_id // 2 * 100 + day(ts)) as cycles from events",
)
def str_fresh_cycles(spark, d):
    """One row per cycle id in a stream with many repeats; all input is one fresh batch."""
    cid = F.floor(F.col("user_id") / 2) * 100 + F.dayofmonth("ts")
    s = event_stream(spark, d).select(cid.alias("cycle_id"), F.col("ts").alias("publication_ts"))
    x = jobs.drain(jobs.fresh_cycles(s, "publication_ts", "cycle_id"), *_paths(spark, "fresh"))
    return x.agg(F.count("*").alias("cycles"))


_CELLS = """(select event_type as site, cast(ts as date) as date, '12' as cycle, cast(event_id % 4 * 12 as int) as lead, ts + interval 12 hour as valid_time, value/5+268.15 as t2m from events)"""
_KEYS = ["site", "date", "cycle"]
#: A cycle is due at the end of its day; its side output is known once the watermark has passed that.
_WHOLE = f"""(select site, date, count(distinct lead) = 4 as ok from {_CELLS} group by 1, 2
 having count(distinct lead) = 4 or date + interval 1 day <= date_trunc('milliseconds', (select m from {_MARK})))"""


def _whole_cells(spark, d):
    s = event_stream(spark, d).select(
        F.col("event_type").alias("site"),
        F.to_date("ts").alias("date"),
        F.lit("12").alias("cycle"),
        (F.col("event_id") % 4 * 12).cast("int").alias("lead"),
        "ts",
        (F.col("ts") + F.make_dt_interval(hours=F.lit(12))).alias("valid_time"),
        F.lit(30.0).alias("latitude"),
        (F.col("value") / 5 + 268.15).alias("t2m"),
    )
    due = F.date_add("date", 1)
    return jobs.whole_cycles(s, _KEYS, "ts", due, F.col("lead"), [0, 12, 24, 36])


def _verdict(cells):
    v = quality.unit_inventory(cells, ["site"]).groupBy(*_KEYS).agg(F.count_distinct("lead").alias("n"))
    return v.withColumn("reason", F.when(F.col("n") < 4, "missing_leads"))


def _freeze(features):
    now = F.col("publish_time") + F.make_dt_interval(hours=F.lit(6))
    return signals.freeze_signal(features, now, entry=0.2)


def _intake(spark, d):
    """Folders of accepted cycles, rejected cycles and signals."""
    root = scratch_path(spark, "cycles")
    good, bad, out = f"{root}/accepted", f"{root}/rejected", f"{root}/signals"
    with rocksdb(spark):
        q = jobs.cycle_intake(_whole_cells(spark, d), lambda c: cycle_features(c, _KEYS), _verdict, _KEYS, good, bad, f"{root}/checkpoint", _freeze, out)
        q.awaitTermination()
    return good, bad, out


@query(
    "str_cycle_intake",
    "O-STR-01",
    f"""with v as {_WHOLE},
 x as (select c.*, valid_time >= c.date + to_minutes(930) and valid_time <= c.date + to_minutes(930) + to_hours(48) as i from {_CELLS} c)
 select x.site, cast(x.date as varchar) as date, case when v.ok then 'accepted' else 'rejected' end as status,
 case when v.ok then count(*) filter (where i and t2m < 273.15)/cast(greatest(count(*) filter (where i), 1) as double) end as freeze_prob
 from x join v on x.site = v.site and x.date = v.date group by 1, 2, v.ok""",
    {"freeze_prob": 8},
)
def str_cycle_intake(spark, d):
    good, bad, _ = _intake(spark, d)
    a = spark.read.parquet(good).select("site", "date", F.lit("accepted").alias("status"), "freeze_prob")
    r = spark.read.parquet(bad).select("site", "date", F.lit("rejected").alias("status"), F.lit(None).cast("double").alias("freeze_prob"))
    return a.unionByName(r).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_DECAYED = "(freeze_prob*exp(-0.693*coalesce(greatest(epoch(date + to_minutes(1290)) - epoch(peak),0),0)/3600.0/48.0))"


@query(
    "str_cycle_signals",
    "O-STR-01",
    f"""with x as (select c.*, valid_time >= c.date + to_minutes(930) and valid_time <= c.date + to_minutes(930) + to_hours(48) as i
  from {_CELLS} c join {_WHOLE} v on c.site = v.site and c.date = v.date and v.ok),
 f as (select site, date, coalesce(arg_min(valid_time, (t2m, valid_time)) filter (where i), max(valid_time) filter (where i)) as peak,
  coalesce(min(t2m) filter (where i), min(t2m)) - 273.15 as temperature_min,
  count(*) filter (where i and t2m < 273.15)/cast(greatest(count(*) filter (where i), 1) as double) as freeze_prob from x group by 1, 2),
 y as (select *, {_DECAYED} as e from f), z as (select *, e > 0.2 and temperature_min < 0 as f from y)
 select site, cast(date as varchar) as date, case when f then 'LONG' else 'FLAT' end as action, case when f then e else 0 end as confidence,
 case when f then least({kelly("e", 3.0, 0.2)}*(1+0.5*least(abs(temperature_min)/10,1)),0.2) else 0 end as size from z""",
    {"confidence": 7, "size": 7},
)
def str_cycle_signals(spark, d):
    """The end of the cycle stream: one signal per accepted cycle."""
    x = spark.read.parquet(_intake(spark, d)[2])
    return x.select("site", F.date_format("date", "yyyy-MM-dd").alias("date"), "action", "confidence", "size")


@query(
    "str_heat_runs",
    "O-STR-04",
    f"""with x as (select station, cast(ts as date) as d, max(value) > 80 as h from {OBS} group by 1, 2),
 h as (select station, d, d - cast(row_number() over (partition by station order by d) as int) as g from x where h),
 r as (select station, d, row_number() over (partition by station, g order by d) as n from h)
 select cast(station as varchar) as location, cast(d as varchar) as day, cast(n as int) as length from r where n >= 2""",
)
def str_heat_runs(spark, d):
    """Daily maxima land as files in any order; the stream keeps the runs of each station."""
    root = scratch_path(spark, "heat")
    e = spark.read.parquet(f"{d}/events.parquet")
    daily = e.groupBy(F.col("user_id").cast("string").alias("location"), F.to_date("ts").alias("day")).agg(
        (F.max("value") > 80).alias("hit")
    )
    daily.write.parquet(f"{root}/in")
    with rocksdb(spark):
        s = jobs.file_stream(spark, f"{root}/in", "location string, day date, hit boolean")
        x = jobs.drain(jobs.run_length_alerts(s, 2), f"{root}/out", f"{root}/checkpoint")
    return jobs.latest_lengths(x).select("location", F.date_format("day", "yyyy-MM-dd").alias("day"), "length")


_FEED = f"""(with e as (select 't' || (user_id % 10) as tenant_id, user_id as session_id, ts, event_id, event_type = 'view' as up from events
  where event_type in ('view', 'click') and ts <= (select m from {_MARK})),
 s as (select *, sum(case when up then 1 else -1 end) over w as s, count(*) filter (where up) over w as c, count(*) filter (where not up) over w as k from e
  window w as (partition by session_id order by ts, event_id rows unbounded preceding)),
 m as (select *, min(s) over (partition by session_id order by ts, event_id rows unbounded preceding) as m from s),
 cl as (select session_id, k - greatest(-m, 0) as n, min(ts) as b from m where not up group by 1, 2)
 select m.tenant_id, m.session_id, m.ts as a, cl.b from m join cl on m.session_id = cl.session_id and m.c = cl.n where m.up)"""


@query(
    "str_feed_sessions",
    "O-STR-05",
    f"""select tenant_id, count(*) as sessions, cast(sum(floor((epoch_ms(b) - epoch_ms(a))/3600000.0)) as double) as hours from {_FEED} group by 1""",
    {"hours": 3},
)
def str_feed_sessions(spark, d):
    e = event_stream(spark, d).filter(F.col("event_type").isin("view", "click"))
    s = e.select(
        F.concat(F.lit("t"), F.col("user_id") % 10).alias("tenant_id"), F.col("user_id").alias("session_id"), "ts", "event_id", "event_type"
    )
    with rocksdb(spark):
        x = jobs.drain(jobs.feed_sessions(s, "ts", "event_id", F.col("event_type") == "view"), *_paths(spark, "feed"))
    h = F.floor((F.col("disconnected_ms") - F.col("connected_ms")) / 3600000.0)
    return x.groupBy("tenant_id").agg(F.count("*").alias("sessions"), F.sum(h).cast("double").alias("hours"))


@query(
    "str_signal_batches",
    "O-STR-06",
    f"""select strftime(ts, '%Y%m%d') || '_12z' as cycle_id, count(*) as n, sum(confidence) as confidence from {SIGNAL_LOG}
 where cast(ts as date) + interval 1 day <= date_trunc('milliseconds', (select m from {_MARK})) group by 1""",
    {"confidence": 6},
)
def str_signal_batches(spark, d):
    k = F.col("event_type")
    act = F.when(k.isin("view", "click"), "LONG").when(k.isin("purchase", "signup"), "SHORT").otherwise("FLAT")
    conf = F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.least(F.col("value") / 100, F.lit(1.0)))
    s = event_stream(spark, d).select(
        "event_id",
        "ts",
        F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_12z")).alias("forecast_cycle_id"),
        F.date_format("ts", "yyyy-MM-dd 15:30:00").alias("publication_ts"),
        F.concat(F.lit("I"), F.col("user_id") % 5).alias("instrument"),
        act.alias("action"),
        conf.alias("confidence"),
    )
    out, ck = _paths(spark, "publish")
    fields = ["instrument", "action", "confidence"]
    due = F.to_date("ts") + F.expr("interval 1 day")
    s = jobs.whole_cycles(s, ["forecast_cycle_id"], "ts", due, release=True)
    with rocksdb(spark):
        q = jobs.publish_batches(s, lambda x: relational.signal_batches(x, ["ts", "event_id"], fields), out, ck)
        q.awaitTermination()
    doc = F.from_json("payload", "signals array<struct<instrument string, action string, confidence double>>")
    r = spark.read.schema("cycle_id string, part long, payload string").json(out)
    x = r.select("cycle_id", F.explode(doc["signals"]).alias("s"))
    return x.groupBy("cycle_id").agg(F.count("*").alias("n"), F.sum("s.confidence").alias("confidence"))


@query(
    "str_error_budget",
    "O-STR-07",
    f"""select cast(epoch(s) as bigint) as start, count(*) as observed_requests, count(*) filter (where event_id % 90 = 11) as real_5xx,
 greatest(1.0 - count(*) filter (where event_id % 90 = 11)/cast(count(*) as double)/(1-cast(0.98 as double)), 0) as remaining_fraction
 from (select event_id, date_trunc('hour', ts) as s from events) where s + interval 1 hour <= (select m from {_MARK}) group by 1""",
    {"remaining_fraction": 7},
)
def str_error_budget(spark, d):
    k = F.col("event_id")
    status = F.when(k % 40 == 7, 503).when(k % 90 == 11, 500).otherwise(200)
    s = event_stream(spark, d).select("ts", status.alias("status"), (status == 503).alias("fail_closed"))
    x = jobs.drain(jobs.budget_windows(s, "ts", "1 hour", 0.98), *_paths(spark, "budget"))
    return x.select(F.unix_timestamp("start").alias("start"), "observed_requests", "real_5xx", "remaining_fraction")


