"""Queries for O-SRC."""

from pyspark.sql import functions as F

from weatherlake.plans.backtest_queries import _equity_sql, _MOM, _trades_sql, bt_trades
from weatherlake.plans.registry import query
from weatherlake.plans.standins import CYCLES, MARKET, OBS_DAILY, cycles, events, grid, market, obs_daily, table
from weatherlake.plans.standins import GRID
from weatherlake.session import scratch_path
from weatherlake.sources import readers, writers


def _store(spark, d):
    """The cycle cells written twice to a partitioned store: the second write finds nothing to add."""
    path = scratch_path(spark, "cycle-store")
    c = cycles(spark, d).withColumn("month", F.date_format("date", "yyyy-MM"))
    unit = ("month", "cycle", "lead")
    first = c.filter(F.year("date") < 1999)
    writers.write_cycles(spark, first, path, unit)
    writers.write_cycles(spark, c, path, unit)
    return path


@query(
    "src_cycle_reader",
    "O-SRC-01",
    f"""select instrument, strftime(date, '%Y-%m') as month, lead, count(*) as cells, min(t2m) as t2m from {CYCLES}
 where strftime(date, '%Y-%m') between '1998-06' and '2000-03' and lead in (0, 24) group by 1, 2, 3""",
    {"t2m": 6},
)
def src_cycle_reader(spark, d):
    x = readers.read_cycle_store(spark, _store(spark, d), first="1998-06", last="2000-03", leads=[0, 24], unit="month")
    return x.groupBy("instrument", "month", "lead").agg(F.count("*").alias("cells"), F.min("t2m").alias("t2m"))


@query(
    "src_cycle_files",
    "O-SRC-01",
    f"""select strftime(date, '%Y%m') || '01' as date, '12' as cycle, lead, count(*) as cells, min(t2m) as t2m, count(*) filter (where instrument = 'N') as n
 from {CYCLES} where strftime(date, '%Y-%m') between '1998-06' and '2000-03' and lead in (0, 24) group by 1, 2, 3""",
    {"t2m": 6},
)
def src_cycle_files(spark, d):
    """Landed lead files, one folder of parts per unit, read back with the unit taken from the path."""
    root = scratch_path(spark, "landed")
    unit = F.format_string("gfs_%s01_12z_f%03d.parquet", F.date_format("date", "yyyyMM"), F.col("lead"))
    landed = cycles(spark, d).select("instrument", "valid_time", "latitude", "t2m", unit.alias("unit"))
    landed.hint("rebalance", F.col("unit")).write.partitionBy("unit").parquet(root)
    schema = "instrument string, valid_time timestamp, latitude double, t2m double"
    x = readers.read_cycle_files(spark, root, schema, first="19980601", last="20000301", leads=[0, 24])
    return x.groupBy("date", "cycle", "lead").agg(
        F.count("*").alias("cells"), F.min("t2m").alias("t2m"), F.count_if(F.col("instrument") == "N").alias("n")
    )


@query("src_cycle_writer", "O-SRC-07", f"select strftime(date, '%Y-%m') as month, count(*) as cells from {CYCLES} group by 1")
def src_cycle_writer(spark, d):
    return spark.read.parquet(_store(spark, d)).groupBy("month").agg(F.count("*").alias("cells"))


@query(
    "src_weather_json",
    "O-SRC-02",
    """with h as (select event_id, 0 as location, ts, value from events union all select event_id, 0, ts + interval 1 hour, value + 1 from events
  union all select event_id, 1, ts, value*2 from events where event_id % 3 = 0)
 select event_id, cast(location as int) as location, 'hourly' as kind, cast(floor(epoch(ts)) as bigint) as t, value from h
 union all select event_id, 0, 'daily', cast(epoch(date_trunc('day', ts)) as bigint), value/2 from events""",
    {"value": 6},
)
def src_weather_json(spark, d):
    """Documents built from events; every third one lists two locations."""
    e = events(spark, d)
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    def doc(times, values, daily):
        h = F.struct(F.array(*times).alias("time"), F.array(*values).alias("temperature_2m"))
        parts = [F.lit(40.5).alias("latitude"), F.lit(-75.0).alias("longitude"), F.lit("GMT").alias("timezone"), h.alias("hourly")]
        if daily:
            day = F.struct(F.array(F.date_format("ts", "yyyy-MM-dd")).alias("time"), F.array(F.col("value") / 2).alias("t_max"))
            parts.append(day.alias("daily"))
        return F.to_json(F.struct(*parts))
    t0 = F.date_format("ts", iso)
    t1 = F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(1)), iso)
    one = doc([t0, t1], [F.col("value"), F.col("value") + 1], True)
    two = doc([t0], [F.col("value") * 2], False)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), one, F.lit(","), two, F.lit("]"))).otherwise(one)
    h, dd = readers.parse_weather(e.select("event_id", text.alias("value")), ["temperature_2m"], ["t_max"], keep=["event_id"])
    a = h.select("event_id", "location", F.lit("hourly").alias("kind"), F.unix_timestamp("time").alias("t"), F.col("temperature_2m").alias("value"))
    b = dd.select("event_id", "location", F.lit("daily").alias("kind"), F.unix_timestamp("time").alias("t"), F.col("daily_t_max").alias("value"))
    return a.unionByName(b)


@query(
    "src_station_json",
    "O-SRC-03",
    f"select station as station_id, cast(d as varchar) as date, t_max as temperature_max, t_min as temperature_min, precip as precipitation from {OBS_DAILY}",
    {"temperature_max": 6, "temperature_min": 6, "precipitation": 6},
)
def src_station_json(spark, d):
    o = obs_daily(spark, d)
    rec = F.struct(
        F.date_format("d", "yyyy-MM-dd").alias("date"), F.col("t_max").alias("tmax"), F.col("t_min").alias("tmin"), F.col("precip").alias("prcp")
    )
    docs = o.select(F.col("station").alias("station_id"), F.to_json(F.struct(F.array(rec).alias("data"))).alias("value"))
    x = readers.parse_station_daily(docs)
    return x.select(
        "station_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "temperature_max", "temperature_min", "precipitation"
    )


@query(
    "src_settlements_json",
    "O-SRC-04",
    """select o_orderkey as product, cast(cast(o_orderdate as date) as varchar) as settlement_date, case when o_orderkey % 10 <> 3 then o_totalprice end as settlement_price,
 case when o_orderkey % 2 = 0 then o_custkey else 0 end as volume, 'US_NATIONAL' as region from orders
 where cast(o_orderdate as date) between date '1996-01-01' and date '1999-12-31'""",
    {"settlement_price": 4},
)
def src_settlements_json(spark, d):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    price = F.when(k % 10 == 3, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    a = F.struct(day.alias("settlementDate"), price.alias("settlementPrice"), F.col("o_custkey").cast("string").alias("volume"))
    b = F.struct(day.alias("date"), price.alias("last"))
    text = (
        F.when(k % 4 == 0, F.to_json(F.struct(F.array(a).alias("settlements"))))
        .when(k % 4 == 2, F.to_json(F.array(a)))
        .otherwise(F.to_json(F.struct(F.array(b).alias("data"))))
    )
    docs = table(spark, d, "orders").select(k.alias("product"), text.alias("value"))
    x = readers.parse_settlements(docs, start="1996-01-01", end="1999-12-31")
    return x.select("product", "settlement_date", "settlement_price", "volume", "region")


@query(
    "src_price_history",
    "O-SRC-05",
    f"select instrument as ticker, count(*) as n, sum(close) as close, cast(min(session) as varchar) as first from {MARKET} group by 1",
    {"close": 3},
)
def src_price_history(spark, d):
    """Closes written as one CSV folder per ticker and read back with the fixed schema."""
    root = scratch_path(spark, "prices")
    m = market(spark, d).select(
        F.col("session").alias("Date"),
        F.col("close").alias("Open"),
        F.col("close").alias("High"),
        F.col("close").alias("Low"),
        F.col("close").alias("Close"),
        F.lit(1).cast("long").alias("Volume"),
        F.col("instrument").alias("ticker"),
    )
    writers.write_report(m, root, "csv", ["ticker"])
    x = spark.read.schema(readers.PRICE_SCHEMA + ", ticker string").option("header", "true").csv(root)
    return readers.nan_to_null(x).dropna(subset=["Close"]).groupBy("ticker").agg(
        F.count("*").alias("n"), F.sum("Close").alias("close"), F.date_format(F.min("Date"), "yyyy-MM-dd").alias("first")
    )


@query(
    "src_price_files",
    "O-SRC-05",
    f"""select instrument as ticker, count(*) filter (where day(session) <> 13) as n, sum(close) filter (where day(session) <> 13) as close,
 count(*) filter (where day(session) = 13) as rejected from {MARKET} group by 1""",
    {"close": 3},
)
def src_price_files(spark, d):
    """A CSV per ticker, with a line that is no price row for every 13th of a month: rows, and lines set aside."""
    root = scratch_path(spark, "price-files")
    m = market(spark, d)
    day, close = F.date_format("session", "yyyy-MM-dd").alias("Date"), F.col("close").cast("string")
    price = F.when(F.dayofmonth("session") == 13, F.lit("n/a")).otherwise(close)
    columns = [price.alias(c) for c in ("Open", "High", "Low", "Close")]
    lines = m.select(day, *columns, F.lit("1").alias("Volume"), F.concat("instrument", F.lit(".csv")).alias("file"))
    writers.write_report(lines, root, "csv", ["file"])
    good, bad = readers.split_prices(spark, root)
    g = good.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("Close").alias("close"))
    return g.join(bad.groupBy("ticker").agg(F.count("*").alias("rejected")), "ticker", "left").fillna(0, ["rejected"])


@query(
    "src_continuous",
    "O-SRC-05",
    f"""select instrument, count(*) as n, sum(close) as close, cast(max(session) as varchar) as last from {MARKET}
 where day(session) <> 13 group by 1""",
    {"close": 3},
)
def src_continuous(spark, d):
    """Continuous series whose adjusted close is NaN on some days."""
    root = scratch_path(spark, "continuous")
    known = F.when(F.dayofmonth("session") == 13, F.lit(float("nan"))).otherwise(F.col("close"))
    market(spark, d).select(F.col("session").cast("timestamp").alias("Date"), known.alias("close_adj"), "instrument").write.parquet(root)
    x = readers.read_continuous(spark, root)
    return x.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("close_adj").alias("close"), F.date_format(F.max("Date"), "yyyy-MM-dd").alias("last"))


@query(
    "src_contract_calendar",
    "O-SRC-05",
    """select 'C' || strftime(m, '%y%m') as contract, monthname(m) as month_name, cast(cast(m + interval 20 day as date) as varchar) as first_notice_day,
 cast(cast(m + interval 27 day as date) as varchar) as last_trading_day from (select distinct date_trunc('month', o_orderdate) as m from orders) where month(m) % 2 = 1""",
)
def src_contract_calendar(spark, d):
    """Contract calendar CSV; the rows of even months have no last trading day and are left out."""
    root = scratch_path(spark, "calendar")
    m = table(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("m")).distinct()
    odd = F.month("m") % 2 == 1
    cal = m.select(
        F.concat(F.lit("C"), F.date_format("m", "yyMM")).alias("contract"),
        F.date_format("m", "MMMM").alias("month_name"),
        F.date_add("m", 20).alias("first_notice_day"),
        F.when(odd, F.date_add("m", 27)).alias("last_trading_day"),
    )
    writers.write_report(cal, root, "csv")
    x = readers.read_contracts(spark, root)
    return x.select("contract", "month_name", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_notice_day", "last_trading_day")])


@query(
    "src_report_sinks",
    "O-SRC-08",
    f"""with t as (select instrument, count(*) as n, sum(pnl) as pnl from {_trades_sql(_equity_sql(_MOM))} group by 1)
 select f.fmt, t.* from t, (values ('csv'), ('json'), ('parquet')) f(fmt)""",
    {"pnl": 0},
)
def src_report_sinks(spark, d):
    t = bt_trades(spark, d)
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, f"trades-{fmt}")
        writers.write_report(t, path, fmt)
        r = spark.read.schema(t.schema).option("header", "true").format(fmt).load(path)
        g = r.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl")).withColumn("fmt", F.lit(fmt))
        out = g if out is None else out.unionByName(g)
    return out


@query(
    "src_upsert",
    "O-SRC-09",
    """select user_id, max_by(value, (v, src, event_id)) as value, max(v) as version from (select user_id, value, event_id, event_id // 10 as v, 0 as src from events where event_id % 3 = 0
 union all select user_id, value + 1000, event_id, event_id // 10, 1 from events where event_id % 3 <> 0) group by 1""",
    {"value": 4},
)
def src_upsert(spark, d):
    e = events(spark, d).select("user_id", "value", F.floor(F.col("event_id") / 10).alias("version"), "event_id")
    old = e.filter(F.col("event_id") % 3 == 0)
    new = e.filter(F.col("event_id") % 3 != 0).withColumn("value", F.col("value") + 1000)
    # one row per key and version on each side, as a store has
    def one(x):
        return x.groupBy("user_id", "version").agg(F.max_by("value", "event_id").alias("value"))
    return writers.upsert(one(old), one(new), ["user_id"], F.col("version"))


@query(
    "src_chunked_map",
    "O-SRC-10",
    f"select time, sum(v*1.8+32) as total, count(*) as n from {GRID} group by 1",
    {"total": 5},
)
def src_chunked_map(spark, d):
    def fahrenheit(pdf):
        return pdf.assign(f=pdf.v * 1.8 + 32)[["time", "f"]]

    x = writers.chunked_map(grid(spark, d), "time", fahrenheit, "time long, f double", columns=["v"], partitions=8)
    return x.groupBy("time").agg(F.sum("f").alias("total"), F.count("*").alias("n"))


@query(
    "src_whole_slices",
    "O-SRC-10",
    f"""with m as (select time, avg(v) as m, max(v) as top from {GRID} group by 1)
 select g.time, max(abs(g.v - m.m)) as far, count(*) filter (where g.v = m.top) as tops, count(*) as n from {GRID} g join m on g.time = m.time group by 1""",
    {"far": 6},
)
def src_whole_slices(spark, d):
    """A function that needs every cell of a time step: departures from the step's own mean."""

    def departures(pdf):
        by = pdf.groupby("time").v
        return pdf.assign(far=(pdf.v - by.transform("mean")).abs(), top=(pdf.v == by.transform("max")).astype("int32"))[["time", "far", "top"]]

    x = writers.chunked_map(grid(spark, d), "time", departures, "time long, far double, top int", columns=["v"])
    return x.groupBy("time").agg(F.max("far").alias("far"), F.sum("top").alias("tops"), F.count("*").alias("n"))
