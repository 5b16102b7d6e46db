"""Domain frames derived from the benchmark tables, with the same definitions as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Raw station observations; several per hour, unbounded per station."""
    return events(spark, d).select(
        "event_id",
        F.col("user_id").alias("station"),
        "ts",
        (F.col("value") / 5 - 5).alias("temp_c"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("precip"),
        F.col("value"),
    )


OBS = """(select event_id, user_id as station, ts, value/5-5 as temp_c, value,
  case when event_type='purchase' then value else 0 end as precip from events)"""


def obs_daily(spark: SparkSession, d: str) -> DataFrame:
    return (
        obs(spark, d)
        .groupBy("station", F.to_date("ts").alias("d"))
        .agg(
            F.avg("temp_c").alias("t_mean"),
            F.min("temp_c").alias("t_min"),
            F.max("temp_c").alias("t_max"),
            F.sum("precip").alias("precip"),
            F.count("*").alias("n_obs"),
        )
    )


OBS_DAILY = f"""(select station, cast(ts as date) as d, avg(temp_c) as t_mean, min(temp_c) as t_min,
  max(temp_c) as t_max, sum(precip) as precip, count(*) as n_obs from {OBS} group by 1, 2)"""


def climate_daily(spark: SparkSession, d: str) -> DataFrame:
    """Long daily record (years) per region, for climatologies and drought indices."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_returnflag").alias("region"), F.to_date("l_shipdate").alias("d"))
        .agg(
            (F.avg("l_extendedprice") / 1000 - 20).alias("t"),
            F.sum(F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).otherwise(0.0)).alias("precip"),
            F.avg("l_quantity").alias("wind"),
        )
    )


CLIMATE_DAILY = """(select l_returnflag as region, cast(l_shipdate as date) as d,
  avg(l_extendedprice)/1000 - 20 as t, sum(case when l_discount >= 0.05 then l_quantity else 0.0 end) as precip,
  avg(l_quantity) as wind from lineitem group by 1, 2)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_returnflag").alias("instrument"), F.to_date("l_shipdate").alias("session"))
        .agg((F.avg("l_extendedprice") / 100 + 1000).alias("close"))
    )


PRICES = """(select l_returnflag as instrument, cast(l_shipdate as date) as session,
  avg(l_extendedprice)/100 + 1000 as close from lineitem group by 1, 2)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 forecast fields: one frame per vector, 1-degree cells from (30, -90)."""
    return (
        table(spark, d, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("pos", "x"))
        .select(
            F.col("vec_id").alias("time"),
            (F.floor(F.col("pos") / 8)).cast("long").alias("i"),
            (F.col("pos") % 8).cast("long").alias("j"),
            (F.floor(F.col("pos") / 8) + 30.0).cast("double").alias("lat"),
            (F.col("pos") % 8 - 90.0).cast("double").alias("lon"),
            F.col("x").cast("double").alias("v"),
        )
    )


_UNNEST = """(select vec_id, label, unnest(range(len(embedding))) as pos, unnest(embedding) as x from embeddings)"""
GRID = f"""(select vec_id as time, pos // 8 as i, pos % 8 as j, cast(pos // 8 + 30.0 as double) as lat,
  cast(pos % 8 - 90.0 as double) as lon, cast(x as double) as v from {_UNNEST})"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """63 ensemble members per case; position 0 is the observation."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("case_id"),
        F.col("label").alias("series_id"),
        F.posexplode("embedding").alias("member", "x0"),
    ).select("case_id", "series_id", "member", F.col("x0").cast("double").alias("x"))


MEMBERS = f"""(select vec_id as case_id, label as series_id, cast(pos as int) as member, cast(x as double) as x
  from {_UNNEST})"""


def prob_obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(
        "doc_id",
        ((F.col("doc_id") * 37) % 101 / F.lit(100.0)).alias("p"),
        F.col("quality").alias("o"),
        F.col("toxic").alias("o2"),
    )


PROB_OBS = """(select doc_id, cast((doc_id*37)%101 as double)/100.0 as p, quality as o, toxic as o2 from labels)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("id"),
        ((k * 37) % 140 - 70).cast("double").alias("lat"),
        ((k * 53) % 360 - 180).cast("double").alias("lon"),
        F.col("s_acctbal").alias("v"),
    )


POINTS = """(select s_suppkey as id, cast((s_suppkey*37)%140-70 as double) as lat,
  cast((s_suppkey*53)%360-180 as double) as lon, s_acctbal as v from supplier)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Observation network, one row per customer key."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("obs_id"),
        ((k * 73) % 1400 / 10.0 - 70).alias("lat"),
        ((k * 91) % 3600 / 10.0 - 180).alias("lon"),
        F.col("c_acctbal").alias("v"),
    )


SITES = """(select c_custkey as obs_id, cast((c_custkey*73)%1400 as double)/10.0-70 as lat,
  cast((c_custkey*91)%3600 as double)/10.0-180 as lon, c_acctbal as v from customer)"""


def cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cell rows of forecast cycles: one cycle per instrument and day, four leads."""
    k = F.col("o_orderkey")
    inst = F.when(F.col("o_orderstatus") == "O", "N").when(F.col("o_orderstatus") == "F", "A").otherwise("R")
    return table(spark, d, "orders").select(
        inst.alias("instrument"),
        F.to_date("o_orderdate").alias("date"),
        F.lit("12").alias("cycle"),
        (k % 4 * 12).cast("int").alias("lead"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 72).cast("int"))).alias("valid_time"),
        (k % 15 + 25.0).alias("latitude"),
        (k % 11 - 83.0).alias("longitude"),
        (F.col("o_totalprice") / 50000 + 272.0).alias("t2m"),
        k.alias("cell_id"),
    )


CYCLES = """(select case o_orderstatus when 'O' then 'N' when 'F' then 'A' else 'R' end as instrument,
  cast(o_orderdate as date) as date, '12' as cycle, cast(o_orderkey % 4 * 12 as int) as lead,
  o_orderdate + to_hours(cast(o_orderkey % 72 as int)) as valid_time, cast(o_orderkey % 15 + 25.0 as double) as latitude,
  cast(o_orderkey % 11 - 83.0 as double) as longitude, o_totalprice/50000 + 272.0 as t2m, o_orderkey as cell_id from orders)"""


def weather(spark: SparkSession, d: str) -> DataFrame:
    """Station weather reports with several variables."""
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("station"),
        F.to_date("l_shipdate").alias("d"),
        (F.col("l_quantity") - 5).alias("t"),
        (x - F.floor(x / 100) * 100).alias("rh"),
        (x / 3000).alias("wind_ms"),
        (F.col("l_orderkey") % 360).cast("double").alias("wind_dir"),
        (F.col("l_discount") * 100).alias("precip"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


WEATHER = """(select l_suppkey as station, cast(l_shipdate as date) as d, l_quantity - 5 as t,
  l_extendedprice - floor(l_extendedprice/100)*100 as rh, l_extendedprice/3000 as wind_ms,
  cast(l_orderkey % 360 as double) as wind_dir, l_discount*100 as precip, l_orderkey, l_linenumber, l_partkey from lineitem)"""


def storms(spark: SparkSession, d: str) -> DataFrame:
    """Cyclone track points: one storm per user."""
    u, v = F.col("user_id"), F.col("value")
    return events(spark, d).select(
        u.alias("storm"),
        "ts",
        "event_id",
        (F.lit(1015.0) - v / 5).alias("hpa"),
        (v * 0.6).alias("kmh"),
        (F.col("event_id") % 60 + 1.0).alias("forward_kmh"),
        (F.col("event_id") % 7 * 0.02).alias("slope"),
        (F.col("event_id") % 12 + 20.0).alias("sst"),
        (F.col("event_id") % 25 * 1.0).alias("shear"),
    )


STORMS = """(select user_id as storm, ts, event_id, 1015.0 - value/5 as hpa, value*0.6 as kmh,
  cast(event_id % 60 + 1.0 as double) as forward_kmh, cast(event_id % 7 as double)*0.02 as slope,
  cast(event_id % 12 + 20.0 as double) as sst, cast(event_id % 25 as double) as shear from events)"""


def weekday(c) :
    """0 = Monday."""
    return F.pmod(F.datediff(c, F.lit("1900-01-01").cast("date")), F.lit(7))


def market(spark: SparkSession, d: str) -> DataFrame:
    """Trading sessions: weekday closes per instrument."""
    return prices(spark, d).filter(weekday(F.col("session")) < 5)


MARKET = f"""(select * from {PRICES} where date_diff('day', date '1900-01-01', session) % 7 < 5)"""
