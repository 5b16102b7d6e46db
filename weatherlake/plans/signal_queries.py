"""Queries for O-SG-01..10 (O-SG-09 sits with the point-in-time queries)."""

from pyspark.sql import functions as F

from weatherlake.functions.tables import INSTRUMENTS, STORM_DISRUPTION
from weatherlake.operators import signals
from weatherlake.plans.hazard_queries import _SS, CYCLE_FEATURES, _case, cycle_frame
from weatherlake.plans.registry import query
from weatherlake.plans.standins import (
    CLIMATE_DAILY,
    OBS_DAILY,
    STORMS,
    climate_daily,
    events,
    obs_daily,
    storms,
)
from weatherlake.functions import storm


def kelly(c, odds, cap, half=2.0):
    return f"(case when ({odds}*{c}-(1-{c}))/{odds} > 0 then least(({odds}*{c}-(1-{c}))/{odds}/{half}, {cap}) else 0 end)"


def signal_log(spark, d):
    """Signals from several desks per hour."""
    k = F.col("event_type")
    act = F.when(k.isin("view", "click"), "LONG").when(k.isin("purchase", "signup"), "SHORT").otherwise("FLAT")
    conf = F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.least(F.col("value") / 100, F.lit(1.0)))
    return events(spark, d).select(
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd HH").alias("hour"),
        F.concat(F.lit("I"), F.col("user_id") % 5).alias("instrument"),
        act.alias("action"),
        conf.alias("confidence"),
    )


SIGNAL_LOG = """(select event_id, ts, strftime(ts, '%Y-%m-%d %H') as hour, 'I' || cast(user_id % 5 as varchar) as instrument,
 case when event_type in ('view','click') then 'LONG' when event_type in ('purchase','signup') then 'SHORT' else 'FLAT' end as action,
 case when event_id % 7 = 0 then 0.0 else least(value/100, 1.0) end as confidence from events)"""


@query(
    "sg_position_size",
    "O-SG-01",
    f"""select event_id, {kelly('confidence', 2.0, 0.25)} as half_kelly, {kelly('confidence', 3.0, 0.4, 1.0)} as full_kelly,
 least(greatest(confidence*0.25,0),0.25) as by_confidence, 0.1 as uniform,
 least(greatest((2.0*confidence-(1-confidence))/2.0*0.5,0),0.25) as portfolio, least(1.0/(event_id%9+1), 0.25) as equal_weight from {SIGNAL_LOG}""",
    {c: 8 for c in ("half_kelly", "full_kelly", "by_confidence", "uniform", "portfolio", "equal_weight")},
)
def sg_position_size(spark, d):
    c = F.col("confidence")
    return signal_log(spark, d).select(
        "event_id",
        signals.position_size(c).alias("half_kelly"),
        signals.position_size(c, odds=3.0, half=False, cap=0.4).alias("full_kelly"),
        signals.position_size(c, "confidence").alias("by_confidence"),
        signals.position_size(c, "uniform").alias("uniform"),
        signals.portfolio_size(c, "kelly").alias("portfolio"),
        signals.portfolio_size(c, "equal_weight", n=F.col("event_id") % 9 + 1).alias("equal_weight"),
    )


_E = "(freeze_prob*exp(-0.693*coalesce(greatest(epoch(publish_time + to_hours(6)) - epoch(event_peak_time),0),0)/3600.0/48.0))"


@query(
    "sg_freeze",
    "O-SG-02",
    f"""with x as (select *, {_E} as e from {CYCLE_FEATURES}), y as (select *, e > 0.2 and temperature_min < 0 as f from x)
 select instrument, cast(date as varchar) as date, case when f then 'LONG' else 'FLAT' end as action, case when f then e else 0 end as confidence,
 case when f then least({kelly('e', 3.0, 0.2)}*(1+0.5*least(abs(temperature_min)/10,1)),0.2) else 0 end as size from y""",
    {"confidence": 7, "size": 7},
)
def sg_freeze(spark, d):
    x = cycle_frame(spark, d)
    now = F.col("publish_time") + F.make_dt_interval(hours=F.lit(6))
    out = signals.freeze_signal(x, now, entry=0.2)
    return out.select("instrument", F.date_format("date", "yyyy-MM-dd").alias("date"), "action", "confidence", "size")


_MK = "case region when 'A' then 'ERCOT' when 'N' then 'PJM' else 'OTHER' end"


@query(
    "sg_heat",
    "O-SG-03",
    f"""with s as (select *, {_MK} as market, strftime(d, '%Y-%m') as mon from {CLIMATE_DAILY}),
 r as (select *, sum(case when t > 20 then 0 else 1 end) over (partition by region, mon order by d rows unbounded preceding) as g from s),
 l as (select region, mon, max(n) as longest_run from (select region, mon, g, count(*) filter (where t > 20) as n from r group by 1, 2, 3) group by 1, 2),
 a as (select region, mon, any_value(market) as market, sum(greatest(t-18.3,0)) as cdd, avg(wind/50-0.3513) as w from s group by 1, 2),
 b as (select a.region, a.mon, market, cdd, longest_run, case when w < 0.15 then 1.0+2.0*(case market when 'ERCOT' then 0.30 when 'PJM' then 0.08 else 0.10 end) else 1.0 end as wind_amplifier
  from a join l on a.region = l.region and a.mon = l.mon),
 c as (select *, least(least(cdd/500.0,1)*wind_amplifier, 0.95) as c, longest_run >= 3 as f from b)
 select region, mon, market, cdd, longest_run, wind_amplifier, case when f then 'LONG' else 'FLAT' end as action,
 case when f then c else 0 end as confidence, case when f then {kelly('c', 2.0, 0.2)} else 0 end as size from c""",
    {"cdd": 6, "wind_amplifier": 6, "confidence": 7, "size": 7},
)
def sg_heat(spark, d):
    m = F.when(F.col("region") == "A", "ERCOT").when(F.col("region") == "N", "PJM").otherwise("OTHER")
    s = climate_daily(spark, d).select(
        "region", F.date_format("d", "yyyy-MM").alias("mon"), "d", "t", (F.col("wind") / 50 - 0.3513).alias("cf"), m.alias("market")
    )
    return signals.heat_signal(s, ["region", "mon"], "market", "d", "t", "cf", hot=20.0)


def storm_outlook(spark, d):
    k = F.col("event_id")
    return storms(spark, d).select(
        k,
        "storm",
        ((k * 37) % 101 / 100.0).alias("landfall_prob"),
        storm.saffir_simpson(F.col("hpa"), F.col("kmh")).alias("category"),
        ((k * 13) % 700).cast("double").alias("closest_approach_miles"),
        ((k * 7) % 200).cast("double").alias("hours_to_landfall"),
    )


OUTLOOK = f"""(select event_id, storm, cast((event_id*37)%101 as double)/100.0 as landfall_prob, {_SS} as category,
 cast((event_id*13)%700 as double) as closest_approach_miles, cast((event_id*7)%200 as double) as hours_to_landfall from {STORMS})"""


@query(
    "sg_hurricane",
    "O-SG-04",
    f"""with x as (select *, least(greatest(category,1),5) as k from {OUTLOOK}),
 y as (select *, landfall_prob*{_case('k', STORM_DISRUPTION, 'null')}*(0.5+0.5*least(greatest(1-closest_approach_miles/600.0,0),1))
  *(0.7+0.3*least(greatest(1-hours_to_landfall/168.0,0),1)) as e from x)
 select event_id, e as effective_prob, case when e > 0.05 then 'LONG' else 'FLAT' end as action, case when e > 0.05 then e else 0 end as confidence,
 case when e > 0.05 then {kelly('e', 2.5, 0.2)} else 0 end as size from y""",
    {"effective_prob": 12, "confidence": 12, "size": 12},
)
def sg_hurricane(spark, d):
    out = signals.hurricane_signal(storm_outlook(spark, d), entry=0.05)
    return out.select("event_id", "effective_prob", "action", "confidence", "size")


@query(
    "sg_drought",
    "O-SG-05",
    f"""with s as (select region, year(d) as yr, d, (t-25)/5 as spi from {CLIMATE_DAILY}),
 r as (select *, sum(case when spi < -0.5 then 0 else 1 end) over (partition by region, yr order by d rows unbounded preceding) as g from s),
 l as (select region, yr, max(n) as longest_run from (select region, yr, g, count(*) filter (where spi < -0.5) as n from r group by 1, 2, 3) group by 1, 2),
 a as (select region, yr, avg(spi) filter (where spi < -0.5) as m from s group by 1, 2),
 c as (select l.region, l.yr, longest_run, least(abs(m)/3.0,1)*(0.5+0.5*least(longest_run/90.0,1)) as c, longest_run >= 3 as f from l join a on l.region = a.region and l.yr = a.yr)
 select region, yr, longest_run, case when f then 'LONG' else 'FLAT' end as action, case when f then c else 0 end as confidence,
 case when f then {kelly('c', 2.0, 0.15)} else 0 end as size from c""",
    {"confidence": 7, "size": 7},
)
def sg_drought(spark, d):
    s = climate_daily(spark, d).select(
        "region", F.year("d").cast("long").alias("yr"), "d", ((F.col("t") - 25) / 5).alias("spi")
    )
    return signals.drought_signal(s, ["region", "yr"], "d", "spi", threshold=-0.5, min_days=3)


@query(
    "sg_wind_power",
    "O-SG-06",
    f"""with c as (select region, quantile_cont(wind, 0.25) as lo, quantile_cont(wind, 0.5) as mid, quantile_cont(wind, 0.75) as hi from {CLIMATE_DAILY} where year(d) < 1998 group by 1),
 f as (select region, strftime(d, '%Y-%m') as mon, avg(wind) + (month(d)-6)*1.2 as m from {CLIMATE_DAILY} where year(d) >= 1998 group by region, mon, month(d)),
 x as (select f.*, lo, mid, hi, least(least(abs((m-mid)/greatest(abs(mid),1e-10)),1)*1.5,1) as c, (m < lo or m > hi) as s from f join c on f.region = c.region)
 select region, mon, m as mean_wind, mid as normal_wind, lo as low_bound, hi as high_bound, case when not s then 'FLAT' when m < lo then 'LONG' else 'SHORT' end as action,
 case when s then c else 0 end as confidence, case when s then {kelly('c', 1.5, 0.15)} else 0 end as size from x""",
    {c: 7 for c in ("mean_wind", "normal_wind", "low_bound", "high_bound", "confidence", "size")},
)
def sg_wind_power(spark, d):
    x = climate_daily(spark, d)
    fc = x.filter(F.year("d") >= 1998).select(
        "region", F.date_format("d", "yyyy-MM").alias("mon"), (F.col("wind") + (F.month("d") - 6) * 1.2).alias("wind")
    )
    return signals.wind_signal(fc, x.filter(F.year("d") < 1998), ["region", "mon"], ["region"], "wind")


@query(
    "sg_ensemble",
    "O-SG-07",
    f"""with g as (select hour, count(*) filter (where confidence > 0) as n_signals, count(*) filter (where confidence > 0 and action = 'LONG') as n_long,
  count(*) filter (where confidence > 0 and action = 'SHORT') as n_short, avg(confidence) filter (where confidence > 0) as cf,
  coalesce(string_agg(distinct instrument, ',' order by instrument) filter (where confidence > 0), '') as instruments from {SIGNAL_LOG} group by 1),
 a as (select *, coalesce(greatest(n_long, n_short)/cast(nullif(n_signals,0) as double),0) as agreement from g),
 c as (select *, cf*(1-0.3*(1-agreement)) as c, n_signals > 0 and agreement >= 0.5 as f from a)
 select hour, n_signals, n_long, n_short, instruments, agreement, case when not f then 'FLAT' when n_long > n_short then 'LONG' else 'SHORT' end as action,
 case when f then c else 0 end as confidence, case when f then {kelly('c', 2.0, 0.25)} else 0 end as size from c""",
    {"agreement": 8, "confidence": 8, "size": 8},
)
def sg_ensemble(spark, d):
    return signals.combine(signal_log(spark, d), ["hour"])


@query(
    "sg_alerts",
    "O-SG-08",
    f"""with fz as (select cast(station as varchar) as location, 'freeze' as alert_type, case when abs(m) > 10 then 'CRITICAL' when abs(m) > 5 then 'HIGH'
  when abs(m) > 2 then 'MEDIUM' else 'LOW' end as severity, m as trigger_value from (select station, min(t_min) as m from {OBS_DAILY} group by 1) where m < 0),
 r as (select *, sum(case when t_max > 5 then 0 else 1 end) over (partition by station order by d rows unbounded preceding) as g from {OBS_DAILY}),
 h as (select station, max(n) as l from (select station, g, count(*) filter (where t_max > 5) as n from r group by 1, 2) group by 1),
 hw as (select cast(station as varchar), 'heatwave', case when l/7.0 > 0.8 then 'CRITICAL' when l/7.0 > 0.5 then 'HIGH' when l/7.0 > 0.3 then 'MEDIUM' else 'LOW' end, cast(l as double) from h where l >= 3),
 hu as (select cast(event_id as varchar), 'hurricane', case when category >= 4 and landfall_prob > 0.5 then 'CRITICAL' when category >= 3 and landfall_prob > 0.4 then 'HIGH'
  when category >= 2 and landfall_prob > 0.3 then 'MEDIUM' else 'LOW' end, landfall_prob from {OUTLOOK} where landfall_prob >= 0.1),
 s as (select station, d, t_mean - 6 as spi from {OBS_DAILY}),
 q as (select *, sum(case when spi < -1.5 then 0 else 1 end) over (partition by station order by d rows unbounded preceding) as g from s),
 dl as (select station, max(n) as l from (select station, g, count(*) filter (where spi < -1.5) as n from q group by 1, 2) group by 1),
 dr as (select cast(dl.station as varchar), 'drought', case when m < -3 then 'CRITICAL' when m < -2 then 'HIGH' when m < -1.5 then 'MEDIUM' else 'LOW' end, m
  from dl join (select station, avg(spi) as m from s group by 1) a on dl.station = a.station where l >= 5)
 select * from fz union all select * from hw union all select * from hu union all select * from dr""",
    {"trigger_value": 7},
)
def sg_alerts(spark, d):
    o = obs_daily(spark, d)
    low = o.groupBy("station").agg(F.min("t_min").alias("t_min"))
    spi = o.select("station", "d", (F.col("t_mean") - 6).alias("spi"))
    return signals.all_alerts(
        signals.freeze_alerts(low, "station", "t_min"),
        signals.heatwave_alerts(o, "station", "d", "t_max", threshold=5.0),
        signals.hurricane_alerts(storm_outlook(spark, d), "event_id"),
        signals.drought_alerts(spi, "station", "d", "spi", days=5),
    )


_NAMES = list(INSTRUMENTS)
_IN = "case l_partkey % 11 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end"


def _spec(k):
    body = " ".join(f"when {n!r} then {v[k]}" for n, v in INSTRUMENTS.items())
    return f"cast(case i {body} end as double)"


@query(
    "sg_instruments",
    "O-SG-10",
    f"""with p as (select {_IN} as i, l_quantity as q, l_extendedprice/100 as px from lineitem)
 select i as instrument, count(*) as n, sum(q*{_spec(3)}*round_even(px/{_spec(2)},0)*{_spec(2)})/1e6 as notional,
 sum(q*{_spec(3)}*round_even(px/{_spec(2)},0)*{_spec(2)}*{_spec(4)})/1e6 as margin, sum(q*{_spec(5)}) as commission from p group by 1""",
    {"notional": 3, "margin": 3, "commission": 3},
)
def sg_instruments(spark, d):
    from weatherlake.plans.standins import table

    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("l_partkey") % 11 + 1).cast("int"))
    p = table(spark, d, "lineitem").withColumn("instrument", name)
    v = signals.contract_values(p, F.lower("instrument"), F.col("l_quantity"), F.col("l_extendedprice") / 100)
    return v.groupBy("instrument").agg(
        F.count("*").alias("n"),
        (F.sum("notional") / 1e6).alias("notional"),
        (F.sum("margin") / 1e6).alias("margin"),
        F.sum("commission").alias("commission"),
    )
