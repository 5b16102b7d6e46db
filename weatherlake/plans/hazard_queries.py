"""Queries for O-HZ-01..20."""

from pyspark.sql import functions as F

from weatherlake.functions import storm, thermal
from weatherlake.functions.tables import BEAUFORT, STORM_PROFILE, STORM_RAIN_DIAMETER, STORM_RAIN_RATE, TURBINES
from weatherlake.operators import grids, hazards, spatial
from weatherlake.plans.registry import query
from weatherlake.plans.spatial_queries import _KM, _diff_sql, hav
from weatherlake.plans.standins import (
    CYCLES,
    GRID,
    MEMBERS,
    OBS,
    OBS_DAILY,
    SITES,
    STORMS,
    WEATHER,
    cycles,
    grid,
    members,
    obs,
    obs_daily,
    sites,
    storms,
    weather,
)


def _case(key, table, default, field=None):
    body = " ".join(f"when {k!r} then {v if field is None else v[field]}" for k, v in table.items())
    return f"cast(case {key} {body} else {default} end as double)"


@query(
    "hz_freeze_probability",
    "O-HZ-01",
    f"""with d as (select series_id, case_id, avg(case when x <= 0.05 then 1.0 else 0.0 end) as s, quantile_cont(x, 0.1) as q from {MEMBERS} group by 1, 2)
 select series_id, avg(s) as mean_p, avg(case when q <= 0.05 then 1.0 else 0.0 end) as q10_p, max(s) as worst_p from d group by 1""",
    {"mean_p": 8, "q10_p": 8, "worst_p": 8},
)
def hz_freeze_probability(spark, d):
    m = members(spark, d)
    parts = [
        hazards.freeze_probability(m, ["series_id"], "case_id", "x", k, 0.05).withColumnRenamed("freeze_probability", n)
        for k, n in (("ensemble_mean", "mean_p"), ("quantile_10", "q10_p"), ("worst_case", "worst_p"))
    ]
    return parts[0].join(parts[1], "series_id").join(parts[2], "series_id")


_TF = "(t*9.0/5.0+32.0)"
_HI = f"""case when t < 27 or rh < 40 then 0.5*({_TF}+61.0+({_TF}-68.0)*1.2+rh*0.094) else
 -42.379+2.04901523*{_TF}+10.14333127*rh-0.22475541*{_TF}*rh-0.00683783*{_TF}*{_TF}-0.05481717*rh*rh
 +0.00122874*{_TF}*{_TF}*rh+0.00085282*{_TF}*rh*rh-0.00000199*{_TF}*{_TF}*rh*rh
 + case when rh > 85 and {_TF} between 80 and 87 then (rh-85)/10.0*((87.0-{_TF})/5.0) else 0 end end"""


@query(
    "hz_heat_index",
    "O-HZ-02",
    f"select station, max(({_HI} - 32.0)*5.0/9.0) as heat_index from {WEATHER} group by 1",
    {"heat_index": 5},
)
def hz_heat_index(spark, d):
    return hazards.worst_per_group(
        weather(spark, d), ["station"], thermal.heat_index(F.col("t"), F.col("rh")), "heat_index"
    )


@query(
    "hz_wind_chill",
    "O-HZ-03",
    f"""select station, min(case when t-20 > 10 or wind_ms*3.6 < 4.8 then t-20
 else 13.12+0.6215*(t-20)-11.37*pow(wind_ms*3.6,0.16)+0.3965*(t-20)*pow(wind_ms*3.6,0.16) end) as wind_chill from {WEATHER} group by 1""",
    {"wind_chill": 5},
)
def hz_wind_chill(spark, d):
    return weather(spark, d).groupBy("station").agg(
        F.min(thermal.wind_chill(F.col("t") - 20, F.col("wind_ms") * 3.6)).alias("wind_chill")
    )


@query(
    "hz_diurnal_range",
    "O-HZ-04",
    f"select station, avg(t_max - t_min) as diurnal_range from {OBS_DAILY} group by 1",
    {"diurnal_range": 7},
)
def hz_diurnal_range(spark, d):
    return hazards.diurnal_range(obs_daily(spark, d), ["station"], "t_max", "t_min")


@query(
    "hz_precipitation_total",
    "O-HZ-05",
    f"""select station, case when count(*) > 1 then greatest(sum(precip)*48.0/(count(*)-1), 0) else 0.0 end as accumulation
 from {OBS} group by 1""",
    {"accumulation": 5},
)
def hz_precipitation_total(spark, d):
    return hazards.precipitation_total(obs(spark, d), ["station"], "precip", 48)


@query(
    "hz_snow_probability",
    "O-HZ-06",
    f"""select station, coalesce(avg(least(greatest((2.0-(t-25))/2.0,0),1)) filter (where precip > 0), 0) as snow_probability
 from {WEATHER} group by 1""",
    {"snow_probability": 8},
)
def hz_snow_probability(spark, d):
    w = weather(spark, d).withColumn("t", F.col("t") - 25)
    return hazards.snow_probability(w, ["station"], "t", "precip")


@query(
    "hz_rain_days",
    "O-HZ-07",
    f"select station, avg(case when precip >= 1 then 1.0 else 0.0 end) as rain_day_probability from {OBS_DAILY} group by 1",
    {"rain_day_probability": 8},
)
def hz_rain_days(spark, d):
    return hazards.rain_day_probability(obs_daily(spark, d), ["station"], "precip")


_PC = """case when hpa > 1000 then 'TD' when hpa > 985 then 'TS' when hpa > 970 then 'Cat1' when hpa > 955 then 'Cat2'
 when hpa > 940 then 'Cat3' when hpa > 920 then 'Cat4' else 'Cat5' end"""


@query("hz_pressure_class", "O-HZ-08", f"select {_PC} as class, count(*) as n from {STORMS} group by 1")
def hz_pressure_class(spark, d):
    return storms(spark, d).groupBy(storm.pressure_class(F.col("hpa")).alias("class")).agg(F.count("*").alias("n"))


def _back_sql(seconds):
    return f"""(select a.event_id, a.storm, a.hpa, a.sst, a.shear, arg_max(b.hpa, (b.ts, b.event_id)) as before from {STORMS} a left join {STORMS} b
 on a.storm = b.storm and b.ts <= a.ts - to_seconds({seconds}) group by all)"""


@query(
    "hz_pressure_tendency",
    "O-HZ-08",
    f"""select event_id, case when hpa - before > 1 then 'rising' when hpa - before < -1 then 'falling'
 when before is not null then 'steady' end as tendency from {_back_sql(10800)}""",
)
def hz_pressure_tendency(spark, d):
    x = hazards.earlier_value(storms(spark, d), ["storm"], "ts", "hpa", 3 * 3600, "event_id", "before")
    return x.select("event_id", storm.pressure_tendency(F.col("before"), F.col("hpa")).alias("tendency"))


@query(
    "hz_storm_surge",
    "O-HZ-09",
    f"""select storm, max((1013.25-hpa)*100.0/(1025.0*9.81) + 0.04*forward_kmh*tanh(1.0/greatest(slope,0.01))) as surge
 from {STORMS} group by 1""",
    {"surge": 6},
)
def hz_storm_surge(spark, d):
    e = storm.storm_surge(F.col("hpa"), F.col("forward_kmh"), F.col("slope"))
    return hazards.worst_per_group(storms(spark, d), ["storm"], e, "surge")


@query(
    "hz_geostrophic_wind",
    "O-HZ-10",
    f"""with g as (select time, i, j, lat, (({_diff_sql('v', 'lon', 'lat')})/({_KM}*cos(radians(lat)))) as x, ({_diff_sql('v', 'lat', 'lon')})/{_KM} as y from {GRID}),
 w as (select *, 2.0*7.2921e-5*sin(radians(lat)) as f from g)
 select time, i, j, sqrt(y*y+x*x)/(1.225*f) as speed,
 case when degrees(atan2(-y, x)) < 0 then degrees(atan2(-y, x))+360 else degrees(atan2(-y, x)) end as direction from w""",
    {"speed": 4, "direction": 5},
)
def hz_geostrophic_wind(spark, d):
    g = grids.gradient(grid(spark, d))
    w = storm.geostrophic_wind(F.col("d_dx"), F.col("d_dy"), F.col("lat"))
    return g.withColumn("w", w).select("time", "i", "j", "w.speed", "w.direction")


_SS = """case when kmh/1.852 < 64 then 0 when kmh/1.852 <= 82 then 1
 when kmh/1.852 <= 95 then case when hpa > 965 then 1 else 2 end when kmh/1.852 <= 112 then case when hpa > 945 then 2 else 3 end
 when kmh/1.852 <= 136 then case when hpa > 920 then 3 else 4 end else 5 end"""


@query("hz_saffir_simpson", "O-HZ-11", f"select storm, cast(max({_SS}) as int) as category from {STORMS} group by 1")
def hz_saffir_simpson(spark, d):
    return hazards.worst_per_group(storms(spark, d), ["storm"], storm.saffir_simpson(F.col("hpa"), F.col("kmh")), "category")


@query(
    "hz_rapid_intensification",
    "O-HZ-12",
    f"""select storm, max(1.0/(1.0+exp(-(-3.94+0.14*(before-hpa)+0.13*sst-0.15*shear)))) as ri_probability
 from {_back_sql(86400)} group by 1""",
    {"ri_probability": 8},
)
def hz_rapid_intensification(spark, d):
    x = hazards.earlier_value(storms(spark, d), ["storm"], "ts", "hpa", 24 * 3600, "event_id", "before")
    p = storm.rapid_intensification(F.col("before") - F.col("hpa"), F.col("sst"), F.col("shear"))
    return hazards.worst_per_group(x, ["storm"], p, "ri_probability")


_CENTRES = f"""(select storm as id, cast((storm*29)%140-70 as double) as lat, cast((storm*61)%360-180 as double) as lon,
 cast(max({_SS}) as int) as cat from {STORMS} group by 1)"""
_B = _case("cat", STORM_PROFILE, 1.0, 1)
_R = _case("cat", STORM_PROFILE, 60.0, 0)


@query(
    "hz_wind_at_radius",
    "O-HZ-13",
    f"""with j as (select c.id, s.obs_id, c.cat, {hav('c.lat', 'c.lon', 's.lat', 's.lon')} as km from {_CENTRES} c, {SITES} s),
 k as (select *, {_B} as b, pow({_R}/greatest(km, 0.1), 2.0*{_B}) as x from j where km <= 800)
 select obs_id, max(sqrt(greatest(b/1.15*x*(cat*18.0)*100.0*exp(-x), 0))) as wind_ms from k group by 1""",
    {"wind_ms": 5},
)
def hz_wind_at_radius(spark, d):
    cat = F.max(storm.saffir_simpson(F.col("hpa"), F.col("kmh")))
    c = storms(spark, d).groupBy(F.col("storm").alias("id")).agg(cat.alias("cat"))
    c = c.withColumn("lat", ((F.col("id") * 29) % 140 - 70).cast("double")).withColumn(
        "lon", ((F.col("id") * 61) % 360 - 180).cast("double")
    )
    s = sites(spark, d).select("obs_id", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    # centres of one category at one place blow alike, and so do sites at one place
    j = spatial.radius_join(c.select("lat", "lon", "cat").distinct(), s.select("o_lat", "o_lon").distinct(), 800.0)
    at = hazards.worst_per_group(j, ["o_lat", "o_lon"], storm.wind_at_radius(F.col("cat"), F.col("d")), "wind_ms")
    return hazards.worst_per_group(s.join(at.hint("merge"), ["o_lat", "o_lon"]), ["obs_id"], F.col("wind_ms"), "wind_ms")


@query(
    "hz_storm_rainfall",
    "O-HZ-14",
    f"""select storm, max({_case('c', STORM_RAIN_RATE, 15.0)} * least({_case('c', STORM_RAIN_DIAMETER, 300.0)}/forward_kmh, 24.0)) as rain_mm
 from (select *, {_SS} as c from {STORMS}) group by 1""",
    {"rain_mm": 5},
)
def hz_storm_rainfall(spark, d):
    c = storm.saffir_simpson(F.col("hpa"), F.col("kmh"))
    return hazards.worst_per_group(
        storms(spark, d), ["storm"], storm.storm_rainfall(c, F.col("forward_kmh"), F.lit(24.0)), "rain_mm"
    )


_TYPES = list(TURBINES)
_TT = "case l_partkey % 4 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_TYPES)) + " end"
_HUB = "cast(80 + (l_partkey % 3) * 20 as double)"


def _spec(k):
    return _case("tt", TURBINES, "null", k)


_POWER = f"""(select station, d, l_partkey, case when v >= ci and v < vr then pr*pow((v-ci)/(vr-ci),3) when v >= vr and v <= co then pr else 0 end as mw
 from (select *, {_spec(0)} as pr, {_spec(1)} as ci, {_spec(2)} as vr, {_spec(3)} as co,
  case when hub <> 80 then wind_ms/(ln(hub/0.03)/ln(80.0/0.03)) else wind_ms end as v
  from (select *, {_TT} as tt, {_HUB} as hub from {WEATHER})))"""


def turbines(spark, d):
    k = F.col("l_partkey") % 4
    tt = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (k + 1).cast("int"))
    hub = ((F.col("l_partkey") % 3) * 20 + 80).cast("double")
    w = weather(spark, d)
    return w.withColumn("mw", storm.turbine_power(F.col("wind_ms"), tt, hub)).select("station", "d", "l_partkey", "mw")


@query(
    "hz_turbine_power",
    "O-HZ-15",
    f"select l_partkey % 12 as unit, sum(mw) as mw, max(mw) as top, count(*) as n from {_POWER} group by 1",
    {"mw": 4, "top": 6},
)
def hz_turbine_power(spark, d):
    return turbines(spark, d).groupBy((F.col("l_partkey") % 12).alias("unit")).agg(
        F.sum("mw").alias("mw"), F.max("mw").alias("top"), F.count("*").alias("n")
    )


@query(
    "hz_farm_output",
    "O-HZ-16",
    f"select station, cast(d as varchar) as d, least(sum(mw)*0.78, 3.0) as farm_mw from {_POWER} group by 1, 2",
    {"farm_mw": 7},
)
def hz_farm_output(spark, d):
    t = turbines(spark, d).withColumn("cap", F.lit(3.0))
    return hazards.farm_output(t, ["station", "d"], "mw", "cap").withColumn("d", F.date_format("d", "yyyy-MM-dd"))


_BF = " ".join(f"when wind_ms >= {lo} then {12 - k}" for k, lo in enumerate(reversed(BEAUFORT)))


@query(
    "hz_beaufort_components",
    "O-HZ-17",
    f"""select cast(case {_BF} else 0 end as int) as force, count(*) as n, avg(-wind_ms*sin(radians(wind_dir))) as u,
 avg(-wind_ms*cos(radians(wind_dir))) as v from {WEATHER} group by 1""",
    {"u": 6, "v": 6},
)
def hz_beaufort_components(spark, d):
    w = weather(spark, d)
    return w.groupBy(storm.beaufort(F.col("wind_ms")).cast("int").alias("force")).agg(
        F.count("*").alias("n"),
        F.avg(storm.wind_u(F.col("wind_ms"), F.col("wind_dir"))).alias("u"),
        F.avg(storm.wind_v(F.col("wind_ms"), F.col("wind_dir"))).alias("v"),
    )


_SUN = f"""(with a as (select event_id, ts, value, cast((user_id*37)%130-65 as double) as lat, cast((user_id*53)%360-180 as double) as lon,
  2.0*pi()*(dayofyear(ts)-1)/365.0 as b from events),
 c as (select *, 229.18*(0.000075+0.001868*cos(b)-0.032077*sin(b)-0.014615*cos(2*b)-0.04089*sin(2*b)) as eot,
  0.006918-0.399912*cos(b)+0.070257*sin(b)-0.006758*cos(2*b)+0.000907*sin(2*b)-0.002697*cos(3*b)+0.00148*sin(3*b) as de,
  hour(ts)+minute(ts)/60.0+second(ts)/3600.0 as h, radians(lat) as la from a),
 e as (select *, h + (4.0*(lon-15.0*round_even(lon/15.0,0))+eot)/60.0 as raw from c),
 f as (select *, radians(15.0*(raw - 24.0*floor(raw/24.0) - 12.0)) as ha from e),
 g as (select *, greatest(-1.0,least(1.0,sin(la)*sin(de)+cos(la)*cos(de)*cos(ha))) as cz from f),
 k as (select *, degrees(acos(cz)) as zenith,
  greatest(-1.0,least(1.0,case when abs(cz) > 1e-6 then -cos(de)*sin(ha)/cos(la) else 0 end)) as sa,
  greatest(-1.0,least(1.0,(sin(de)-sin(la)*cz)/(cos(la)*sin(acos(cz))+1e-10))) as ca from g)
 select event_id, ts, value, zenith, 90.0-zenith as elevation,
 (degrees(atan2(sa,ca))+360.0) - 360.0*floor((degrees(atan2(sa,ca))+360.0)/360.0) as azimuth from k)"""


def sun(spark, d):
    from weatherlake.plans.standins import events

    u = F.col("user_id")
    pos = storm.solar_position(((u * 37) % 130 - 65).cast("double"), ((u * 53) % 360 - 180).cast("double"), F.col("ts"))
    return events(spark, d).withColumn("p", pos).select(
        "event_id", "ts", "value", "user_id", "p.zenith", "p.azimuth", "p.elevation"
    )


@query(
    "hz_solar_position",
    "O-HZ-18",
    f"select event_id, zenith, elevation, azimuth from {_SUN}",
    {"zenith": 6, "elevation": 6, "azimuth": 5},
)
def hz_solar_position(spark, d):
    return sun(spark, d).select("event_id", "zenith", "elevation", "azimuth")


_AM = "(1.0/(cos(radians(least(zenith,90.0)))+0.50572*pow(96.07995-least(zenith,90.0),-1.6364)))"


@query(
    "hz_solar_energy",
    "O-HZ-19",
    f"""with g as (select cast(ts as date) as d, 1361.0*cos(radians(zenith)) as g0, {_AM} as m, (event_id % 11)/10.0 as cl, value/10 as t from {_SUN}),
 r as (select d, case when g0 <= 0 then 0 else greatest(g0*exp(-0.09*(0.1/(0.01*exp(-300.0/8500.0)+0.00196))*pow(m,0.88)),0) end as clear,
  case when g0 <= 0 then 0 else greatest(g0*(pow(0.7,pow(m,0.678))*(1.0-cl)+0.20*cl),0) end as ghi, t from g)
 select cast(d as varchar) as d, sum(clear) as clear_wh, sum(ghi) as ghi_wh, sum(case when ghi <= 0 then 0 else
  greatest(ghi*100.0*0.2/1000.0*(1.0-0.004*(t+25.0/800.0*ghi-25.0))*0.85,0) end) as pv_kwh from r group by 1""",
    {"clear_wh": 4, "ghi_wh": 4, "pv_kwh": 6},
)
def hz_solar_energy(spark, d):
    s = sun(spark, d)
    ghi = storm.cloudy_ghi((F.col("event_id") % 11) / 10.0, F.col("zenith"))
    s = s.withColumn("ghi", ghi).withColumn("clear", storm.clear_sky_ghi(F.col("zenith"), F.lit(300.0), F.lit(0.1)))
    kw = storm.pv_output(F.col("ghi"), 0.2, 100.0, F.col("value") / 10)
    return s.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(
        F.sum("clear").alias("clear_wh"), F.sum("ghi").alias("ghi_wh"), F.sum(kw).alias("pv_kwh")
    )


CYCLE_FEATURES = f"""(with x as (select *, date + to_minutes(930) as pub, (valid_time >= date + to_minutes(930)
  and valid_time <= date + to_minutes(930) + to_hours(48)) as inh from {CYCLES})
 select instrument, date, cycle, pub as publish_time,
  coalesce(arg_min(valid_time, (t2m, valid_time)) filter (where inh), max(valid_time) filter (where inh)) as event_peak_time,
  coalesce(min(t2m) filter (where inh), min(t2m)) - 273.15 as temperature_min,
  (count(*) filter (where inh and t2m < 273.15))/cast(greatest(count(*) filter (where inh),1) as double) as freeze_prob,
  coalesce(min(t2m) filter (where inh), min(t2m)) as t2m_min_k, count(*) as grid_cells, count(*) filter (where inh) as horizon_cells
 from x group by 1, 2, 3, 4)"""


def cycle_frame(spark, d):
    return hazards.cycle_features(cycles(spark, d), ["instrument", "date", "cycle"])


@query(
    "hz_cycle_features",
    "O-HZ-20",
    f"""select instrument, cast(date as varchar) as date, cast(epoch(event_peak_time) as bigint) as peak, temperature_min, freeze_prob,
 grid_cells, horizon_cells from {CYCLE_FEATURES}""",
    {"temperature_min": 7, "freeze_prob": 8, "peak": 0},
)
def hz_cycle_features(spark, d):
    return cycle_frame(spark, d).select(
        "instrument",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.unix_timestamp("event_peak_time").alias("peak"),
        "temperature_min",
        "freeze_prob",
        "grid_cells",
        "horizon_cells",
    )
