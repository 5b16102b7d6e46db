"""Queries for O-TS-08..21."""

from pyspark.sql import functions as F


from weatherlake.operators import climate, islands, ranks
from weatherlake.plans.registry import query
from weatherlake.plans.standins import CLIMATE_DAILY, OBS, OBS_DAILY, climate_daily, obs, obs_daily


def _s(c="d"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@query(
    "ts_degree_days",
    "O-TS-08",
    f"""select station, sum(greatest(18.3-temp_c,0)) as hdd, sum(greatest(temp_c-18.3,0)) as cdd from {OBS} group by 1""",
    {"hdd": 6, "cdd": 6},
)
def ts_degree_days(spark, d):
    return climate.degree_days(obs(spark, d), ["station"], "temp_c")


@query(
    "ts_market_degree_days",
    "O-TS-09",
    f"""select station, cast(d as varchar) as d, greatest(65-f,0) as hdd_f, greatest(f-65,0) as cdd_f from
 (select station, d, case when max(t_mean) over (partition by station) < 40 then t_mean*9.0/5.0+32.0 else t_mean end as f
  from {OBS_DAILY})""",
    {"hdd_f": 6, "cdd_f": 6},
)
def ts_market_degree_days(spark, d):
    return climate.market_degree_days(obs_daily(spark, d), ["station"], "t_mean").select(
        "station", _s(), "hdd_f", "cdd_f"
    )


@query(
    "ts_growing_degree_days",
    "O-TS-10",
    f"""select station, sum(least(greatest(t_max,10),30)-10) as gdd, sum(greatest(least(t_max,30)-10,0)) as gdd_season
 from {OBS_DAILY} group by 1""",
    {"gdd": 6, "gdd_season": 6},
)
def ts_growing_degree_days(spark, d):
    return climate.growing_degree_days(obs_daily(spark, d), ["station"], "t_max")


@query(
    "ts_dry_fraction",
    "O-TS-11",
    f"""select region, cast(d as varchar) as d, avg(case when precip < 10 then 1.0 else 0.0 end) over
 (partition by region order by d rows between 29 preceding and current row) as dry_fraction from {CLIMATE_DAILY}""",
    {"dry_fraction": 7},
)
def ts_dry_fraction(spark, d):
    return climate.dry_day_fraction(climate_daily(spark, d), ["region"], "d", "precip", threshold=10.0).select(
        "region", _s(), "dry_fraction"
    )


@query(
    "ts_frost_days",
    "O-TS-12",
    f"""select station, count(*) filter (where t_min <= 0) as frost_days, count(*) as days from {OBS_DAILY} group by 1""",
)
def ts_frost_days(spark, d):
    return climate.frost_days(obs_daily(spark, d), ["station"], "t_min")


@query(
    "ts_heatwave_days",
    "O-TS-13",
    f"""with m as (select region, d, t, sum(case when t > 18 then 0 else 1 end) over
  (partition by region order by d rows unbounded preceding) as g from {CLIMATE_DAILY})
 select region, cast(d as varchar) as d, (t > 18 and count(*) filter (where t > 18) over (partition by region, g) >= 3)
 as in_run from m""",
)
def ts_heatwave_days(spark, d):
    src = climate_daily(spark, d).select("region", "d", "t")
    return islands.in_long_run(src, ["region"], ["d"], F.col("t") > 18, 3).select("region", _s(), "in_run")


@query(
    "ts_longest_run",
    "O-TS-14",
    f"""with m as (select station, temp_c > 2 as f, sum(case when temp_c > 2 then 0 else 1 end) over
  (partition by station order by ts, event_id rows unbounded preceding) as g from {OBS})
 select station, max(n) as longest_run from (select station, g, count(*) filter (where f) as n from m group by 1, 2)
 group by 1""",
)
def ts_longest_run(spark, d):
    return islands.longest_run(
        obs(spark, d), ["station"], ["ts", "event_id"], F.col("temp_c") > 2, long=True
    )


@query(
    "ts_climatology_zscore",
    "O-TS-15",
    f"""with c as (select region, month(d) as mon, avg(t) as m, coalesce(stddev_samp(t),0) as s from {CLIMATE_DAILY}
  where year(d) < 2000 group by 1, 2)
 select x.region, cast(x.d as varchar) as d, x.t - c.m as departure, (x.t - c.m)/nullif(c.s,0) as zscore
 from {CLIMATE_DAILY} x left join c on x.region = c.region and month(x.d) = c.mon""",
    {"departure": 6, "zscore": 6},
)
def ts_climatology_zscore(spark, d):
    daily = climate_daily(spark, d).withColumn("mon", F.month("d"))
    clim = climate.climatology(daily.filter(F.year("d") < 2000), ["region", "mon"], "t")
    return climate.anomaly(daily, clim, ["region", "mon"], "t").select("region", _s(), "departure", "zscore")


@query(
    "ts_percentile_rank",
    "O-TS-16",
    f"""with h as (select station, value from {OBS} where ts < timestamp '2024-01-16'),
 q as (select event_id, station, value from {OBS} where ts >= timestamp '2024-01-16')
 select event_id, (count(*) filter (where h.value < q.value) + count(*) filter (where h.value <= q.value)
  + case when count(*) filter (where h.value = q.value) > 0 then 1 else 0 end) * 50.0
  / nullif(count(h.value), 0) as pct_rank
 from q left join h on q.station = h.station group by event_id""",
    {"pct_rank": 7},
)
def ts_percentile_rank(spark, d):
    o = obs(spark, d)
    cut = F.lit("2024-01-16").cast("timestamp")
    hist = o.filter(F.col("ts") < cut).select("station", "value")
    new = o.filter(F.col("ts") >= cut).select("event_id", "station", "value")
    return ranks.percentile_rank(new, hist, ["station"], "value").select("event_id", "pct_rank")


@query("ts_spi", "O-TS-17")
def ts_spi(spark, d):
    src = climate_daily(spark, d).select("region", "d", "precip")
    return climate.spi(src, ["region"], "d", "precip").select("region", "d", F.round("spi", 6).alias("spi"))


@query("ts_drought_index", "O-TS-18")
def ts_drought_index(spark, d):
    return climate.drought_index(climate_daily(spark, d), ["region"], "d", "precip")


@query(
    "ts_drought_moments",
    "O-TS-18 (moments)",
    f"""with a as (select region, d, sum(precip) over w as acc, count(*) over w as n from {CLIMATE_DAILY}
  window w as (partition by region order by d rows between 89 preceding and current row))
 select region, avg(acc) as mean, var_samp(acc) as var, max_by(acc, d) as latest, count(*) as windows
 from a where n = 90 group by 1""",
    {"mean": 6, "var": 4, "latest": 6},
)
def ts_drought_moments(spark, d):
    return climate.drought_moments(climate_daily(spark, d), ["region"], "d", "precip")


@query(
    "ts_doy_climatology",
    "O-TS-19",
    f"""with c as (select region, dayofyear(d) as doy, avg(t) as m, coalesce(stddev_samp(t),0) as s from {CLIMATE_DAILY}
  where year(d) < 1997 group by 1, 2), g as (select region, avg(t) as m from {CLIMATE_DAILY} where year(d) >= 1997 group by 1)
 select x.region, cast(x.d as varchar) as d, coalesce(c.m, g.m) as clim_mean, c.s as clim_std,
  x.t - coalesce(c.m, g.m) as anomaly from {CLIMATE_DAILY} x join g on x.region = g.region
  left join c on x.region = c.region and dayofyear(x.d) = c.doy where year(x.d) >= 1997""",
    {"clim_mean": 9, "clim_std": 8, "anomaly": 9},
)
def ts_doy_climatology(spark, d):
    daily = climate_daily(spark, d)
    out = climate.day_of_year_anomaly(
        daily.filter(F.year("d") < 1997), daily.filter(F.year("d") >= 1997), ["region"], "d", "t"
    )
    return out.select("region", _s(), "clim_mean", "clim_std", "anomaly")


@query(
    "ts_year_split",
    "O-TS-20",
    f"""select case when year(d) between 1995 and 1998 then 'train' when year(d) = 1999 then 'val'
  when year(d) >= 2000 then 'test' end as split, count(*) as n, avg(t) as mean from {CLIMATE_DAILY} group by 1""",
    {"mean": 6},
)
def ts_year_split(spark, d):
    return (
        climate_daily(spark, d)
        .groupBy(climate.split_label(F.col("d"), (1995, 1998), 1999, 2000).alias("split"))
        .agg(F.count("*").alias("n"), F.avg("t").alias("mean"))
    )


@query(
    "ts_standardise",
    "O-TS-21",
    f"""with f as (select station, avg(temp_c) as m, case when stddev_pop(temp_c) = 0 then 1 else stddev_pop(temp_c) end as s
  from {OBS} where ts < timestamp '2024-01-16' group by 1)
 select event_id, (temp_c - m)/s as temp_c_scaled, (temp_c - m)/s*s + m as temp_c_restored
 from {OBS} o left join f on o.station = f.station""",
    {"temp_c_scaled": 6, "temp_c_restored": 6},
)
def ts_standardise(spark, d):
    o = obs(spark, d).select("event_id", "station", "ts", "temp_c")
    fitted = climate.scaler(o.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp")), ["station"], ["temp_c"])
    scaled = climate.standardise(o, fitted, ["station"], ["temp_c"])
    return climate.unstandardise(scaled, ["temp_c"]).select("event_id", "temp_c_scaled", "temp_c_restored")



