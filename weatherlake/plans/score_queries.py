"""Queries for O-VF-01..10."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weatherlake.operators import scores
from weatherlake.plans.registry import query
from weatherlake.plans.standins import CLIMATE_DAILY, MEMBERS, PROB_OBS, climate_daily, members, prob_obs


def persistence_pairs(spark, d):
    w = Window.partitionBy("region").orderBy("d")
    return climate_daily(spark, d).select(
        "region", "d", F.col("t").alias("y"), F.lag("t").over(w).alias("p"), F.month("d").alias("mon")
    )


PAIRS = f"""(select region, d, t as y, lag(t) over (partition by region order by d) as p, month(d) as mon
 from {CLIMATE_DAILY})"""


@query(
    "vf_point_scores",
    "O-VF-01",
    f"""select region, sqrt(avg((p-y)*(p-y))) as rmse, avg(abs(p-y)) as mae,
 avg(case when y <> 0 then abs((p-y)/y) end) as mape, avg(case when y <> 0 then abs((p-y)/y) end)*100 as mape_pct,
 avg(p-y) as bias from {PAIRS} where p is not null group by 1""",
    {"rmse": 6, "mae": 6, "mape": 6, "mape_pct": 5, "bias": 8},
)
def vf_point_scores(spark, d):
    return scores.point_scores(persistence_pairs(spark, d), ["region"], "y", "p")


@query(
    "vf_anomaly_correlation",
    "O-VF-02",
    f"""with c as (select region, mon, avg(y) as c from {PAIRS} group by 1, 2),
 x as (select a.*, c.c from {PAIRS} a join c using (region, mon) where p is not null),
 m as (select region, avg(y) as m from x group by 1)
 select x.region, sum((y-c)*(p-c))/sqrt(sum((y-c)*(y-c))*sum((p-c)*(p-c))) as acc,
 sum((y-m)*(p-m))/sqrt(sum((y-m)*(y-m))*sum((p-m)*(p-m))) as acc_centered
 from x join m on x.region = m.region group by 1""",
    {"acc": 6, "acc_centered": 6},
)
def vf_anomaly_correlation(spark, d):
    p = persistence_pairs(spark, d)
    clim = p.groupBy("region", "mon").agg(F.avg("y").alias("c"))
    return scores.anomaly_correlation(p.join(clim, ["region", "mon"]), ["region"], "y", "p", "c")


def targets(spark, d):
    x = prob_obs(spark, d)
    return x.unpivot(["doc_id", "p"], ["o", "o2"], "target", "outcome").select("target", "p", "outcome")


TARGETS = f"""(select 'o' as target, p, o as outcome from {PROB_OBS} union all
 select 'o2' as target, p, o2 as outcome from {PROB_OBS})"""


@query(
    "vf_brier",
    "O-VF-03",
    f"""select target, avg((p-outcome)*(p-outcome)) as brier,
 1 - avg((p-outcome)*(p-outcome))/avg((0.5-outcome)*(0.5-outcome)) as brier_skill from {TARGETS} group by 1""",
    {"brier": 8, "brier_skill": 8},
)
def vf_brier(spark, d):
    return scores.brier(targets(spark, d), ["target"], "p", "outcome", 0.5)


_EDGES = "(select unnest(range(10)) as bin)"
_IN = "x.p >= b.bin*cast(0.1 as double) and (x.p < (b.bin+1)*cast(0.1 as double) or (b.bin = 9 and x.p <= 1))"


@query(
    "vf_reliability",
    "O-VF-04",
    f"""with t as (select distinct target from {TARGETS})
 select t.target, cast(b.bin as int) as bin, coalesce(avg(x.outcome), (b.bin+0.5)/10) as observed_freq,
 coalesce(avg(x.p), (b.bin+0.5)/10) as predicted_prob, count(x.p) as n
 from t cross join {_EDGES} b left join {TARGETS} x on x.target = t.target and {_IN} group by t.target, b.bin""",
    {"observed_freq": 8, "predicted_prob": 8},
)
def vf_reliability(spark, d):
    return scores.reliability(targets(spark, d), ["target"], "p", "outcome")


@query(
    "vf_roc_auc",
    "O-VF-05",
    f"""with r as (select target, outcome, rank() over (partition by target order by p)
  + (count(*) over (partition by target, p) - 1)/2.0 as rk from {TARGETS})
 select target, (sum(case when outcome = 1 then rk end) - count(*) filter (where outcome = 1)
  * (count(*) filter (where outcome = 1) + 1)/2.0)
  / (count(*) filter (where outcome = 1) * count(*) filter (where outcome = 0)) as auc from r group by 1""",
    {"auc": 8},
)
def vf_roc_auc(spark, d):
    return scores.roc_auc(targets(spark, d), ["target"], "p", "outcome")


@query(
    "vf_discrimination",
    "O-VF-06",
    f"""select target, bin, e*10.0/nullif(sum(e) over (partition by target),0) as event_density,
 x*10.0/nullif(sum(x) over (partition by target),0) as no_event_density from
 (select x.target, cast(b.bin as int) as bin, count(*) filter (where outcome = 1) as e,
  count(*) filter (where outcome = 0) as x from {TARGETS} x join {_EDGES} b on {_IN} group by 1, 2)""",
    {"event_density": 8, "no_event_density": 8},
)
def vf_discrimination(spark, d):
    return scores.discrimination(targets(spark, d), ["target"], "p", "outcome")


def with_obs(spark, d):
    """Members with the case's observation next to them (a case is one ensemble)."""
    m = members(spark, d)
    o = F.max(F.when(F.col("member") == 0, F.col("x"))).over(Window.partitionBy("case_id"))
    return m.withColumn("obs", o).filter(F.col("member") > 0)


WITH_OBS = f"""(select * from (select *, max(case when member = 0 then x end) over (partition by case_id) as obs
 from {MEMBERS}) where member > 0)"""


@query(
    "vf_crps",
    "O-VF-07",
    f"""with a as (select series_id, case_id, avg(abs(x-obs)) as a from {WITH_OBS} group by 1, 2),
 b as (select l.case_id, sum(abs(l.x-r.x))/(2.0*63*63) as b from {WITH_OBS} l join {WITH_OBS} r
  on l.case_id = r.case_id group by 1)
 select series_id, avg(a-b) as crps, count(*) as cases from a join b on a.case_id = b.case_id group by 1""",
    {"crps": 6},
)
def vf_crps(spark, d):
    return scores.ensemble_crps(with_obs(spark, d), ["series_id"], "case_id", "x", "obs")


@query(
    "vf_ensemble_spread",
    "O-VF-08",
    f"""select series_id, avg(s) as spread from (select series_id, case_id, stddev_samp(x) as s from {WITH_OBS}
 group by 1, 2) group by 1""",
    {"spread": 8},
)
def vf_ensemble_spread(spark, d):
    return scores.ensemble_spread(members(spark, d).filter("member > 0"), ["series_id"], "case_id", "x")


@query(
    "vf_calibration_error",
    "O-VF-09",
    f"""select target, sum(w*abs(p-o))/sum(w) as ece from (select x.target, b.bin, count(*) as w, avg(p) as p,
 avg(outcome) as o from {TARGETS} x join {_EDGES} b on {_IN} group by 1, 2) group by 1""",
    {"ece": 8},
)
def vf_calibration_error(spark, d):
    return scores.calibration_error(targets(spark, d), ["target"], "p", "outcome")


@query(
    "vf_sharpness_coverage",
    "O-VF-10",
    f"""with q as (select series_id, case_id, max(obs) as obs, quantile_cont(x, 0.1) as lo, quantile_cont(x, 0.9) as hi
 from {WITH_OBS} group by 1, 2)
 select series_id, avg(hi-lo) as sharpness, avg(case when obs between lo and hi then 1.0 else 0.0 end) as coverage
 from q group by 1""",
    {"sharpness": 6, "coverage": 8},
)
def vf_sharpness_coverage(spark, d):
    # the percentile buffer of a case is one ensemble, so it stays small
    qs = [0.1, 0.5, 0.9]
    wide = (
        with_obs(spark, d)
        .groupBy("series_id", "case_id")
        .agg(F.max("obs").alias("obs"), F.percentile("x", F.array(*map(F.lit, qs))).alias("qv"))
    )
    long = wide.select("series_id", "case_id", F.posexplode("qv").alias("q", "v"))
    sharp = scores.sharpness(long, ["series_id", "case_id"], "q", "v").groupBy("series_id").agg(
        F.avg("sharpness").alias("sharpness")
    )
    bounds = wide.select("series_id", "obs", F.col("qv")[0].alias("lo"), F.col("qv")[2].alias("hi"))
    return sharp.join(scores.coverage(bounds, ["series_id"], "lo", "hi", "obs"), "series_id")
