"""Queries for O-ML-01..10."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weatherlake.functions.stats import z
from weatherlake.operators import models
from weatherlake.plans.registry import query
from weatherlake.plans.score_queries import PAIRS, WITH_OBS, persistence_pairs, with_obs
from weatherlake.plans.standins import CLIMATE_DAILY, OBS, PROB_OBS, climate_daily, obs, prob_obs

CUT = "timestamp '2024-01-16'"


def _cut():
    return F.lit("2024-01-16").cast("timestamp")


@query(
    "ml_persistence",
    "O-ML-01",
    f"""with l as (select station, max_by(temp_c, (ts, event_id)) as yhat from {OBS} where ts < {CUT} group by 1)
 select event_id, yhat, yhat as q10, yhat as q90 from {OBS} o left join l on o.station = l.station where ts >= {CUT}""",
    {"yhat": 8, "q10": 8, "q90": 8},
)
def ml_persistence(spark, d):
    o = obs(spark, d).select("event_id", "station", "ts", "temp_c")
    out = models.persistence(o.filter(F.col("ts") < _cut()), o.filter(F.col("ts") >= _cut()), ["station"], ["ts", "event_id"], "temp_c")
    return out.select("event_id", "yhat", "q10", "q90")


@query(
    "ml_climatology_forecast",
    "O-ML-02",
    f"""with t as (select region, d, dayofyear(d) as doy, t from {CLIMATE_DAILY} where year(d) < 1998),
 c as (select region, doy, avg(t) as m, coalesce(stddev_samp(t), 0) as s from t group by 1, 2),
 l as (select region, max_by(t, d) as y, max_by(doy, d) as doy from t group by 1),
 sh as (select l.region, l.y - c.m as sh from l join c on l.region = c.region and l.doy = c.doy),
 fb as (select region, avg(m) as fb from c group by 1)
 select x.region, cast(x.d as varchar) as d, coalesce(c.m, fb.fb) + sh.sh as yhat,
  coalesce(c.m, fb.fb) + sh.sh + coalesce(c.s, 1.0) * ({z(0.1)!r}) as q10,
  coalesce(c.m, fb.fb) + sh.sh + coalesce(c.s, 1.0) * ({z(0.75)!r}) as q75
 from {CLIMATE_DAILY} x join fb on x.region = fb.region join sh on x.region = sh.region
 left join c on x.region = c.region and dayofyear(x.d) = c.doy where year(x.d) >= 1998""",
    {"yhat": 8, "q10": 7, "q75": 7},
)
def ml_climatology_forecast(spark, d):
    x = climate_daily(spark, d).select("region", "d", "t")
    out = models.climatology_forecast(
        x.filter(F.year("d") < 1998), x.filter(F.year("d") >= 1998), ["region"], "d", "t", shift=True
    )
    return out.select("region", F.date_format("d", "yyyy-MM-dd").alias("d"), "yhat", "q10", "q75")


def predictions(spark, d):
    """Three rival forecasts of the daily value: persistence, monthly normal, their mean."""
    p = persistence_pairs(spark, d)
    clim = p.filter(F.year("d") < 1998).groupBy("region", "mon").agg(F.avg("y").alias("c"))
    j = p.join(clim, ["region", "mon"]).filter(F.col("p").isNotNull() & (F.year("d") >= 1998))
    return j.select(
        "region", "d", "y", F.col("p").alias("persist"), F.col("c").alias("normal"), ((F.col("p") + F.col("c")) / 2).alias("midway")
    )


_PRED = f"""(select x.region, x.d, x.y, x.p as persist, c.c as normal, (x.p+c.c)/2 as midway from {PAIRS} x
 join (select region, mon, avg(y) as c from {PAIRS} where year(d) < 1998 group by 1, 2) c
 on x.region = c.region and x.mon = c.mon where x.p is not null and year(x.d) >= 1998)"""
_LONG = f"""(select region, d, y, 'persist' as model, persist as yhat from {_PRED} union all
 select region, d, y, 'normal', normal from {_PRED} union all select region, d, y, 'midway', midway from {_PRED})"""
_RMSE = f"(select region, model, sqrt(avg((y-yhat)*(y-yhat))) as rmse from {_LONG} where year(d) = 1998 group by 1, 2)"
_BMA = f"""(select region, model, rmse, e / sum(e) over (partition by region) as weight from
 (select *, exp(-(rmse - min(rmse) over (partition by region))) as e from {_RMSE}))"""


def long_predictions(spark, d):
    return predictions(spark, d).unpivot(["region", "d", "y"], ["persist", "normal", "midway"], "model", "yhat")


@query("ml_bma_weights", "O-ML-04", f"select * from {_BMA}", {"rmse": 7, "weight": 7})
def ml_bma_weights(spark, d):
    return models.bma_weights(long_predictions(spark, d).filter(F.year("d") == 1998), ["region"])


@query(
    "ml_stacking",
    "O-ML-04",
    f"""with s as (select region, count(*) as n, sum(persist*persist)+1.0 as a, sum(persist*normal) as b,
  sum(normal*normal)+1.0 as c, sum(persist*y) as e, sum(normal*y) as f, avg(y) as my, avg(persist) as mp, avg(normal) as mn
  from {_PRED} where year(d) = 1998 group by 1),
 k as (select region, (e*c-b*f)/(a*c-b*b) as k1, (a*f-b*e)/(a*c-b*b) as k2, my, mp, mn from s)
 select p.region, cast(p.d as varchar) as d, my - mp*k1 - mn*k2 + persist*k1 + normal*k2 as yhat
 from {_PRED} p join k on p.region = k.region where year(p.d) > 1998""",
    {"yhat": 6},
)
def ml_stacking(spark, d):
    p = predictions(spark, d)
    x = ["persist", "normal"]
    fitted = models.fit_linear(p.filter(F.year("d") == 1998), ["region"], x, "y", ridge=1.0, centred=False)
    out = models.apply_linear(p.filter(F.year("d") > 1998), fitted, ["region"], x)
    return out.select("region", F.date_format("d", "yyyy-MM-dd").alias("d"), "yhat")


@query(
    "ml_blend",
    "O-ML-05",
    f"""select l.region, cast(l.d as varchar) as d, sum(w.weight*l.yhat)/sum(w.weight) as blended,
 stddev_pop(l.yhat) as inter_model_std from {_LONG} l join {_BMA} w on l.region = w.region and l.model = w.model
 where year(l.d) > 1998 group by 1, 2""",
    {"blended": 7, "inter_model_std": 7},
)
def ml_blend(spark, d):
    p = long_predictions(spark, d)
    w = models.bma_weights(p.filter(F.year("d") == 1998), ["region"])
    out = models.blend(p.filter(F.year("d") > 1998), w, ["region"], ["d"])
    return out.withColumn("d", F.date_format("d", "yyyy-MM-dd"))


@query(
    "ml_blend_quantiles",
    "O-ML-05",
    f"""select l.region, cast(l.d as varchar) as d, q.q, sum(w.weight*(l.yhat + q.z*w.rmse))/sum(w.weight) as value
 from {_LONG} l join {_BMA} w on l.region = w.region and l.model = w.model
 cross join (values ('q10', {z(0.1)!r}), ('q50', 0.0), ('q90', {z(0.9)!r})) q(q, z) where year(l.d) > 1998 group by 1, 2, 3""",
    {"value": 6},
)
def ml_blend_quantiles(spark, d):
    p = long_predictions(spark, d)
    w = models.bma_weights(p.filter(F.year("d") == 1998), ["region"])
    q = F.array(*[F.struct(F.lit(models.q_name(v)).alias("q"), F.lit(z(v)).alias("z")) for v in (0.1, 0.5, 0.9)])
    pq = (
        p.filter(F.year("d") > 1998)
        .join(w.select("region", "model", "rmse"), ["region", "model"])
        .select("region", "d", "model", "yhat", "rmse", F.inline(q))
        .select("region", "d", "model", "q", (F.col("yhat") + F.col("z") * F.col("rmse")).alias("value"))
    )
    out = models.blend_quantiles(pq, w, ["region"], ["d"])
    return out.withColumn("d", F.date_format("d", "yyyy-MM-dd"))


@query(
    "ml_reweight",
    "O-ML-06",
    f"""with cur as (select region, model, sqrt(avg((y-yhat)*(y-yhat))) as rmse from {_LONG} where year(d) = 1999 group by 1, 2),
 c as (select *, exp(-(rmse - min(rmse) over (partition by region))) as e from cur),
 h as (select region, model, exp(-rmse) as e from {_RMSE}),
 b as (select c.region, c.model, c.rmse, 0.9 * h.e / sum(h.e) over (partition by c.region)
  + (1-0.9) * c.e / sum(c.e) over (partition by c.region) as b from c join h on c.region = h.region and c.model = h.model)
 select region, model, b / sum(b) over (partition by region) as weight,
 cast(rank() over (partition by region order by rmse, model) as int) as rank from b""",
    {"weight": 7},
)
def ml_reweight(spark, d):
    p = long_predictions(spark, d)
    hist = models.rmse_by_model(p.filter(F.year("d") == 1998), ["region"])
    return models.reweight(hist, models.bma_weights(p.filter(F.year("d") == 1999), ["region"]), ["region"])


@query(
    "ml_direct_multi_step",
    "O-ML-07",
    f"""with s as (select region, d, t, h.h, lead(t, cast(h.h as int)) over (partition by region, h.h order by d) as y
  from {CLIMATE_DAILY} cross join (select unnest(range(1, 8)) as h) h),
 f as (select region, h, regr_slope(y, t) as b, regr_intercept(y, t) as a from s where y is not null group by 1, 2),
 l as (select region, max_by(t, d) as t from {CLIMATE_DAILY} group by 1)
 select f.region, cast(f.h as int) as h, f.a + f.b * l.t as yhat from f join l on f.region = l.region""",
    {"yhat": 6},
)
def ml_direct_multi_step(spark, d):
    return models.direct_multi_step(climate_daily(spark, d).select("region", "d", "t"), ["region"], "d", ["t"], "t", 7)


@query(
    "ml_multi_output",
    "O-ML-07",
    f"""with s as (select region, d, t, h.h, lead(t, cast(h.h as int)) over (partition by region, h.h order by d) as y,
  lead(t, 7) over (partition by region, h.h order by d) as y7
  from {CLIMATE_DAILY} cross join (select unnest(range(1, 8)) as h) h),
 f as (select region, h, regr_slope(y, t) as b, regr_intercept(y, t) as a from s where y7 is not null group by 1, 2),
 l as (select region, max_by(t, d) as t from {CLIMATE_DAILY} group by 1)
 select f.region, cast(f.h as int) as h, f.a + f.b * l.t as yhat from f join l on f.region = l.region""",
    {"yhat": 6},
)
def ml_multi_output(spark, d):
    return models.multi_output(climate_daily(spark, d).select("region", "d", "t"), ["region"], "d", ["t"], "t", 7)


_AR = f"""with p as (select region, d, t, lag(t, 1) over w as x2, lag(t, 2) over w as x1 from {CLIMATE_DAILY}
  window w as (partition by region order by d)),
 m as (select region, count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(t) as my, covar_pop(x1,x1) as s11,
  covar_pop(x1,x2) as s12, covar_pop(x2,x2) as s22, covar_pop(x1,t) as s1y, covar_pop(x2,t) as s2y
  from p where x1 is not null group by 1),
 c as (select region, (s1y*s22-s12*s2y)/(s11*s22-s12*s12) as b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) as b2, my, m1, m2 from m),
 k as (select region, my - m1*b1 - m2*b2 as a, b1, b2 from c),
 l as (select region, max_by(x2, d) as x1, max_by(t, d) as x2 from p group by 1)"""


def ar_state(spark, d):
    """Second-order autoregression per region and the last two values to start from."""
    w = Window.partitionBy("region").orderBy("d")
    p = climate_daily(spark, d).select(
        "region", "d", "t", F.lag("t", 1).over(w).alias("x2"), F.lag("t", 2).over(w).alias("x1")
    )
    fitted = models.fit_linear(p, ["region"], ["x1", "x2"], "t")
    last = p.groupBy("region").agg(F.max_by(F.array("x2", "t"), "d").alias("window"))
    return last.join(fitted, "region").withColumn("anchor", F.lit(None).cast("double"))


@query(
    "ml_rollout_recursive",
    "O-ML-08",
    "with recursive "
    + _AR[5:]
    + """, r as (select k.region, 1 as step, x2 as w1, a + b1*x1 + b2*x2 as v from k join l on k.region = l.region
  union all select r.region, r.step+1, r.v, k.a + k.b1*r.w1 + k.b2*r.v from r join k on r.region = k.region where r.step < 168)
 select region, step, v as value, 0.02*step as uncertainty from r""",
    {"value": 6, "uncertainty": 6},
)
def ml_rollout_recursive(spark, d):
    return models.rollout(ar_state(spark, d), ["region"])


@query(
    "ml_rollout_momentum",
    "O-ML-08",
    "with recursive "
    + _AR[5:]
    + """, s as (select k.region, a + b1*x1 + b2*x2 as raw, x2 from k join l on k.region = l.region),
 r as (select region, 1 as step, raw as anchor, raw as ema, x2 as w1, raw as v from s
  union all select r.region, r.step+1, r.anchor, 0.98*r.ema + 0.02*(k.a + k.b1*r.w1 + k.b2*r.v), r.v,
   0.98*r.ema + 0.02*(k.a + k.b1*r.w1 + k.b2*r.v)
   + (r.anchor - (0.98*r.ema + 0.02*(k.a + k.b1*r.w1 + k.b2*r.v)))*(1-exp(-0.01*(r.step+1)))
  from r join k on r.region = k.region where r.step < 168)
 select region, step, v as value, 0.02*step as uncertainty from r""",
    {"value": 6, "uncertainty": 6},
)
def ml_rollout_momentum(spark, d):
    return models.rollout(ar_state(spark, d), ["region"], method="momentum")


@query(
    "ml_threshold",
    "O-ML-09",
    f"""with g as (select i, i*cast(0.005 as double) as t from (select unnest(range(201)) as i)),
 c as (select g.i, g.t, count(*) filter (where p >= t and o = 1) as tp, count(*) filter (where p >= t and o = 0) as fp,
  count(*) filter (where p < t and o = 1) as fn from g, {PROB_OBS} group by 1, 2),
 s as (select i, t, tp/greatest(tp+fp, 1e-12) as pr, tp/greatest(tp+fn, 1e-12) as rc from c),
 f as (select i, t, 2*pr*rc/greatest(pr+rc, 1e-12) as f1 from s)
 select 'quality' as target, arg_max(t, (f1, -i)) as threshold, max(f1) as score from f""",
    {"threshold": 6, "score": 8},
)
def ml_threshold(spark, d):
    src = prob_obs(spark, d).select(F.lit("quality").alias("target"), "p", "o")
    return models.optimise_threshold(src, ["target"], "p", "o")


@query(
    "ml_weighted_ensemble",
    "O-ML-10",
    f"""with g as (select case_id, sum(member*x)/sum(member) as mean, stddev_samp(x) as member_std from {WITH_OBS} group by 1)
 select *, mean + greatest(member_std, 1e-12)*({z(0.1)!r}) as q10, mean + greatest(member_std, 1e-12)*({z(0.25)!r}) as q25,
 mean as q50, mean + greatest(member_std, 1e-12)*({z(0.75)!r}) as q75, mean + greatest(member_std, 1e-12)*({z(0.9)!r}) as q90
 from g""",
    {c: 7 for c in ("mean", "member_std", "q10", "q25", "q50", "q75", "q90")},
)
def ml_weighted_ensemble(spark, d):
    return models.weighted_ensemble(with_obs(spark, d), ["case_id"], "x", "member")


def boosted_frame(spark, d):
    w = Window.partitionBy("region").orderBy("d")
    return climate_daily(spark, d).select(
        "region",
        "d",
        "t",
        "precip",
        F.lag("t", 1).over(w).alias("t1"),
        F.lag("t", 2).over(w).alias("t2"),
        F.lag("precip", 1).over(w).alias("p1"),
        F.dayofyear("d").cast("double").alias("doy"),
    )


BOOSTED = ["t1", "t2", "p1", "doy"]


def boosted_models(spark, d, targets):
    """Fitted to the years before 1998, stopped by 1998; later years are free for residuals and forecasts."""
    f = boosted_frame(spark, d)
    return models.boosted_fit(f.filter(F.year("d") < 1998), f.filter(F.year("d") == 1998), BOOSTED, targets)


@query("ml_boosted_importance", "O-ML-03")
def ml_boosted_importance(spark, d):
    return models.feature_importance(spark, boosted_models(spark, d, ["t", "precip"]), BOOSTED)


def boosted_forecast(spark, d):
    f = boosted_frame(spark, d)
    model = boosted_models(spark, d, ["t"])["t"]
    known = model.transform(f.filter(F.year("d") == 1999))
    return models.boosted_predict(model, f.filter(F.year("d") > 1999), known, "region", "t")


@query("ml_boosted_forecast", "O-ML-03")
def ml_boosted_forecast(spark, d):
    return boosted_forecast(spark, d).select("region", "d", "t", "yhat", "q10", "q25", "q50", "q75", "q90")


@query(
    "ml_boosted_invariants",
    "O-ML-03",
    f"""with x as (select region, d, t, lag(t, 1) over w as t1, lag(t, 2) over w as t2, lag(precip, 1) over w as p1 from {CLIMATE_DAILY} window w as (partition by region order by d))
 select region, count(*) as n, min(cast(d as varchar)) as first_day, sum(t) as t, true as ordered from x
 where year(d) > 1999 and t1 is not null and t2 is not null and p1 is not null group by 1""",
    {"t": 6},
)
def ml_boosted_invariants(spark, d):
    """What holds of the forecasts whatever the trees: a row for every day with features, quantiles in order."""
    x = boosted_forecast(spark, d)
    qs = ["q10", "q25", "q50", "q75", "q90"]
    ordered = F.bool_and(F.expr(" and ".join(f"{a} <= {b}" for a, b in zip(qs, qs[1:]))))
    return x.groupBy("region").agg(
        F.count("*").alias("n"), F.min(F.date_format("d", "yyyy-MM-dd")).alias("first_day"), F.sum("t").alias("t"), ordered.alias("ordered")
    )
