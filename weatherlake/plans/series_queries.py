"""Queries for O-TS-01..07 and 22 on raw station observations."""

from pyspark.sql import functions as F

from weatherlake.operators import series
from weatherlake.plans.registry import also, query
from weatherlake.plans.standins import OBS, obs

KEYS, ORDER = ["station"], ["ts", "event_id"]


_W = "partition by station order by ts, event_id"


def _f(k):
    return f"{_W} rows between {k - 1} preceding and current row"


def _src(spark, d):
    return obs(spark, d).select("event_id", "station", "ts", "temp_c")


@query(
    "ts_lags",
    "O-TS-01",
    "select event_id, "
    + ", ".join(f"lag(temp_c, {k}) over ({_W}) as temp_c_lag_{k}" for k in series.LAGS)
    + f" from {OBS}",
    {f"temp_c_lag_{k}": 9 for k in series.LAGS},
)
def ts_lags(spark, d):
    out = series.features(_src(spark, d), KEYS, ORDER, ["temp_c"], stats=("lag",), windows=())
    return out.drop("station", "ts", "temp_c")


def _roll_sql(k):
    gate = f"count(*) over (partition by station) >= {k} and count(temp_c) over ({_f(k)}) >= {max(1, k // 2)}"
    fns = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return [f"case when {gate} then {fn}(temp_c) over ({_f(k)}) end as temp_c_roll{n}_{k}" for n, fn in fns.items()]


@query(
    "ts_rolling_stats",
    "O-TS-02",
    "select event_id, " + ", ".join(x for k in series.WINDOWS for x in _roll_sql(k)) + f" from {OBS}",
    {f"temp_c_roll{n}_{k}": 7 for k in series.WINDOWS for n in ("mean", "std", "min", "max")},
)
def ts_rolling_stats(spark, d):
    return series.features(_src(spark, d), KEYS, ORDER, ["temp_c"], stats=("window",)).drop(
        "station", "ts", "temp_c"
    )


@query(
    "ts_ema",
    "O-TS-05",
    f"""with recursive s as (select event_id, station, temp_c as x, row_number() over ({_W}) as rn from {OBS}),
 r as (select event_id, station, rn, x as e12, x as e24, x as e48 from s where rn = 1
  union all select s.event_id, s.station, s.rn, r.e12 + 2.0/13*(s.x - r.e12), r.e24 + 2.0/25*(s.x - r.e24),
  r.e48 + 2.0/49*(s.x - r.e48) from r join s on s.station = r.station and s.rn = r.rn + 1)
 select event_id, e12 as temp_c_ema_12, e24 as temp_c_ema_24, e48 as temp_c_ema_48 from r""",
    {f"temp_c_ema_{k}": 6 for k in series.EMA_SPANS},
)
def ts_ema(spark, d):
    return series.ema(_src(spark, d), KEYS, ORDER, "temp_c").drop("station", "ts", "temp_c")


def _z_sql(k):
    gate = f"count(*) over (partition by station) >= {k} and count(temp_c) over ({_f(k)}) >= {max(1, k // 2)}"
    return (
        f"case when {gate} then (temp_c - avg(temp_c) over ({_f(k)})) / nullif(stddev_samp(temp_c) over ({_f(k)}), 0)"
        f" end as temp_c_anomaly_{k}"
    )


@query(
    "ts_rolling_trend",
    "O-TS-03",
    "select event_id, "
    + ", ".join(
        f"case when count(*) over ({_f(k)}) = {k} then regr_slope(temp_c, rn) over ({_f(k)}) end as temp_c_trend_{k}"
        for k in series.WINDOWS
    )
    + f" from (select *, cast(row_number() over ({_W}) as double) as rn from {OBS})",
    {f"temp_c_trend_{k}": 6 for k in series.WINDOWS},
)
def ts_rolling_trend(spark, d):
    return series.features(_src(spark, d), KEYS, ORDER, ["temp_c"], stats=("trend",)).drop("station", "ts", "temp_c")


@query(
    "ts_rolling_zscore",
    "O-TS-04",
    "select *, "
    + ", ".join(f"coalesce(abs(temp_c_anomaly_{k}) > 3, false) as temp_c_is_anomaly_{k}" for k in series.WINDOWS)
    + " from (select event_id, "
    + ", ".join(_z_sql(k) for k in series.WINDOWS)
    + f" from {OBS})",
    {f"temp_c_anomaly_{k}": 6 for k in series.WINDOWS},
)
def ts_rolling_zscore(spark, d):
    return series.features(_src(spark, d), KEYS, ORDER, ["temp_c"], stats=("anomaly",)).drop("station", "ts", "temp_c")


@query(
    "ts_full_mean",
    "O-TS-06",
    "select event_id, "
    + ", ".join(
        f"case when count(temp_c) over ({_f(k)}) = {k} then avg(temp_c) over ({_f(k)}) end as temp_c_rolling_{k}"
        for k in series.WINDOWS
    )
    + f" from {OBS}",
    {f"temp_c_rolling_{k}": 7 for k in series.WINDOWS},
)
def ts_full_mean(spark, d):
    return series.features(_src(spark, d), KEYS, ORDER, ["temp_c"], stats=("rolling",)).drop("station", "ts", "temp_c")


_VARIABLES = ("temp_c", "precip")


def _every_sql(v):
    yield from (f"lag({v}, {k}) over ({_W}) as {v}_lag_{k}" for k in series.LAGS)
    for k in series.WINDOWS:
        yield from (x.replace("temp_c", v) for x in [*_roll_sql(k), _z_sql(k)])
        yield f"case when count(*) over ({_f(k)}) = {k} then regr_slope({v}, rn) over ({_f(k)}) end as {v}_trend_{k}"
        yield f"case when count({v}) over ({_f(k)}) = {k} then avg({v}) over ({_f(k)}) end as {v}_rolling_{k}"


def _ema_sql():
    spans = [(v, k, f"{v}_ema_{k}") for v in _VARIABLES for k in series.EMA_SPANS]
    first = ", ".join(f"{v} as {n}" for v, _, n in spans)
    more = ", ".join(f"r.{n} + 2.0/{k + 1}*(s.{v} - r.{n})" for v, k, n in spans)
    return f"""(with recursive s as (select event_id, station, temp_c, precip, row_number() over ({_W}) as rn from {OBS}),
 r as (select event_id, station, rn, {first} from s where rn = 1
  union all select s.event_id, s.station, s.rn, {more} from r join s on s.station = r.station and s.rn = r.rn + 1)
 select event_id, {", ".join(n for _, _, n in spans)} from r)"""


@query(
    "ts_feature_builder",
    "O-TS-07",
    "select f.*, "
    + ", ".join(
        f"coalesce(abs({v}_anomaly_{k}) > 3, false) as {v}_is_anomaly_{k}" for v in _VARIABLES for k in series.WINDOWS
    )
    + ", e.* exclude (event_id) from (select event_id, "
    + ", ".join(x for v in _VARIABLES for x in _every_sql(v))
    + f" from (select *, cast(row_number() over ({_W}) as double) as rn from {OBS})) f join {_ema_sql()} e on f.event_id = e.event_id",
    {
        n: 7 if "_roll" in n and "_rolling_" not in n else 6
        for v in _VARIABLES
        for n in (
            *(f"{v}_lag_{k}" for k in series.LAGS),
            *(f"{v}_ema_{k}" for k in series.EMA_SPANS),
            *(
                f"{v}_{s}_{k}"
                for s in ("rollmean", "rollstd", "rollmin", "rollmax", "trend", "anomaly", "rolling")
                for k in series.WINDOWS
            ),
        )
    },
)
def ts_feature_builder(spark, d):
    out = series.ema(obs(spark, d).select("event_id", "station", "ts", *_VARIABLES), KEYS, ORDER, _VARIABLES)
    return series.features(out, KEYS, ORDER, _VARIABLES).drop("station", "ts", *_VARIABLES)


@query(
    "ts_sequences",
    "O-TS-22",
    f"""select event_id, cast(168 as int) as n, first_value(temp_c) over ({_f(168)}) as head, temp_c as tail,
 sum(temp_c) over ({_f(168)}) + (168 - count(*) over ({_f(168)})) * first_value(temp_c) over ({_f(168)}) as total
 from {OBS}""",
    {"head": 9, "tail": 9, "total": 6},
)
def ts_sequences(spark, d):
    s = series.sequences(_src(spark, d), KEYS, ORDER, ["ts", "temp_c"])
    v = F.transform("sequence", lambda x: x["temp_c"])
    return s.select(
        "event_id",
        F.size("sequence").alias("n"),
        F.element_at(v, 1).alias("head"),
        F.element_at(v, -1).alias("tail"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


# Names under which the full jobs were registered beside smaller ones.
for _name in ("ts_rolling_trend", "ts_rolling_zscore", "ts_full_mean", "ts_feature_builder", "ts_sequences"):
    also(f"{_name}_all", _name)
