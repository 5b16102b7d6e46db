"""Queries for O-PIT, O-EV, O-DQ and O-SG-09."""

from pyspark.sql import functions as F

from weatherlake.operators import backtest, events as ev, pit as P, quality, signals
from weatherlake.plans.backtest_queries import _equity_sql, _trades_sql
from weatherlake.plans.hazard_queries import CYCLE_FEATURES, cycle_frame
from weatherlake.plans.registry import query

from weatherlake.plans.standins import CYCLES, MARKET, cycles, market

K = ["instrument"]
FOLDS = [(f"fold{y - 1996}", f"{y}-01-01", f"{y}-12-31") for y in range(1997, 2002)]
TRAIN = [(f"fold{y - 1996}", f"{y - 1}-12-31") for y in range(1997, 2002)]
YEARS = 5.0


def _str(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


def calendar(spark, d):
    return P.session_calendar(market(spark, d), K)


def pit(spark, d):
    return P.build_pit(cycle_frame(spark, d), calendar(spark, d), K)


CAL = f"""(select instrument, session, close, row_number() over w - 1 as pos, lead(close, 1) over w as next_close,
  lead(close, 2) over w as next2_close, lead(session, 2) over w as exit_session from {MARKET}
  window w as (partition by instrument order by session))"""
PIT = f"""(select c.*, s.session, s.pos, s.close, s.next_close, s.next2_close, s.exit_session, s.next_close/s.close-1 as fwd_return,
  s.next2_close/s.close-1 as fwd2_return from {CYCLE_FEATURES} c asof join {CAL} s on c.instrument = s.instrument and c.date <= s.session
  where s.next_close is not null)"""
FILLED = f"""(select c.*, s.session, s.pos, s.exit_session, s.next2_close/s.close-1 as fwd2_return from {CYCLE_FEATURES} c asof left join {CAL} s on c.instrument = s.instrument and c.date <= s.session)"""


def _ep_sql(src):
    return f"""(with f as (select *, freeze_prob > 0 as fz from {src}),
 l as (select instrument, date, pos, lag(pos) over (partition by instrument order by date) as prev from f where fz),
 n as (select instrument, date, case when pos is null or prev is null or pos - prev > 2 then 1 else 0 end as st from l),
 i as (select *, sum(st) over (partition by instrument order by date rows unbounded preceding) as eid from n)
 select f.*, fz as is_freeze, coalesce(i.st, 0) = 1 as episode_start, cast(coalesce(i.eid, 0) as bigint) as episode_id
 from f left join i on f.instrument = i.instrument and f.date = i.date)"""


@query(
    "pit_fill_session",
    "O-PIT-01",
    f"select instrument, cast(date as varchar) as date, cast(session as varchar) as session, cast(pos as int) as pos from {FILLED}",
)
def pit_fill_session(spark, d):
    x = P.fill_session(cycle_frame(spark, d), calendar(spark, d), K, ["session", "pos"])
    return _str(x.select("instrument", "date", "session", "pos"), "date", "session")


@query(
    "pit_realised_close",
    "O-PIT-02",
    f"""select c.instrument, cast(c.date as varchar) as date, cast(s.session as varchar) as close_date, s.close as realised,
 cast(date_diff('day', s.session, c.date) as int) as stale_days,
 case when s.session is null then 'missing' when date_diff('day', s.session, c.date) > 2 then 'stale' else 'ok' end as close_status
 from {CYCLE_FEATURES} c asof left join {CAL} s on c.instrument = s.instrument and c.date >= s.session""",
    {"realised": 9, "stale_days": 0},
)
def pit_realised_close(spark, d):
    x = P.realised_close(cycle_frame(spark, d), calendar(spark, d), K, 2)
    return _str(
        x.select("instrument", "date", "close_date", "realised", "stale_days", "close_status"), "date", "close_date"
    )


@query(
    "pit_builder",
    "O-PIT-03",
    f"""select instrument, cast(date as varchar) as date, cast(session as varchar) as session, temperature_min, freeze_prob,
 fwd_return, fwd2_return from {PIT}""",
    {"temperature_min": 7, "freeze_prob": 8, "fwd_return": 8, "fwd2_return": 8},
)
def pit_builder(spark, d):
    x = pit(spark, d).select("instrument", "date", "session", "temperature_min", "freeze_prob", "fwd_return", "fwd2_return")
    return _str(x, "date", "session")


def contracts(spark, d):
    """Two-monthly contracts: the last session of every odd month is the first notice day."""
    m = market(spark, d)
    return (
        m.filter(F.month("session") % 2 == 1)
        .groupBy("instrument", F.date_format("session", "yyyyMM").alias("month_name"))
        .agg(F.max("session").alias("first_notice_day"))
        .withColumn("last_trading_day", F.date_sub("first_notice_day", 2))
    )


CONTRACTS = f"""(select instrument, strftime(session, '%Y%m') as month_name, max(session) as first_notice_day,
 max(session) - 2 as last_trading_day from {MARKET} where month(session) % 2 = 1 group by 1, 2)"""


def _front_sql(trigger, op):
    return f"""(select s.*, coalesce(c.month_name, l.m) as contract_month from {CAL} s asof left join {CONTRACTS} c on s.instrument = c.instrument
 and s.session {op} c.{trigger} join (select instrument, max_by(month_name, {trigger}) as m from {CONTRACTS} group by 1) l on s.instrument = l.instrument)"""


@query(
    "pit_front_month",
    "O-PIT-04",
    f"""select a.instrument, cast(a.session as varchar) as session, a.contract_month as fnd, b.contract_month as ltd
 from {_front_sql('first_notice_day', '<')} a join {_front_sql('last_trading_day', '<=')} b on a.instrument = b.instrument and a.session = b.session""",
)
def pit_front_month(spark, d):
    c, k = calendar(spark, d).select("instrument", "session"), contracts(spark, d)
    a = P.front_month(c, k, K, "first_notice_day").withColumnRenamed("contract_month", "fnd")
    b = P.front_month(c, k, K, "last_trading_day", "LTD").withColumnRenamed("contract_month", "ltd")
    return _str(a.join(b, ["instrument", "session"]), "session")


_TH = f"""(select p.instrument, f.fold, f.train_end, quantile_cont(p.freeze_prob, 0.5) as theta_p from {PIT} p join
 (values {", ".join(f"('{n}', date '{e}')" for n, e in TRAIN)}) f(fold, train_end) on p.date <= f.train_end where p.freeze_prob > 0 group by 1, 2, 3)"""
_FOLD = "case " + " ".join(f"when {{c}} between date '{a}' and date '{b}' then '{n}'" for n, a, b in FOLDS) + " else 'seed' end"


@query(
    "pit_fold_thresholds",
    "O-PIT-05",
    f"select instrument, fold, cast(train_end as varchar) as train_end, theta_p from {_TH}",
    {"theta_p": 8},
)
def pit_fold_thresholds(spark, d):
    return _str(P.fold_thresholds(pit(spark, d), K, TRAIN), "train_end")


def fired(spark, d):
    ep = P.episodes(pit(spark, d), calendar(spark, d), K)
    return P.firing(ep, P.fold_thresholds(pit(spark, d), K, TRAIN), K, FOLDS)


_FIRED = f"""(select e.*, e.freeze_prob >= t.theta_p and e.temperature_min <= 0 as fire, e.fold from
 (select *, {_FOLD.format(c='date')} as fold from {_ep_sql(PIT)}) e left join {_TH} t on e.instrument = t.instrument and e.fold = t.fold)"""


@query(
    "pit_candidate_fire",
    "O-PIT-05",
    f"select instrument, fold, count(*) as n, count(*) filter (where fire) as fires from {_FIRED} group by 1, 2",
)
def pit_candidate_fire(spark, d):
    return fired(spark, d).groupBy("instrument", "fold").agg(
        F.count("*").alias("n"), F.count_if("candidate_fire").alias("fires")
    )


_SIG = f"""(select *, lag(s30) over w as sigma, lag(close) over w as prev from (select *, case when count(ret) over f >= 10
  then stddev_samp(ret) over f end as s30 from (select *, close/lag(close) over w - 1 as ret from {CAL} window w as (partition by instrument order by session))
  window f as (partition by instrument order by session rows between 29 preceding and current row)) window w as (partition by instrument order by session))"""
_ROLLS = f"""(with c as (select *, coalesce(lag(month_name) over (partition by instrument order by first_notice_day), '') as contract_from from {CONTRACTS}),
 j as (select s.instrument, s.session as roll_date, c.contract_from, c.month_name as contract_to, s.close/s.prev as factor,
  case when s.sigma > 1e-6 then 1 + 0.5*s.sigma else 1.5 end as lim from {_SIG} s join c on s.instrument = c.instrument and s.session = c.first_notice_day where s.prev is not null)
 select instrument, roll_date, contract_from, contract_to, factor, factor >= lim or factor <= 1/lim as flagged from j)"""
_ADJ = f"""(select s.*, coalesce(product(coalesce(r.factor, 1.0)) over (partition by s.instrument order by s.session rows between 1 following and unbounded following), 1.0) as adjustment_factor
 from {CAL} s left join (select * from {_ROLLS} where not flagged) r on s.instrument = r.instrument and s.session = r.roll_date)"""


def rolls(spark, d):
    return P.roll_table(calendar(spark, d), contracts(spark, d), K, "first_notice_day", n_sigma=0.5)


@query(
    "pit_roll_table",
    "O-PIT-06",
    f"""select instrument, cast(roll_date as varchar) as roll_date, contract_from, contract_to, factor, flagged,
 case when flagged then 'none' else 'back' end as adjustment_type from {_ROLLS}""",
    {"factor": 8},
)
def pit_roll_table(spark, d):
    return _str(rolls(spark, d).drop("flag_reason"), "roll_date")


@query(
    "pit_back_adjust",
    "O-PIT-06",
    f"""select instrument, cast(session as varchar) as session, adjustment_factor, close*adjustment_factor as close_adj from {_ADJ}""",
    {"adjustment_factor": 7, "close_adj": 3},
)
def pit_back_adjust(spark, d):
    x = P.back_adjust(calendar(spark, d), rolls(spark, d), K)
    return _str(x.select("instrument", "session", "adjustment_factor", "close_adj"), "session")


_JUMPS = f"""(select s.instrument, s.session, s.ret as return, s.sigma as daily_sigma, abs(s.ret)/nullif(s.sigma, 0) as ratio, r.roll_date as near_roll
 from {_SIG} s join {_ROLLS} r on s.instrument = r.instrument and s.session between r.roll_date - 3 and r.roll_date + 3
 where abs(s.ret) >= case when s.sigma > 1e-6 then 1.5*s.sigma else 1.5 end)"""


@query(
    "pit_roll_jumps",
    "O-PIT-07",
    f"select instrument, cast(session as varchar) as session, return, daily_sigma, ratio, cast(near_roll as varchar) as near_roll from {_JUMPS}",
    {"return": 8, "daily_sigma": 8, "ratio": 6},
)
def pit_roll_jumps(spark, d):
    return _str(P.roll_jumps(calendar(spark, d), rolls(spark, d), K, n_sigma=1.5), "session", "near_roll")


@query(
    "pit_timestamp_check",
    "O-PIT-08",
    f"""with x as (select *, (epoch((session + to_hours(14)) at time zone 'America/New_York') - epoch(publish_time))/3600.0 as m from {PIT})
 select instrument, count(*) as n_rows, count(*) filter (where m < 0) as publish_after_cutoff,
 count(*) filter (where event_peak_time < publish_time or event_peak_time > publish_time + to_hours(48)) as event_peak_outside_horizon,
 min(m) as min_publish_margin_hours from x group by 1""",
    {"min_publish_margin_hours": 6},
)
def pit_timestamp_check(spark, d):
    return P.timestamp_report(P.timestamp_violations(pit(spark, d)), K)


@query(
    "pit_signal_lookahead",
    "O-PIT-08",
    f"""select instrument, count(*) filter (where date > session) as future_cycle, count(*) filter (where publish_time >
  ((session + to_hours(14)) at time zone 'America/New_York') at time zone 'UTC') as published_after_cutoff
 from (select instrument, publish_time, session, cast(date + cast(pos % 3 as int) as date) as date from {PIT}) group by 1""",
)
def pit_signal_lookahead(spark, d):
    x = pit(spark, d)
    s = x.select(
        "instrument",
        "session",
        F.col("session").cast("timestamp").alias("ts"),
        P.cycle_id(F.date_add("date", (F.col("pos") % 3).cast("int")), F.col("cycle")).alias("forecast_cycle_id"),
        F.col("publish_time").alias("publication_ts"),
    )
    v = P.signal_lookahead(s)
    return v.groupBy("instrument").agg(
        F.count_if(F.array_contains("reasons", "future_cycle")).alias("future_cycle"),
        F.count_if(F.array_contains("reasons", "published_after_cutoff")).alias("published_after_cutoff"),
    )


@query("pit_vintage_check", "O-PIT-09")
def pit_vintage_check(spark, d):
    """Content digests of the cycle table's files against a pinned manifest with one altered entry."""
    from weatherlake.session import scratch_path

    out = scratch_path(spark, "cycles")
    c = cycles(spark, d).withColumn("y", F.year("date"))
    c.repartition("y").write.partitionBy("y").parquet(out)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(out)
    files = files.withColumn("y", F.regexp_extract("path", r"y=(\d+)", 1).cast("int"))
    now = P.vintage_manifest(files, ["y"])
    pinned = now.filter("y <> 1996").withColumn("sha256", F.when(F.col("y") == 1997, F.lit("x")).otherwise(F.col("sha256")))
    return P.vintage_violations(c.select("y"), pinned, now, ["y"])


_EP = _ep_sql(PIT)


@query(
    "pit_unmodelled_rolls",
    "O-PIT-10",
    f"""with p as (select r.instrument, r.roll_date, s.pos from {_ROLLS} r join {CAL} s on r.instrument = s.instrument and r.roll_date = s.session where r.flagged),
 e as (select distinct instrument, pos from {_EP} where episode_start)
 select p.instrument, cast(p.roll_date as varchar) as roll_date, count(e.pos) > 0 as near_episode from p left join e
 on p.instrument = e.instrument and abs(p.pos - e.pos) <= 3 group by 1, 2""",
)
def pit_unmodelled_rolls(spark, d):
    c = calendar(spark, d)
    starts = P.episodes(pit(spark, d), c, K).filter("episode_start")
    x = P.unmodelled_rolls(rolls(spark, d), starts, c, K)
    return _str(x.select("instrument", "roll_date", "near_episode"), "roll_date")


@query(
    "pit_episodes",
    "O-PIT-11",
    f"select instrument, cast(date as varchar) as date, is_freeze, episode_start, episode_id from {_ep_sql(FILLED)}",
)
def pit_episodes(spark, d):
    c = calendar(spark, d)
    x = P.episodes(P.fill_session(cycle_frame(spark, d), c, K, ["session", "pos"]), c, K)
    return _str(x.select("instrument", "date", "is_freeze", "episode_start", "episode_id"), "date")


@query(
    "pit_episode_summary",
    "O-PIT-12",
    f"""select instrument, episode_id, cast(min(date) as varchar) as start_date, count(*) as n_rows, count(*) filter (where is_freeze) as n_freezing,
 max(freeze_prob) as entry_freeze_prob from {_EP} where episode_id > 0 group by 1, 2""",
    {"entry_freeze_prob": 8},
)
def pit_episode_summary(spark, d):
    return _str(P.episode_summary(P.episodes(pit(spark, d), calendar(spark, d), K), K), "start_date")


_ENTRIES = f"(select * from {_FIRED} where episode_id > 0 and fire qualify row_number() over (partition by instrument, episode_id order by date) = 1)"


@query(
    "pit_candidate_entries",
    "O-PIT-13",
    f"""select instrument, episode_id, cast(date as varchar) as date, cast(session as varchar) as session, fold, freeze_prob, fwd2_return from {_ENTRIES}""",
    {"freeze_prob": 8, "fwd2_return": 8},
)
def pit_candidate_entries(spark, d):
    x = P.candidate_entries(fired(spark, d), K)
    return _str(
        x.select("instrument", "episode_id", "date", "session", "fold", "freeze_prob", "fwd2_return"), "date", "session"
    )


_SCHED = f"""(select c.*, case when exists (select 1 from {_EP} e where e.episode_start and e.instrument = c.instrument and c.pos - e.pos between 0 and 1)
 then 1.0 else 0.0 end as position from {CAL} c)"""


def schedule(spark, d):
    c = calendar(spark, d)
    starts = P.episodes(pit(spark, d), c, K).filter("episode_start")
    return P.hold_schedule(starts, c, K)


@query(
    "pit_hold_schedule",
    "O-PIT-14",
    f"select instrument, cast(session as varchar) as session, position from {_SCHED}",
    {"position": 1},
)
def pit_hold_schedule(spark, d):
    return _str(schedule(spark, d).select("instrument", "session", "position"), "session")


@query(
    "pit_provenance",
    "O-PIT-15",
    f"""with r as (select f.instrument, f.session, f.contract_month, a.adjustment_factor from {_front_sql('first_notice_day', '<')} f join {_ADJ} a on f.instrument = a.instrument and f.session = a.session),
 s as (select e.instrument, e.date, e.pos, e.cycle, r.contract_month, r.adjustment_factor from {_EP} e left join r on e.instrument = r.instrument and e.session = r.session where e.episode_start),
 x as (select instrument, pos + k as pos, date, strftime(date, '%Y%m%d') || '_12z' as forecast_cycle_id, contract_month, adjustment_factor from s, (select unnest(range(2)) as k))
 select instrument, cast(pos as int) as pos, max_by(forecast_cycle_id, date) as forecast_cycle_id, max_by(contract_month, date) as contract_month, max_by(adjustment_factor, date) as adjustment_factor
 from x group by 1, 2""",
    {"adjustment_factor": 7},
)
def pit_provenance(spark, d):
    c = calendar(spark, d)
    front = P.front_month(c.select("instrument", "session"), contracts(spark, d), K, "first_notice_day")
    adj = P.back_adjust(c, rolls(spark, d), K).select("instrument", "session", "adjustment_factor")
    starts = P.episodes(pit(spark, d), c, K).filter("episode_start")
    p = P.provenance(starts, front.join(adj, ["instrument", "session"]), K, "forecast-v1", "cycle-archive")
    return p.select(
        "instrument",
        "pos",
        "provenance.forecast_cycle_id",
        "provenance.roll_state.contract_month",
        "provenance.roll_state.adjustment_factor",
    )


def benchmark(spark, d):
    return ev.oos_benchmark(pit(spark, d), K, FOLDS[0][1], FOLDS[-1][2])


_BENCH = f"(select instrument, avg(fwd2_return) as benchmark from {PIT} where date between date '{FOLDS[0][1]}' and date '{FOLDS[-1][2]}' group by 1)"


def ledger(spark, d):
    c = calendar(spark, d)
    starts = P.episodes(pit(spark, d), c, K).filter("episode_start")
    return P.event_ledger(starts, c, benchmark(spark, d), K, FOLDS)


_EMB = f"""(select instrument, session from (select *, {_FOLD.format(c='session')} as f from {CAL}) where f <> 'seed'
 qualify row_number() over (partition by instrument, f order by session) <= 5)"""
_LEDGER = f"""(select e.instrument, e.episode_id, e.date as entry_cycle, e.session as entry_session, e.exit_session, e.fwd2_return as gross, e.fwd2_return - 0.003 as net,
 e.fwd2_return - 0.003 - b.benchmark as net_of_benchmark, {_FOLD.format(c='e.date')} as fold, e.date between date '{FOLDS[0][1]}' and date '{FOLDS[-1][2]}' as in_oos,
 m.session is not null as embargoed, isodow(e.date) >= 6 as entry_weekend, e.session > e.date as next_close_fill, cast(date_diff('day', e.date, e.session) as int) as fill_days_after_cycle,
 e.date between date '{FOLDS[0][1]}' and date '{FOLDS[-1][2]}' and m.session is null as scored
 from {_EP} e left join {_BENCH} b on e.instrument = b.instrument left join {_EMB} m on e.instrument = m.instrument and e.session = m.session where e.episode_start)"""


@query(
    "pit_event_ledger",
    "O-PIT-16",
    f"""select * replace (cast(entry_cycle as varchar) as entry_cycle, cast(entry_session as varchar) as entry_session, cast(exit_session as varchar) as exit_session) from {_LEDGER}""",
    {"gross": 8, "net": 8, "net_of_benchmark": 8},
)
def pit_event_ledger(spark, d):
    x = ledger(spark, d).drop("entry_freeze_prob", "entry_temperature_min")
    return _str(x, "entry_cycle", "entry_session", "exit_session")


@query(
    "pit_cross_validate",
    "O-PIT-17",
    f"""with t as (select instrument, session, close, exit_price, pnl/equity as r from {_trades_sql(_equity_sql(_SCHED))}),
 j as (select e.instrument, e.exit_session, e.gross, t.r, t.close as ep, t.exit_price as xp, a.close as ca, b.close as cb from (select * from {_LEDGER} where in_oos) e
 left join t on e.instrument = t.instrument and e.entry_session = t.session left join {CAL} a on e.instrument = a.instrument and e.entry_session = a.session
 left join {CAL} b on e.instrument = b.instrument and e.exit_session = b.session)
 select instrument, count(*) filter (where exit_session is not null and r is not null) as matched_trades, count(*) as n_oos_events,
 count(*) filter (where exit_session is not null and r is null) as unmatched_events, coalesce(max(abs(r-gross)) filter (where exit_session is not null), 0) as max_return_abs_error,
 count(*) filter (where exit_session is not null and r is not null and (ep <> ca or xp <> cb)) as price_mismatches from j group by 1""",
    {"max_return_abs_error": 6},
)
def pit_cross_validate(spark, d):
    c = calendar(spark, d)
    e = backtest.equity_curve(schedule(spark, d), K, "session")
    return P.cross_validate(ledger(spark, d), backtest.trades(e, K, "session"), c, K)


_SCORED = f"(select * from {_LEDGER} where scored and net_of_benchmark is not null)"


def scored(spark, d):
    return ledger(spark, d).filter(F.col("scored") & F.col("net_of_benchmark").isNotNull())


def _sh(x):
    return f"avg({x})/stddev_samp({x})*sqrt(count(*)/{YEARS})"


@query(
    "ev_metrics",
    "O-EV-01",
    f"""select instrument, count(*) as n_events, avg(gross) as mean_gross, avg(net) as mean_net, avg(net_of_benchmark) as mean_net_of_benchmark,
 {_sh('gross')} as gross_sharpe, {_sh('net')} as net_sharpe, {_sh('net_of_benchmark')} as net_of_benchmark_sharpe,
 avg(net_of_benchmark)/(stddev_samp(net_of_benchmark)/sqrt(count(*))) as t_stat, avg(case when net > 0 then 1.0 else 0.0 end) as win_rate from {_SCORED} group by 1""",
    {
        c: 7
        for c in "mean_gross mean_net mean_net_of_benchmark gross_sharpe net_sharpe net_of_benchmark_sharpe t_stat win_rate".split()
    },
)
def ev_metrics(spark, d):
    return ev.event_metrics(scored(spark, d), K, YEARS)


def _numbered(spark, d):
    return ev.numbered(scored(spark, d), K, "entry_cycle", "net_of_benchmark")


@query("ev_bootstrap", "O-EV-02")
def ev_bootstrap(spark, d):
    boot = ev.bootstrap_sharpes(_numbered(spark, d), K, YEARS)
    return ev.bootstrap_summary(boot, K)


@query(
    "ev_newey_west",
    "O-EV-03",
    f"""with e as (select instrument, row_number() over (partition by instrument order by entry_cycle) as i, net_of_benchmark as x,
  count(*) over (partition by instrument) as n, net_of_benchmark - avg(net_of_benchmark) over (partition by instrument) as dm from {_SCORED}),
 l as (select *, greatest(1, least(floor(4*pow(n/100.0, 2.0/9.0)), greatest(1, floor(n/2.0)))) as lag from e),
 c as (select a.instrument, sum((1-(a.i-b.i)/(a.lag+1))*a.dm*b.dm)*2 as c from l a join l b on a.instrument = b.instrument and a.i > b.i and a.i - b.i <= a.lag group by 1),
 o as (select instrument, max(n) as n, max(lag) as lag, avg(x) as m, sum(dm*dm) as g from l group by 1)
 select o.instrument, n, cast(lag as int) as lag, sqrt((g+c)/n/n) as se, m/sqrt((g+c)/n/n) as t_stat from o join c on o.instrument = c.instrument""",
    {"se": 8, "t_stat": 6},
)
def ev_newey_west(spark, d):
    return ev.newey_west(_numbered(spark, d), K)


@query(
    "ev_decision",
    "O-EV-04",
    f"""with o as (select *, lag(entry_session) over (partition by instrument order by entry_session, entry_cycle) as p from {_SCORED}),
 v as (select instrument, count(*) filter (where entry_session < p + 3) as n_overlapping, coalesce(bool_or(entry_session < p + 3), false) as purging_needed from o group by 1),
 m as (select instrument, count(*) as n, {_sh('net_of_benchmark')} as s from {_SCORED} group by 1)
 select m.instrument, n as n_events, n_overlapping, purging_needed, case when n = 0 then 'no trades' when n >= 30 then 'full-power' when n >= 8 then 'shrunk edge claim' else 'under-powered' end as power,
 case when n < 8 then 'UNDER_POWERED' when s > 1 and s - 1.96 > 0 then 'PASS' else 'FAIL_PIVOT' end as decision from m join v on m.instrument = v.instrument""",
)
def ev_decision(spark, d):
    s = scored(spark, d)
    m = ev.event_metrics(s, K, YEARS).join(ev.overlaps(s, K), "instrument")
    sharpe = F.col("net_of_benchmark_sharpe")
    return m.select(
        "instrument",
        "n_events",
        "n_overlapping",
        "purging_needed",
        ev.power_class(F.col("n_events")).alias("power"),
        ev.decision(F.col("n_events"), sharpe, sharpe - 1.96).alias("decision"),
    )


@query(
    "ev_benchmark",
    "O-EV-05",
    f"""with l as (select instrument, count(*) as n, avg(next2_close/close-1) as live from {CAL} where session >= date '2001-06-01' group by 1)
 select b.instrument, case when n >= 3 and live is not null then live else benchmark end as benchmark,
 case when n >= 3 and live is not null then 'live_window' else 'locked_fallback' end as source from {_BENCH} b left join l on b.instrument = l.instrument""",
    {"benchmark": 8},
)
def ev_benchmark(spark, d):
    return ev.live_benchmark(calendar(spark, d), benchmark(spark, d), K, "2001-06-01")


_EFF = "(freeze_prob*exp(-0.693*coalesce(greatest(epoch(publish_time) - epoch(event_peak_time),0),0)/3600.0/48.0))"
_BUCKET = """case when freeze_prob <= 0 then 'none' when freeze_prob <= 0.05 then 'trace(0-5%)' when freeze_prob <= 0.2 then 'low(5-20%)'
 when freeze_prob <= 0.5 then 'mid(20-50%)' else 'high(50%+)' end"""


@query(
    "sg_season_evidence",
    "O-SG-09",
    f"""select instrument, case when month(date) >= 11 then year(date) || '/' || (year(date)+1) when month(date) <= 3 then (year(date)-1) || '/' || year(date)
  else year(date) || '/' || (year(date)+1) || ' (off-season)' end as season, count(*) as days, avg(freeze_prob) as mean_prob, max(freeze_prob) as max_prob,
 count(*) filter (where freeze_prob > 0) as days_with_freeze from {PIT} group by 1, 2""",
    {"mean_prob": 8, "max_prob": 8},
)
def sg_season_evidence(spark, d):
    return pit(spark, d).groupBy("instrument", signals.season_label(F.col("date")).alias("season")).agg(
        F.count("*").alias("days"),
        F.avg("freeze_prob").alias("mean_prob"),
        F.max("freeze_prob").alias("max_prob"),
        F.count_if(F.col("freeze_prob") > 0).alias("days_with_freeze"),
    )


@query(
    "sg_bucket_evidence",
    "O-SG-09",
    f"select instrument, {_BUCKET} as bucket, count(*) as n, avg(fwd_return) as mean, stddev_samp(fwd_return) as std from {PIT} group by 1, 2",
    {"mean": 8, "std": 8},
)
def sg_bucket_evidence(spark, d):
    return pit(spark, d).groupBy("instrument", signals.freeze_bucket(F.col("freeze_prob")).alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("fwd_return").alias("mean"), F.stddev_samp("fwd_return").alias("std")
    )


@query(
    "sg_rank_evidence",
    "O-SG-09",
    f"""with r as (select instrument, fwd_return as y, rank() over (partition by instrument order by freeze_prob) + (count(*) over (partition by instrument, freeze_prob)-1)/2.0 as rx,
  rank() over (partition by instrument order by fwd_return) + (count(*) over (partition by instrument, fwd_return)-1)/2.0 as ry,
  {_EFF} > 0.2 and temperature_min < 0 as long from {PIT})
 select instrument, corr(rx, ry) as spearman, count(*) as n, count(*) filter (where long) as n_true, count(*) filter (where not long) as n_false,
 (avg(y) filter (where long) - avg(y) filter (where not long))/sqrt(var_samp(y) filter (where long)/count(*) filter (where long)
  + var_samp(y) filter (where not long)/count(*) filter (where not long)) as welch_t from r group by 1""",
    {"spearman": 8, "welch_t": 6},
)
def sg_rank_evidence(spark, d):
    p = signals.freeze_signal(pit(spark, d), F.col("publish_time"), entry=0.2)
    a = signals.spearman(p, K, "freeze_prob", "fwd_return")
    return a.join(signals.welch_t(p, K, "fwd_return", F.col("action") == "LONG"), "instrument")


LEADS = (0, 12, 24, 36)


@query(
    "dq_missing_units",
    "O-DQ-01",
    f"""with w as (select i.instrument, cast(d.d as date) as date, l.lead from (select distinct instrument from {CYCLES}) i,
  (select unnest(generate_series(date '1999-01-01', date '1999-03-31', interval 1 day)) as d) d, (select unnest([0, 12, 24, 36]) as lead) l)
 select w.instrument, cast(w.date as varchar) as date, '12' as cycle, w.lead from w left join (select distinct instrument, date, lead from {CYCLES}) h
 on w.instrument = h.instrument and w.date = h.date and w.lead = h.lead where h.date is null""",
)
def dq_missing_units(spark, d):
    return _str(quality.missing_units(cycles(spark, d), K, "1999-01-01", "1999-03-31", ["12"], LEADS), "date")


@query(
    "dq_gates",
    "O-DQ-01",
    f"""with w as (select i.instrument, cast(d.d as date) as date, l.lead from (select distinct instrument from {CYCLES}) i,
  (select unnest(generate_series(date '1999-01-01', date '1999-12-31', interval 1 day)) as d) d, (select unnest([0, 12, 24, 36]) as lead) l),
 inv as (select instrument, date, lead, count(distinct latitude) as lats, count(*) filter (where not (t2m between 200 and 330)) as bad from {CYCLES} group by 1, 2, 3),
 g as (select 'completeness' as gate, count(*) as f from w left join inv h on w.instrument = h.instrument and w.date = h.date and w.lead = h.lead where h.date is null
  union all select 'schema', count(*) filter (where bad > 0 or lats < 1) from inv
  union all select 'pit', count(*) filter (where abs(fwd_return) > 0.5 or abs(fwd2_return) > 0.5 or fwd2_return is null) from {PIT}
  union all select 'staleness', case when max(date) = date '1999-12-31' then 0 else 1 end from {CYCLES})
 select gate, f = 0 as ok, cast(f as bigint) as failures from g""",
)
def dq_gates(spark, d):
    return quality.dataset_gates(cycles(spark, d), pit(spark, d), K, "1999-01-01", "1999-12-31", ["12"], LEADS, 1)


# The two queries above check fixed dates and keep their SQL; these check every day the table spans. The last day
# is then the table's own, so the staleness gate of ``dq_gates_all`` can't fail; ``dq_gates`` and ``dq_staleness`` judge that.
_WANTED = f"""w as (select i.instrument, cast(d.d as date) as date, l.lead from (select distinct instrument from {CYCLES}) i,
  (select unnest(generate_series(lo, hi, interval 1 day)) as d from (select cast(min(date) as timestamp) as lo, cast(max(date) as timestamp) as hi from {CYCLES})) d,
  (select unnest([0, 12, 24, 36]) as lead) l)"""


def _span(cells):
    first, last = cells.agg(F.min("date"), F.max("date")).first()
    return str(first), str(last)


@query(
    "dq_missing_units_all",
    "O-DQ-01",
    f"""with {_WANTED} select w.instrument, cast(w.date as varchar) as date, '12' as cycle, w.lead from w left join (select distinct instrument, date, lead from {CYCLES}) h
 on w.instrument = h.instrument and w.date = h.date and w.lead = h.lead where h.date is null""",
)
def dq_missing_units_all(spark, d):
    x = cycles(spark, d)
    return _str(quality.missing_units(x, K, *_span(x), ["12"], LEADS), "date")


@query(
    "dq_gates_all",
    "O-DQ-01",
    f"""with {_WANTED},
 inv as (select instrument, date, lead, count(distinct latitude) as lats, count(*) filter (where not (t2m between 200 and 330)) as bad from {CYCLES} group by 1, 2, 3),
 g as (select 'completeness' as gate, count(*) as f from w left join inv h on w.instrument = h.instrument and w.date = h.date and w.lead = h.lead where h.date is null
  union all select 'schema', count(*) filter (where bad > 0 or lats < 1) from inv
  union all select 'pit', count(*) filter (where abs(fwd_return) > 0.5 or abs(fwd2_return) > 0.5 or fwd2_return is null) from {PIT}
  union all select 'staleness', 0)
 select gate, f = 0 as ok, cast(f as bigint) as failures from g""",
)
def dq_gates_all(spark, d):
    x = cycles(spark, d)
    return quality.dataset_gates(x, pit(spark, d), K, *_span(x), ["12"], LEADS, 1)


_VERDICT = f"""(with i as (select instrument, date, cycle, lead, count(*) as n, count(t2m) as p from {CYCLES} group by 1, 2, 3, 4)
 select instrument, date, cycle, sum(n) as grid_cells, case when not list_has_all(list(lead), [0, 12]) then 'missing_leads' when count(*) filter (where n <> 1) > 0 then 'wrong_cell_count'
 when sum(p) = 0 then 'no_temperature' end as reason from i group by 1, 2, 3)"""


@query(
    "dq_validate_cycles",
    "O-DQ-02",
    f"select instrument, cast(date as varchar) as date, cycle, cast(grid_cells as bigint) as grid_cells, reason from {_VERDICT}",
)
def dq_validate_cycles(spark, d):
    return _str(quality.validate_cycles(cycles(spark, d), K, (0, 12), 1).drop("leads"), "date")


@query(
    "dq_staleness",
    "O-DQ-03",
    f"""with x as (select instrument, date, date + to_hours(cast(pos % 80 as int)) as now from {PIT}),
 y as (select *, cast(now - to_minutes(930) as date) as latest from x)
 select instrument, case when date > latest then 'not_published' when date_diff('day', date, latest) > 1 then 'stale' else 'ok' end as verdict, count(*) as n from y group by 1, 2""",
)
def dq_staleness(spark, d):
    x = pit(spark, d)
    now = F.col("date").cast("timestamp") + F.make_dt_interval(hours=(F.col("pos") % 80).cast("int"))
    v = F.coalesce(quality.staleness(F.col("date"), now), F.lit("ok"))
    return x.groupBy("instrument", v.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "dq_replay",
    "O-DQ-04",
    f"""with x as (select c.*, v.reason as bad, r.session as rc, f.session, f.close, f.next2_close, f.exit_session, b.benchmark from {CYCLE_FEATURES} c
  left join {_VERDICT} v on c.instrument = v.instrument and c.date = v.date asof left join {CAL} r on c.instrument = r.instrument and c.date >= r.session
  asof left join {CAL} f on c.instrument = f.instrument and c.date <= f.session left join {_BENCH} b on c.instrument = b.instrument),
 y as (select *, freeze_prob >= 0.4 and temperature_min <= 0 as fires from x),
 z as (select *, coalesce(bad, case when rc is null then 'close_missing' when date_diff('day', rc, date) > 7 then 'close_stale' when fires and session is null then 'no_fill_session'
  when fires and exit_session is null then 'no_exit_session' end) as reason from y),
 w as (select *, fires and reason is null as booked from z)
 select instrument, cast(date as varchar) as date, strftime(date, '%Y%m%d') || '_12z' as forecast_cycle_id, case when reason is null then 'ok' else 'rejected' end as status, reason, booked,
 case when booked then cast(count(*) filter (where booked) over (partition by instrument order by date rows unbounded preceding) as bigint) end as episode_id,
 case when booked then next2_close/close-1 end as gross, case when booked then next2_close/close-1-0.003-benchmark end as net_of_benchmark from w""",
    {"gross": 8, "net_of_benchmark": 8, "episode_id": 0},
)
def dq_replay(spark, d):
    f = cycle_frame(spark, d)
    v = quality.validate_cycles(cycles(spark, d), K, (0, 12), 1)
    theta = f.select("instrument").distinct().withColumn("theta_p", F.lit(0.4))
    return _str(quality.replay(f, v, calendar(spark, d), theta, benchmark(spark, d), K), "date")


