"""Queries for O-BT, O-RK and O-PF."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weatherlake.operators import backtest, ranks
from weatherlake.plans.registry import query
from weatherlake.plans.standins import MARKET, events, market

KEYS = ["instrument"]


def momentum(df):
    """Half long or short when the close is 5 % off the close five sessions ago; looks back only."""
    w = Window.partitionBy("instrument").orderBy("session")
    m = F.col("close") / F.lag("close", 5).over(w) - 1
    return df.withColumn("position", F.when(m > 0.05, 0.5).when(m < -0.05, -0.5).otherwise(0.0))


_W = "(partition by {k} order by session)"


def _equity_sql(src, keys="instrument"):
    w = f"(partition by {keys} order by session)"
    return f"""(with a as (select *, row_number() over {w} - 1 as bar, count(*) over (partition by {keys}) as bars from {src}),
 b as (select * replace (case when bar = 0 then 0.0 else coalesce(position, 0.0) end as position) from a where bars >= 2),
 c as (select *, coalesce(lag(position) over {w}, 0.0) as held, coalesce(close/lag(close) over {w} - 1, 0.0) as ret from b),
 d as (select *, abs(position - held) as turnover, 1 + held*ret as gain from c),
 e as (select *, 1e6 * product(gain*(1 - turnover*0.0007)) over (partition by {keys} order by session rows unbounded preceding) as equity from d)
 select *, coalesce(lag(equity) over {w} * gain, equity) as pre, turnover*0.0007 as cost from e)"""


_MOM = f"""(select *, case when m > 0.05 then 0.5 when m < -0.05 then -0.5 else 0.0 end as position from
 (select *, close/lag(close, 5) over (partition by instrument order by session) - 1 as m from {MARKET}))"""


def _trades_sql(eq, keys="instrument"):
    return f"""(with m as (select *, lead(bar) over w as xb, lead(session) over w as xs, lead(close) over w as xc, lead(pre) over w as xp,
  lead(cost) over w as xk from {eq} where turnover > 0 window w as (partition by {keys} order by session)),
 l as (select {keys}, max(bar) as lb, max_by(session, bar) as ls, max_by(close, bar) as lc, max_by(equity, bar) as le from {eq} group by all)
 select m.*, coalesce(xb, lb) as exit_idx, coalesce(xs, ls) as exit_time, coalesce(xc, lc) as exit_price,
  case when xb is null then le else xp end - equity as pnl, cost + coalesce(xk, 0) as costs
 from m join l using ({keys}) where position <> 0)"""


def _equity(spark, d):
    return backtest.run(market(spark, d), momentum, KEYS, "session")


@query(
    "bt_equity",
    "O-BT-01",
    f"""select instrument, cast(session as varchar) as session, position, turnover, equity from {_equity_sql(_MOM)}""",
    {"position": 4, "turnover": 4, "equity": 3},
)
def bt_equity(spark, d):
    return _equity(spark, d).select(
        "instrument", F.date_format("session", "yyyy-MM-dd").alias("session"), "position", "turnover", "equity"
    )


@query(
    "bt_trades",
    "O-BT-02",
    f"""select instrument, cast(bar as int) as entry_idx, cast(exit_idx as int) as exit_idx, cast(session as varchar) as entry_time,
 cast(exit_time as varchar) as exit_time, close as entry_price, exit_price, pnl, pnl/equity as return, costs as costs_incurred
 from {_trades_sql(_equity_sql(_MOM))}""",
    {"entry_price": 9, "exit_price": 9, "pnl": 3, "return": 7, "costs_incurred": 7},
)
def bt_trades(spark, d):
    t = backtest.trades(_equity(spark, d), KEYS, "session")
    return t.drop("position", "costs_bps").withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("entry_time", "exit_time")}
    )


def _summary_sql(eq, keys="instrument"):
    return f"""(with r as (select *, equity/lag(equity) over (partition by {keys} order by session) - 1 as r,
  max(equity) over (partition by {keys} order by session rows unbounded preceding) as peak from {eq}),
 c as (select {keys}, coalesce((avg(r)-0.02/252)/nullif(stddev_samp(r), 0)*sqrt(252), 0) as sharpe, max((peak-equity)/peak) as max_drawdown,
  max_by(equity, bar)/1e6 - 1 as total_return from r group by all),
 t as (select {keys}, avg(case when pnl > 0 then 1.0 else 0.0 end) as win_rate,
  sum(case when pnl > 0 then pnl else 0 end) as won, -sum(case when pnl < 0 then pnl else 0 end) as lost, count(*) as n_trades
  from {_trades_sql(eq, keys)} group by all)
 select c.*, coalesce(win_rate, 0.0) as win_rate, case when n_trades is null then 0.0 when lost >= 1e-15 then won/lost when won <= 0 then 0.0 end as profit_factor,
  coalesce(n_trades, 0) as n_trades from c left join t using ({keys}))"""


_SUMMARY_ROUND = {"sharpe": 6, "max_drawdown": 7, "total_return": 7, "win_rate": 7, "profit_factor": 6}


@query("bt_summary", "O-BT-04", f"select * from {_summary_sql(_equity_sql(_MOM))}", _SUMMARY_ROUND)
def bt_summary(spark, d):
    return backtest.summary(_equity(spark, d), KEYS, "session")


def _folds_sql(src):
    return f"""(select *, cast(floor((i-252)/63.0) as int) as fold from (select *, row_number() over (partition by instrument order by session) - 1 as i,
  count(*) over (partition by instrument) as n from {src}) where i >= 252 and floor((i-252)/63.0) < floor((n-252)/63.0))"""


@query(
    "bt_walk_forward",
    "O-BT-03",
    f"select * from {_summary_sql(_equity_sql(_folds_sql(_MOM), 'instrument, fold'), 'instrument, fold')}",
    _SUMMARY_ROUND,
)
def bt_walk_forward(spark, d):
    x = backtest.walk_forward_folds(momentum(market(spark, d)), KEYS, "session")
    e = backtest.equity_curve(x, ["instrument", "fold"], "session")
    return backtest.summary(e, ["instrument", "fold"], "session")


_RETRAIN = f"""(with b as (select *, close/lag(close, 5) over (partition by instrument order by session) - 1 as m,
  row_number() over (partition by instrument order by session) - 1 as i, count(*) over (partition by instrument) as n from {MARKET}),
 k as (select instrument, unnest(range(cast(floor((max(n)-252)/63.0) as bigint))) as fold from b group by 1),
 t as (select b.instrument, k.fold, quantile_cont(abs(m), 0.5) as theta from b join k on b.instrument = k.instrument
  and b.i >= k.fold*63 and b.i < k.fold*63+252 group by 1, 2)
 select f.instrument, f.session, f.close, f.fold, case when f.m > t.theta then 0.03 when f.m < -t.theta then -0.03 else 0.0 end as position
 from (select *, cast(floor((i-252)/63.0) as int) as fold from b where i >= 252) f join t on f.instrument = t.instrument and f.fold = t.fold)"""


@query(
    "bt_walk_forward_retrained",
    "O-BT-03",
    f"select * from {_summary_sql(_equity_sql(_RETRAIN, 'instrument, fold'), 'instrument, fold')}",
    _SUMMARY_ROUND,
)
def bt_walk_forward_retrained(spark, d):
    w = Window.partitionBy("instrument").orderBy("session")
    x = market(spark, d).withColumn("m", F.col("close") / F.lag("close", 5).over(w) - 1)
    tr = backtest.walk_forward_training(x, KEYS, "session").withColumn("a", F.abs("m"))
    theta = ranks.exact_quantiles(tr, ["instrument", "fold"], "a", {"theta": 0.5})
    f = backtest.walk_forward_folds(x, KEYS, "session").join(theta, ["instrument", "fold"])
    pos = F.when(F.col("m") > F.col("theta"), 0.03).when(F.col("m") < -F.col("theta"), -0.03).otherwise(0.0)
    e = backtest.equity_curve(f.withColumn("position", pos), ["instrument", "fold"], "session")
    return backtest.summary(e, ["instrument", "fold"], "session")


_SIG = f"""(select *, case when size = 0 then 0.0 when action = 'LONG' then size else -size end as position from
 (select *, case when day(session) % 3 = 0 then 'LONG' when day(session) % 3 = 1 then 'SHORT' else 'FLAT' end as action,
  case when day(session) % 3 = 2 then 0.0 else day(session)/620.0 end as size from {MARKET}
  where session between date '1996-01-01' and date '1999-12-31'))"""


@query(
    "bt_stored_signals",
    "O-BT-05",
    f"""select instrument, round(sharpe, 4) as sharpe, round(max_drawdown, 4) as max_drawdown, round(total_return, 4) as total_return,
 round(win_rate, 4) as win_rate, round(profit_factor, 4) as profit_factor, n_trades from {_summary_sql(_equity_sql(_SIG))}""",
    {c: 4 for c in ("sharpe", "max_drawdown", "total_return", "win_rate", "profit_factor")},
)
def bt_stored_signals(spark, d):
    p = market(spark, d)
    k = F.dayofmonth("session") % 3
    s = p.select(
        "instrument",
        "session",
        F.when(k == 0, "LONG").when(k == 1, "SHORT").otherwise("FLAT").alias("action"),
        F.when(k == 2, 0.0).otherwise(F.dayofmonth("session") / 620.0).alias("size"),
    )
    return backtest.signal_backtest(s, p, KEYS, "session", "1996-01-01", "1999-12-31")


def returns(spark, d):
    w = Window.partitionBy("instrument").orderBy("session")
    r = market(spark, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1).filter(F.col("r").isNotNull())
    return r.withColumn("bench", F.avg("r").over(Window.partitionBy("session")))


RETURNS = f"""(select *, avg(r) over (partition by session) as bench from (select *, close/lag(close) over
 (partition by instrument order by session) - 1 as r from {MARKET}) where r is not null)"""


@query(
    "rk_var_cvar",
    "O-RK-01",
    f"""with q as (select instrument, quantile_cont(r, 0.05) as c from {RETURNS} group by 1)
 select x.instrument, -max(c) as var, -avg(r) filter (where r <= c) as cvar from {RETURNS} x join q on x.instrument = q.instrument group by 1""",
    {"var": 7, "cvar": 7},
)
def rk_var_cvar(spark, d):
    return backtest.value_at_risk(returns(spark, d), KEYS, "r")


@query(
    "rk_ratios",
    "O-RK-02",
    f"""with e as (select *, product(1+r) over (partition by instrument order by session rows unbounded preceding) as e from {RETURNS}),
 f as (select *, 1 - e/max(e) over (partition by instrument order by session rows unbounded preceding) as dd from e)
 select instrument, (avg(r)-0.02/252)/stddev_samp(r)*sqrt(252) as sharpe,
  avg(r-0.02/252)/sqrt(sum(case when r-0.02/252 < 0 then (r-0.02/252)*(r-0.02/252) end)/count(*))*sqrt(252) as sortino,
  avg(r-bench)/stddev_samp(r-bench)*sqrt(252) as information, (pow(max_by(e, session), 252.0/count(*))-1)/max(dd) as calmar,
  max(dd) as max_drawdown from f group by 1""",
    {"sharpe": 6, "sortino": 6, "information": 6, "calmar": 6, "max_drawdown": 7},
)
def rk_ratios(spark, d):
    return backtest.return_ratios(returns(spark, d), KEYS, "session", "r", "bench")


@query(
    "rk_drawdown",
    "O-RK-03",
    f"""select instrument, max((p-close)/p) as max_drawdown from (select *, max(close) over (partition by instrument order by session
 rows unbounded preceding) as p from {MARKET}) group by 1""",
    {"max_drawdown": 7},
)
def rk_drawdown(spark, d):
    return backtest.drawdown(market(spark, d), KEYS, "session", "close")


@query(
    "pf_risk_parity",
    "O-PF-01",
    f"""select *, (1/vol)/sum(1/vol) over (partition by yr) as weight from (select year(session) as yr, instrument,
 greatest(stddev_samp(r), 1e-10) as vol from {RETURNS} group by 1, 2)""",
    {"vol": 7, "weight": 7},
)
def pf_risk_parity(spark, d):
    r = returns(spark, d).withColumn("yr", F.year("session").cast("long"))
    return backtest.risk_parity(r, ["yr"], "instrument", "r")


@query(
    "pf_trade_log",
    "O-PF-02",
    """with e as (select user_id as account, ts, event_id, value-50 as pnl, 10000 + sum(value-50) over w as equity from events
  window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
 f as (select *, pnl/nullif(equity-pnl, 0) as r, greatest(max(equity) over (partition by account order by ts, event_id rows unbounded preceding), 10000) as p from e)
 select account, sum(pnl)/10000 as total_return, (avg(r)-0.02/252)/stddev_samp(r)*sqrt(252) as sharpe,
  coalesce(avg(r-0.02/252)/sqrt(sum(case when r-0.02/252 < 0 then (r-0.02/252)*(r-0.02/252) end)/count(*))*sqrt(252), 0) as sortino,
  max((p-equity)/p) as max_drawdown, avg(case when pnl > 0 then 1.0 else 0.0 end) as win_rate,
  sum(case when pnl > 0 then pnl else 0 end)/nullif(-sum(case when pnl < 0 then pnl else 0 end),0) as profit_factor, count(*) as n_trades
 from f group by 1""",
    {"total_return": 7, "sharpe": 5, "sortino": 5, "max_drawdown": 7, "win_rate": 7, "profit_factor": 6},
)
def pf_trade_log(spark, d):
    log = events(spark, d).select(
        F.col("user_id").alias("account"), "ts", "event_id", (F.col("value") - 50).alias("pnl")
    )
    return backtest.trade_log_pnl(log, ["account"], ["ts", "event_id"], "pnl", 10000.0)


def paper_orders(spark, d):
    k = F.col("event_type")
    act = (
        F.when(k == "view", "LONG")
        .when(k == "signup", "SHORT")
        .when(k == "click", "CLOSE_LONG")
        .when(k == "error", "CLOSE_SHORT")
        .otherwise("FLAT")
    )
    return events(spark, d).select(
        F.col("user_id").cast("string").alias("account"),
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("I"), F.col("event_id") % 3).alias("instrument"),
        act.alias("action"),
        F.lit(0.1).alias("size"),
        (F.col("value") / 10 + 50).alias("price"),
    )


@query("pf_paper_ledger", "O-PF-03")
def pf_paper_ledger(spark, d):
    out = backtest.paper_ledger(paper_orders(spark, d), ["ts", "seq"], 1e6, 2.0, 5.0)
    return out.select("account", "seq", "status", F.round("cash", 4).alias("cash"), F.round("equity", 4).alias("equity"))
