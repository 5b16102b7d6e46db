"""Queries for O-REL, O-AU and O-MT."""

from pyspark.sql import functions as F

from weatherlake.operators import audit, metering, relational
from weatherlake.operators.metering import SEVERITY_KEYWORDS
from weatherlake.plans.pit_queries import _LEDGER, K, ledger
from weatherlake.plans.hazard_queries import CYCLE_FEATURES, cycle_frame
from weatherlake.session import materialise
from weatherlake.plans.registry import query
from weatherlake.plans.signal_queries import SIGNAL_LOG, signal_log
from weatherlake.operators import pit as P
from weatherlake.plans.standins import MARKET, events, market, table

ASOF = "2024-02-01 00:00:00"
START, END = "2024-01-08 00:00:00", "2024-01-22 00:00:00"


def _asof():
    return F.lit(ASOF).cast("timestamp")


@query(
    "rel_instruments",
    "O-REL-01",
    f"""select instrument, count(*) as signal_count, cast(floor(epoch(max(ts))) as bigint) as latest, epoch(timestamp '{ASOF}') - epoch(max(ts)) as staleness_seconds
 from {SIGNAL_LOG} group by 1""",
    {"staleness_seconds": 1},
)
def rel_instruments(spark, d):
    x = relational.instruments_rollup(signal_log(spark, d), _asof())
    return x.select("instrument", "signal_count", F.unix_timestamp("latest_signal_at").alias("latest"), "staleness_seconds")


@query(
    "rel_latest_signals",
    "O-REL-02",
    f"""select event_id, instrument, action, confidence from {SIGNAL_LOG} where instrument = 'I3' and ts >= timestamp '2024-01-05' order by ts desc, event_id desc limit 50""",
    {"confidence": 8},
)
def rel_latest_signals(spark, d):
    x = relational.latest_signals(signal_log(spark, d), "I3", 50, since="2024-01-05")
    return x.select("event_id", "instrument", "action", "confidence")


@query(
    "rel_ledger_summary",
    "O-REL-03",
    f"""select count(*) as total_count, count(*) filter (where scored) as scored_count, sum(net_of_benchmark) filter (where scored) as net_of_benchmark,
 avg(net_of_benchmark) filter (where scored) as mean_net_of_benchmark from {_LEDGER}""",
    {"net_of_benchmark": 6, "mean_net_of_benchmark": 6},
)
def rel_ledger_summary(spark, d):
    return relational.ledger_summary(ledger(spark, d))


@query(
    "rel_edge_status",
    "O-REL-04",
    f"""select 'unproven' as status, n as n_scored_events, 'unproven_n' || n as header from (select count(*) filter (where scored) as n from {_LEDGER})""",
)
def rel_edge_status(spark, d):
    return relational.edge_status(ledger(spark, d), rerun_passed=False)


def audit_log(spark, d):
    """Audit events: tenant, action and JSON payload per event."""
    k = F.col("event_id")
    t = F.col("event_type")
    act = (
        F.when(t == "view", "feed.connect")
        .when(t == "click", "feed.disconnect")
        .when((t == "error") & (k % 3 == 0), "metering.s1")
        .when(t == "error", "metering.suspend")
        .otherwise(F.concat(F.lit("api."), t))
    )
    reason = F.when(k % 3 == 0, F.concat(F.lit("reason "), k)).otherwise(F.lit(None))
    desc = F.when(k % 3 == 1, F.concat(F.lit("description "), k)).otherwise(F.lit(None))
    return events(spark, d).select(
        k.alias("id"),
        F.concat(F.lit("r"), k).alias("request_id"),
        F.when(k % 50 != 0, F.concat(F.lit("t"), F.col("user_id") % 10)).alias("tenant_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("actor_id"),
        act.alias("action"),
        "ts",
        F.to_json(F.struct(reason.alias("reason"), desc.alias("description"))).alias("payload"),
        F.col("user_id").alias("session_id"),
        "value",
    )


AUDIT = """(select event_id as id, 'r' || event_id as request_id, case when event_id % 50 <> 0 then 't' || (user_id % 10) end as tenant_id, 'u' || user_id as actor_id,
 case when event_type = 'view' then 'feed.connect' when event_type = 'click' then 'feed.disconnect' when event_type = 'error' and event_id % 3 = 0 then 'metering.s1'
  when event_type = 'error' then 'metering.suspend' else 'api.' || event_type end as action, ts,
 case event_id % 3 when 0 then 'reason ' || event_id when 1 then 'description ' || event_id end as note, user_id as session_id, value from events)"""


@query(
    "rel_audit_page",
    "O-REL-05",
    f"select id, request_id, tenant_id, action from {AUDIT} where tenant_id = 't4' and action = 'api.purchase' order by id desc limit 40 offset 20",
)
def rel_audit_page(spark, d):
    x = relational.audit_page(audit_log(spark, d), tenant="t4", action="api.purchase", limit=40, offset=20)
    return x.select("id", "request_id", "tenant_id", "action")


@query(
    "rel_cycle_status",
    "O-REL-06",
    f"""with c as (select instrument, max(date) as d, max(publish_time) as p from {CYCLE_FEATURES} group by 1),
 m as (select case event_id % 3 when 0 then 'A' when 1 then 'N' end as instrument, max(ts) as b from events where event_id % 3 < 2 group by 1)
 select c.instrument, strftime(c.d, '%Y%m%d') || '_12z' as latest_cycle_id, epoch(timestamp '2001-08-02') - epoch(p) as staleness_seconds,
 cast(floor(epoch(coalesce(m.b, p))) as bigint) as worker, case when epoch(timestamp '2001-08-02') - epoch(p) >= 86400 then 'DEGRADED' else 'OK' end as state
 from c left join m on c.instrument = m.instrument""",
    {"staleness_seconds": 1},
)
def rel_cycle_status(spark, d):
    c = cycle_frame(spark, d).select(
        "instrument", P.cycle_id(F.col("date"), F.col("cycle")).alias("forecast_cycle_id"), F.col("publish_time").alias("publication_ts")
    )
    k = F.col("event_id") % 3
    inst = F.when(k == 0, "A").when(k == 1, "N")
    m = events(spark, d).filter(k < 2).select(inst.alias("instrument"), F.lit("worker.last_run").alias("name"), "ts")
    x = relational.cycle_status(c, m, F.lit("2001-08-02").cast("timestamp"), K)
    return x.select(
        "instrument", "latest_cycle_id", "staleness_seconds", F.unix_timestamp("worker_last_run").alias("worker"), "state"
    )


@query(
    "rel_incidents",
    "O-REL-07",
    f"""select cast(floor(epoch(ts)) as bigint) as ts, tenant_id, action, coalesce(note, action) as summary from {AUDIT}
 where action in ('metering.s1', 'metering.suspend', 'metering.block_invoice') order by {AUDIT}.ts desc limit 25""".replace(f"{AUDIT}.ts", "epoch(ts)"),
)
def rel_incidents(spark, d):
    return relational.incidents(audit_log(spark, d), limit=25).withColumn("ts", F.unix_timestamp("ts"))


@query(
    "rel_signal_batches",
    "O-REL-08",
    f"""select cycle_id, cast(floor((rn-1)/100) as bigint) as part, cast((rn-1) % 100 as int) as pos, instrument, action, confidence from
 (select *, strftime(ts, '%Y%m%d') || '_12z' as cycle_id, row_number() over (partition by strftime(ts, '%Y%m%d') order by ts, event_id) as rn from {SIGNAL_LOG})""",
    {"confidence": 8},
)
def rel_signal_batches(spark, d):
    s = signal_log(spark, d).withColumns(
        {
            "forecast_cycle_id": F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_12z")),
            "publication_ts": F.date_format("ts", "yyyy-MM-dd 15:30:00"),
        }
    )
    b = relational.signal_batches(
        s, ["ts", "event_id"], ["instrument", "action", "confidence"], part_size=100
    )
    doc = F.from_json("payload", "signals array<struct<instrument string, action string, confidence double>>")
    x = b.select("cycle_id", "part", F.posexplode(doc["signals"]).alias("pos", "s"))
    return x.select("cycle_id", "part", "pos", "s.instrument", "s.action", "s.confidence")


@query(
    "rel_ticker_snapshot",
    "O-REL-09",
    f"""with x as (select *, coalesce(lag(close) over (partition by instrument order by session), close) as p from {MARKET})
 select instrument, cast(max(session) as varchar) as market_time, max_by(close, session) as price, max_by(close - p, session) as change,
 max_by((close-p)/p*100, session) as change_pct from x group by 1""",
    {"price": 9, "change": 9, "change_pct": 8},
)
def rel_ticker_snapshot(spark, d):
    x = relational.ticker_snapshot(market(spark, d), "instrument", "session", "close")
    return x.withColumn("market_time", F.date_format("market_time", "yyyy-MM-dd"))


@query(
    "rel_spread",
    "O-REL-10",
    f"""select cast(coalesce(a.session, b.session) as varchar) as session, a.close - b.close as spread from (select * from {MARKET} where instrument = 'A') a
 full join (select * from {MARKET} where instrument = 'R') b on a.session = b.session""",
    {"spread": 9},
)
def rel_spread(spark, d):
    x = relational.spread(market(spark, d), "instrument", "session", "close", "A", "R")
    return x.withColumn("session", F.date_format("session", "yyyy-MM-dd"))


def sealed(spark, d):
    a = audit_log(spark, d).select(
        F.coalesce("tenant_id", F.lit("internal")).alias("tenant_id"),
        "id",
        "ts",
        F.to_json(F.struct("action", "actor_id", "request_id")).alias("payload"),
    )
    return materialise(audit.seal_chains(a, "tenant_id", ["ts", "id"]), "sealed")


@query(
    "au_verify_chain",
    "O-AU-01",
    f"""with x as (select coalesce(tenant_id, 'internal') as tenant_id, id, row_number() over (partition by coalesce(tenant_id, 'internal') order by ts, id) - 1 as p from {AUDIT}),
 bad as (select tenant_id, min(p) as p from x where id % 997 = 5 or (tenant_id = 't3' and p = 17) group by 1)
 select x.tenant_id, count(*) as n, bad.p is null as ok, cast(bad.p as bigint) as first_bad from x left join bad on x.tenant_id = bad.tenant_id group by 1, bad.p""",
    {"first_bad": 0},
)
def au_verify_chain(spark, d):
    """Sealed chains with altered payloads, and one with a broken link."""
    s = sealed(spark, d)
    rank = audit.chain_rows(s, ["tenant_id"], ["ts", "id"])
    broken = (F.col("tenant_id") == "t3") & (F.col("position") == 17)
    t = rank.withColumns(
        {
            "payload": F.when(F.col("id") % 997 == 5, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")),
            "prev_hash": F.when(broken, F.lit("x")).otherwise(F.col("prev_hash")),
        }
    ).drop("bad", "position")
    return audit.verify_chains(t, ["tenant_id"], ["ts", "id"])


@query(
    "au_seal_chain",
    "O-AU-02",
    f"""select coalesce(tenant_id, 'internal') as tenant_id, count(*) as n, count(*) - 1 as linked, true as ok from {AUDIT} group by 1""",
)
def au_seal_chain(spark, d):
    s = sealed(spark, d)
    v = audit.verify_chains(s, ["tenant_id"], ["ts", "id"])
    n = s.groupBy("tenant_id").agg(F.count("prev_hash").alias("linked"))
    return v.join(n, "tenant_id").select("tenant_id", "n", "linked", "ok")


_PATH = "case id % 5 when 0 then '/v1/admin/keys/' || id when 1 then '/v1/backtests' when 2 then '/v1/signals/x' when 3 then '/v1/admin/tenants' else '/health' end"


def access_lines(spark, d):
    """Access-log lines, some of them unparseable."""
    k = F.col("id")
    path = (
        F.when(k % 5 == 0, F.concat(F.lit("/v1/admin/keys/"), k))
        .when(k % 5 == 1, "/v1/backtests")
        .when(k % 5 == 2, "/v1/signals/x")
        .when(k % 5 == 3, "/v1/admin/tenants")
        .otherwise("/health")
    )
    status = F.when(k % 40 == 7, 503).when(k % 90 == 11, 500).otherwise(200)
    line = F.concat(
        F.lit("10.0.0.1 "), "request_id", F.lit(' "POST '), path, F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" 12 0.004")
    )
    a = audit_log(spark, d)
    return a.select("id", "ts", F.when(k % 101 == 0, F.lit("malformed line")).otherwise(line).alias("value"))


@query(
    "src_access_log",
    "O-SRC-06",
    f"select request_id, 'POST' as method, {_PATH} as path, case when id % 40 = 7 then 503 when id % 90 = 11 then 500 else 200 end as status from {AUDIT} where id % 101 <> 0",
)
def src_access_log(spark, d):
    from weatherlake.sources import readers

    return readers.parse_access_log(access_lines(spark, d)).select("request_id", "method", "path", "status")


@query(
    "au_omissions",
    "O-AU-03",
    f"""select request_id from {AUDIT} where id % 101 <> 0 and id % 5 in (0, 1, 3) and id % 97 = 0""",
)
def au_omissions(spark, d):
    from weatherlake.sources import readers

    log = readers.parse_access_log(access_lines(spark, d))
    return audit.omissions(log, audit_log(spark, d).filter(F.col("id") % 97 != 0))


_CALLS = f"""(select coalesce(tenant_id, 'internal') as tenant_id, count(*) filter (where action like 'api.%') as api_calls, count(*) as chain_events
 from {AUDIT} where ts >= timestamp '{START}' and ts < timestamp '{END}' group by 1)"""


@query("mt_api_calls", "O-MT-01", f"select * from {_CALLS}")
def mt_api_calls(spark, d):
    return metering.api_calls(audit_log(spark, d), START, END)


_PAIRS = f"""(with e as (select coalesce(tenant_id, 'internal') as tenant_id, session_id, ts, id, action = 'feed.connect' as up from {AUDIT} where action like 'feed.%'),
 s as (select *, sum(case when up then 1 else -1 end) over w as s, count(*) filter (where up) over w as c, count(*) filter (where not up) over w as k from e
  window w as (partition by tenant_id, session_id order by ts, id rows unbounded preceding)),
 m as (select *, min(s) over (partition by tenant_id, session_id order by ts, id rows unbounded preceding) as m from s),
 cl as (select tenant_id, session_id, k - greatest(-m, 0) as n, min(ts) as b from m where not up group by 1, 2, 3)
 select m.tenant_id, m.session_id, m.ts as a, cl.b from m join cl on m.tenant_id = cl.tenant_id and m.session_id = cl.session_id and m.c = cl.n where m.up)"""
_FEED = f"""(select tenant_id, sum(floor(h)) as feed_hours from (select tenant_id, greatest(epoch(least(b, timestamp '{END}')) - epoch(greatest(a, timestamp '{START}')), 0)/3600.0 as h from {_PAIRS})
 group by 1 having sum(floor(h)) > 0)"""


def sessions(spark, d):
    a = audit_log(spark, d).withColumn("tenant_id", F.coalesce("tenant_id", F.lit("internal")))
    return metering.feed_sessions(a, ["tenant_id", "session_id"], "id")


@query("mt_feed_hours", "O-MT-02", f"select * from {_FEED}", {"feed_hours": 3})
def mt_feed_hours(spark, d):
    return metering.feed_hours(sessions(spark, d), START, END)


def jobs(spark, d):
    a = audit_log(spark, d).filter("action = 'api.purchase'")
    secs = (F.col("value") * 60).cast("long")
    return a.select(
        "tenant_id",
        F.when(F.col("id") % 5 != 0, "done").otherwise("failed").alias("status"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=secs)).alias("finished_at"),
    )


_BACK = f"""(select coalesce(tenant_id, 'internal') as tenant_id, sum(h) as backtest_hours from (select tenant_id, (epoch(least(ts + to_seconds(cast(trunc(value*60) as bigint)), timestamp '{END}'))
 - epoch(greatest(ts, timestamp '{START}')))/3600.0 as h from {AUDIT} where action = 'api.purchase' and id % 5 <> 0) where h > 0 group by 1)"""


@query("mt_backtest_hours", "O-MT-03", f"select * from {_BACK}", {"backtest_hours": 5})
def mt_backtest_hours(spark, d):
    return metering.backtest_hours(jobs(spark, d), START, END)


def tenants(spark, d):
    """Tenants seen in the audit log with tier and subscription item."""
    t = audit_log(spark, d).filter("tenant_id is not null").select("tenant_id").distinct()
    k = F.substring("tenant_id", 2, 9).try_cast("int")
    tier = F.when(k % 3 == 0, "free").when(k % 3 == 1, "pro").otherwise("labs")
    return t.withColumn("tier", tier).withColumn(
        "subscription_item", F.when(k % 4 < 2, F.concat(F.lit("si_"), "tenant_id"))
    )


TENANTS = f"""(select tenant_id, case k % 3 when 0 then 'free' when 1 then 'pro' else 'labs' end as tier, case when k % 4 < 2 then 'si_' || tenant_id end as subscription_item
 from (select distinct tenant_id, cast(substr(tenant_id, 2) as int) as k from {AUDIT} where tenant_id is not null))"""
_USAGE = f"""(select coalesce(c.tenant_id, f.tenant_id, b.tenant_id) as tenant_id, coalesce(t.tier, 'free') as tier, coalesce(c.api_calls, 0) as api_calls,
 round(coalesce(feed_hours, 0), 3) as feed_hours, round(coalesce(backtest_hours, 0), 3) as backtest_hours, coalesce(c.chain_events, 0) as chain_events
 from {_CALLS} c full join {_FEED} f on c.tenant_id = f.tenant_id full join {_BACK} b on coalesce(c.tenant_id, f.tenant_id) = b.tenant_id
 left join {TENANTS} t on coalesce(c.tenant_id, f.tenant_id, b.tenant_id) = t.tenant_id)"""


def metered(spark, d):
    return metering.usage(
        mt_api_calls(spark, d),
        metering.feed_hours(sessions(spark, d), START, END),
        metering.backtest_hours(jobs(spark, d), START, END),
        tenants(spark, d),
    )


@query("mt_usage", "O-MT-04", f"select * from {_USAGE}", {"feed_hours": 3, "backtest_hours": 3})
def mt_usage(spark, d):
    return metered(spark, d)


def reports(spark, d):
    k = F.substring("tenant_id", 2, 9).try_cast("int")
    chain = mt_api_calls(spark, d).select("tenant_id", F.col("api_calls").alias("chain_calls"))
    rollup = chain.select("tenant_id", (F.col("chain_calls") + F.when(k == 7, 3).otherwise(0)).alias("rollup_calls"))
    log = audit_log(spark, d).filter(
        (F.col("ts") >= START) & (F.col("ts") < END) & F.col("action").startswith("api.") & F.col("tenant_id").isNotNull()
    )
    k2 = F.substring("tenant_id", 2, 9).try_cast("int")
    kept = log.filter(~((k2 % 4 == 1) & (F.col("id") % 4 == 0)) & ~((k2 % 4 == 2) & (F.col("id") % 30 == 0)))
    logged = kept.groupBy("tenant_id").agg(F.count("*").alias("log_calls"))
    return metering.reconcile(chain, rollup, logged)


_REP = f"""(with c as (select tenant_id, api_calls as c from {_CALLS}),
 l as (select tenant_id, count(*) as l from {AUDIT} where ts >= timestamp '{START}' and ts < timestamp '{END}' and action like 'api.%' and tenant_id is not null
  and not (cast(substr(tenant_id, 2) as int) % 4 = 1 and id % 4 = 0) and not (cast(substr(tenant_id, 2) as int) % 4 = 2 and id % 30 = 0) group by 1),
 j as (select coalesce(c.tenant_id, l.tenant_id) as tenant_id, coalesce(c, 0) as chain_calls, coalesce(c, 0) + case when c.tenant_id = 't7' then 3 else 0 end as rollup_calls,
  coalesce(l, 0) as log_calls from c full join l on c.tenant_id = l.tenant_id),
 p as (select *, rollup_calls = chain_calls as chain_ok, case when chain_calls <> 0 then round(abs(chain_calls-log_calls)/cast(chain_calls as double)*100, 4) end as log_drift_percent from j)
 select *, case when not chain_ok then case when log_drift_percent is null or log_drift_percent > 1 then 'extreme' else 'drift' end
  when chain_calls = 0 then case when log_calls > 0 then 'extreme' else 'normal' end when log_drift_percent > 10 then 'extreme' when log_drift_percent > 1 then 'drift' else 'normal' end as state,
 concat_ws(',', case when not chain_ok then 'rollup-mismatch' end, case when log_drift_percent > 1 then 'log-drift' end) as actions from p)"""


@query("mt_reconcile", "O-MT-05", f"select * from {_REP}", {"log_drift_percent": 4})
def mt_reconcile(spark, d):
    return reports(spark, d).withColumn("actions", F.array_join("actions", ","))


def account_state(spark, d):
    """Open blocks, suspensions and keys derived from the tenant list."""
    t = tenants(spark, d).withColumn("k", F.substring("tenant_id", 2, 9).try_cast("int"))
    when = F.lit("2024-01-10").cast("timestamp")
    cleared = F.when(F.col("k") % 2 == 0, when)
    blocks = t.select("tenant_id", F.concat(F.lit("b"), "k").alias("block_id"), cleared.alias("cleared_at"))
    keys = t.select("tenant_id", "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select(
        "tenant_id",
        F.concat(F.lit("k"), "k", F.lit("_"), "j").alias("key_id"),
        F.when(F.col("k") % 5 == 3, F.when(F.col("j") == 0, F.lit("2024-01-02").cast("timestamp")).otherwise(when)).alias("revoked_at"),
    )
    susp = t.filter("k % 5 = 3").select(
        "tenant_id",
        F.concat(F.lit("s"), "k").alias("suspension_id"),
        when.alias("suspended_at"),
        F.lit(None).cast("timestamp").alias("lifted_at"),
        F.array(*[F.concat(F.lit("k"), "k", F.lit(f"_{j}")) for j in range(3)]).alias("key_ids"),
    )
    return blocks, susp, keys


@query(
    "mt_drift_actions",
    "O-MT-06",
    f"""with r as (select * from {_REP}), t as (select tenant_id, cast(substr(tenant_id, 2) as int) as k from {TENANTS}),
 ks as (select t.tenant_id, k, j, 'k' || k || '_' || j as key_id from t, (select unnest(range(3)) as j)),
 ex as (select r.tenant_id from r join t on r.tenant_id = t.tenant_id where state = 'extreme' and k % 5 <> 3)
 select r.tenant_id, 'clear_block' as action, 'b' || k as target from r join t on r.tenant_id = t.tenant_id where state = 'normal' and k % 2 <> 0
 union all select r.tenant_id, 'lift_suspension', 's' || k from r join t on r.tenant_id = t.tenant_id where state = 'normal' and k % 5 = 3
 union all select r.tenant_id, 'restore_key', key_id from r join ks on r.tenant_id = ks.tenant_id where state = 'normal' and k % 5 = 3 and j > 0
 union all select tenant_id, 'incident', null from r where state <> 'normal' union all select tenant_id, 'block_invoice', null from r where state <> 'normal'
 union all select tenant_id, 'suspend', null from ex union all select ex.tenant_id, 'revoke_key', key_id from ex join ks on ex.tenant_id = ks.tenant_id""",
)
def mt_drift_actions(spark, d):
    return metering.drift_actions(reports(spark, d), *account_state(spark, d))


@query(
    "mt_usage_batches",
    "O-MT-07",
    f"""select 'usage-2024-01-08-' || u.tenant_id as batch_id, u.tenant_id, u.tier, t.subscription_item, '2024-01-08' as period,
 cast(u.api_calls + floor(u.feed_hours*1000) + floor(u.backtest_hours*1000) as bigint) as quantity from {_USAGE} u join {TENANTS} t on u.tenant_id = t.tenant_id
 where u.api_calls + floor(u.feed_hours*1000) + floor(u.backtest_hours*1000) > 0 and (t.subscription_item is not null or t.tier <> 'free')""",
)
def mt_usage_batches(spark, d):
    return metering.usage_batches(metered(spark, d), tenants(spark, d), "2024-01-08")


@query(
    "mt_sync_stale",
    "O-MT-08",
    f"""with a as (select count(*) as n from {AUDIT} x join {TENANTS} t on x.tenant_id = t.tenant_id where t.tier <> 'free' and (action like 'api.%' or action like 'feed.%')),
 s as (select max(ts) filter (where action = 'api.signup' and id % 7 = 0) as l from {AUDIT})
 select 'late' as at, cast(floor(epoch(l)) as bigint) as last_sync, epoch(timestamp '{ASOF}') - epoch(l) > 86400 as stale from s
 union all select 'none', null, n > 0 from a""",
    {"last_sync": 0},
)
def mt_sync_stale(spark, d):
    a = audit_log(spark, d)
    syncs = a.select(
        F.when((F.col("action") == "api.signup") & (F.col("id") % 7 == 0), "submitted").otherwise("failed").alias("status"),
        F.col("ts").alias("submitted_at"),
    )
    j, t = jobs(spark, d), tenants(spark, d)
    late = metering.sync_stale(syncs, a, j, t, _asof())
    none = metering.sync_stale(syncs.filter("status = 'failed'"), a, j, t, _asof())
    both = late.withColumn("at", F.lit("late")).unionByName(none.withColumn("at", F.lit("none")))
    return both.select("at", F.unix_timestamp("last_sync").alias("last_sync"), "stale")


def trials(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    t0 = F.lit("2024-01-01").cast("timestamp")
    one = F.lit("2024-01-05").cast("timestamp")
    ten = c.select(k.cast("string").alias("tenant_id"), F.when(k % 2 == 0, "pro").otherwise("free").alias("tier"))
    tr = c.filter(k % 5 != 4).select(
        k.cast("string").alias("tenant_id"),
        (t0 + F.make_dt_interval(days=(k % 60).cast("int"), hours=(k % 24).cast("int"))).alias("expires_at"),
        F.when(k % 7 == 0, one).alias("converted_at"),
        F.when(k % 11 == 0, one).alias("downgraded_at"),
        F.when(k % 3 == 0, "free").otherwise("pro").alias("tier_at_trial"),
    )
    out = c.filter(k % 6 == 1).select(k.cast("string").alias("tenant_id"), F.lit("trial.expiring").alias("kind"))
    return ten, tr, out


_TRIALS = """(select c_custkey as k, cast(c_custkey as varchar) as tenant_id, case when c_custkey % 2 = 0 then 'pro' else 'free' end as tier, c_custkey % 5 <> 4 as trial,
 timestamp '2024-01-01' + to_days(cast(c_custkey % 60 as int)) + to_hours(c_custkey % 24) as e, c_custkey % 7 = 0 as conv, c_custkey % 11 = 0 as dn,
 case when c_custkey % 3 = 0 then 'free' else 'pro' end as tt from customer)"""


@query(
    "mt_trial_states",
    "O-MT-09",
    f"""select tenant_id, tier, case when not trial then 'none' when conv then 'converted' when dn then 'downgraded' when e <= timestamp '{ASOF}' then 'expired' else 'active' end as state,
 case when trial then cast(greatest(floor((epoch(e) - epoch(timestamp '{ASOF}'))/86400), 0) as bigint) else 0 end as days_left from {_TRIALS}""",
)
def mt_trial_states(spark, d):
    ten, tr, _ = trials(spark, d)
    return metering.trial_states(ten, tr, _asof())


@query(
    "mt_trial_work",
    "O-MT-09",
    f"""select tenant_id, case when tier = tt then 'downgraded_to_free' else 'kept_paid_tier' end as work from {_TRIALS} where trial and not conv and not dn and e <= timestamp '{ASOF}'
 union all select tenant_id, 'notify_expiring' from {_TRIALS} where trial and not conv and not dn and e > timestamp '{ASOF}' and e <= timestamp '{ASOF}' + to_days(2) and k % 6 <> 1""",
)
def mt_trial_work(spark, d):
    return metering.trial_work(*trials(spark, d), _asof())


def _sev(name):
    return (
        "regexp_matches(t, '(^|[^\\p{L}\\p{N}_])(" + "|".join(SEVERITY_KEYWORDS[name]) + ")($|[^\\p{L}\\p{N}_])')"
    )


@query(
    "mt_ticket_severity",
    "O-MT-10",
    f"""with x as (select 'c' || conv_id || '-' || turn as id, lower(text) as t from conversations union all select 'd' || doc_id, lower(text) from documents)
 select id, case when {_sev('S1')} then 'S1' when {_sev('S2')} then 'S2' else 'S3' end as severity from x""",
)
def mt_ticket_severity(spark, d):
    c = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    t = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return c.unionByName(t).select("id", metering.severity(F.col("text")).alias("severity"))


@query(
    "mt_error_budget",
    "O-MT-11",
    f"""with l as (select strftime(ts, '%Y-%m-%d') as day, case when id % 40 = 7 then 503 when id % 90 = 11 then 500 else 200 end as status from {AUDIT} where id % 101 <> 0)
 select day, count(*) as observed_requests, count(*) filter (where status = 500) as real_5xx, count(*) filter (where status = 503) as fail_closed_5xx,
 greatest(1.0 - count(*) filter (where status = 500)/cast(count(*) as double)/(1-cast(0.98 as double)), 0) as remaining_fraction from l group by 1""",
    {"remaining_fraction": 7},
)
def mt_error_budget(spark, d):
    from weatherlake.sources import readers

    log = readers.parse_access_log(access_lines(spark, d)).withColumn("fail_closed", F.col("status") == 503)
    return metering.error_budget(log, [F.date_format("ts", "yyyy-MM-dd").alias("day")], target=0.98)
