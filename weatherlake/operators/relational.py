"""Read queries over the store (O-REL-01..10). As-of times are arguments, never the wall clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.operators.windows import POS, number_rows

INCIDENT_ACTIONS = ("metering.s1", "metering.suspend", "metering.block_invoice")
CYCLE_SECONDS = 86_400


def instruments_rollup(signals: DataFrame, asof: Column) -> DataFrame:
    g = signals.groupBy("instrument").agg(F.count("*").alias("signal_count"), F.max("ts").alias("latest_signal_at"))
    age = F.round((F.unix_micros(asof) - F.unix_micros("latest_signal_at")) / 1e6, 1)
    return g.withColumn("staleness_seconds", age).orderBy("instrument")


def latest_signals(
    signals: DataFrame, instrument: str, limit: int = 20, since: str | None = None, cycle_id: str | None = None, tie: str = "event_id"
) -> DataFrame:
    """Newest signals of an instrument; the limit (1..100) is part of the query, another one is refused."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    x = signals.filter(F.col("instrument") == instrument)
    if since is not None:
        x = x.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if cycle_id is not None:
        x = x.filter(F.col("forecast_cycle_id") == cycle_id)
    return x.orderBy(F.col("ts").desc(), F.col(tie).desc()).limit(limit)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    net = F.when(F.col("scored"), F.col("net_of_benchmark"))
    return ledger.agg(
        F.count("*").alias("total_count"),
        F.count_if("scored").alias("scored_count"),
        F.round(F.sum(net), 6).alias("net_of_benchmark"),
        F.round(F.avg(net), 6).alias("mean_net_of_benchmark"),
    )


def edge_status(ledger: DataFrame, rerun_passed: bool, n_min: int = 8) -> DataFrame:
    n = F.count_if("scored")
    status = F.when(n < n_min, "underpowered").when(F.lit(rerun_passed), "proven").otherwise("unproven")
    g = ledger.agg(status.alias("status"), n.alias("n_scored_events"))
    return g.withColumn("header", F.concat("status", F.lit("_n"), F.col("n_scored_events").cast("string")))


def audit_page(
    audit: DataFrame, tenant: str | None = None, actor: str | None = None, action: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    for name, value in (("tenant_id", tenant), ("actor_id", actor), ("action", action)):
        if value is not None:
            audit = audit.filter(F.col(name) == value)
    return audit.orderBy(F.col("id").desc()).offset(offset).limit(limit)


def status_of(staleness: Column, period: int = CYCLE_SECONDS) -> Column:
    return F.when(staleness.isNull(), "UNKNOWN").when(staleness >= period, "DEGRADED").otherwise("OK")


def cycle_status(cycles: DataFrame, metrics: DataFrame, asof: Column, keys: Sequence[str]) -> DataFrame:
    """Latest published cycle, worker heartbeat (else the publication) and freshness state per key."""
    c = cycles.groupBy(*keys).agg(
        F.max_by("forecast_cycle_id", F.struct("publication_ts", "forecast_cycle_id")).alias("latest_cycle_id"),
        F.max("publication_ts").alias("publication_ts"),
    )
    beat = metrics.filter(F.col("name") == "worker.last_run").groupBy(*keys).agg(F.max("ts").alias("_beat"))
    j = c.join(beat, list(keys), "left")
    age = F.round((F.unix_micros(asof) - F.unix_micros("publication_ts")) / 1e6, 1)
    j = j.withColumns({"staleness_seconds": age, "worker_last_run": F.coalesce("_beat", "publication_ts")})
    return j.withColumn("state", status_of(F.col("staleness_seconds"))).drop("_beat")


def incidents(audit: DataFrame, actions: Sequence[str] = INCIDENT_ACTIONS, limit: int = 5) -> DataFrame:
    """Newest incidents with a one-line summary from the JSON payload."""
    def text(field: str) -> Column:
        return F.nullif(F.get_json_object("payload", f"$.{field}"), F.lit(""))
    x = audit.filter(F.col("action").isin(*actions))
    summary = F.coalesce(text("reason"), text("description"), F.col("action"))
    return x.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit).select("ts", "tenant_id", "action", summary.alias("summary"))


def signal_batches(signals: DataFrame, order: Sequence[str], fields: Sequence[str], part_size: int = 1000) -> DataFrame:
    """One JSON document per cycle with its signals in time order.

    A cycle with more than ``part_size`` signals becomes several numbered parts, so no document and no
    task holds an unbounded group.
    """
    n = number_rows(signals, ["forecast_cycle_id"], order)
    n = n.withColumn("part", F.floor((F.col(POS) - 1) / part_size))
    item = F.struct(POS, *[F.col(f) for f in fields])
    g = n.groupBy("forecast_cycle_id", "part").agg(
        F.array_sort(F.collect_list(item)).alias("_s"), F.max("publication_ts").alias("publication_ts")
    )
    plain = F.transform("_s", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    doc = F.struct(
        F.lit("signals.batch").alias("type"),
        F.lit("1").alias("version"),
        F.col("forecast_cycle_id").alias("cycle_id"),
        F.col("publication_ts"),
        plain.alias("signals"),
    )
    return g.select(
        F.col("forecast_cycle_id").alias("cycle_id"), "part", F.size("_s").alias("n_signals"), F.to_json(doc).alias("payload")
    )


def ticker_snapshot(prices: DataFrame, key: str, session: str, close: str) -> DataFrame:
    """Last close with its change from the previous one (daily frame per ticker)."""
    w = Window.partitionBy(key).orderBy(session)
    x = prices.withColumn("_p", F.coalesce(F.lag(close).over(w), F.col(close)))
    g = x.groupBy(key).agg(F.max_by(F.struct(F.col(close).alias("c"), "_p", F.col(session).alias("s")), session).alias("m"))
    price, prev = F.col("m.c"), F.col("m._p")
    return g.select(
        key,
        price.alias("price"),
        (price - prev).alias("change"),
        F.when(prev != 0, (price - prev) / prev * 100).otherwise(0.0).alias("change_pct"),
        F.col("m.s").alias("market_time"),
    )


def spread(prices: DataFrame, key: str, session: str, close: str, long: str, short: str) -> DataFrame:
    """Long minus short close by date, NULL where either is missing."""
    def leg(name: str) -> Column:
        return F.max(F.when(F.col(key) == name, F.col(close)))
    return prices.filter(F.col(key).isin(long, short)).groupBy(session).agg((leg(long) - leg(short)).alias("spread"))
