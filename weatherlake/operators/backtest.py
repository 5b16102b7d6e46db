"""Backtests as window products, and risk statistics (O-BT, O-RK, O-PF).

A price series is a daily frame: one row per key and session, so its partition is bounded by the
calendar. Positions do not depend on equity; the equity curve is therefore a running product and needs
no loop. Duplicate sessions of one key must be rejected beforehand (``quality.duplicate_keys``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.operators.ranks import exact_quantiles
from weatherlake.operators.windows import running

YEAR = 252.0
SignalRule = Callable[[DataFrame], DataFrame]


def equity_curve(
    prices: DataFrame,
    keys: Sequence[str],
    ts: str,
    price: str = "close",
    position: str = "position",
    capital: float = 1_000_000.0,
    commission_bps: float = 5.0,
    slippage_bps: float = 2.0,
) -> DataFrame:
    """One row per bar: position after the bar, turnover, equity and equity before the bar's cost.

    The first bar holds nothing; each later bar earns the previous position and then pays for its
    change. Keys with fewer than two bars yield nothing.
    """
    rate = (commission_bps + slippage_bps) / 10_000
    w = Window.partitionBy(*keys).orderBy(ts)
    x = prices.filter(F.col(price).isNotNull()).withColumns(
        {"bar": F.row_number().over(w) - 1, "_bars": F.count("*").over(Window.partitionBy(*keys))}
    )
    pos = F.when(F.col("bar") == 0, 0.0).otherwise(F.coalesce(position, F.lit(0.0)))
    x = x.filter(F.col("_bars") >= 2).withColumn("position", pos)
    before = F.lag(price).over(w)
    x = x.withColumns(
        {
            "_held": F.coalesce(F.lag("position").over(w), F.lit(0.0)),
            "_ret": F.when(before != 0, F.col(price) / before - 1).otherwise(0.0),
        }
    )
    x = x.withColumn("turnover", F.abs(F.col("position") - F.col("_held")))
    x = x.withColumn("_gain", F.col("_held") * F.col("_ret") + 1)
    growth = F.product(F.col("_gain") * (1 - F.col("turnover") * rate)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    x = x.withColumn("equity", growth * capital)
    x = x.withColumn(
        "equity_before_cost", F.coalesce(F.lag("equity").over(w) * F.col("_gain"), F.col("equity"))
    ).withColumn("cost_share", F.col("turnover") * rate)
    return x.drop("_bars", "_held", "_ret", "_gain")


def trades(equity: DataFrame, keys: Sequence[str], ts: str, price: str = "close") -> DataFrame:
    """One row per holding period; a position still open ends at the last bar without exit cost."""
    w = Window.partitionBy(*keys).orderBy("bar")
    state = F.struct(
        F.col("bar"), F.col(ts).alias("ts"), F.col(price).alias("price"), "equity_before_cost", "cost_share", "equity"
    )
    last = F.last(state).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moves = equity.withColumn("_s", state).withColumn("_last", last).filter(F.col("turnover") > 0)
    moves = moves.withColumn("_exit", F.lead("_s").over(w)).filter(F.col("position") != 0)
    open_ = F.col("_exit").isNull()
    end = F.when(open_, F.col("_last")).otherwise(F.col("_exit"))
    value = F.when(open_, F.col("_last.equity")).otherwise(F.col("_exit.equity_before_cost"))
    cost = F.col("cost_share") + F.when(open_, 0.0).otherwise(F.col("_exit.cost_share"))
    pnl = value - F.col("equity")
    return moves.select(
        *keys,
        F.col("bar").alias("entry_idx"),
        end["bar"].alias("exit_idx"),
        F.col(ts).alias("entry_time"),
        end["ts"].alias("exit_time"),
        F.col(price).alias("entry_price"),
        end["price"].alias("exit_price"),
        "position",
        pnl.alias("pnl"),
        F.when(F.col("equity") != 0, pnl / F.col("equity")).otherwise(0.0).alias("return"),
        cost.alias("costs_incurred"),
        (cost * 10_000).alias("costs_bps"),
    )


def sharpe(r: Column, degenerate: float | None, rf: float = 0.02) -> Column:
    """Annualised Sharpe inside an aggregate; short or flat samples give ``degenerate``."""
    sd = F.stddev_samp(r)
    value = (F.avg(r) - rf / YEAR) / sd * YEAR**0.5
    return F.when((F.count(r) < 2) | sd.isNull() | (sd < 1e-15), F.lit(degenerate).cast("double")).otherwise(value)


def sortino(r: Column, degenerate: float | None, rf: float = 0.02) -> Column:
    e = r - rf / YEAR
    down = F.sqrt(F.sum(F.when(e < 0, e * e)) / F.count(r))
    value = F.avg(e) / down * YEAR**0.5
    bad = (F.count(r) < 2) | down.isNull() | (down < 1e-15)
    return F.when(bad, F.lit(degenerate).cast("double")).otherwise(value)


def profit_columns(pnl: Column) -> dict[str, Column]:
    """Win rate and profit factor; a factor without any loss is infinite, shown as NULL."""
    won = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    lost = F.abs(F.coalesce(F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)))
    factor = F.when(lost >= 1e-15, won / lost).when(won <= 0, 0.0)
    return {"win_rate": F.avg((pnl > 0).cast("double")), "profit_factor": factor, "n_trades": F.count("*")}


def drawdown(df: DataFrame, keys: Sequence[str], ts: str, equity: str) -> DataFrame:
    """Maximum drawdown per key of a daily equity frame."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(equity).over(w)
    dd = F.when(peak > 0, (peak - F.col(equity)) / peak).otherwise(0.0)
    return df.withColumn("_dd", dd).groupBy(*keys).agg(F.max("_dd").alias("max_drawdown"))


def summary(equity: DataFrame, keys: Sequence[str], ts: str, price: str = "close", capital: float = 1_000_000.0) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("bar")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = equity.withColumns(
        {"_r": F.col("equity") / F.lag("equity").over(w) - 1, "_dd": (peak - F.col("equity")) / peak}
    )
    curve = e.groupBy(*keys).agg(
        sharpe(F.col("_r"), 0.0).alias("sharpe"),
        F.max("_dd").alias("max_drawdown"),
        (F.max_by("equity", "bar") / capital - 1).alias("total_return"),
    )
    deals = trades(equity, keys, ts, price).groupBy(*keys).agg(
        *[c.alias(n) for n, c in profit_columns(F.col("pnl")).items()]
    )
    none = {"win_rate": 0.0, "profit_factor": 0.0, "n_trades": 0}
    out = curve.join(deals.withColumn("_any", F.lit(True)), list(keys), "left")
    for n, v in none.items():
        out = out.withColumn(n, F.when(F.col("_any"), F.col(n)).otherwise(F.lit(v)))
    return out.drop("_any")


def run(
    prices: DataFrame, rule: SignalRule, keys: Sequence[str], ts: str, start=None, end=None, **costs
) -> DataFrame:
    """Apply a set-based signal rule that adds ``position``, then the equity curve.

    The rule sees the whole frame as columns; it is point-in-time when it only looks back through
    windows ordered by ``ts`` (``quality``'s append test checks that).
    """
    x = prices
    if start is not None:
        x = x.filter(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        x = x.filter(F.col(ts) <= F.lit(end).cast("date"))
    return equity_curve(rule(x), keys, ts, **costs)


def walk_forward_folds(
    df: DataFrame, keys: Sequence[str], ts: str, train: int = 252, test: int = 63
) -> DataFrame:
    """Label test rows with ``fold`` (0-based). Series shorter than train + test form one fold.

    Folds are arithmetic on the row number: no range join.
    """
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    x = df.withColumns({"_i": i, "_n": n})
    f = F.floor((F.col("_i") - train) / test)
    folds = F.floor((F.col("_n") - train) / test)
    fold = F.when(F.col("_n") < train + test, 0).when((f >= 0) & (f < folds), f)
    return x.withColumn("fold", fold.cast("int")).filter(F.col("fold").isNotNull()).drop("_i", "_n")


def walk_forward_training(
    df: DataFrame, keys: Sequence[str], ts: str, train: int = 252, test: int = 63
) -> DataFrame:
    """Rows repeated for every fold they train (at most train / test + 1 copies)."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    x = df.withColumns({"_i": i, "_n": n}).filter(F.col("_n") >= train + test)
    first = F.greatest(F.ceil((F.col("_i") - train + 1) / test), F.lit(0))
    last = F.least(F.floor(F.col("_i") / test), F.floor((F.col("_n") - train) / test) - 1)
    x = x.withColumn("_a", first).withColumn("_b", last).filter(F.col("_a") <= F.col("_b"))
    x = x.withColumn("fold", F.explode(F.sequence("_a", "_b")))
    return x.withColumn("fold", F.col("fold").cast("int")).drop("_i", "_n", "_a", "_b")


def signal_backtest(
    signals: DataFrame, prices: DataFrame, keys: Sequence[str], session: str, start: str, end: str, **costs
) -> DataFrame:
    """Backtest stored signals (action, size per key and day) on real prices; metrics rounded to 4."""
    side = F.when(F.col("action") == "LONG", 1.0).when(F.col("action") == "SHORT", -1.0).otherwise(0.0)
    s = signals.select(*keys, session, (side * F.col("size")).alias("position"))
    x = prices.filter(F.col(session).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    e = equity_curve(x.join(s, [*keys, session], "left"), keys, session, **costs)
    out = summary(e, keys, session, capital=costs.get("capital", 1_000_000.0))
    return out.select(*keys, *[F.round(c, 4).alias(c) for c in ("sharpe", "max_drawdown", "total_return", "win_rate", "profit_factor")], "n_trades")


# Risk statistics over returns.


def value_at_risk(returns: DataFrame, keys: Sequence[str], r: str, confidence: float = 0.95) -> DataFrame:
    """Historical VaR and CVaR with the linear percentile, from exact order statistics."""
    q = exact_quantiles(returns, keys, r, {"_cut": 1 - confidence})
    tail = F.avg(F.when(F.col(r) <= F.col("_cut"), F.col(r)))
    j = returns.filter(F.col(r).isNotNull()).join(q, list(keys))
    return j.groupBy(*keys).agg(
        (-F.max("_cut")).alias("var"), F.coalesce(-tail, -F.max("_cut")).alias("cvar")
    )


def return_ratios(returns: DataFrame, keys: Sequence[str], ts: str, r: str, benchmark: str) -> DataFrame:
    """Sharpe, Sortino, information and Calmar ratios; degenerate samples are NULL."""
    x = returns.filter(F.col(r).isNotNull())
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_e", F.product(F.col(r) + 1).over(w))
    x = x.withColumn("_dd", 1 - F.col("_e") / F.max("_e").over(w))
    active = F.col(r) - F.col(benchmark)
    te = F.stddev_samp(active)
    dd, n = F.max("_dd"), F.count("*")
    growth = F.max_by("_e", ts)
    return x.groupBy(*keys).agg(
        sharpe(F.col(r), None).alias("sharpe"),
        sortino(F.col(r), None).alias("sortino"),
        F.when((F.count(active) >= 2) & (te >= 1e-15), F.avg(active) / te * YEAR**0.5).alias("information"),
        F.when((n >= 2) & (dd >= 1e-15), (F.pow(growth, F.lit(YEAR) / n) - 1) / dd).alias("calmar"),
        dd.alias("max_drawdown"),
    )


def risk_parity(returns: DataFrame, groups: Sequence[str], instrument: str, r: str) -> DataFrame:
    """Inverse-volatility weights with a floor of 1e-10 on the volatility."""
    v = returns.groupBy(*groups, instrument).agg(
        F.greatest(F.coalesce(F.stddev_samp(r), F.lit(1e-10)), F.lit(1e-10)).alias("vol")
    )
    inv = 1 / F.col("vol")
    return v.withColumn("weight", inv / F.sum(inv).over(Window.partitionBy(*groups)))


def trade_log_pnl(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str, capital: float
) -> DataFrame:
    """Metrics of an equity path built from trade results; accounts may be of any length (range scans)."""
    path = running(log, keys, order, {"_sum": ("sum", F.col(pnl))}, keep_ranges=True)
    path = path.withColumn("equity", F.col("_sum") + capital)
    path = running(path, keys, order, {"_top": ("max", F.col("equity"))}, ranged=True)
    before = F.col("equity") - F.col(pnl)
    peak = F.greatest("_top", F.lit(capital))
    path = path.withColumns(
        {
            "_r": F.when(before != 0, F.col(pnl) / before),
            "_dd": F.when(peak > 0, (peak - F.col("equity")) / peak).otherwise(0.0),
        }
    )
    p = profit_columns(F.col(pnl))
    return path.groupBy(*keys).agg(
        (F.sum(pnl) / capital).alias("total_return"),
        sharpe(F.col("_r"), 0.0).alias("sharpe"),
        sortino(F.col("_r"), 0.0).alias("sortino"),
        F.max("_dd").alias("max_drawdown"),
        *[c.alias(n) for n, c in p.items()],
    )


_LEDGER = (
    "account string, seq long, status string, fill_price double, quantity double, pnl double, cash double, equity double"
)


def paper_ledger(
    orders: DataFrame, order: Sequence[str], capital: float = 1_000_000.0, commission: float = 0.0, slippage_bps: float = 0.0
) -> DataFrame:
    """Paper fills per account: open, average in, close, with cash and equity after each order.

    Rows: account (string), seq, instrument, action (LONG, SHORT, FLAT, CLOSE_LONG, CLOSE_SHORT), size,
    price. Sizes come from current equity, so an account is truly sequential. Accounts are spread over
    tasks and streamed in order through Arrow batches; only the open positions of the current account
    are held, never its rows.
    """
    slip = slippage_bps / 10_000

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, cash, book = None, capital, {}
        for b in batches:
            out = []
            for a, seq, inst, action, size, price in zip(
                b.account, b.seq, b.instrument, b.action, b["size"], b.price, strict=True
            ):
                if a != account:
                    account, cash, book = a, capital, {}
                side = -1 if action.endswith("SHORT") else 1
                key = (inst, side)
                status, got, qty, pnl = "flat", None, 0.0, None
                if action.startswith("CLOSE"):
                    status = "none"
                    if key in book:
                        entry, qty = book.pop(key)
                        got = price * (1 - side * slip)
                        pnl = side * (got - entry) * qty
                        cash += entry * qty + pnl - commission
                        status = "closed"
                elif action != "FLAT":
                    got = price * (1 + side * slip)
                    worth = cash + sum(_mark(k, v, inst, price) for k, v in book.items())
                    qty = size * worth / got if got > 0 else 0.0
                    status = "skipped"
                    if qty > 0:
                        entry, held = book.get(key, (0.0, 0.0))
                        book[key] = ((entry * held + got * qty) / (held + qty), held + qty)
                        cash -= got * qty + commission
                        status = "added" if held else "opened"
                worth = cash + sum(_mark(k, v, inst, price) for k, v in book.items())
                out.append((a, seq, status, got, qty, pnl, cash, worth))
            yield pd.DataFrame(out, columns=["account", "seq", "status", "fill_price", "quantity", "pnl", "cash", "equity"])

    need = ["account", "seq", "instrument", "action", "size", "price"]
    ordered = orders.repartition("account").sortWithinPartitions("account", *order).select(*need)
    return ordered.mapInPandas(fill, _LEDGER)


def _mark(key: tuple, position: tuple, instrument: str, price: float) -> float:
    """Value of a position: entry value plus its gain at the price of the instrument being traded."""
    (inst, side), (entry, qty) = key, position
    gain = side * (price - entry) * qty if inst == instrument else 0.0
    return entry * qty + gain
