"""Equity and option backtests on long frames; only turnover control carries state from row to row."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import Panel, div
from tessera.operators import pricing


@dataclass(frozen=True)
class EquityConfig:
    delay: int = 1
    min_weight: float = 0.0
    max_weight: float = 1.0
    abs_limit: float | None = None
    gross_limit: float | None = None
    net_limit: float | None = None
    target_vol: float | None = None
    vol_lookback: int = 20
    vol_floor: float = 0.01
    vol_cap: float = 3.0
    max_turnover: float | None = None
    turnover_penalty: float = 0.0
    transaction_bps: float = 0.0
    slippage_bps: float = 0.0
    borrow_bps: float = 0.0
    capacity_bps: float = 0.0
    year: float = 252.0
    initial: float = 1.0


P = Panel()


def limited_exposure(w: DataFrame, gross_limit: float | None, net_limit: float | None) -> DataFrame:
    """Gross scaled down, an excess of net spread over all assets of the time, gross again."""
    def scaled(w):
        if gross_limit is None:
            return w
        g = F.sum(F.abs("w")).over(Window.partitionBy("t"))
        return w.withColumn("w", F.col("w") * F.when(g > gross_limit, gross_limit / g).otherwise(1.0))

    w = scaled(w)
    if net_limit is None:
        return w
    at = Window.partitionBy("t")
    net, held = F.sum("w").over(at), F.sum((F.col("w") != 0).cast("int")).over(at)
    excess = F.greatest(F.abs(net) - net_limit, F.lit(0.0)) * F.signum(net)
    return scaled(w.withColumn("w", F.col("w") - F.coalesce(div(excess, held), F.lit(0.0))))


def turnover_controlled(w: DataFrame, max_turnover: float | None, penalty: float) -> DataFrame:
    """Moves toward the target as far as allowed; the state is the last weights of all assets, so one ordered pass in a task."""
    if max_turnover is None and not penalty:
        return w

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="t", columns="asset", values="w").sort_index().fillna(0.0)
        last, out = np.zeros(wide.shape[1]), []
        for row in wide.to_numpy():
            step = row - last
            turn = np.abs(step).sum()
            scale = 1.0
            if max_turnover is not None and turn > max_turnover:
                scale = max_turnover / turn
            if penalty:
                scale /= 1 + penalty * turn
            last = last + step * scale
            out.append(last)
        back = pd.DataFrame(out, index=wide.index, columns=wide.columns).stack().rename("w").reset_index()
        return back.merge(g.drop(columns="w"), on=["t", "asset"])[list(g.columns)]

    return w.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda g: walk(g.drop(columns="_one")), w.schema)


def equity_backtest(returns: DataFrame, targets: DataFrame | None = None, signals: list[DataFrame] = (), capacity: DataFrame | None = None, cfg: EquityConfig = EquityConfig()) -> tuple[DataFrame, DataFrame]:
    """returns: t, asset, ret; targets: t, asset, w (default equal); signals: t, x (carried forward). Weights by asset, results by time."""
    w = returns.select("t", "asset", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    if targets is None:
        w = w.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("t")))
    else:
        w = w.join(targets.select("t", "asset", "w"), ["t", "asset"], "left").fillna(0.0, ["w"])
    for s in signals:
        held = F.coalesce(F.last("_x", ignorenulls=True).over(P.upto), F.lit(0.0))
        w = w.join(s.select("t", F.col("x").alias("_x")), "t", "left").withColumn("w", F.col("w") * held).drop("_x")
    w = w.withColumn("w", F.coalesce(F.lag("w", cfg.delay).over(P.order), F.lit(0.0))) if cfg.delay else w
    w = w.withColumn("w", F.least(F.greatest("w", F.lit(cfg.min_weight)), F.lit(cfg.max_weight)))
    if cfg.abs_limit is not None:
        w = w.withColumn("w", F.least(F.greatest("w", F.lit(-cfg.abs_limit)), F.lit(cfg.abs_limit)))
    w = limited_exposure(w, cfg.gross_limit, cfg.net_limit)
    series = Window.partitionBy(F.lit(0)).orderBy("t")  # one row for each time from here on
    if cfg.target_vol is not None:
        port = w.groupBy("t").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
        look = series.rowsBetween(-(cfg.vol_lookback - 1), 0)
        vol = F.when(F.count("r").over(look) >= 2, F.stddev_samp("r").over(look)) * math.sqrt(cfg.year)
        port = port.withColumn("_v", vol).withColumn("_k", F.least(cfg.target_vol / F.greatest("_v", F.lit(cfg.vol_floor)), F.lit(cfg.vol_cap)))
        port = port.withColumn("_k", F.when(F.col("_v").isNotNull(), F.col("_k"))).select("t", F.coalesce(F.lag("_k").over(series), F.lit(1.0)).alias("_k"))
        w = w.join(port, "t").withColumn("w", F.col("w") * F.col("_k")).drop("_k")
    w = turnover_controlled(w, cfg.max_turnover, cfg.turnover_penalty)
    step = F.abs(F.col("w") - F.lag("w").over(P.order))
    w = w.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    use = F.lit(0.0)
    if capacity is not None:
        w = w.join(capacity.select("t", "asset", "capacity"), ["t", "asset"], "left")
        use = F.coalesce(div(F.coalesce(step, F.abs("w")), "capacity"), F.lit(0.0))
    by = w.withColumn("_use", use).groupBy("t").agg(F.sum(F.col("w") * F.col("ret")).alias("gross_return"), F.sum("_step").alias("turnover"), F.sum(F.abs("w")).alias("gross"), F.sum("w").alias("net"), F.sum(F.greatest(-F.col("w"), F.lit(0.0))).alias("short"), F.max("_use").alias("capacity_usage"))
    cost = F.col("turnover") * (cfg.transaction_bps + cfg.slippage_bps) / 1e4 + F.col("short") * cfg.borrow_bps / 1e4 / cfg.year + F.col("capacity_usage") * F.col("capacity_usage") * F.col("turnover") * cfg.capacity_bps / 1e4
    by = by.withColumn("cost", cost).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    grown = F.exp(F.sum(F.ln(F.greatest(1 + F.col("net_return"), F.lit(1e-12)))).over(series.rowsBetween(Window.unboundedPreceding, 0)))
    return w.drop("_step"), by.withColumn("equity", cfg.initial * grown).drop("short")


def factor_exposures(weights: DataFrame, returns: DataFrame, factors: DataFrame) -> DataFrame:
    """Whole-sample betas of the assets, weighted at each time; a diagnostic that looks ahead."""
    beta = returns.join(factors, "t").groupBy("asset", "factor").agg(F.coalesce(div(F.covar_samp("ret", "f"), F.var_samp("f")), F.lit(0.0)).alias("beta"))
    return weights.join(beta, "asset").groupBy("t", "factor").agg(F.sum(F.col("w") * F.col("beta")).alias("exposure"))


def rolling_betas(series: DataFrame, lookback: int = 63, p: Panel = P) -> DataFrame:
    w = p.rows(lookback)
    ok = F.count(F.when(F.col("ret").isNotNull() & F.col("f").isNotNull(), 1)).over(w) >= 3
    return series.withColumn("beta", F.coalesce(F.when(ok, div(F.covar_samp("ret", "f").over(w), F.var_samp("f").over(w))), F.lit(0.0)))


def summary(results: DataFrame, year: float = 252.0) -> DataFrame:
    r = F.col("net_return")
    series = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = results.withColumn("_dd", F.col("equity") / F.max("equity").over(series) - 1)
    return d.agg((F.avg(r) * year).alias("annual_return"), (F.stddev_samp(r) * math.sqrt(year)).alias("volatility"), F.coalesce(div(F.avg(r), F.stddev_samp(r)) * math.sqrt(year), F.lit(0.0)).alias("sharpe"), F.min("_dd").alias("max_drawdown"), F.avg("turnover").alias("turnover"), F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.sum("cost").alias("total_cost"))


@dataclass(frozen=True)
class OptionsConfig:
    target_delta: float = 0.3
    target_tenor: float = 30.0
    min_tenor: float = 1.0
    max_spread: float = 0.5
    contracts: float = 1.0
    multiplier: float = 100.0
    rate: float = 0.0
    dividend: float = 0.0
    fee: float = 0.0
    hedge_every: int = 1
    hedge_bps: float = 0.0
    delay: int = 0
    premium_is_cost: bool = False


def select_contracts(chain: DataFrame, cfg: OptionsConfig = OptionsConfig()) -> DataFrame:
    """chain: t, contract, option_type, strike, tenor, delta, bid, ask, iv. One tradable contract for each time."""
    c = chain.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread_pct", div(F.col("ask") - F.col("bid"), "mid"))
    c = c.filter((F.col("bid") > 0) & (F.col("bid") <= F.col("ask")) & (F.col("spread_pct") <= cfg.max_spread) & (F.col("tenor") >= cfg.min_tenor))
    error = F.abs(F.abs("delta") - cfg.target_delta) + F.abs(F.col("tenor") - cfg.target_tenor) / 365
    order = Window.partitionBy("t").orderBy("_e", "spread_pct", "strike", "option_type", "contract")
    return c.withColumn("_e", error).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").withColumnRenamed("_e", "selection_error")


# The strategies, and the score that each trades on with its sign.
STRATEGIES = ("delta_hedged", "tail_hedge", "volatility_carry", "skew_trading", "term_structure", "realized_vs_implied")


def strategy_signal(strategy: str, columns: list[str], entry: float = 0.0, target_tenor: float = 30.0) -> Column:
    """The side of each quote: buy all, buy puts, or the sign of a score from ``entry`` on; a score column of the chain goes before the made one."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}")
    if strategy == "delta_hedged":
        return F.lit(1.0)
    if strategy == "tail_hedge":
        return F.when(F.col("option_type") == "put", 1.0).otherwise(0.0)
    realized = F.col("realized_volatility") if "realized_volatility" in columns else F.lit(0.0)
    made = {"volatility_carry": ("vol_carry_score", F.col("iv") - realized), "skew_trading": ("skew_score", 1.0 - F.col("moneyness") if "moneyness" in columns else F.lit(0.0)), "term_structure": ("term_structure_score", F.col("tenor") - target_tenor), "realized_vs_implied": ("realized_implied_spread", realized - F.col("iv"))}
    given, own = made[strategy]
    score = F.col(given) if given in columns else own
    side = F.signum(F.when(F.abs(score) >= entry, score).otherwise(0.0))
    return -side if strategy == "volatility_carry" else side


def exercised(option_type: Column, spot: Column, strike: Column, tenor: Column, buffer: float = 2.0, threshold: float = 0.0, american: bool = True) -> Column:
    """Whether a position is assigned or exercised early: close to its end and in the money."""
    return (tenor <= buffer) & (pricing.intrinsic(option_type, spot, strike) > threshold) if american else F.lit(False)


def timing_multiplier(timing: DataFrame, assets: list[str], factors: list[str] = ()) -> DataFrame:
    """t, asset (null: all of them) and x: a weight for each asset if timing has all assets' columns, else one for all.

    One for all is the mean of the columns that are factors, or else of all columns;
    a missing weight is the last one, and 0 before the first.
    """
    names = [c for c in timing.columns if c != "t"]
    held = timing.select("t", *[F.coalesce(F.last(c, ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias(c) for c in names])  # one row for each time
    if set(assets) <= set(names):
        return held.unpivot(["t"], list(assets), "asset", "x")
    used = [c for c in names if c in set(factors)] or names
    return held.select("t", F.lit(None).cast("string").alias("asset"), (sum((F.col(c) for c in used), F.lit(0.0)) / len(used)).alias("x"))


def options_backtest(chain: DataFrame, prices: DataFrame, cfg: OptionsConfig = OptionsConfig()) -> tuple[DataFrame, DataFrame]:
    """prices: t (day), spot. Trades, and profit by day: marks of open positions, delta hedge and costs.

    The change of the marks is the profit, the opening mark included; with
    ``premium_is_cost`` the premium paid is taken off when a trade opens.
    """
    days = Window.partitionBy(F.lit(0)).orderBy("t")
    trades = select_contracts(chain, cfg).withColumns({"side": F.lit(1.0), "n": F.lit(cfg.contracts), "price": F.col("ask"), "expiry": F.col("t") + F.round("tenor").cast("int")})
    trades = trades.withColumn("premium", F.col("n") * F.col("price") * cfg.multiplier).withColumn("opened", F.col("t") + cfg.delay)
    held = trades.select("opened", "expiry", "option_type", "strike", "iv", "delta", "n", "side").withColumn("t", F.explode(F.sequence("opened", F.greatest("expiry", "opened"))))
    pos = held.join(prices.select("t", "spot"), "t")
    left = F.greatest((F.col("expiry") - F.col("t")) / 365.0, F.lit(0.0))
    mark = pricing.black_scholes(F.col("option_type"), F.col("spot"), F.col("strike"), left, F.lit(cfg.rate), F.lit(cfg.dividend), F.greatest("iv", F.lit(1e-6)))
    pos = pos.withColumn("mark", mark * F.col("n") * F.col("side") * cfg.multiplier).withColumn("d", F.col("delta") * F.col("n") * F.col("side") * cfg.multiplier)
    daily = prices.select("t", "spot").join(pos.groupBy("t").agg(F.sum("mark").alias("value"), F.sum("d").alias("delta")), "t", "left").fillna(0.0, ["value", "delta"])
    daily = daily.withColumn("_i", F.row_number().over(days) - 1)
    want = F.when(F.col("_i") % cfg.hedge_every == 0, -F.col("delta"))
    daily = daily.withColumn("shares", F.coalesce(F.last(want, ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    costs = trades.groupBy(F.col("opened").alias("t")).agg(F.sum((F.col("ask") - F.col("bid")) / 2 * F.col("n") * cfg.multiplier + cfg.fee * F.col("n")).alias("trade_cost"), F.sum("premium").alias("premium"))
    daily = daily.join(costs, "t", "left").fillna(0.0, ["trade_cost", "premium"])
    turn = F.abs(F.col("shares") - zero(F.lag("shares").over(days)))
    daily = daily.withColumns({
        "option_pnl": F.col("value") - zero(F.lag("value").over(days)) - (F.col("premium") if cfg.premium_is_cost else 0.0),
        "hedge_pnl": zero(F.lag("shares").over(days) * (F.col("spot") - F.lag("spot").over(days))),
        "cost": F.col("trade_cost") + turn * F.col("spot") * cfg.hedge_bps / 1e4,
    })
    return trades, daily.withColumn("pnl", F.col("option_pnl") + F.col("hedge_pnl") - F.col("cost")).select("t", "spot", "value", "shares", "option_pnl", "hedge_pnl", "cost", "pnl")


def bucketed(trades: DataFrame, column: str, edges: list[float], name: str) -> DataFrame:
    """Right-closed intervals; outside them no bucket."""
    b = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        b = F.when((F.col(column) > lo) & (F.col(column) <= hi), f"({lo:g}, {hi:g}]").otherwise(b)
    return trades.withColumn(name, b)


def performance_by(trades: DataFrame, buckets: list[str], pnl: str = "pnl") -> DataFrame:
    """All groupings in one pass over the trades."""
    stacked = F.explode(F.array(*[F.struct(F.lit(b).alias("grouping"), F.col(b).cast("string").alias("bucket")) for b in buckets]))
    t = trades.withColumn("_b", stacked).filter("_b.bucket is not null")
    return t.groupBy("_b.grouping", "_b.bucket").agg(F.count("*").alias("contracts"), F.sum(pnl).alias("pnl"), F.avg(pnl).alias("mean_pnl"))
