"""Liquidity features of quotes, trades and order flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, clean, div


def bid_ask_spreads(df: DataFrame, bid: str = "bid", ask: str = "ask") -> DataFrame:
    spread = F.col(ask) - F.col(bid)
    return df.withColumns({"spread": spread, "relative_spread": clean(div(spread, (F.col(ask) + F.col(bid)) / 2))})


def volume(df: DataFrame, vol: str = "volume", window: int = 21, p: Panel = ASSET) -> DataFrame:
    mean = p.mean(vol, window)
    return df.withColumns({"volume_mean": mean, "volume_shock": clean(div(vol, mean) - 1)})


def turnover(df: DataFrame, shares: str = "shares", vol: str = "volume") -> DataFrame:
    return df.withColumn("turnover", clean(div(vol, shares)))


def amihud(df: DataFrame, ret: str = "ret", dollar_volume: str = "dollar_volume", window: int = 21, p: Panel = ASSET) -> DataFrame:
    df = df.withColumn("amihud", clean(div(F.abs(ret), dollar_volume)))
    return df.withColumn("amihud_mean", p.mean("amihud", window))


def order_imbalance(df: DataFrame, buy: str = "buy_volume", sell: str = "sell_volume") -> DataFrame:
    net = F.col(buy) - F.col(sell)
    return df.withColumns({"order_imbalance": net, "order_imbalance_share": clean(div(net, F.col(buy) + F.col(sell)))})


def market_depth(df: DataFrame, bid_size: str = "bid_size", ask_size: str = "ask_size") -> DataFrame:
    depth = F.col(bid_size) + F.col(ask_size)
    return df.withColumns({"depth": depth, "depth_imbalance": clean(div(F.col(bid_size) - F.col(ask_size), depth))})


def quote_dispersion(df: DataFrame, bid: str = "bid", ask: str = "ask", venue: str = "venue", p: Panel = ASSET) -> DataFrame:
    """Spread of midpoints over the venues of a time; without venues, over five rows."""
    mid = (F.col(bid) + F.col(ask)) / 2
    if venue in df.columns:
        return df.groupBy(p.time).agg(F.stddev_samp(mid).alias("quote_dispersion"))
    return df.withColumn("_mid", mid).withColumn("quote_dispersion", p.std("_mid", 5)).drop("_mid")


def funding_and_borrow_proxies(df: DataFrame, rebate: str = "borrow_rebate", utilization: str = "borrow_utilization", funding: str = "funding_rate") -> DataFrame:
    """What the columns at hand allow."""
    out = {}
    if rebate in df.columns:
        out["borrow_cost"] = -F.col(rebate)
    if utilization in df.columns:
        out["borrow_pressure"] = F.col(utilization)
    if funding in df.columns:
        out["funding_cost"] = F.col(funding)
    return df.withColumns(out) if out else df
