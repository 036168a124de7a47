"""Price features: each adds columns to a long panel of one row for an entity and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, clean, div


def _priced(df: DataFrame, p: Panel, price: str) -> DataFrame:
    return df.withColumn("_c", p.filled(price))


def multi_horizon_returns(df: DataFrame, horizons=(1, 5, 21, 63), price: str = "close", p: Panel = ASSET) -> DataFrame:
    df = _priced(df, p, price)
    return df.withColumns({f"return_{h}": clean(div("_c", p.lag("_c", h)) - 1) for h in horizons}).drop("_c")


def momentum(df: DataFrame, horizons=(21, 63, 126, 252), skip: int = 1, price: str = "close", p: Panel = ASSET) -> DataFrame:
    return df.withColumns({f"momentum_{h}": clean(div(p.lag(price, skip), p.lag(price, h + skip)) - 1) for h in horizons})


def reversal(df: DataFrame, horizons=(1, 5, 21), price: str = "close", p: Panel = ASSET) -> DataFrame:
    df = _priced(df, p, price)
    return df.withColumns({f"reversal_{h}": clean(-(div("_c", p.lag("_c", h)) - 1)) for h in horizons}).drop("_c")


def moving_average_relationships(df: DataFrame, windows=(10, 20, 50, 200), price: str = "close", p: Panel = ASSET) -> DataFrame:
    df = df.withColumns({f"_ma{n}": p.mean(price, n) for n in windows})
    out = {f"price_to_ma_{n}": clean(div(price, f"_ma{n}") - 1) for n in windows}
    out |= {f"ma_{a}_to_ma_{b}": clean(div(f"_ma{a}", f"_ma{b}") - 1) for a, b in zip(windows, windows[1:], strict=False)}
    return df.withColumns(out).drop(*(f"_ma{n}" for n in windows))


def trend_strength(df: DataFrame, windows=(20, 60), price: str = "close", p: Panel = ASSET) -> DataFrame:
    """Least-squares slope relative to the price, and the efficiency of the path."""
    df = df.withColumn("_rn", F.row_number().over(p.order).cast("double")).withColumn("_step", F.abs(F.col(price) - p.lag(price)))
    out = {}
    for n in windows:
        slope = F.covar_pop(F.col(price), F.col("_rn")).over(p.rows(n)) / ((n * n - 1) / 12.0)
        out[f"trend_slope_{n}"] = clean(div(F.when(F.count(price).over(p.rows(n)) == n, slope), price))
        out[f"trend_efficiency_{n}"] = clean(div(F.abs(F.col(price) - p.lag(price, n)), p.sum("_step", n)))
    return df.withColumns(out).drop("_rn", "_step")


def gap_and_overnight_returns(df: DataFrame, open_: str = "open", high: str = "high", low: str = "low", close: str = "close", p: Panel = ASSET) -> DataFrame:
    last = p.lag(close)
    return df.withColumns({
        "overnight_return": clean(div(open_, last) - 1),
        "intraday_return": clean(div(close, open_) - 1),
        "close_to_close_return": clean(div(close, last) - 1),
        "gap_to_range": clean(div(F.col(open_) - last, F.col(high) - F.col(low))),
    })


def drawdown(df: DataFrame, window: int = 252, price: str = "close", p: Panel = ASSET) -> DataFrame:
    df = df.withColumn("drawdown", clean(div(price, F.max(price).over(p.rows(window))) - 1))
    return df.withColumn("max_drawdown", F.min("drawdown").over(p.rows(window)))
