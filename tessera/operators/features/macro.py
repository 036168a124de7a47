"""Macro features: dependence between markets, curves, spreads, surprises and policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, clean, div
from tessera.operators.features.risk import rolling_dependence


def equity_rates_dependence(df: DataFrame, equity: str = "equity", rates: str = "rates", window: int = 63, p: Panel = ASSET) -> DataFrame:
    return rolling_dependence(df, equity, rates, "equity_rates", window, p)


def equity_credit_dependence(df: DataFrame, equity: str = "equity", credit: str = "credit", window: int = 63, p: Panel = ASSET) -> DataFrame:
    return rolling_dependence(df, equity, credit, "equity_credit", window, p)


def dollar_and_commodity_relationships(df: DataFrame, equity: str = "equity", dollar: str = "dollar", commodity: str = "commodity", window: int = 63, p: Panel = ASSET) -> DataFrame:
    return rolling_dependence(rolling_dependence(df, equity, dollar, "equity_dollar", window, p), equity, commodity, "equity_commodity", window, p)


def yield_curve_factors(df: DataFrame, tenors: list[str], short: str = "2y", belly: str = "5y", long: str = "10y") -> DataFrame:
    """Wide curves: level over the tenors that are there, slope and curvature."""
    there = [F.when(F.col(f"`{t}`").isNotNull(), 1).otherwise(0) for t in tenors]
    total = sum((F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in tenors), F.lit(0.0))
    s, b, x = (F.col(f"`{t}`") for t in (short, belly, long))
    return df.withColumns({"level": div(total, sum(there, F.lit(0))), "slope": x - s, "curvature": 2 * b - s - x})


def credit_spreads(df: DataFrame, windows=(21, 63), spread: str = "spread", p: Panel = ASSET) -> DataFrame:
    out = {"spread_level": F.col(spread), "spread_change": F.col(spread) - p.lag(spread)}
    for n in windows:
        out[f"spread_z_{n}"] = clean(div(F.col(spread) - p.mean(spread, n), p.std(spread, n)))
    return df.withColumns(out)


def _expanding_z(p: Panel, x: str):
    return clean(div(F.col(x) - F.avg(x).over(p.upto), F.stddev_samp(x).over(p.upto)))


def surprises(df: DataFrame, names=("inflation", "growth"), p: Panel = ASSET) -> DataFrame:
    """Columns ``<name>_actual`` and ``<name>_consensus``: surprise and its expanding z-score."""
    df = df.withColumns({f"{n}_surprise": F.col(f"{n}_actual") - F.col(f"{n}_consensus") for n in names})
    return df.withColumns({f"{n}_surprise_z": _expanding_z(p, f"{n}_surprise") for n in names})


def monetary_policy_features(df: DataFrame, target: str = "policy_rate", expected: str = "expected_policy_rate", assets: str = "central_bank_assets", p: Panel = ASSET) -> DataFrame:
    df = df.withColumns({"policy_change": F.col(target) - p.lag(target), "policy_surprise": F.col(target) - F.col(expected), "balance_sheet_growth": clean(div(assets, p.lag(assets)) - 1)})
    return df.withColumn("policy_surprise_z", _expanding_z(p, "policy_surprise"))
