"""Risk features of a return series, by entity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, clean, div

YEAR = 252.0


def realized_volatility(df: DataFrame, windows=(21, 63, 252), ret: str = "ret", year: float = YEAR, p: Panel = ASSET) -> DataFrame:
    return df.withColumns({f"realized_vol_{n}": clean(p.std(ret, n) * math.sqrt(year)) for n in windows})


def semivariance(df: DataFrame, windows=(21, 63), ret: str = "ret", year: float = YEAR, p: Panel = ASSET) -> DataFrame:
    r = F.col(ret)
    df = df.withColumns({"_dn": F.when(r.isNotNull(), F.pow(F.least(r, F.lit(0.0)), 2)), "_up": F.when(r.isNotNull(), F.pow(F.greatest(r, F.lit(0.0)), 2))})
    out = {}
    for n in windows:
        out |= {f"downside_semivariance_{n}": p.mean("_dn", n) * year, f"upside_semivariance_{n}": p.mean("_up", n) * year}
    return df.withColumns(out).drop("_dn", "_up")


def _bipower(p: Panel, n: int, year: float):
    return math.pi / 2 * p.sum("_bp", n) * year / n


def bipower_variation(df: DataFrame, windows=(21, 63), ret: str = "ret", year: float = YEAR, p: Panel = ASSET) -> DataFrame:
    df = df.withColumn("_bp", F.abs(ret) * F.abs(p.lag(ret)))
    return df.withColumns({f"bipower_variation_{n}": _bipower(p, n, year) for n in windows}).drop("_bp")


def jump_variation(df: DataFrame, windows=(21, 63), ret: str = "ret", year: float = YEAR, p: Panel = ASSET) -> DataFrame:
    """Realized less bipower variation, not below 0; missing where either is (``greatest`` skips missing values)."""
    df = df.withColumns({"_bp": F.abs(ret) * F.abs(p.lag(ret)), "_sq": F.col(ret) * F.col(ret)})
    out = {}
    for n in windows:
        d = p.sum("_sq", n) * year / n - _bipower(p, n, year)
        out[f"jump_variation_{n}"] = F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))
    return df.withColumns(out).drop("_bp", "_sq")


def volatility_of_volatility(df: DataFrame, vol_window: int = 21, windows=(21, 63), ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    df = df.withColumn("_v", p.std(ret, vol_window))
    return df.withColumns({f"vol_of_vol_{n}": p.std("_v", n) for n in windows}).drop("_v")


def tail_estimates(df: DataFrame, windows=(63, 252), quantiles=(0.01, 0.05), ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    """Rolling linear quantiles, and the mean of the returns at or below them."""
    out = {}
    for n in windows:
        got = F.collect_list(ret).over(p.rows(n))
        for q in quantiles:
            name, cut = f"{int(q * 100):02d}_{n}", F.percentile(F.col(ret), F.lit(q)).over(p.rows(n))
            whole = F.count(ret).over(p.rows(n)) == n
            out[f"var_{name}"] = F.when(whole, cut)
            out[f"_got_{n}"] = F.when(whole, got)
    df = df.withColumns(out)
    more = {}
    for n in windows:
        for q in quantiles:
            name = f"{int(q * 100):02d}_{n}"
            cut = F.col(f"var_{name}")
            tail = F.filter(f"_got_{n}", lambda x: x <= cut)  # noqa: B023  used at once
            more[f"es_{name}"] = F.try_divide(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x), F.size(tail))
    return df.withColumns(more).drop(*(f"_got_{n}" for n in windows))


def realized_beta(df: DataFrame, windows=(63, 252), ret: str = "ret", market: str = "market", p: Panel = ASSET) -> DataFrame:
    out = {}
    for n in windows:
        w = p.rows(n)
        whole = (F.count(F.when(F.col(ret).isNotNull() & F.col(market).isNotNull(), 1)).over(w) == n)
        out[f"beta_{n}"] = clean(F.when(whole, div(F.covar_samp(ret, market).over(w), F.var_samp(market).over(w))))
    return df.withColumns(out)


def rolling_dependence(df: DataFrame, left: str, right: str, name: str, window: int = 63, p: Panel = ASSET) -> DataFrame:
    """Rolling correlation and beta of a pair; a constant side gives a missing value."""
    w = p.rows(window)
    whole = F.count(F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), 1)).over(w) == window
    cov, sl, sr = F.covar_samp(left, right).over(w), F.stddev_samp(left).over(w), F.stddev_samp(right).over(w)
    return df.withColumns({f"{name}_correlation": clean(F.when(whole, div(cov, sl * sr))), f"{name}_beta": clean(F.when(whole, div(cov, F.var_samp(right).over(w))))})
