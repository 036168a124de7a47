"""Features of option surfaces and chains, by time; nearest picks skip missing values and break ties by the value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import div


def nearest(value: str, distance: Column, where: Column | None = None) -> Column:
    """The value at the least distance, the lower of equals."""
    ok = F.col(value).isNotNull() & distance.isNotNull() & (F.lit(True) if where is None else where)
    return F.min_by(F.col(value), F.when(ok, F.struct(distance, F.col(value))))


def atm_implied_volatility(df: DataFrame, moneyness: str = "moneyness", iv: str = "iv", time: str = "t") -> DataFrame:
    return df.groupBy(time).agg(nearest(iv, F.abs(F.col(moneyness) - 1)).alias("atm_iv"))


def _at(column: str, to: float):
    return F.abs(F.col(column) - to)


def skew(df: DataFrame, low: float = 0.25, high: float = 0.75, delta: str = "delta", iv: str = "iv", time: str = "t") -> DataFrame:
    return df.groupBy(time).agg((nearest(iv, _at(delta, low)) - nearest(iv, _at(delta, high))).alias("skew"))


def curvature(df: DataFrame, delta: str = "delta", iv: str = "iv", time: str = "t") -> DataFrame:
    a, b, c = (nearest(iv, _at(delta, x)) for x in (0.25, 0.5, 0.75))
    return df.groupBy(time).agg(((a - b) - (b - c)).alias("curvature"))


def term_structure_slope(df: DataFrame, near: float = 30.0, far: float = 90.0, tenor: str = "tenor_days", iv: str = "iv", time: str = "t") -> DataFrame:
    return df.groupBy(time).agg((nearest(iv, _at(tenor, far)) - nearest(iv, _at(tenor, near))).alias("term_slope"))


def tail_risk_prices(df: DataFrame, put: float = -0.1, call: float = 0.1, delta: str = "delta", price: str = "mid", time: str = "t") -> DataFrame:
    a, b = nearest(price, _at(delta, put), F.col(delta) < 0), nearest(price, _at(delta, call), F.col(delta) > 0)
    return df.groupBy(time).agg(a.alias("tail_put"), b.alias("tail_call")).withColumn("tail_ratio", div("tail_put", "tail_call"))


def put_call_relative_richness(df: DataFrame, at: float = 0.25, delta: str = "delta", iv: str = "iv", time: str = "t") -> DataFrame:
    d = F.abs(F.abs(F.col(delta)) - at)
    return df.groupBy(time).agg((nearest(iv, d, F.col(delta) < 0) - nearest(iv, d, F.col(delta) > 0)).alias("put_call_richness"))


def option_liquidity(df: DataFrame, bid: str = "bid", ask: str = "ask", volume: str = "volume", open_interest: str = "open_interest", time: str = "t") -> DataFrame:
    spread = div(F.col(ask) - F.col(bid), (F.col(ask) + F.col(bid)) / 2)
    return df.groupBy(time).agg(F.avg(spread).alias("mean_relative_spread"), F.sum(volume).alias("total_volume"), F.sum(open_interest).alias("total_open_interest"))


def exposure_proxies(df: DataFrame, spot: str = "spot", open_interest: str = "open_interest", delta: str = "delta", gamma: str = "gamma", vega: str = "vega", tenor: str = "tenor_days", multiplier: float = 100.0, time: str = "t") -> DataFrame:
    n = F.col(spot) * F.col(open_interest) * multiplier
    charm = -n * F.col(delta) / F.greatest(F.col(tenor).cast("double"), F.lit(1.0))
    return df.groupBy(time).agg(F.sum(n * F.col(gamma)).alias("gamma_exposure"), F.sum(n * F.col(vega) * F.col(delta)).alias("vanna_exposure"), F.sum(charm).alias("charm_exposure"))


def implied_correlation(index: DataFrame, components: DataFrame, time: str = "t") -> DataFrame:
    """index: time, index_iv; components: time, iv, weight. The panel's formula, relative to the mean variance."""
    c = components.groupBy(time).agg(F.sum(F.expr("weight * weight * iv * iv")).alias("_own"), F.avg(F.expr("iv * iv")).alias("_mean"), F.sum("weight").alias("_w"), F.sum(F.expr("weight * weight")).alias("_ww"))
    return index.join(c, time).select(time, div(div(F.expr("index_iv * index_iv - _own"), "_mean"), F.expr("_w * _w - _ww")).alias("implied_correlation"))


def pairwise_implied_correlation(index_variance: Column, variances: Column, weights: Column) -> Column:
    """From arrays: what the index's variance leaves over twice the sum of the pairs' products."""
    own = F.aggregate(F.zip_with(weights, variances, lambda w, v: w * w * v), F.lit(0.0), lambda a, x: a + x)
    root = F.zip_with(weights, variances, lambda w, v: w * F.sqrt(v))
    whole = F.aggregate(root, F.lit(0.0), lambda a, x: a + x)
    return div(index_variance - own, whole * whole - own)


def variance_risk_premium(df: DataFrame, implied: str = "implied", realized: str = "realized") -> DataFrame:
    i, r = F.col(implied) * F.col(implied), F.col(realized) * F.col(realized)
    return df.withColumns({"implied_variance": i, "realized_variance": r, "variance_risk_premium": i - r})


def delta_hedged_return(df: DataFrame, option_return: str = "option_return", underlying_return: str = "underlying_return", delta: str = "delta") -> DataFrame:
    return df.withColumn("delta_hedged_return", F.col(option_return) - F.col(delta) * F.col(underlying_return))


def surface_principal_components(wide: DataFrame, points: list[str], n: int = 3, time: str = "t", key: str | None = None) -> DataFrame:
    """Scores of the latest row on the expanding window's components; a component's largest loading is positive.

    Rows with a gap take no part.  The window keeps sums of the points and of their
    products, taken from the first whole row, so what a row carries does not grow.
    """
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    k = len(points)
    cols = [F.col(f"`{a}`").cast("double") for a in points]
    whole = F.lit(True)
    for c in cols:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    d = wide.select(*([key] if key else []), time, F.when(whole, F.array(*cols)).alias("_x"))
    d = d.withColumn("_o", F.first("_x", ignorenulls=True).over(w)).withColumn("_d", F.zip_with("_x", "_o", lambda x, o: x - o))
    at = lambda i: F.col("_d")[i]
    sums = [F.sum(at(i)).over(w) for i in range(k)]
    products = [F.sum(at(i) * at(j)).over(w) for i in range(k) for j in range(i, k)]
    d = d.select(*([key] if key else []), time, F.count("_x").over(w).alias("_n"), F.array(*sums).alias("_s"), F.array(*products).alias("_q"), F.last("_d", ignorenulls=True).over(w).alias("_last"))

    @F.pandas_udf("array<double>")
    def scores(rows: pd.Series, sums: pd.Series, products: pd.Series, last: pd.Series) -> pd.Series:
        upper = np.triu_indices(k)

        def one(m, s, q, x):
            if m < 2:
                return [None] * n
            s, scatter = np.asarray(s, float), np.zeros((k, k))
            scatter[upper] = np.asarray(q, float)
            scatter = scatter + np.triu(scatter, 1).T - np.outer(s, s) / m
            v = np.linalg.eigh(scatter)[1].T[::-1]
            v = v * np.sign(v[np.arange(k), np.abs(v).argmax(1)])[:, None]
            got = (v @ (np.asarray(x, float) - s / m))[: min(n, int(m), k)].tolist()
            return got + [None] * (n - len(got))

        return pd.Series([one(*r) for r in zip(rows, sums, products, last, strict=True)])

    got = d.withColumn("_p", scores("_n", "_s", "_q", "_last"))
    return got.select(*([key] if key else []), time, *[F.get("_p", F.lit(j)).alias(f"surface_pc_{j + 1}") for j in range(n)])


def option_factors(quotes: DataFrame, by: list[str], tenor: str = "tenor", delta: str = "delta", iv: str = "iv") -> DataFrame:
    """Smile, skew, curvature and term structure of each group of quotes.

    At the money is the quote whose delta is nearest to a half; wings lie at deltas
    up to 0.25 or from 0.75; skew needs quotes at exactly -0.25 and 0.25, and is 0
    without; of equally near quotes, and of equal deltas, the lowest volatility counts.
    """
    t, d, v = F.col(tenor), F.abs(F.col(delta)), F.col(iv)
    at = lambda x: F.min(F.when(F.col(delta) == x, v))
    g = quotes.groupBy(*by).agg(F.min(F.struct(F.abs(d - 0.5), v.alias("v")))["v"].alias("_atm"), F.avg(F.when((d <= 0.25) | (d >= 0.75), v)).alias("_wing"), at(-0.25).alias("_put"), at(0.25).alias("_call"), F.min(F.struct(t, v.alias("v")))["v"].alias("_front"), F.min(F.struct(-t, v.alias("v")))["v"].alias("_back"))
    g = g.withColumn("smile", F.coalesce(F.col("_wing") - F.col("_atm"), F.lit(0.0))).withColumn("skew", F.coalesce(F.col("_put") - F.col("_call"), F.lit(0.0)))
    return g.select(*by, "smile", "skew", (F.col("smile") - F.col("skew") / 2).alias("curvature"), (F.col("_back") - F.col("_front")).alias("term_structure"))
