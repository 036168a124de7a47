"""Features across the entities of a time; one row for each time, or entity and time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, div


def breadth(df: DataFrame, ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    """Missing returns count in the denominator."""
    up, down = (F.avg(F.coalesce((c).cast("double"), F.lit(0.0))) for c in (F.col(ret) > 0, F.col(ret) < 0))
    return df.groupBy(p.time).agg(up.alias("advancing"), (up - down).alias("net_breadth"))


def dispersion(df: DataFrame, ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    q = lambda x: F.percentile(ret, F.lit(x))
    return df.groupBy(p.time).agg(F.stddev_samp(ret).alias("dispersion"), (q(0.75) - q(0.25)).alias("interquartile_range"))


def concentration(df: DataFrame, weight: str = "weight", top: int = 5, p: Panel = ASSET) -> DataFrame:
    at = Window.partitionBy(p.time)
    df = df.withColumn("_s", div(F.abs(weight), F.sum(F.abs(weight)).over(at))).withColumn("_r", F.row_number().over(at.orderBy(F.col("_s").desc_nulls_last(), p.key)))
    return df.groupBy(p.time).agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.sum(F.when(F.col("_r") <= top, F.col("_s"))).alias(f"top_{top}_share"))


def factor_crowding(df: DataFrame, factor: str = "factor", exposure: str = "exposure", weight: str = "weight") -> DataFrame:
    return df.groupBy(factor).agg(F.try_divide(F.sum(F.abs(exposure) * F.abs(weight)), F.sum(F.abs(weight))).alias("crowding"))


def factor_returns(df: DataFrame, factors: list[str], ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    """Least squares without intercept at each time; one or two factors in closed form, more in a grouped map."""
    y = F.col(ret)
    df = df.dropna(subset=[ret, *factors])
    s = lambda a, b: F.sum(a * b)
    if len(factors) == 1:
        (a,) = factors
        return df.groupBy(p.time).agg(F.try_divide(s(F.col(a), y), s(F.col(a), F.col(a))).alias(a))
    if len(factors) == 2:
        a, b = (F.col(f) for f in factors)
        m = df.groupBy(p.time).agg(s(a, a).alias("aa"), s(a, b).alias("ab"), s(b, b).alias("bb"), s(a, y).alias("ay"), s(b, y).alias("by"))
        det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
        det = F.when(F.abs(det) > 1e-12 * F.col("aa") * F.col("bb"), det)
        return m.select(p.time, F.try_divide(F.expr("ay * bb - by * ab"), det).alias(factors[0]), F.try_divide(F.expr("by * aa - ay * ab"), det).alias(factors[1]))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        beta = np.linalg.lstsq(g[factors].to_numpy(float), g[ret].to_numpy(float), rcond=None)[0]
        return pd.DataFrame([[g[p.time].iloc[0], *beta]], columns=[p.time, *factors])

    kind = dict(df.dtypes)[p.time]
    return df.select(p.time, ret, *factors).groupBy(p.time).applyInPandas(solve, f"{p.time} {kind}, " + ", ".join(f"`{f}` double" for f in factors))


def residual_volatility(df: DataFrame, betas: DataFrame, factor_rows: DataFrame, window: int = 63, ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    """betas: entity, factor, beta; factor_rows: time, factor, f. Deviation of what the factors leave."""
    fitted = betas.join(factor_rows, "factor").groupBy(p.key, p.time).agg(F.sum(F.col("beta") * F.col("f")).alias("_fit"))
    df = df.join(fitted, [p.key, p.time], "left").withColumn("residual", F.col(ret) - F.col("_fit"))
    return df.withColumn("residual_vol", p.std("residual", window)).drop("_fit")


def correlation_distribution(df: DataFrame, window: int = 63, ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    """Mean, deviation and ninth decile of the pairwise correlations over the last rows, as many as there are."""
    a = df.select(F.col(p.time).alias("_t"), F.col(p.key).alias("_a"), F.col(ret).alias("_x"))
    b = df.select(F.col(p.time).alias("_t"), F.col(p.key).alias("_b"), F.col(ret).alias("_y"))
    w = Window.partitionBy("_a", "_b").orderBy("_t").rowsBetween(-(window - 1), 0)
    pairs = a.join(b, "_t").filter("_a < _b").withColumn("_ok", F.col("_x").isNotNull() & F.col("_y").isNotNull())
    x, y = F.when(F.col("_ok"), F.col("_x")), F.when(F.col("_ok"), F.col("_y"))
    cor = div(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))
    return pairs.withColumn("_r", cor).groupBy(F.col("_t").alias(p.time)).agg(F.avg("_r").alias("mean_correlation"), F.stddev_pop("_r").alias("std_correlation"), F.percentile("_r", F.lit(0.9)).alias("p90_correlation"))


def leading_covariance_eigenvalues(wide: DataFrame, assets: list[str], window: int = 63, n: int = 3, time: str = "t", key: str | None = None) -> DataFrame:
    """Shares of the largest eigenvalues of the trailing covariance; entities with a gap in the window are left out."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(time).rowsBetween(-(window - 1), 0)

    @F.pandas_udf("array<double>")
    def shares(rows: pd.Series) -> pd.Series:
        def one(r):
            x = np.array([[np.nan if v is None else v for v in row] for row in r], float)
            x = x[:, ~np.isnan(x).any(0)]
            if len(x) < 2 or not x.shape[1]:
                return [None] * n
            e = np.linalg.eigvalsh(np.atleast_2d(np.cov(x, rowvar=False)))[::-1]
            e = np.maximum(e, 0)
            s = (e / e.sum() if e.sum() > 0 else e * np.nan)[:n].tolist()
            return s + [None] * (n - len(s))

        return rows.map(one)

    got = wide.withColumn("_w", F.collect_list(F.array(*[F.col(f"`{a}`").cast("double") for a in assets])).over(w)).withColumn("_e", shares("_w"))
    return got.select(*([key] if key else []), time, *[F.get("_e", F.lit(k)).alias(f"eigenvalue_share_{k + 1}") for k in range(n)])
