"""Forecast metrics, statistical tests and economic metrics as aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, div, normal_cdf, normal_pdf

N = NormalDist()


def point_errors(df: DataFrame, y: str = "y", f: str = "f", by: list[str] | None = None, eps: float = 1e-12) -> DataFrame:
    """MAE, RMSE and QLIKE over finite pairs."""
    ok = ~F.isnan(y) & ~F.isnan(f) & (F.abs(y) < float("inf")) & (F.abs(f) < float("inf"))
    e = F.col(y) - F.col(f)
    ratio = F.greatest(F.col(y), F.lit(eps)) / F.greatest(F.col(f), F.lit(eps))
    return df.filter(ok).groupBy(*(by or [])).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(ratio - F.ln(ratio) - 1).alias("qlike"))


def brier_score(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def multiclass_brier(probs: Column, label: Column) -> Column:
    """A row's squared distance from its one-hot label."""
    return F.aggregate(F.transform(probs, lambda x, i: F.pow(x - F.when(i == label, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)


def calibration(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Expected and greatest gap between confidence and frequency over equal bins, the last one closed."""
    b = df.withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).groupBy("_b").agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return b.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("expected_calibration_error"), F.max("gap").alias("calibration_error"))


def log_scores(df: DataFrame, density: str = "density", eps: float = 1e-12) -> DataFrame:
    return df.agg((-F.avg(F.ln(F.greatest(F.col(density), F.lit(eps))))).alias("predictive_log_score"), F.sum(F.when(F.col(density) > 0, F.ln(density))).alias("log_likelihood"))


def interval_scores(df: DataFrame, y: str = "y", lower: str = "lower", upper: str = "upper") -> DataFrame:
    return df.agg(F.avg(F.col(y).between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"), F.avg(F.col(upper) - F.col(lower)).alias("sharpness"))


def crps_normal(y: Column, mean: Column, std: Column) -> Column:
    z = (y - mean) / std
    return std * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def crps_samples(y: Column, samples: Column) -> Column:
    """From a sorted copy, so a row costs its sample's sort and not all pairs."""
    s, n = F.array_sort(samples), F.size(samples)
    near = F.aggregate(F.transform(s, lambda x: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(F.transform(s, lambda x, i: x * (2 * i + 1 - n)), F.lit(0.0), lambda a, x: a + x)
    return near - spread / (n * n)


def diebold_mariano(df: DataFrame, a: str, b: str, p: Panel = ASSET, bandwidth: int | None = None, alternative: str = "two-sided") -> DataFrame:
    """Mean loss difference over its Bartlett long-run deviation; a statistic and p-value for each series."""
    d = df.withColumn("_d", F.col(a) - F.col(b)).filter(F.col("_d").isNotNull())
    size = d.groupBy(p.key).agg(F.count("*").alias("n"), F.avg("_d").alias("_m"))
    lags = bandwidth if bandwidth is not None else int(round((size.agg(F.max("n")).first()[0] or 0) ** (1 / 3)))
    d = d.join(size, p.key).withColumn("_c", F.col("_d") - F.col("_m"))
    d = d.withColumn("_k", F.floor(F.pow(F.col("n"), F.lit(1 / 3)) + 1e-9) if bandwidth is None else F.lit(bandwidth))
    cov = [F.sum(F.col("_c") * F.col("_c"))]
    d = d.withColumns({f"_l{k}": p.lag("_c", k) for k in range(1, lags + 1)})
    long = F.sum(F.col("_c") * F.col("_c")) / F.first("n")
    for k in range(1, lags + 1):
        weight = F.greatest(F.lit(0.0), 1 - k / (F.first("_k") + 1.0))
        long = long + 2 * weight * F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)) / F.first("n")
    del cov
    got = d.groupBy(p.key).agg(F.first("n").alias("n"), F.first("_m").alias("mean_difference"), long.alias("long_run_variance"))
    stat = F.when(F.col("long_run_variance") > 0, F.col("mean_difference") / F.sqrt(F.col("long_run_variance") / F.col("n")))
    p_value = {"two-sided": 2 * (1 - normal_cdf(F.abs("statistic"))), "less": normal_cdf(F.col("statistic")), "greater": 1 - normal_cdf(F.col("statistic"))}[alternative]
    return got.withColumn("statistic", stat).withColumn("p_value", p_value)


def false_discovery(df: DataFrame, p_value: str = "p_value", alpha: float = 0.05, method: str = "benjamini-hochberg") -> DataFrame:
    """Adjusted p-values and rejections: bonferroni, holm, benjamini-hochberg or benjamini-yekutieli."""
    whole = Window.partitionBy(F.lit(0))
    df = df.withColumn("_m", F.count("*").over(whole).cast("double")).withColumn("_k", F.row_number().over(whole.orderBy(p_value)).cast("double"))
    up, down = whole.orderBy(F.col("_k")).rowsBetween(Window.unboundedPreceding, 0), whole.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(p_value)
    if method == "bonferroni":
        q = x * F.col("_m")
    elif method == "holm":
        q = F.max(x * (F.col("_m") - F.col("_k") + 1)).over(up)
    else:
        harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k) if method == "benjamini-yekutieli" else F.lit(1.0)
        q = F.min(x * F.col("_m") * harmonic / F.col("_k")).over(down)
    return df.withColumn("adjusted", F.least(q, F.lit(1.0))).withColumn("rejected", F.col("adjusted") <= alpha).drop("_m", "_k")


def economic_metrics(df: DataFrame, ret: str = "ret", year: float = 252.0, alpha: float = 0.05, risk_free: float = 0.0, p: Panel = ASSET) -> DataFrame:
    """Return, risk and tail figures of each series in two aggregations over one ordered pass."""
    r = F.col(ret)
    df = df.filter(r.isNotNull()).withColumn("_eq", F.exp(F.sum(F.ln(F.greatest(1 + r, F.lit(1e-12)))).over(p.upto)))
    df = df.withColumn("_dd", F.col("_eq") / F.greatest(F.max("_eq").over(p.upto), F.lit(0.0)) - 1)
    cut = df.groupBy(p.key).agg(F.percentile(ret, F.lit(alpha)).alias("value_at_risk"))
    excess = r - risk_free / year
    got = df.join(cut, p.key).groupBy(p.key).agg(
        F.count("*").alias("n"), F.first("value_at_risk").alias("value_at_risk"), F.avg(F.when(r <= F.col("value_at_risk"), r)).alias("expected_shortfall"),
        F.exp(F.sum(F.ln(F.greatest(1 + r, F.lit(1e-12)))) * year / F.count("*")).alias("_g"), (F.stddev_samp(r) * math.sqrt(year)).alias("volatility"), F.avg(excess).alias("_x"), F.stddev_samp(excess).alias("_s"),
        F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2))).alias("_down"), F.min("_dd").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_gain"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("_loss"),
    )
    got = got.withColumn("annual_return", F.col("_g") - 1)
    return got.select(p.key, "n", "annual_return", "volatility", (div("_x", "_s") * math.sqrt(year)).alias("sharpe"), (div("_x", "_down") * math.sqrt(year)).alias("sortino"), div("annual_return", F.abs("max_drawdown")).alias("calmar"), "max_drawdown", "value_at_risk", "expected_shortfall", "hit_rate", div("_gain", "_loss").alias("profit_factor"))


def conditional_economic_metrics(df: DataFrame, slice_: str, **how) -> DataFrame:
    """The same for each value of a column."""
    p = how.pop("p", ASSET)
    keyed = df.withColumn("_k", F.struct(p.key, slice_)).drop(p.key)
    got = economic_metrics(keyed.withColumnRenamed("_k", p.key), p=p, **how)
    return got.select(F.col(f"{p.key}.{p.key}").alias(p.key), F.col(f"{p.key}.{slice_}").alias(slice_), *[c for c in got.columns if c != p.key])


def sharpe_moments(df: DataFrame, ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    r = F.col(ret)
    m = df.filter(r.isNotNull()).groupBy(p.key).agg(F.count("*").cast("double").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"))
    d = df.filter(r.isNotNull()).join(m, p.key).groupBy(p.key).agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("s").alias("s"), F.avg(F.pow((r - F.col("m")) / F.col("s"), 3)).alias("skew"), F.avg(F.pow((r - F.col("m")) / F.col("s"), 4)).alias("kurt"))
    return d.withColumn("sr", div("m", "s"))


def probabilistic_sharpe(df: DataFrame, ret: str = "ret", benchmark: float = 0.0, p: Panel = ASSET) -> DataFrame:
    """Probability that the Sharpe ratio exceeds the benchmark, given skewness and kurtosis."""
    d = sharpe_moments(df, ret, p)
    var = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    z = (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(var, F.lit(1e-12)))
    return d.select(p.key, F.col("sr").alias("sharpe"), normal_cdf(z).alias("probabilistic_sharpe"))


def expected_max_sharpe(trials: int, deviation: float) -> float:
    """Of independent trials without skill."""
    if trials < 2:
        return 0.0
    e = 0.5772156649015329
    return deviation * ((1 - e) * N.inv_cdf(1 - 1 / trials) + e * N.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(df: DataFrame, trials: int, deviation: float, ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    return probabilistic_sharpe(df, ret, expected_max_sharpe(trials, deviation), p).withColumnRenamed("probabilistic_sharpe", "deflated_sharpe")


def bootstrap_indices(n: int, block: int, seed: int, kind: str = "stationary") -> np.ndarray:
    """Circular blocks: of fixed length (moving) or of geometric length (stationary)."""
    rng = np.random.default_rng(seed)
    if kind == "moving":
        starts = rng.integers(0, n, -(-n // block))
        return ((starts[:, None] + np.arange(block)) % n).reshape(-1)[:n]
    new = rng.random(n) < 1 / block
    new[0] = True
    start, at = rng.integers(0, n, n), np.flatnonzero(new)
    since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return (np.repeat(start[at], np.diff(np.append(at, n))) + since) % n


def bootstrap_tests(losses: DataFrame, models: list[str], benchmark: str, n_bootstrap: int = 1000, block: int = 10, seed: int = 0, kind: str = "stationary") -> dict[str, float]:
    """White's reality check and Hansen's test: the replications are dealt out, the losses (one row for each time) travel to them."""
    rows = losses.select(benchmark, *models).dropna().toPandas().to_numpy(float)  # one aligned series, the tests' own input
    d = rows[:, :1] - rows[:, 1:]
    n, mean = len(d), d.mean(0)
    sd = np.maximum(d.std(0, ddof=1), 1e-12)
    spark = losses.sparkSession

    def replicate(frames):
        import pandas as pd

        for f in frames:
            out = []
            for b in f["id"]:
                c = d[bootstrap_indices(n, block, seed + int(b), kind)].mean(0) - mean
                out.append((float(np.sqrt(n) * c.max()), float(max(0.0, (np.sqrt(n) * c / sd).max()))))
            yield pd.DataFrame(out, columns=["rc", "spa"])

    rc, spa = float(np.sqrt(n) * mean.max()), float(max(0.0, (np.sqrt(n) * mean / sd).max()))
    reps = spark.range(n_bootstrap).mapInPandas(replicate, "rc double, spa double")
    over = reps.agg(F.sum((F.col("rc") >= rc).cast("int")), F.sum((F.col("spa") >= spa).cast("int"))).first()
    return {"reality_check": rc, "reality_check_p": (1 + over[0]) / (n_bootstrap + 1), "spa": spa, "spa_p": (1 + over[1]) / (n_bootstrap + 1)}


def model_confidence_set(losses: DataFrame, models: list[str], alpha: float = 0.1, n_bootstrap: int = 500, block: int = 10, seed: int = 0) -> list[str]:
    """Models left after removing the worst while their differences are significant."""
    x = losses.select(*models).dropna().toPandas().to_numpy(float)
    boot = np.stack([x[bootstrap_indices(len(x), block, seed + b)].mean(0) for b in range(n_bootstrap)])
    alive = list(range(len(models)))
    while len(alive) > 1:
        m, b = x[:, alive].mean(0), boot[:, alive]
        gap, bgap = m - m.mean(), (b - b.mean(1, keepdims=True)) - (m - m.mean())
        sd = np.maximum(bgap.std(0), 1e-12)
        if (1 + (np.abs(bgap / sd).max(1) >= np.abs(gap / sd).max()).sum()) / (n_bootstrap + 1) > alpha:
            break
        alive.pop(int(np.argmax(gap / sd)))
    return [models[k] for k in alive]
