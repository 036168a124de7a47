"""Walk-forward evaluation, paired forecasting tasks, baselines and leaderboards."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, div
from tessera.operators import splits
from tessera.operators.models import hmm

# The loss of each forecasting task.
TASK_LOSSES = {"equity_return": "mse", "realized_volatility": "qlike", "correlation": "mse", "tail_event": "brier", "cross_sectional_ranking": "negative_spearman", "factor_timing": "mse"}


def walk_forward(df: DataFrame, features: list[str], make: Callable[[int], Iterable[splits.Split]], config: hmm.Config = hmm.Config(), key: str = "asset", time: str = "t") -> DataFrame:
    """A task for each entity and split fits on training rows and filters through the tested ones.

    ``make`` plans the splits of a series from its number of rows.  key, split, t, role,
    state and filtered probabilities of the validation and test rows.
    """
    kinds = dict(df.dtypes)
    cols = list(dict.fromkeys([*features, *config.inputs]))

    def deal(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        parts = [g.assign(split=k, role=s.roles(len(g))).dropna(subset=["role"]) for k, s in enumerate(make(len(g)))]
        return pd.concat(parts) if parts else g.iloc[:0].assign(split=0, role="")

    at = df.select(key, time, *[F.col(c).cast("double") for c in cols]).groupBy(key).applyInPandas(deal, f"{key} {kinds[key]}, {time} {kinds[time]}, {''.join(f'{c} double, ' for c in cols)}split int, role string")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        x, ok = hmm.design(g, features, config)
        train = ok & (g["role"] == "train").to_numpy()
        held = ok & ~train
        out = pd.DataFrame({key: g[key][held], "split": g["split"][held], time: g[time][held], "role": g["role"][held]})
        if train.sum() <= 2 * config.states or not held.any():
            return out.iloc[:0].assign(state=pd.Series(dtype="int32"), probabilities=pd.Series(dtype=object))
        p, density = hmm.learned(x[train], config)
        f, _ = hmm.forward(density(x[ok]), p)
        got = f[held[ok]]
        return out.assign(state=got.argmax(1).astype("int32"), probabilities=[r.tolist() for r in got])

    return at.groupBy(key, "split").applyInPandas(run, f"{key} {kinds[key]}, split int, {time} {kinds[time]}, role string, state int, probabilities array<double>")


def regime_baselines(df: DataFrame, ret: str = "ret", state: str = "state", window: int = 20, p: Panel = ASSET) -> DataFrame:
    """Returns of holding, of a trend rule that sees the rows before only, and of knowing each state's sign."""
    trend = F.avg(ret).over(p.order.rowsBetween(-window, -1))
    sign = df.groupBy(p.key, state).agg(F.signum(F.avg(ret)).alias("_s"))
    r = F.coalesce(F.col(ret), F.lit(0.0))
    return df.withColumn("_t", F.coalesce(F.signum(trend), F.lit(0.0))).join(sign, [p.key, state], "left").select(p.key, p.time, r.alias("no_regime"), (r * F.col("_t")).alias("simple_rule"), (r * F.coalesce("_s", F.lit(0.0))).alias("oracle"))


def loss(df: DataFrame, metric: str, y: str = "y", f: str = "f", eps: float = 1e-12) -> DataFrame:
    """A row's loss; the ranking loss is one for each time."""
    a, b = F.col(y), F.col(f)
    if metric == "negative_spearman":
        return negative_spearman(df, y, f)
    ratio = F.greatest(a, F.lit(eps)) / F.greatest(b, F.lit(eps))
    forms = {"mse": (a - b) * (a - b), "brier": (a - b) * (a - b), "mae": F.abs(a - b), "qlike": ratio - F.ln(ratio) - 1}
    return df.withColumn("loss", forms[metric])


def negative_spearman(df: DataFrame, y: str = "y", f: str = "f", p: Panel = ASSET) -> DataFrame:
    """Correlation of mean ranks at each time, negated."""
    at = Window.partitionBy(p.time)
    mean_rank = lambda c: F.rank().over(at.orderBy(c)) + (F.count("*").over(Window.partitionBy(p.time, c)) - 1) / 2.0
    r = df.filter(F.col(y).isNotNull() & F.col(f).isNotNull()).withColumns({"_a": mean_rank(y), "_b": mean_rank(f)})
    return r.groupBy(p.time).agg((-div(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))).alias("loss"))


@dataclass(frozen=True)
class Task:
    target: str
    features: tuple[str, ...]
    probabilities: tuple[str, ...]
    metric: str = "mse"

    def __post_init__(self):
        if both := set(self.features) & set(self.probabilities):
            raise ValueError(f"{sorted(both)} are features and probabilities")


def paired_task(df: DataFrame, task: Task, train, test) -> DataFrame:
    """Test rows with the forecasts that know no regime and that know it, and both losses."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    out = df
    for name, cols in (("agnostic", task.features), ("aware", (*task.features, *task.probabilities))):
        out = VectorAssembler(inputCols=list(cols), outputCol=f"_{name}", handleInvalid="skip").transform(out)
    fitted = {name: LinearRegression(featuresCol=f"_{name}", labelCol=task.target, predictionCol=name, regParam=1e-6).fit(out.filter(train)) for name in ("agnostic", "aware")}
    out = out.filter(test)
    for m in fitted.values():
        out = m.transform(out)
    for name in fitted:
        out = loss(out, task.metric, task.target, name).withColumnRenamed("loss", f"{name}_loss")
    return out.drop("_agnostic", "_aware")


def flatten_metrics(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    return df.unpivot([key], metrics, "metric", "value").filter(F.col("value").isNotNull())


def rank_models(df: DataFrame, metric: str, lower_is_better: bool = True, name: str = "model") -> DataFrame:
    """Places from 1; a missing value comes last."""
    by = F.col(metric).asc_nulls_last() if lower_is_better else F.col(metric).desc_nulls_last()
    return df.withColumn("place", F.row_number().over(Window.orderBy(by, name)))  # a row for each model


def preprocess(df: DataFrame, features: list[str], train, components: int | None = None) -> DataFrame:
    """Standardised on the training rows with pyspark.ml, then principal components if asked for."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True)]
    last = "_z"
    if components:
        stages.append(PCA(k=components, inputCol="_z", outputCol="_p"))
        last = "_p"
    got = Pipeline(stages=stages).fit(df.filter(train)).transform(df)
    return got.withColumn("features", vector_to_array(last)).drop("_x", "_z", "_p")


def ranked_stability(labels: list[list[int]]) -> float:
    from tessera.operators.states import pairwise_agreement

    return pairwise_agreement([np.asarray(x).tolist() for x in labels])
