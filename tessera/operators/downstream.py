"""Forecasting tasks with and without regime probabilities: designs, decisions and what they are worth."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, div
from tessera.operators import evaluation


@dataclass(frozen=True)
class Design:
    """What both arms share; the costs are rates per unit of turnover."""

    train: tuple
    test: tuple
    cadence: str = "once"
    delay: int = 0
    costs: dict[str, float] = field(default_factory=dict)

    @property
    def cost_rate(self) -> float:
        return float(self.costs.get("proportional_cost", 0.0)) + float(self.costs.get("half_spread", 0.0))

    def rows(self, part: tuple, time: str = "t") -> Column:
        return F.col(time).between(F.lit(part[0]), F.lit(part[1]))


@dataclass(frozen=True)
class Spec:
    name: str
    task: evaluation.Task
    design: Design
    realized: str | None = None
    periods: int = 252

    def position(self, forecast: Column) -> Column:
        """What a forecast is traded as: its sign, or less the more volatility is expected."""
        return F.when(forecast > 0, div(F.lit(0.01), forecast)) if self.name == "realized_volatility" else F.signum(forecast)


# The targets of the tasks, in the order in which they are best begun.
TARGETS = {"equity_return": "forward_return", "realized_volatility": "realized_volatility", "tail_event": "tail_event", "factor_timing": "factor_return", "correlation": "realized_correlation", "cross_sectional_ranking": "forward_return"}


def spec(name: str, features: tuple[str, ...], probabilities: tuple[str, ...], design: Design, target: str | None = None, realized: str | None = None, metric: str | None = None) -> Spec:
    """One of the six tasks with its own loss, or another that is named."""
    if name not in evaluation.TASK_LOSSES:
        raise ValueError(f"no task {name}")
    return Spec(name, evaluation.Task(target or TARGETS[name], tuple(features), tuple(probabilities), metric or evaluation.TASK_LOSSES[name]), design, realized)


def recommended(features: tuple[str, ...], probabilities: tuple[str, ...], design: Design) -> list[Spec]:
    return [spec(n, features, probabilities, design) for n in TARGETS]


def strategy_returns(df: DataFrame, position: str, realized: str, cost_rate: float = 0.0, delay: int = 0, name: str = "net", p: Panel = ASSET) -> DataFrame:
    """Adds turnover and the return after costs; rows without a position or a return take no part."""
    r = F.lag(realized, -delay).over(p.order) if delay else F.col(realized)
    d = df.withColumn("_r", r).filter(F.col(position).isNotNull() & F.col("_r").isNotNull())
    d = d.withColumn("turnover", F.abs(F.col(position) - F.coalesce(F.lag(position).over(p.order), F.lit(0.0))))
    return d.withColumn(name, F.col(position) * F.col("_r") - cost_rate * F.col("turnover")).drop("_r")


def economic_metrics(df: DataFrame, net: str = "net", periods: int = 252, p: Panel = ASSET) -> DataFrame:
    """Annualised return, volatility and their ratio, the deepest fall, and the mean turnover of each entity."""
    wealth = F.exp(F.sum(F.ln(F.greatest(1 + F.col(net), F.lit(1e-12)))).over(p.upto))
    d = df.withColumn("_w", wealth).withColumn("_fall", F.col("_w") / F.max("_w").over(p.upto) - 1)
    m = d.groupBy(p.key).agg((F.avg(net) * periods).alias("annualized_return"), (F.coalesce(F.stddev_samp(net), F.lit(0.0)) * periods**0.5).alias("annualized_volatility"), F.min("_fall").alias("max_drawdown"), F.avg("turnover").alias("turnover"))
    return m.withColumn("sharpe", F.when(F.col("annualized_volatility") > 0, F.col("annualized_return") / F.col("annualized_volatility")).otherwise(0.0))


def relative_improvement(agnostic: Column, aware: Column) -> Column:
    return F.when(agnostic == 0, 0.0).otherwise((agnostic - aware) / F.abs(agnostic))


def improvement(losses: DataFrame, agnostic: str = "agnostic_loss", aware: str = "aware_loss", by: list[str] | None = None) -> DataFrame:
    """Mean losses of both arms and what the regimes save."""
    m = losses.filter(F.col(agnostic).isNotNull() & F.col(aware).isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(agnostic).alias("agnostic_loss"), F.avg(aware).alias("aware_loss"))
    return m.withColumn("absolute_improvement", F.col("agnostic_loss") - F.col("aware_loss")).withColumn("relative_improvement", relative_improvement(F.col("agnostic_loss"), F.col("aware_loss")))


def evaluate(df: DataFrame, s: Spec, time: str = "t", p: Panel = ASSET) -> tuple[DataFrame, DataFrame | None]:
    """The improvement of the forecasts, and of trading on them where the task has a realised return."""
    got = evaluation.paired_task(df, s.task, s.design.rows(s.design.train, time), s.design.rows(s.design.test, time))
    if s.realized is None:
        return improvement(got), None
    arms = []
    for arm in ("agnostic", "aware"):
        traded = strategy_returns(got.withColumn("_p", s.position(F.col(arm))), "_p", s.realized, s.design.cost_rate, s.design.delay, "net", p)
        arms.append(economic_metrics(traded, "net", s.periods, p).withColumn("arm", F.lit(arm)))
    return improvement(got), arms[0].unionByName(arms[1])


def adjustments(trials: int, pruned: int = 0, stability: float | None = None) -> dict[str, float]:
    """What a comparison must know of the search before it: the trials that really ran, and how stable the winner is."""
    return {"effective_trials": float(max(trials - pruned, 1))} | ({} if stability is None else {"stability": stability})


def with_costs(s: Spec, **costs: float) -> Spec:
    return replace(s, design=replace(s.design, costs=costs))
