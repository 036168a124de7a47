"""Rule models: threshold votes, rolling percentiles and hysteresis as expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel


@dataclass(frozen=True)
class Threshold:
    feature: str
    value: float
    above: bool = True
    weight: float = 1.0

    def vote(self) -> Column:
        """1 for risk-off, 0 for risk-on, missing where the feature is."""
        c = F.col(self.feature)
        return F.when(c.isNotNull() & ~F.isnan(c), ((c >= self.value) if self.above else (c <= self.value)).cast("double"))


# The default rules (feature, threshold, whether above is risk-off).
DEFAULTS = {
    "volatility": Threshold("volatility", 0.2),
    "correlation": Threshold("correlation", 0.7),
    "liquidity": Threshold("liquidity", 0.0, False),
    "breadth": Threshold("breadth", 0.5, False),
    "trend": Threshold("trend", 0.0, False),
    "credit": Threshold("credit", 0.0),
    "skew": Threshold("skew", 0.0, False),
    "term_structure": Threshold("term_structure", 0.0, False),
}


def default_rule(name: str, feature: str | None = None, value: float | None = None) -> StaticRule:
    """The rule of one risk (volatility, correlation, liquidity, breadth, trend, credit, skew or term_structure), its feature or threshold replaced if given."""
    t = DEFAULTS[name]
    return StaticRule((Threshold(feature or t.feature, t.value if value is None else value, t.above, t.weight),))


class RuleModel:
    """A rule as a model: nothing to fit, a state for every row (missing where no feature votes), and saved as JSON."""

    def __init__(self, rule: StaticRule):
        self.rule = rule

    def fit(self, df: DataFrame) -> RuleModel:
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.rule.predict(df)

    def to_json(self) -> str:
        return json.dumps(asdict(self.rule), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RuleModel:
        held = json.loads(text)
        return cls(StaticRule(**held | {"thresholds": tuple(Threshold(**t) for t in held["thresholds"])}))


def calibrate(score: Column, method: str = "none") -> Column:
    if method == "clip":
        return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return 1 / (1 + F.exp(-8 * (score - 0.5))) if method == "logistic" else score


@dataclass(frozen=True)
class StaticRule:
    """Weighted share of risk-off votes; a missing feature abstains, or votes as the policy says."""

    thresholds: tuple[Threshold, ...]
    policy: str = "propagate"
    decision: float = 0.5
    calibration: str = "none"
    weights: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        total, votes = F.lit(0.0), F.lit(0.0)
        for t in self.thresholds:
            v, w = t.vote(), float(self.weights.get(t.feature, t.weight))
            if self.policy in ("risk_off", "risk_on"):
                v = F.coalesce(v, F.lit(1.0 if self.policy == "risk_off" else 0.0))
            votes = votes + F.coalesce(v, F.lit(0.0)) * w
            total = total + F.when(v.isNotNull(), w).otherwise(0.0)
        score = calibrate(F.try_divide(votes, total), self.calibration)
        return df.withColumn("score", score).withColumn("state", (F.col("score") >= self.decision).cast("int"))


def composite(thresholds: tuple[Threshold, ...], weights: dict, decision: float = 0.5) -> StaticRule:
    return StaticRule(thresholds, "propagate", decision, "logistic", weights)


@dataclass(frozen=True)
class PercentileRule:
    feature: str
    quantile: float
    window: int
    least: int
    above: bool = True

    def predict(self, df: DataFrame, p: Panel = ASSET) -> DataFrame:
        cut = p.full(F.percentile(F.col(self.feature), F.lit(self.quantile)), self.feature, self.window, self.least)
        c = F.col(self.feature)
        return df.withColumn("threshold", cut).withColumn("state", ((c >= F.col("threshold")) if self.above else (c <= F.col("threshold"))).cast("int"))


@dataclass(frozen=True)
class HysteresisRule:
    """Enters at one level and leaves at another: the last event decides, so no row waits for a loop."""

    feature: str
    enter: float
    leave: float
    initial: int = 0
    missing: str = "propagate"

    def event(self) -> Column:
        c = F.col(self.feature)
        absent = {"risk_off": F.lit(1), "risk_on": F.lit(0)}.get(self.missing, F.lit(None).cast("int"))
        return F.when(c.isNull() | F.isnan(c), absent).when(c >= self.enter, 1).when(c <= self.leave, 0)

    def predict(self, df: DataFrame, p: Panel = ASSET) -> DataFrame:
        return df.withColumn("state", F.coalesce(F.last(self.event(), ignorenulls=True).over(p.upto), F.lit(self.initial)))
