"""Evaluation of models over the windows of every series: predictions, state metrics by window, and their summary."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import Panel
from tessera.operators import alignment, evaluation, splits, states
from tessera.operators.models import hmm, registry

# The metrics of a window, and the fields that two runs must share to be compared.
METRICS = ("regime_persistence", "switching_frequency", "state_entropy", "probability_entropy", "transition_stability", "brier_score")
CONTRACT = ("dataset", "features", "validation", "execution_delay", "costs", "target")


@dataclass(frozen=True)
class Descriptor:
    """What a metric needs, which way is better, and the probabilities it is meant for (``any`` or ``none``: all kinds)."""

    name: str
    inputs: frozenset[str]
    direction: str = "diagnostic"
    probabilities: str = "none"
    aggregation: str = "mean"

    def compatible(self, available: set[str], probabilities: str = "none") -> bool:
        return self.inputs <= available and self.probabilities in ("any", "none", probabilities)


DESCRIPTORS = {d.name: d for d in (
    Descriptor("regime_persistence", frozenset({"states"})), Descriptor("switching_frequency", frozenset({"states"})), Descriptor("state_entropy", frozenset({"states"})),
    Descriptor("probability_entropy", frozenset({"probabilities"}), probabilities="any"), Descriptor("transition_stability", frozenset({"states"}), "minimize"), Descriptor("brier_score", frozenset({"probabilities", "truth"}), "minimize", "filtered"),
)}


class ContractError(ValueError):
    """Two runs that do not answer the same question."""


@dataclass(frozen=True)
class Validation:
    """Windows as shares or rows: ``kind`` is expanding, rolling or purged; numbers below 1 are shares of a series' rows."""

    kind: str = "expanding"
    train: float = 0.5
    validation: float = 0.1
    test: float = 0.1
    step: int | None = None
    embargo: int = 0

    def __post_init__(self):
        if self.kind not in ("expanding", "rolling", "purged"):
            raise ValueError(f"no validation {self.kind}")

    def plan(self, n: int):
        a, b, c = (max(2, int(x * n) if x < 1 else int(x)) for x in (self.train, self.validation, self.test))
        made = {"expanding": lambda: splits.ExpandingWindow(a, b, c, self.step), "rolling": lambda: splits.rolling_window(a, b, c, self.step), "purged": lambda: splits.purged(a, b, c, self.step, self.embargo)}
        return made[self.kind]().split(n)


@dataclass(frozen=True)
class Evaluation:
    """What a configuration says; an unknown field or metric is an error."""

    model: str = "gaussian-hmm"
    parameters: dict = field(default_factory=dict)
    features: tuple[str, ...] = ("ret",)
    validation: Validation = Validation()
    metrics: tuple[str, ...] = METRICS[:5]
    truth: str | None = None
    aligned: bool = True
    contract: dict = field(default_factory=dict)

    def __post_init__(self):
        if bad := set(self.metrics) - set(METRICS):
            raise ValueError(f"no metric {', '.join(sorted(bad))}")
        if not registry.spec(self.model).filters:
            raise ValueError(f"{self.model} does not filter")
        registry.configuration(self.model, self.parameters)

    @classmethod
    def parse(cls, value: dict) -> Evaluation:
        if unknown := set(value) - {f.name for f in fields(cls)}:
            raise ValueError(f"no field {', '.join(sorted(unknown))}")
        held = dict(value)
        if isinstance(held.get("validation"), dict):
            held["validation"] = Validation(**held["validation"])
        return cls(**held | {k: tuple(held[k]) for k in ("features", "metrics") if k in held})


@dataclass
class Result:
    predictions: DataFrame
    windows: DataFrame
    summary: dict[str, float]


def predictions(df: DataFrame, e: Evaluation, key: str = "asset", time: str = "t") -> DataFrame:
    """key, split, t, role, unaligned_state, state and filtered probabilities of the rows that were not trained on."""
    config = hmm.Config(**registry.configuration(e.model, e.parameters) | {"inputs": tuple(e.parameters.get("inputs", ()))})
    got = evaluation.walk_forward(df, list(e.features), e.validation.plan, config, key, time).withColumnRenamed("state", "unaligned_state")
    if not e.aligned:
        return got.withColumn("state", F.col("unaligned_state"))
    mapped = mappings(got.join(df.select(key, time, *e.features), [key, time]), list(e.features), key)
    return got.join(mapped, [key, "split", "unaligned_state"], "left").withColumn("state", F.coalesce("aligned", "unaligned_state")).drop("aligned")


def mappings(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """key, split, unaligned_state and the state of the series' first split whose means are nearest, by least total cost; a row for each state of a split."""
    centres = df.groupBy(key, "split", "unaligned_state").agg(*[F.avg(f).alias(f) for f in features])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        side = {s: {"state_means": {int(r.unaligned_state): [getattr(r, f) for f in features] for r in part.itertuples()}} for s, part in g.groupby("split")}
        first, out = side[min(side)], []
        for s, here in side.items():
            import warnings

            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                found = alignment.align(first, here).mapping
            out += [(g[key].iloc[0], s, c, r) for c, r in found.items()]
        return pd.DataFrame(out, columns=[key, "split", "unaligned_state", "aligned"])

    kind = dict(df.dtypes)[key]
    return centres.groupBy(key).applyInPandas(run, f"{key} {kind}, split int, unaligned_state int, aligned int")


def window_metrics(pred: DataFrame, metrics: tuple[str, ...], key: str = "asset", time: str = "t", truth: DataFrame | None = None) -> DataFrame:
    """key, split, rows and a column for each metric."""
    d = pred.withColumn("_w", F.concat_ws("\u0001", key, F.col("split").cast("string")))
    p = Panel("_w", time)
    out = d.groupBy("_w", key, "split").agg(F.count("*").alias("rows"), F.avg(states.probability_entropy(F.col("probabilities"))).alias("probability_entropy"))
    out = out.join(states.persistence(d, "state", p).select("_w", F.col("persistence").alias("regime_persistence"), "switching_frequency"), "_w", "left")
    out = out.join(states.occupancy_entropy(d, "state", p=p).select("_w", F.col("entropy").alias("state_entropy")), "_w", "left")
    if "transition_stability" in metrics:
        out = out.join(_moves_change(d, p, key), ["_w"], "left")
    if truth is not None:
        # a row's squared distance from the true state's unit vector
        y = d.join(truth.select(key, time, F.col(truth.columns[-1]).cast("int").alias("_y")), [key, time])
        gap = F.aggregate(F.zip_with("probabilities", F.sequence(F.lit(0), F.size("probabilities") - 1), lambda q, k: F.pow(q - F.when(k == F.col("_y"), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)
        out = out.join(y.groupBy("_w").agg(F.avg(gap).alias("brier_score")), "_w", "left")
    return out.select(key, "split", "rows", *[m for m in METRICS if m in metrics and m in out.columns])


def _moves_change(d: DataFrame, p: Panel, key: str) -> DataFrame:
    """Frobenius distance of a window's matrix of moves from that of the window before; missing for the first."""
    m = states.transitions(d, "state", p).join(d.select("_w", key, "split").distinct(), "_w").select(key, "split", "from_state", "to_state", "probability")
    both = m.withColumn("_x", F.col("probability")).unionByName(m.withColumn("split", F.col("split") + 1).withColumn("_x", -F.col("probability")))
    gap = both.groupBy(key, "split", "from_state", "to_state").agg(F.sum("_x").alias("_d")).groupBy(key, "split").agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("transition_stability"))
    return gap.filter("split > 0").select(F.concat_ws("\u0001", key, F.col("split").cast("string")).alias("_w"), "transition_stability")


def summarised(windows: DataFrame, n: int) -> dict[str, float]:
    """Means over the windows of what is finite, and how many windows and predictions there are; a row of numbers."""
    names = [c for c in windows.columns if c in METRICS]
    r = windows.agg(F.count("*").alias("n_windows"), *[F.avg(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))).alias(c) for c in names]).first()
    return {"n_windows": float(r.n_windows), "n_predictions": float(n)} | {c: r[c] for c in names if r[c] is not None and math.isfinite(r[c])}


def evaluate(df: DataFrame, e: Evaluation, output: str | None = None, resume: bool = True, key: str = "asset", time: str = "t") -> Result:
    """Runs a configuration; below ``output`` the predictions are kept by the configuration's hash and read again."""
    from tessera.experiments import stable_hash

    spark, path = df.sparkSession, f"{output}/{stable_hash(asdict(e))[:16]}" if output else None
    held = None
    if path and resume:
        try:
            held = spark.read.parquet(f"{path}/predictions")
        except Exception as x:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(x):
                raise
    if held is None:
        held = predictions(df, e, key, time)
        if path:
            held.write.mode("overwrite").parquet(f"{path}/predictions")
            held = spark.read.parquet(f"{path}/predictions")
    truth = df.select(key, time, e.truth) if e.truth else None
    windows = window_metrics(held, e.metrics, key, time, truth)
    if path:
        windows.write.mode("overwrite").parquet(f"{path}/windows")
        windows = spark.read.parquet(f"{path}/windows")
    return Result(held, windows, summarised(windows, held.count()))


def differences(left: dict, right: dict, at: str = "") -> dict[str, tuple]:
    """The leaves in which two contracts differ, by their path; a missing leaf is None."""
    out: dict[str, tuple] = {}
    for k in sorted({*left, *right}):
        a, b, here = left.get(k), right.get(k), f"{at}.{k}" if at else str(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out |= differences(a, b, here)
        elif a != b:
            out[here] = (a, b)
    return out


def assert_comparable(left: dict, right: dict) -> None:
    if missing := [k for k in CONTRACT if k not in left or k not in right]:
        raise ContractError(f"not stated: {', '.join(missing)}")
    if found := differences({k: left[k] for k in CONTRACT}, {k: right[k] for k in CONTRACT}):
        raise ContractError(f"differ in {', '.join(found)}")


def compared(runs: dict[str, tuple[dict, dict[str, float]]], metric: str, lower_is_better: bool = True) -> dict[str, list]:
    """runs: name to contract and summary. Runs that answer the first one's question ranked by the metric; the others, and those without it, apart."""
    first = next(iter(runs.values()))[0] if runs else {}
    out: dict[str, list] = {"ranked": [], "incompatible": [], "missing_metric": []}
    for name, (contract, summary) in runs.items():
        try:
            assert_comparable(first, contract)
        except ContractError as x:
            out["incompatible"].append((name, str(x)))
            continue
        (out["ranked"] if metric in summary else out["missing_metric"]).append((name, summary.get(metric)))
    out["ranked"].sort(key=lambda r: r[1] if lower_is_better else -r[1])
    return out


def infer_features(df: DataFrame, reserved: tuple[str, ...] = ("t", "timestamp", "split", "availability_timestamp", "asset", "symbol")) -> list[str]:
    return [c for c in df.columns if c not in reserved]


def surface(points: DataFrame, tenor: str = "tenor", moneyness: str = "moneyness", value: str = "iv", levels: list[float] | None = None) -> DataFrame:
    """Mean volatility by tenor (rows) and moneyness (columns); the columns are the stated levels, or those found."""
    p = points.groupBy(tenor)
    return (p.pivot(moneyness, levels) if levels else p.pivot(moneyness)).agg(F.avg(value)).orderBy(tenor)


def occupancy_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Shares of the second label within each of the first."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))
