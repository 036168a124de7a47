"""Whole studies from one document: source, features, models, validation, evaluation, comparison, report; and searches."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from statistics import fmean

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import charts
from tessera.experiments import Registry, Report, SearchSpace, Stage, atomic_write, run_stages, stable_hash
from tessera.operators import runner
from tessera.operators.models import registry
from tessera.sources import providers

#: The stages in their order, and what each waits for.
STAGES = {"source": (), "features": ("source",), "models": (), "validation": (), "evaluation": ("features", "models", "validation"), "comparison": ("evaluation",), "report": ("comparison",)}


@dataclass(frozen=True)
class StagePlan:
    name: str
    after: tuple[str, ...]
    config: dict


@dataclass(frozen=True)
class Study:
    name: str
    stages: tuple[StagePlan, ...]

    def config(self, stage: str) -> dict:
        return next(s.config for s in self.stages if s.name == stage)


def plan(document: str | dict) -> Study:
    """The stages of a document (a path, or what it holds), in an order in which each comes after what it waits for."""
    held = providers.load_mapping(document) if isinstance(document, str) else document
    if unknown := set(held) - {"name", *STAGES}:
        raise ValueError(f"no stage {', '.join(sorted(unknown))}")
    return Study(held.get("name", "study"), tuple(StagePlan(n, after, held.get(n) or {}) for n, after in STAGES.items()))


def dry_run(document: str | dict, output: str | None = None) -> list[str]:
    """What is wrong with a study, without running it."""
    try:
        study = plan(document)
    except (ValueError, KeyError, OSError) as x:
        return [str(x)]
    wrong, models = [], study.config("models").get("candidates", [])
    if not models:
        wrong.append("models: no candidates")
    names = [m.get("name", m.get("model")) for m in models]
    wrong += [f"models: {n} is named twice" for n in sorted({n for n in names if names.count(n) > 1}, key=str)]
    for m in models:
        try:
            evaluation_of(study, m)
        except (ValueError, KeyError, TypeError, NotImplementedError) as x:
            wrong.append(f"models: {m.get('name', m.get('model'))}: {x}")
    source = study.config("source")
    if source.get("kind", "events") not in ("events", "table", "mock"):
        wrong.append(f"source: no kind {source['kind']}")
    if source.get("kind", "events") != "mock" and not source.get("path"):
        wrong.append("source: no path")
    if output and (Path(output) / study.name / "report.html").exists():
        wrong.append(f"report: {output}/{study.name} has one already")
    return wrong


def evaluation_of(study: Study, model: dict) -> runner.Evaluation:
    held = study.config("evaluation")
    return runner.Evaluation.parse({"model": model["model"], "parameters": model.get("parameters", {}), "features": study.config("features").get("columns", ["ret"]), "validation": study.config("validation"), **{k: held[k] for k in ("metrics", "truth", "aligned") if k in held}})


def contract_of(study: Study) -> dict:
    held = study.config("evaluation")
    return {"dataset": study.config("source"), "features": study.config("features"), "validation": study.config("validation"), "execution_delay": held.get("execution_delay", 0), "costs": held.get("costs", {}), "target": held.get("target", "state")}


def source_frame(spark: SparkSession, config: dict) -> DataFrame:
    """asset, t and values: hourly bars with returns of an events table, a Parquet table as it is, or mock bars."""
    kind = config.get("kind", "events")
    if kind == "events":
        from tessera.plans import inputs

        return inputs.returns(spark, config["path"]).dropna(subset=["ret"])
    if kind == "mock":
        bars = providers.ingest(spark, {"symbols": ["AAA", "BBB"]} | config)["equity_ohlcv"].withColumnRenamed("symbol", "asset")
        from tessera.functions.exprs import ASSET, div

        return bars.withColumn("ret", div("c", ASSET.lag("c")) - 1).dropna(subset=["ret"])
    return spark.read.parquet(config["path"])


def run(spark: SparkSession, document: str | dict, root: str = "experiments", resume: bool = True) -> dict:
    """Runs a study: a run of the registry with a summary for each model, their ranking and a report; unchanged stages are kept."""
    if wrong := dry_run(document):
        raise ValueError("; ".join(wrong))
    study = plan(document)
    tracked = Registry(root).start(study.name, {s.name: s.config for s in study.stages}, resume=resume)
    candidates = study.config("models")["candidates"]

    def evaluated(done):
        df, out = source_frame(spark, study.config("source")), {}
        for m in candidates:
            r = runner.evaluate(df, evaluation_of(study, m), f"{tracked.folder.resolve()}/evaluation", resume)
            out[m.get("name", m["model"])] = {"summary": r.summary, "windows": [w.asDict() for w in r.windows.orderBy("asset", "split").limit(1000).collect()]}
        return out

    def ranked(done):
        contract = contract_of(study)
        metric = study.config("comparison").get("metric", "regime_persistence")
        return runner.compared({n: (contract, e["summary"]) for n, e in done["evaluation"].items()}, metric, study.config("comparison").get("lower_is_better", False))

    def reported(done):
        return str(write_report(study.name, done["evaluation"], done["comparison"], tracked.folder / "report.html"))

    made = {"source": lambda d: study.config("source"), "features": lambda d: study.config("features"), "models": lambda d: [registry.configuration(m["model"], m.get("parameters")) for m in candidates], "validation": lambda d: study.config("validation"), "evaluation": evaluated, "comparison": ranked, "report": reported}
    done = run_stages(tracked, [Stage(s.name, made[s.name], s.config) for s in study.stages], resume)
    for name, e in done["evaluation"].items():
        tracked.log_metrics({f"{name}.{k}": v for k, v in e["summary"].items()})
    tracked.log_json("comparison", done["comparison"], "comparison")
    tracked.finish()
    return done | {"run": tracked.id}


def write_report(title: str, evaluated: dict, comparison: dict, path: Path) -> Path:
    """Ranking, summaries and a chart for each metric."""
    page = Report(title).table("Ranking", [{"model": n, "value": v} for n, v in comparison["ranked"]])
    page.table("Summaries", [{"model": n} | e["summary"] for n, e in evaluated.items()])
    metrics = sorted({k for e in evaluated.values() for k in e["summary"] if not k.startswith("n_")})
    page.parts += [charts.bar_chart({n: e["summary"].get(m, 0.0) for n, e in evaluated.items()}, m) for m in metrics]
    return page.write(path)


def discover(root: str) -> list[dict]:
    """All model documents below a folder, by path: their model and parameters."""
    out = []
    for p in sorted(Path(root).rglob("*.y*ml")):
        held = providers.load_mapping(str(p))
        if "model" in held:
            out.append({"path": str(p.relative_to(root)), "model": held["model"], "parameters": held.get("parameters", {})})
    return out


# --- searches ---------------------------------------------------------------


@dataclass
class EarlyStopping:
    """Says stop after ``patience`` trials without a better one, but not before ``least`` trials."""

    patience: int = 10
    least: int = 5
    best: float | None = None
    since: int = 0
    seen: int = 0

    def __call__(self, value: float) -> bool:
        self.seen += 1
        if self.best is None or value < self.best:
            self.best, self.since = value, 0
        else:
            self.since += 1
        return self.seen >= self.least and self.since >= self.patience


@dataclass(frozen=True)
class MetricObjective:
    """Metrics of a trial to one number, less being better; a constraint that is broken makes the trial void (infinite)."""

    evaluate: Callable[[dict], dict[str, float]]
    weights: dict[str, float]
    constraints: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def __call__(self, parameters: dict) -> float:
        got = self.evaluate(parameters)
        for name, (lo, hi) in self.constraints.items():
            if name not in got or (lo is not None and got[name] < lo) or (hi is not None and got[name] > hi):
                return float("inf")
        return sum(w * got[name] for name, w in self.weights.items())


def nested_objective(evaluate_fold: Callable[[dict, object], float], folds: Iterable, aggregate: Callable[[list[float]], float] = fmean, prune: Callable[[list[float]], bool] | None = None) -> Callable[[dict], float]:
    """An objective over inner folds; ``prune`` sees the scores so far and may end a trial as void."""
    kept = list(folds)

    def objective(parameters: dict) -> float:
        scores: list[float] = []
        for f in kept:
            scores.append(evaluate_fold(parameters, f))
            if prune and prune(scores):
                return float("inf")
        return aggregate(scores)

    return objective


@dataclass(frozen=True)
class Tuning:
    """A search's document; unknown fields are an error."""

    model: str
    space: dict
    trials: int = 20
    seed: int = 0
    patience: int | None = None
    weights: dict = field(default_factory=lambda: {"switching_frequency": 1.0})
    constraints: dict = field(default_factory=dict)

    def __post_init__(self):
        if unknown := set(self.space) - set(registry.spec(self.model).defaults):
            raise ValueError(f"{self.model} takes no {', '.join(sorted(unknown))}")
        if self.trials < 1:
            raise ValueError("at least one trial")

    @classmethod
    def from_yaml(cls, path: str) -> Tuning:
        return cls(**providers.load_mapping(path))


def search(space: dict, objective: Callable[[dict], float], trials: int = 20, seed: int = 0, stop: EarlyStopping | None = None) -> dict:
    """Random search: the best trial, all trials, and how many were void."""
    rng, kept = random.Random(seed), []
    sampled = SearchSpace({k: v if isinstance(v, list) and not _range(v) else tuple(v) for k, v in space.items()})
    for _ in range(trials):
        p = sampled.sample(rng)
        kept.append({"value": objective(p), "parameters": p})
        if stop and stop(kept[-1]["value"]):
            break
    best = min(kept, key=lambda t: t["value"])
    return best | {"trials": kept, "void": sum(t["value"] == float("inf") for t in kept)}


def _range(v: list) -> bool:
    return len(v) in (2, 3) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v[:2]) and (len(v) == 2 or v[2] == "log")


def tune(spark: SparkSession, t: Tuning, df: DataFrame, features: list[str], validation: runner.Validation | None = None) -> dict:
    """The parameters whose windows score best."""

    def metrics(p: dict) -> dict[str, float]:
        return runner.evaluate(df, runner.Evaluation(t.model, p, tuple(features), validation or runner.Validation())).summary

    stop = EarlyStopping(t.patience) if t.patience else None
    return search(t.space, MetricObjective(metrics, t.weights, {k: tuple(v) for k, v in t.constraints.items()}), t.trials, t.seed, stop)


# --- artifacts ---------------------------------------------------------------


class Browser:
    """What a registry holds, read only."""

    def __init__(self, root: str = "experiments"):
        self.registry = Registry(root)

    def runs(self, group: str | None = None) -> list[dict]:
        return self.registry.runs(group)

    def matching(self, run_id: str, *terms: str) -> list[tuple[str, str]]:
        return self.registry.artifacts(run_id, *terms)

    def load_table(self, spark: SparkSession, path: str) -> DataFrame:
        """A JSON, CSV or Parquet artifact as a table."""
        suffix = Path(path).suffix
        if suffix == ".json":
            return spark.read.option("multiLine", True).json(path)
        if suffix == ".csv":
            return spark.read.option("header", True).option("inferSchema", True).csv(path)
        return spark.read.parquet(path)


def figures(spark: SparkSession, predictions: DataFrame, windows: DataFrame, key: str = "asset", time: str = "t", value: DataFrame | None = None, points: int = 2000) -> dict[str, str]:
    """Charts of a result: shares of states, moves, probabilities over time and the metrics by window.

    Aggregates are Spark's; over time a chart has at most ``points`` buckets, each
    with its rows' means, so what is drawn does not grow with the rows.
    """
    shares = {f"state {r.state}": r.share for r in runner.occupancy_crosstab(predictions.filter("state is not null").withColumn("_all", F.lit(1)), "_all", "state").orderBy("state").collect()}
    edge = predictions.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
    width = max(1, -(-((edge.b or 0) - (edge.a or 0) + 1) // points))
    states = predictions.agg(F.max(F.size("probabilities")).alias("k")).first().k or 0
    by_time = predictions.groupBy(F.floor((F.col(time) - (edge.a or 0)) / width).alias("_b")).agg(*[F.avg(F.col("probabilities")[j]).alias(f"p{j}") for j in range(states)]).orderBy("_b").collect()
    by_window = windows.groupBy("split").agg(*[F.avg(c).alias(c) for c in windows.columns if c in runner.METRICS]).orderBy("split").collect()
    out = {"occupancy": charts.bar_chart(shares, "Share of rows by state"), "probabilities": charts.probability_area_chart([[r[f"p{j}"] or 0.0 for j in range(states)] for r in by_time])}
    for c in windows.columns:
        if c in runner.METRICS:
            out[c] = charts.line_chart({c: [r[c] for r in by_window]}, c, "split")
    return out


def save_document(path: str, value: dict) -> None:
    atomic_write(Path(path), json.dumps(value, indent=1, default=str).encode())


def signature(e: runner.Evaluation) -> str:
    return stable_hash(asdict(e))
