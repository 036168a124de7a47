"""Runs and their artifacts: a small transactional registry, staged pipelines with resume, reports and a command line."""

from __future__ import annotations

import argparse
import hashlib
import html
import json
import os
import pickle
import re
import sqlite3
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from statistics import fmean, pstdev

SECRET = re.compile(r"(?i)password|secret|token|api_?key|credential")


def redacted(value, name: str = ""):
    """Values under secret names replaced, at any depth."""
    if SECRET.search(name):
        return "***"
    if isinstance(value, dict):
        return {k: redacted(v, str(k)) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redacted(v, name) for v in value]
    return value


def without_none(value):
    if isinstance(value, dict):
        return {k: without_none(v) for k, v in value.items() if v is not None}
    return [without_none(v) for v in value if v is not None] if isinstance(value, (list, tuple)) else value


def stable_hash(value) -> str:
    return hashlib.sha256(json.dumps(redacted(value), sort_keys=True, default=str).encode()).hexdigest()


def atomic_write(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with tmp.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


class Checkpoints:
    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def save(self, name: str, value) -> None:
        atomic_write(self.folder / f"{name}.pkl", pickle.dumps(value))

    def load(self, name: str, default=None):
        p = self.folder / f"{name}.pkl"
        return pickle.loads(p.read_bytes()) if p.exists() else default


class Registry:
    """Groups, runs, artifacts, models and results."""

    def __init__(self, root: str | Path = "experiments"):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)
        self.db = sqlite3.connect(self.root / "experiments.sqlite3")
        self.db.executescript("""
            CREATE TABLE IF NOT EXISTS groups (name TEXT PRIMARY KEY, created REAL);
            CREATE TABLE IF NOT EXISTS runs (id TEXT PRIMARY KEY, grp TEXT, name TEXT, status TEXT, config TEXT, hash TEXT, started REAL, ended REAL);
            CREATE TABLE IF NOT EXISTS artifacts (run TEXT, kind TEXT, path TEXT, PRIMARY KEY (run, path));
            CREATE TABLE IF NOT EXISTS models (run TEXT, name TEXT, path TEXT, PRIMARY KEY (run, name));
            CREATE TABLE IF NOT EXISTS results (run TEXT, metric TEXT, value REAL, PRIMARY KEY (run, metric));""")

    def start(self, name: str, config: dict, group: str = "default", resume: bool = True) -> Run:
        """The latest unfinished run of the name and configuration, or a new one."""
        with self.db:
            self.db.execute("INSERT OR IGNORE INTO groups VALUES (?, ?)", (group, time.time()))
            h = stable_hash(config)
            row = self.db.execute("SELECT id FROM runs WHERE name = ? AND hash = ? AND grp = ? AND status <> 'completed' ORDER BY started DESC", (name, h, group)).fetchone() if resume else None
            run = row[0] if row else uuid.uuid4().hex
            if not row:
                self.db.execute("INSERT INTO runs VALUES (?, ?, ?, 'running', ?, ?, ?, NULL)", (run, group, name, json.dumps(redacted(config), default=str), h, time.time()))
        return Run(self, run, self.root / run)

    def runs(self, group: str | None = None) -> list[dict]:
        cur = self.db.execute("SELECT * FROM runs" + (" WHERE grp = ?" if group else "") + " ORDER BY started", (group,) if group else ())
        return [dict(zip([c[0] for c in cur.description], r, strict=True)) for r in cur]

    def results(self, run: str) -> dict[str, float]:
        return dict(self.db.execute("SELECT metric, value FROM results WHERE run = ?", (run,)))

    def artifacts(self, run: str, *terms: str) -> list[tuple[str, str]]:
        found = self.db.execute("SELECT kind, path FROM artifacts WHERE run = ? ORDER BY path", (run,)).fetchall()
        return [a for a in found if all(t.casefold() in f"{a[0]} {a[1]}".casefold() for t in terms)]

    def compare(self, group: str, metric: str, lower_is_better: bool = True) -> dict[str, list]:
        ranked, missing = [], []
        for r in self.runs(group):
            v = self.results(r["id"]).get(metric)
            (missing.append(r["name"]) if v is None else ranked.append((r["name"], v)))
        return {"ranked": sorted(ranked, key=lambda x: x[1] if lower_is_better else -x[1]), "missing": missing}


@dataclass
class Run:
    registry: Registry
    id: str
    folder: Path
    warnings: list[str] = field(default_factory=list)

    def log_json(self, name: str, value, kind: str = "json") -> Path:
        path = self.folder / f"{name}.json"
        atomic_write(path, json.dumps(without_none(redacted(value)), indent=1, default=str).encode())
        with self.registry.db:
            self.registry.db.execute("INSERT OR REPLACE INTO artifacts VALUES (?, ?, ?)", (self.id, kind, str(path)))
        return path

    def log_metrics(self, metrics: dict[str, float]) -> None:
        with self.registry.db:
            self.registry.db.executemany("INSERT OR REPLACE INTO results VALUES (?, ?, ?)", [(self.id, k, float(v)) for k, v in metrics.items()])

    def finish(self, status: str = "completed") -> None:
        with self.registry.db:
            self.registry.db.execute("UPDATE runs SET status = ?, ended = ? WHERE id = ?", (status, time.time(), self.id))


@dataclass(frozen=True)
class Stage:
    name: str
    work: Callable[[dict], object]
    config: dict = field(default_factory=dict)


def run_stages(run: Run, stages: list[Stage], resume: bool = True) -> dict:
    """In order; a stage whose configuration and predecessors are as before is not run again."""
    done, saved, mark = {}, Checkpoints(run.folder / "stages"), ""
    for s in stages:
        mark = stable_hash([mark, s.name, s.config])
        held = saved.load(s.name) if resume else None
        if held and held["mark"] == mark:
            done[s.name] = held["value"]
            continue
        done[s.name] = s.work(done)
        saved.save(s.name, {"mark": mark, "value": done[s.name]})
    return done


def stability(run_seed: Callable[[int], float], seeds: Iterable[int]) -> dict[str, float]:
    xs = [run_seed(s) for s in seeds]
    return {"mean": fmean(xs), "std": pstdev(xs)}


@dataclass
class SearchSpace:
    """name: (low, high), or a list of choices; a third item makes a range logarithmic."""

    parameters: dict

    def sample(self, rng) -> dict:
        import math

        out = {}
        for name, p in self.parameters.items():
            if isinstance(p, list):
                out[name] = p[rng.randrange(len(p))]
            elif len(p) == 3:
                out[name] = math.exp(rng.uniform(math.log(p[0]), math.log(p[1])))
            else:
                out[name] = rng.randint(*p) if all(isinstance(x, int) for x in p) else rng.uniform(*p)
        return out


def optimize(space: SearchSpace, objective: Callable[[dict], float], trials: int = 20, patience: int | None = None, seed: int = 0) -> dict:
    """Random search for the least value, stopped after ``patience`` trials without a better one."""
    import random

    rng, best, since, seen = random.Random(seed), None, 0, []
    for _ in range(trials):
        p = space.sample(rng)
        v = objective(p)
        seen.append((v, p))
        best, since = ((v, p), 0) if best is None or v < best[0] else (best, since + 1)
        if patience and since >= patience:
            break
    return {"value": best[0], "parameters": best[1], "trials": len(seen)}


class Report:
    """A page of tables and line charts from small aggregated results."""

    def __init__(self, title: str):
        self.title, self.parts = title, []

    def table(self, title: str, rows: list[dict]) -> Report:
        cols = list(rows[0]) if rows else []
        cell = lambda v: html.escape(f"{v:.6g}" if isinstance(v, float) else str(v))
        body = "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in cols) + "</tr>" for r in rows)
        self.parts.append(f"<h2>{html.escape(title)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in cols) + f"</tr>{body}</table>")
        return self

    def line(self, title: str, ys: list[float]) -> Report:
        ys = [y for y in ys if y == y]
        lo, hi = (min(ys), max(ys)) if ys else (0, 1)
        pts = " ".join(f"{600 * k / max(len(ys) - 1, 1):.1f},{150 - 140 * (y - lo) / ((hi - lo) or 1):.1f}" for k, y in enumerate(ys))
        self.parts.append(f'<h2>{html.escape(title)}</h2><svg width="600" height="160"><polyline fill="none" stroke="black" points="{pts}"/></svg>')
        return self

    def write(self, path: str | Path) -> Path:
        atomic_write(Path(path), f"<!doctype html><meta charset=utf-8><title>{html.escape(self.title)}</title><h1>{html.escape(self.title)}</h1>{''.join(self.parts)}".encode())
        return Path(path)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options):
        s = sub.add_parser(name)
        for x in positional:
            s.add_argument(x)
        for o, default in options.items():
            s.add_argument(f"--{o}", **({"required": True} if default is ... else {"default": default}))

    command("query", "what", data="/root/testdata/sf0.01", output=None)
    command("sql", "what", data="/root/testdata/sf0.01", output=None)
    command("synthetic", "scenario", output=...)
    command("models", family=None)
    command("describe", "model")
    command("compare", "group", metric="loss", root="experiments")
    command("ingest", "document", output=...)
    command("build", "query", data="/root/testdata/sf0.01", output=...)
    command("train", "model", data=..., features="ret", parameters="{}", output=...)
    command("evaluate", "model", data=..., features="ret", parameters="{}", output=...)
    command("tune", "document", data=..., features="ret", output=None)
    command("plan", "document")
    command("run", "document", root="experiments")
    command("report", "run", root="experiments")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    from tessera import workflow
    from tessera.operators.models import registry

    if a.command == "models":
        print("\n".join(registry.available(a.family)))
        return 0
    if a.command == "describe":
        print(json.dumps(registry.describe(a.model), default=str))
        return 0
    if a.command == "compare":
        print(json.dumps(Registry(a.root).compare(a.group, a.metric)))
        return 0
    if a.command == "plan":
        wrong = workflow.dry_run(a.document)
        print("\n".join(wrong or [f"{s.name} after {', '.join(s.after) or 'nothing'}" for s in workflow.plan(a.document).stages]))
        return 1 if wrong else 0
    if a.command == "report":
        r = Registry(a.root)
        print("\n".join(path for _, path in r.artifacts(a.run)) + f"\n{Path(a.root) / a.run / 'report.html'}\n" + json.dumps(r.results(a.run)))
        return 0
    from tessera.session import local_session

    spark = local_session()
    if a.command == "synthetic":
        from tessera.sources.synthetic import generate

        generate(spark, a.scenario).write.mode("overwrite").parquet(a.output)
        return 0
    if a.command == "ingest":
        from tessera.sources import providers

        for domain, df in providers.ingest(spark, providers.load_mapping(a.document)).items():
            df.write.mode("overwrite").parquet(f"{a.output}/{domain}")
        return 0
    if a.command == "run":
        done = workflow.run(spark, a.document, a.root)
        print(json.dumps({"run": done["run"], "comparison": done["comparison"], "report": done["report"]}))
        return 0
    if a.command in ("train", "evaluate"):
        from tessera.operators import runner

        df, features, given = spark.read.parquet(a.data), a.features.split(","), json.loads(a.parameters)
        if a.command == "train":
            registry.create(a.model, given).run(df, features).write.mode("overwrite").parquet(a.output)
        else:
            print(json.dumps(runner.evaluate(df, runner.Evaluation(a.model, given, tuple(features)), a.output).summary))
        return 0
    if a.command == "tune":
        found = workflow.tune(spark, workflow.Tuning.from_yaml(a.document), spark.read.parquet(a.data), a.features.split(","))
        workflow.save_document(a.output, found) if a.output else print(json.dumps(found, default=str))
        return 0
    from tessera.plans import catalog

    if a.command in ("query", "build"):
        df = catalog.queries()[a.what if a.command == "query" else a.query](spark, a.data)
    else:
        for f in Path(a.data).glob("*.parquet"):
            spark.read.parquet(str(f)).createOrReplaceTempView(f.stem)
        df = spark.sql(a.what)
    df.write.mode("overwrite").parquet(a.output) if a.output else df.show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
