"""States of two fits matched by what they are like, whatever their labels.

``describe`` reduces a labelled frame to a few numbers per state in Spark: means,
covariances, risk, duration samples, moves and quantiles.  Matching those is work
on as many rows as there are states, so it runs on the driver.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel
from tessera.operators import states

# The names of the distances.
DISTANCES = ("state_means", "covariances", "return_risk", "durations", "transitions", "distributions")
#: Quantiles that stand for a state's distribution, so what reaches the driver does not grow with the rows.
QUANTILES = 101


@dataclass(frozen=True)
class Method:
    """Which distances count, and how much; ``ambiguity`` is the share of a cost by which the next one must be larger."""

    distances: tuple[str, ...] = DISTANCES
    weights: dict[str, float] = field(default_factory=dict)
    ambiguity: float = 0.05
    epsilon: float = 1e-12

    @classmethod
    def of(cls, given) -> Method:
        if given is None or given == "auto":
            return cls()
        return given if isinstance(given, cls) else cls((given,) if isinstance(given, str) else tuple(given))


@dataclass(frozen=True)
class Alignment:
    costs: np.ndarray
    parts: dict[tuple[int, int], dict[str, float]]
    mapping: dict[int, int]
    matched: dict[int, float]
    ambiguous: tuple[int, ...]

    @property
    def total(self) -> float:
        return sum(self.matched.values())

    def relabelled(self, labels: list[int]) -> list[int]:
        """A label that is matched with none keeps its name."""
        return [self.mapping.get(x, x) for x in labels]


def describe(df: DataFrame, features: list[str], state: str = "state", p: Panel = ASSET) -> dict[str, dict[int, list]]:
    """distance name: state: its descriptor."""
    d, k = df.filter(F.col(state).isNotNull()), len(features)
    shares = [j / (QUANTILES - 1) for j in range(QUANTILES)]
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    aggs = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)] + [F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    aggs += [F.percentile(features[0], F.array(*map(F.lit, shares))).alias("q"), F.avg(features[0]).alias("r"), F.stddev_samp(features[0]).alias("s")]
    out: dict[str, dict[int, list]] = {n: {} for n in DISTANCES}
    for r in d.groupBy(F.col(state).cast("int").alias("state")).agg(*aggs).collect():
        cov = np.zeros((k, k))
        for i, (a, b) in enumerate(pairs):
            x, y = features.index(a), features.index(b)
            cov[x, y] = cov[y, x] = r[f"c{i}"] or 0.0
        out["state_means"][r.state] = [r[f"m{i}"] for i in range(k)]
        out["covariances"][r.state] = cov.reshape(-1).tolist()
        out["return_risk"][r.state] = [r.r or 0.0, r.s or 0.0]
        out["distributions"][r.state] = list(r.q or [])
    for r in states.runs(d, state, p).groupBy(F.col(state).cast("int").alias("state")).agg(F.percentile("length", F.array(*map(F.lit, shares))).alias("q")).collect():
        out["durations"][r.state] = list(r.q)
    found = sorted(out["state_means"])
    for r in states.transitions(d, state, p).groupBy(F.col("from_state").cast("int").alias("a"), F.col("to_state").cast("int").alias("b")).agg(F.avg("probability").alias("x")).collect():
        out["transitions"].setdefault(r.a, [0.0] * len(found))[found.index(r.b)] = r.x
    return {n: v for n, v in out.items() if v}


def earth_mover(a: np.ndarray, b: np.ndarray) -> float:
    """Area between the distribution functions of two samples."""
    at = np.sort(np.concatenate([a, b]))
    gap = np.searchsorted(np.sort(a), at[:-1], "right") / len(a) - np.searchsorted(np.sort(b), at[:-1], "right") / len(b)
    return float((np.abs(gap) * np.diff(at)).sum())


def distance(name: str, a, b) -> float:
    a, b = np.ravel(np.asarray(a, float)), np.ravel(np.asarray(b, float))
    if name in ("durations", "distributions"):
        return earth_mover(a, b)
    # a row of moves is compared whatever the order of the states it leads to
    return float(np.linalg.norm(np.sort(a) - np.sort(b) if name == "transitions" else a - b))


def align(reference: dict[str, dict[int, list]], candidate: dict[str, dict[int, list]], method=None) -> Alignment:
    """Least total cost over the distances that both sides have; two states that share none are an error."""
    how = Method.of(method)
    ours, theirs = (sorted({s for block in side.values() for s in block}) for side in (reference, candidate))
    parts = {(r, c): {n: distance(n, reference[n][r], candidate[n][c]) * how.weights.get(n, 1.0) for n in how.distances if r in reference.get(n, {}) and c in candidate.get(n, {})} for r in ours for c in theirs}
    if bare := [pair for pair, found in parts.items() if not found]:
        raise ValueError(f"states {bare[0]} share no descriptor")
    costs = np.array([[sum(parts[r, c].values()) for c in theirs] for r in ours])
    wide = costs if len(ours) <= len(theirs) else costs.T
    pairs = [(i, j) if wide is costs else (j, i) for i, j in enumerate(states.hungarian(wide))]
    unclear = []
    for i, j in pairs:
        others = [np.sort(line)[1] for line in (costs[i], costs[:, j]) if len(line) > 1]
        if others and min(others) - costs[i, j] <= max(how.epsilon, abs(costs[i, j]) * how.ambiguity):
            unclear.append(theirs[j])
            warnings.warn(f"state {theirs[j]} could as well be another than {ours[i]}", RuntimeWarning, stacklevel=2)
    return Alignment(costs, parts, {theirs[j]: ours[i] for i, j in pairs}, {theirs[j]: float(costs[i, j]) for i, j in pairs}, tuple(unclear))
