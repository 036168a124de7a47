"""Hidden Markov models: expectation maximisation and filtering of one series, as arrays.

``fit_series`` and ``filter_series`` run them for every entity in a grouped map;
parallelism comes from entities and restarts.  ``OnlineFilter`` is the one-step
update that the streaming operator carries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Config:
    states: int = 2
    iterations: int = 50
    restarts: int = 3
    tolerance: float = 1e-4
    ridge: float = 1e-4
    sticky: float = 0.0
    dof: float | None = None
    seed: int = 0
    lags: int = 0
    inputs: tuple[str, ...] = ()
    #: Rows that a state lasts on average; each step sets the chance of staying by it.
    mean_duration: float | None = None
    #: Starts from a Gaussian mixture and even moves, not from k-means.
    mixture: bool = False
    #: Each state regresses the first feature on the others, the lags and the inputs.
    regression: bool = False


@dataclass
class Params:
    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = -np.inf

    def packed(self) -> list[float]:
        return np.concatenate([a.reshape(-1) for a in (self.start, self.moves, self.means, self.covs)]).tolist()

    @classmethod
    def unpacked(cls, flat: list[float], k: int, d: int) -> Params:
        a = np.asarray(flat, float)
        cut = np.cumsum([k, k * k, k * d])
        return cls(a[: cut[0]], a[cut[0] : cut[1]].reshape(k, k), a[cut[1] : cut[2]].reshape(k, d), a[cut[2] :].reshape(k, d, d))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres; far first choices, then Lloyd's steps."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None] - c) ** 2).sum(2).min(1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))]])
    for _ in range(steps):
        lab = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return lab, c


def emissions(x: np.ndarray, p: Params, dof: float | None = None) -> np.ndarray:
    """Log densities, normal or Student's."""
    out, d = np.empty((len(x), len(p.means))), x.shape[1]
    for j, (m, c) in enumerate(zip(p.means, p.covs, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        q, det = (z * z).sum(0), 2 * np.log(np.diag(low)).sum()
        if dof is None:
            out[:, j] = -0.5 * (q + det + d * math.log(2 * math.pi))
        else:
            out[:, j] = math.lgamma((dof + d) / 2) - math.lgamma(dof / 2) - 0.5 * (d * math.log(dof * math.pi) + det) - (dof + d) / 2 * np.log1p(q / dof)
    return out


def forward(loge: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities and each row's share of the log-likelihood."""
    out, scale, last = np.empty_like(loge), np.empty(len(loge)), None
    for t, row in enumerate(loge):
        top = row.max()
        a = (p.start if last is None else last @ p.moves) * np.exp(row - top)
        s = a.sum()
        last = out[t] = a / s if s > 0 else np.full(len(row), 1 / len(row))
        scale[t] = math.log(max(s, 1e-300)) + top
    return out, scale


def smooth(loge: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Filtered, smoothed, expected moves and log-likelihood."""
    f, scale = forward(loge, p)
    e = np.exp(loge - loge.max(1, keepdims=True))
    b, pair = np.ones(f.shape[1]), np.zeros_like(p.moves)
    g = np.empty_like(f)
    g[-1] = f[-1]
    for t in range(len(f) - 2, -1, -1):
        w = e[t + 1] * b
        joint = f[t][:, None] * p.moves * w
        joint /= max(joint.sum(), 1e-300)
        pair += joint
        g[t] = joint.sum(1)
        b = p.moves @ w
        b /= max(b.max(), 1e-300)
    return f, g, pair, float(scale.sum())


def maximise(x: np.ndarray, g: np.ndarray, pair: np.ndarray, c: Config) -> Params:
    w = g.sum(0) + 1e-12
    means = g.T @ x / w[:, None]
    covs = np.stack([(x - m).T @ ((x - m) * g[:, [j]]) / w[j] + c.ridge * np.eye(x.shape[1]) for j, m in enumerate(means)])
    return Params(g[0] / g[0].sum(), _moves(pair, c), means, covs)


def _moves(pair: np.ndarray, c: Config) -> np.ndarray:
    moves = pair + c.sticky * np.eye(len(pair)) + 1e-6
    moves = moves / moves.sum(1, keepdims=True)
    if c.mean_duration is not None:
        np.fill_diagonal(moves, np.clip(1 - 1 / c.mean_duration, 1e-12, 1 - 1e-12))
        moves = moves / moves.sum(1, keepdims=True)
    return moves


def gaussian_mixture(x: np.ndarray, k: int, rng: np.random.Generator, ridge: float, steps: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances by expectation maximisation from k-means."""
    g = np.eye(k)[kmeans(x, k, rng)[0]]
    last = -np.inf
    for _ in range(steps):
        w = g.sum(0) + 1e-12
        means = g.T @ x / w[:, None]
        covs = np.stack([(x - m).T @ ((x - m) * g[:, [j]]) / w[j] + ridge * np.eye(x.shape[1]) for j, m in enumerate(means)])
        p = Params(w / w.sum(), np.eye(k), means, covs)
        joint = emissions(x, p) + np.log(p.start)
        top = joint.max(1, keepdims=True)
        whole = top + np.log(np.exp(joint - top).sum(1, keepdims=True))
        g = np.exp(joint - whole)
        if abs(whole.mean() - last) < tolerance:
            break
        last = whole.mean()
    return p.start, means, covs


def first_params(x: np.ndarray, c: Config, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    if c.mixture:
        w, means, covs = gaussian_mixture(x, c.states, rng, c.ridge)
        return Params((w + 1e-12) / (w + 1e-12).sum(), np.full((c.states, c.states), 1 / c.states), means, covs)
    lab, _ = kmeans(x, c.states, rng)
    g = np.eye(c.states)[lab] * 0.9 + 0.1 / c.states
    return maximise(x, g, g[:-1].T @ g[1:], c)


@dataclass
class Regressions:
    """Each state's coefficients (constant first) and variance, beside the chain."""

    start: np.ndarray
    moves: np.ndarray
    coefficients: np.ndarray
    variances: np.ndarray
    loglik: float = -np.inf


def regression_emissions(y: np.ndarray, design_: np.ndarray, p: Regressions) -> np.ndarray:
    e = y[:, None] - design_ @ p.coefficients.T
    return -0.5 * (e * e / p.variances + np.log(2 * math.pi * p.variances))


def fit_regressions(y: np.ndarray, x: np.ndarray, c: Config) -> Regressions:
    """A switching regression of y on a constant and x (which may have no column), by expectation maximisation; states by their constant."""
    d, best = np.column_stack([np.ones(len(y)), x]), None
    for r in range(c.restarts):
        lab, _ = kmeans(np.column_stack([y, x]), c.states, np.random.default_rng(c.seed + r))
        g = np.eye(c.states)[lab] * 0.9 + 0.1 / c.states
        pair, last = g[:-1].T @ g[1:], -np.inf
        for _ in range(c.iterations):
            w = g.sum(0) + 1e-12
            gram = np.einsum("tk,ti,tj->kij", g, d, d) + 1e-9 * np.eye(d.shape[1])
            coef = np.linalg.solve(gram, np.einsum("tk,ti,t->ki", g, d, y)[:, :, None])[:, :, 0]
            var = (g * (y[:, None] - d @ coef.T) ** 2).sum(0) / w + c.ridge * y.var()
            p = Regressions(g[0] / g[0].sum(), _moves(pair, c), coef, var)
            _, g, pair, p.loglik = smooth(regression_emissions(y, d, p), p)
            if abs(p.loglik - last) < c.tolerance * (1 + abs(p.loglik)):
                break
            last = p.loglik
        if best is None or p.loglik > best.loglik:
            best = p
    o = np.argsort(best.coefficients[:, 0], kind="stable")
    return Regressions(best.start[o], best.moves[np.ix_(o, o)], best.coefficients[o], best.variances[o], best.loglik)


def fit(x: np.ndarray, c: Config = Config()) -> Params:
    """The best of several starts; states in the order of their first mean."""
    best = None
    for r in range(c.restarts):
        p = first_params(x, c, c.seed + r)
        last = -np.inf
        for _ in range(c.iterations):
            _, g, pair, ll = smooth(emissions(x, p, c.dof), p)
            p = maximise(x, g, pair, c)
            p.loglik = ll
            if abs(ll - last) < c.tolerance * (1 + abs(ll)):
                break
            last = ll
        if best is None or p.loglik > best.loglik:
            best = p
    o = np.argsort(best.means[:, 0], kind="stable")
    return Params(best.start[o], best.moves[np.ix_(o, o)], best.means[o], best.covs[o], best.loglik)


def learned(x: np.ndarray, c: Config):
    """The fitted chain, and the log densities of rows under it."""
    if c.regression:
        r = fit_regressions(x[:, 0], x[:, 1:], c)
        return r, lambda z: regression_emissions(z[:, 0], np.column_stack([np.ones(len(z)), z[:, 1:]]), r)
    p = fit(x, c)
    return p, lambda z: emissions(z, p, c.dof)


def duration_pmf(p: Params, longest: int = 100) -> np.ndarray:
    """Each state's chances of lasting 1, 2, ... rows: geometric, cut at the longest."""
    stay = 1 - 1 / np.maximum(expected_durations(p), 1.0)[:, None]
    mass = (1 - stay) * stay ** np.arange(longest)
    return mass / mass.sum(1, keepdims=True)


def expected_durations(p: Params) -> np.ndarray:
    return 1 / np.maximum(1 - np.diag(p.moves), 1e-12)


class OnlineFilter:
    """One observation at a time; the state is the last filtered vector."""

    def __init__(self, p: Params, dof: float | None = None, state: list[float] | None = None):
        self.p, self.dof, self.state = p, dof, None if state is None else np.asarray(state, float)

    def step(self, row: np.ndarray) -> np.ndarray:
        e = emissions(np.atleast_2d(row), self.p, self.dof)[0]
        a = (self.p.start if self.state is None else self.state @ self.p.moves) * np.exp(e - e.max())
        self.state = a / a.sum() if a.sum() > 0 else np.full(len(a), 1 / len(a))
        return self.state


def design(g: pd.DataFrame, features: list[str], c: Config) -> tuple[np.ndarray, np.ndarray]:
    """The rows' features with lags and inputs, and which rows are whole."""
    cols = [g[f].astype(float) for f in (*features, *c.inputs)]
    cols += [g[f].astype(float).shift(k) for k in range(1, c.lags + 1) for f in features]
    x = np.column_stack([s.to_numpy() for s in cols])
    return x, np.isfinite(x).all(1)


def run_series(df: DataFrame, features: list[str], c: Config = Config(), key: str = "asset", time: str = "t", smoothed: bool = False) -> DataFrame:
    """Fit each entity and label its rows: key, time, state and the states' probabilities (filtered unless ``smoothed``)."""
    kinds = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        x, ok = design(g, features, c)
        prob = np.full((len(g), c.states), np.nan)
        if ok.sum() > c.states * 2:
            p, density = learned(x[ok], c)
            f, s, _, _ = smooth(density(x[ok]), p)
            prob[ok] = s if smoothed else f
        state = pd.array(np.where(ok & ~np.isnan(prob[:, 0]), np.nan_to_num(prob).argmax(1), -1), "Int64")
        return pd.DataFrame({key: g[key].to_numpy(), time: g[time].to_numpy(), "state": [None if v < 0 else int(v) for v in state], "probabilities": [None if np.isnan(r[0]) else r.tolist() for r in prob]}).astype({"state": "Int32"})

    return df.select(key, time, *dict.fromkeys([*features, *c.inputs])).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {time} {kinds[time]}, state int, probabilities array<double>")


# What differs between the family's members.
VARIANTS: dict[str, Config] = {
    "gaussian-hmm": Config(), "sticky-hmm": Config(sticky=10.0), "student-t-hmm": Config(dof=5.0), "ar-hmm": Config(lags=1), "input-output-hmm": Config(), "gmm-hmm": Config(mixture=True),
    "hsmm": Config(mean_duration=10.0), "explicit-duration-latent-state": Config(mean_duration=10.0), "markov-switching-var": Config(lags=1), "markov-switching-ar": Config(lags=1, regression=True), "markov-switching-regression": Config(regression=True),
}


def variant(name: str, **changes) -> Config:
    return replace(VARIANTS[name], **changes)
