"""Synthetic regime series with known states: a generator for each scenario, a task for each series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _chain(rng, n: int, k: int, stay: float = 0.9) -> np.ndarray:
    s = np.empty(n, int)
    s[0] = rng.integers(k)
    for t in range(1, n):
        s[t] = s[t - 1] if k == 1 or rng.random() < stay else rng.choice([j for j in range(k) if j != s[t - 1]])
    return s


def _emit(rng, s, k, lo=-2.0, hi=2.0, small=0.6, large=1.4, noise=None):
    m, v = np.linspace(lo, hi, k), np.linspace(small, large, k)
    return m[s] + v[s] * (rng.normal(size=len(s)) if noise is None else noise)


def gaussian_hmm(rng, n, k=3):
    s = _chain(rng, n, k)
    return _emit(rng, s, k), s


def student_t_hmm(rng, n, k=3):
    s = _chain(rng, n, k)
    return _emit(rng, s, k, noise=rng.standard_t(5.0, n)), s


def hsmm_non_geometric(rng, n, k=3, pmf=(0.05, 0.15, 0.3, 0.3, 0.2)):
    out, state = [], int(rng.integers(k))
    while len(out) < n:
        out += [state] * (5 * (int(rng.choice(len(pmf), p=pmf)) + 1))
        state = int(rng.choice([j for j in range(k) if j != state]))
    s = np.array(out[:n])
    return _emit(rng, s, k), s


def markov_switching_ar(rng, n, k=2):
    s, x = _chain(rng, n, k), np.zeros(n)
    phi, sd = np.linspace(0.8, -0.4, k), np.linspace(0.5, 1.5, k)
    for t in range(1, n):
        x[t] = phi[s[t]] * x[t - 1] + sd[s[t]] * rng.normal()
    return x, s


def switching_stochastic_volatility(rng, n, k=2):
    s = _chain(rng, n, k)
    return np.exp((np.linspace(-1.5, 0.5, k)[s] + 0.2 * rng.normal(size=n)) / 2) * rng.normal(size=n), s


def switching_covariance(rng, n, k=3):
    s = _chain(rng, n, k)
    return np.sqrt(s + 1.0) * rng.normal(size=n), s


def abrupt_change_points(rng, n, cuts=(60, 130)):
    s = np.searchsorted(np.array(cuts), np.arange(n), side="right")
    return 3.0 * s + rng.normal(size=n), s


def gradual_transitions(rng, n, width=15.0):
    w = 1 / (1 + np.exp(-(np.arange(n) - n / 2) / width))
    return 4 * w - 2 + rng.normal(size=n), (w > 0.5).astype(int)


def recurring_regimes(rng, n, period=40):
    s = (np.arange(n) // (period // 2)) % 2
    return 4.0 * s - 2 + rng.normal(size=n), s


def non_recurring_regimes(rng, n, k=4):
    s = np.minimum(np.arange(n) * k // n, k - 1)
    return 2.0 * s + rng.normal(size=n), s


def rare_crisis_states(rng, n, share=0.03):
    s = (rng.random(n) < share).astype(int)
    return np.where(s == 1, -4 + 3 * rng.normal(size=n), rng.normal(size=n)), s


def overlapping_emissions(rng, n, k=2):
    s = _chain(rng, n, k)
    return np.linspace(-0.3, 0.3, k)[s] + rng.normal(size=n), s


def structural_drift(rng, n):
    return np.linspace(0, 3, n) + rng.normal(size=n), np.zeros(n, int)


def missing_observations(rng, n, share=0.1):
    x, s = gaussian_hmm(rng, n)
    x[rng.random(n) < share] = np.nan
    return x, s


def outliers(rng, n, share=0.03, magnitude=8.0):
    x, s = gaussian_hmm(rng, n)
    hit = rng.random(n) < share
    x[hit] += magnitude * rng.choice([-1, 1], hit.sum())
    return x, s


def misspecified_state_count(rng, n, true=3):
    return gaussian_hmm(rng, n, true)


SCENARIOS = {f.__name__: f for f in (gaussian_hmm, student_t_hmm, hsmm_non_geometric, markov_switching_ar, switching_stochastic_volatility, switching_covariance, abrupt_change_points, gradual_transitions, recurring_regimes, non_recurring_regimes, rare_crisis_states, overlapping_emissions, structural_drift, missing_observations, outliers, misspecified_state_count)}


def generate(spark: SparkSession, scenario: str, series: int = 4, n: int = 200, seed: int = 0) -> DataFrame:
    """asset, t, value, state; a series' seed is its own, so the result depends on no partitioning."""
    if scenario not in SCENARIOS:
        raise ValueError(f"no scenario {scenario}")
    make = SCENARIOS[scenario]

    def run(frames):
        for f in frames:
            for i in f["id"]:
                x, s = make(np.random.default_rng(seed + int(i)), n)
                yield pd.DataFrame({"asset": f"s{i}", "t": np.arange(n), "value": pd.array(np.where(np.isnan(x), 0, x), "float64"), "state": s.astype("int32"), "_gone": np.isnan(x)})

    made = spark.range(0, series, 1, min(series, 64)).mapInPandas(run, "asset string, t long, value double, state int, _gone boolean")
    return made.selectExpr("asset", "t", "CASE WHEN NOT _gone THEN value END AS value", "state")
