"""Change-point detectors: one ordered series in a task, many series at once.

Each detector is a pure function of an array (scores and boundaries); ``detect``
runs it for every entity in a grouped map, and fills gaps forward, then backward,
then with 0.  The online detectors work in stretches between two alarms, where
their sums are plain cumulative ones; the offline ones work on prefix sums, over
one column or several.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Found = tuple[np.ndarray, list[int]]
#: Rows that are looked at first after an alarm; each further look is twice as long.
LOOK = 64


def _stretches(n: int, least: int, threshold: float, look_at: Callable) -> Found:
    """Scores up to each alarm, and the alarms.

    ``look_at(a, b, alarm, state)``: the scores of rows a to b and the state after
    them; ``alarm`` is the last one before (or None), ``state`` is None right after it.
    """
    scores, cuts, a, state, look = np.zeros(n), [], 0, None, LOOK
    while a < n:
        b = min(n, a + look)
        scores[a:b], state = look_at(a, b, cuts[-1] if cuts else None, state)
        look *= 2
        late = max(a, least) + np.flatnonzero(scores[max(a, least) : b] >= threshold)
        if len(late):
            cuts.append(int(late[0]))
            b, state, look = cuts[-1] + 1, None, LOOK
        a = b
    return scores, cuts


def _restarted(start: float, steps: np.ndarray) -> np.ndarray:
    """A sum that never falls below zero: the plain one less its lowest value so far."""
    total = start + np.cumsum(steps)
    return total - np.minimum(np.minimum.accumulate(total), 0.0)


def cusum(x: np.ndarray, threshold: float = 5.0, drift: float = 0.0, least: int = 5, mean: float | None = None, std: float | None = None) -> Found:
    """Two-sided sums of standardised deviations from the baseline; an alarm resets them and moves the mean to its value.

    The baseline is the first rows; its deviation is the sample's, and 1 where that is 0.
    """
    head = x[: max(1, least)]
    centre = float(head.mean()) if mean is None else mean
    spread = std or (float(head.std(ddof=1)) if len(head) > 1 else 0.0) or 1.0

    def look_at(a, b, alarm, state):
        z = (x[a:b] - (centre if alarm is None else x[alarm])) / spread
        up, down = (_restarted(s, sign * z - drift) for s, sign in zip(state or (0.0, 0.0), (1, -1), strict=True))
        return np.maximum(up, down), (float(up[-1]), float(down[-1]))

    return _stretches(len(x), least, threshold, look_at)


def page_hinkley(x: np.ndarray, threshold: float = 50.0, delta: float = 0.005, alpha: float = 0.999, least: int = 5) -> Found:
    """A faded sum of deviations from the running mean above its lowest value; an alarm resets both, and the mean to its value.

    The running mean counts all rows, those before an alarm as rows of the alarm's value.
    """

    def look_at(a, b, alarm, state):
        total, low, whole = state or (0.0, 0.0, 0.0 if alarm is None else x[alarm] * (alarm + 1))
        means = (whole + np.cumsum(x[a:b])) / np.arange(a + 1, b + 1)
        faded = np.array(list(itertools.accumulate(x[a:b] - means - delta, lambda t, v: alpha * t + v, initial=total))[1:])
        lows = np.minimum(np.minimum.accumulate(faded), low)
        return faded - lows, (float(faded[-1]), float(lows[-1]), float(means[-1] * b))

    return _stretches(len(x), least, threshold, look_at)


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the columns about their means, and of all squares."""
    x = x.reshape(len(x), -1)
    x = x - (x.mean(0) if len(x) else 0.0)
    return np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0)]), np.concatenate([[0.0], np.cumsum((x * x).sum(1))])


def _cost(s, q, a, b):
    """Squared error of rows a to b about their mean, from prefix sums."""
    return q[b] - q[a] - ((s[b] - s[a]) ** 2).sum(-1) / (b - a)


def binary_segmentation(x: np.ndarray, most: int = 5, least: int = 5, threshold: float = 1.0) -> Found:
    """The best split of all segments, again and again; each segment is searched once."""
    s, q = _sums(x)
    scores, cuts, open_ = np.zeros(len(x)), [], []

    def search(a, b):
        k = np.arange(a + least, b - least + 1)
        if len(k):
            g = _cost(s, q, a, b) - _cost(s, q, a, k) - _cost(s, q, k, b)
            scores[k] = np.maximum(scores[k], g)
            open_.append((float(g.max()), int(k[g.argmax()]), a, b))

    search(0, len(x))
    while open_ and len(cuts) < most:
        best = max(open_, key=lambda o: o[0])  # of equal gains the first
        if best[0] < threshold or best[0] <= 0:
            break
        open_.remove(best)
        cuts.append(best[1])
        if len(cuts) < most:  # a last split is not searched on
            search(best[2], best[1])
            search(best[1], best[3])
    return scores, sorted(cuts)


def optimal_partition(x: np.ndarray, penalty: float = 3.0, least: int = 5) -> Found:
    """Least cost plus penalty over all partitions into segments of ``least`` rows or more.

    A candidate that cannot win at a row is dropped ``least`` rows later, when the
    row that beats it may itself be a last cut.  Scores are the gains of a split in
    the middle of a window around each row.
    """
    s, q = _sums(x)
    n = len(x)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    alive, doomed = np.array([0]), {}
    for t in range(least, n + 1):
        alive = alive[~np.isin(alive, doomed.pop(t, []))]
        if t - least >= least:
            alive = np.append(alive, t - least)
        cost = best[alive] + _cost(s, q, alive, t) + penalty
        k = int(cost.argmin())
        best[t], back[t] = cost[k], alive[k]
        over = alive[cost - penalty > best[t] + 1e-9 * (1 + abs(best[t]))]
        if len(over):
            doomed[t + least] = over
    cuts, t = [], n
    while back[t] > 0:
        t = int(back[t])
        cuts.append(t)
    scores, i = np.zeros(n), np.arange(least, n - least)
    if len(i):
        scores[i] = np.maximum(0.0, _cost(s, q, i - least, i + least) - _cost(s, q, i - least, i) - _cost(s, q, i, i + least))
    return scores, sorted(cuts)


def non_max_suppression(scores: np.ndarray, candidates: list[int], radius: int) -> list[int]:
    kept: list[int] = []
    for c in sorted(candidates, key=lambda i: (-scores[i], i)):
        if all(abs(c - k) > radius for k in kept):
            kept.append(c)
    return sorted(kept)


def _ks(a: np.ndarray, b: np.ndarray) -> float:
    """The largest distance of the two distributions, from counts, so equal distances are equal numbers."""
    both = np.sort(np.concatenate([a, b]))
    left, right = (np.searchsorted(np.sort(w), both, "right") for w in (a, b))
    return float(np.abs(left * len(b) - right * len(a)).max() / (len(a) * len(b)))


def _kernel_distance(x: np.ndarray, window: int, gamma: float) -> np.ndarray:
    """Kernel distance of the windows before and after each row that has both; products of a row's neighbourhood are summed once for all rows."""
    x = x.reshape(len(x), -1)
    out, rows = np.zeros(len(x)), np.arange(window, len(x) - window)
    for part in np.array_split(rows, max(1, len(rows) * window * window // 2_000_000)):
        if len(part):
            at = part[:, None] + np.arange(-window, window)
            k = np.exp(-gamma * ((x[at][:, :, None, :] - x[at][:, None, :, :]) ** 2).sum(-1))
            w = window
            out[part] = np.sqrt(np.maximum(0.0, k[:, :w, :w].mean((1, 2)) + k[:, w:, w:].mean((1, 2)) - 2 * k[:, :w, w:].mean((1, 2))))
    return out


def distributional(x: np.ndarray, window: int = 20, threshold: float = 0.75, kernel: bool = True, gamma: float | None = None) -> Found:
    """The windows before and after each row compared, by a kernel or by their distributions; peaks from the threshold on."""
    if kernel:
        scores = _kernel_distance(x, window, gamma or 1.0 / max(float(x.var()), 1e-6))
    else:
        scores, first = np.zeros(len(x)), x.reshape(len(x), -1)[:, 0]
        for i in range(window, len(x) - window):
            scores[i] = _ks(first[i - window : i], first[i : i + window])
    return scores, non_max_suppression(scores, np.flatnonzero(scores >= threshold).tolist(), window)


def bayesian_online(x: np.ndarray, hazard: float = 0.01, threshold: float = 0.5, least: int = 5, short: int = 0, mean: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1.0) -> Found:
    """Student-t run lengths under a normal-gamma prior; the score is the probability that the run is at most ``short`` rows long.

    A run of length 0 has the hazard as its probability, whatever the data, so with
    ``short`` 0 no alarm is possible below it; a short run gathers probability only
    after a change.  Every run length is kept: the work grows with the square of the rows.
    """
    p, mu, ka, b = np.ones(1), np.full(1, mean), np.full(1, kappa), np.full(1, beta)
    # a run's shape is the prior's and a half for each of its rows
    shape = alpha + np.arange(len(x) + 2) / 2
    lg = np.array([math.lgamma(v) for v in shape])
    scores, cuts = np.zeros(len(x)), []
    for i, v in enumerate(x):
        a = shape[: i + 1]
        df, s2 = 2 * a, b * (ka + 1) / (a * ka)
        log = lg[1 : i + 2] - lg[: i + 1] - 0.5 * np.log(df * math.pi * s2) - (df + 1) / 2 * np.log1p((v - mu) ** 2 / (df * s2))
        like = np.exp(log - log.max()) * p
        p = np.concatenate([[like.sum() * hazard], like * (1 - hazard)])
        p /= p.sum()
        mu, b = np.concatenate([[mean], (ka * mu + v) / (ka + 1)]), np.concatenate([[beta], b + ka * (v - mu) ** 2 / (2 * (ka + 1))])
        ka = np.concatenate([[kappa], ka + 1])
        scores[i] = p[: short + 1].sum()
        if i >= least and scores[i] >= threshold:
            cuts.append(max(0, i - short))
    return scores, cuts


DETECTORS: dict[str, Callable[..., Found]] = {"cusum": cusum, "page_hinkley": page_hinkley, "binary_segmentation": binary_segmentation, "pelt": optimal_partition, "distributional": distributional, "bocpd": bayesian_online}


def detect(df: DataFrame, method: str, value: str | list[str] = "value", key: str = "asset", time: str = "t", **how) -> DataFrame:
    """key, time, score, probability, boundary and segment of every row; several values count together in the offline detectors."""
    if method not in DETECTORS:
        raise ValueError(f"no detector {method}")
    f, values = DETECTORS[method], [value] if isinstance(value, str) else list(value)
    kinds = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        x = g[values].astype(float).replace([np.inf, -np.inf], np.nan).ffill().bfill().fillna(0.0).to_numpy()
        offline = method in ("binary_segmentation", "pelt", "distributional")
        scores, cuts = f(x if offline and len(values) > 1 else x[:, 0], **how)
        flag = np.zeros(len(x), bool)
        flag[[c for c in cuts if 0 < c < len(x)]] = True
        top = scores.max() if len(scores) and scores.max() > 0 else 1.0
        return pd.DataFrame({key: g[key].to_numpy(), time: g[time].to_numpy(), "score": scores, "probability": np.clip(scores / top, 0.0, 1.0), "boundary": flag, "segment": np.cumsum(flag)})

    return df.select(key, time, *[F.col(v).cast("double").alias(v) for v in values]).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {time} {kinds[time]}, score double, probability double, boundary boolean, segment long")


def boundary_metrics(found: list[int], truth: list[int], n: int, tolerance: int = 5) -> dict[str, float]:
    """Nearest free matches in order: mean signed delay, and false alarms per row."""
    free, delays = sorted(truth), []
    for d in sorted(found):
        near = min(free, key=lambda t: (abs(t - d), t), default=None)
        if near is not None and abs(near - d) <= tolerance:
            free.remove(near)
            delays.append(d - near)
    return {"delay": float(np.mean(delays)) if delays else math.inf, "false_alarms": (len(found) - len(delays)) / max(n, 1), "missed": len(free)}
