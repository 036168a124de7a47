"""Clustering, jump, econometric, state-space and supervised models.

Clustering and supervised models of many rows use pyspark.ml; models of an ordered
series run per entity in a grouped map.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.functions.exprs import ASSET, Panel, div
from tessera.operators.models import hmm


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)


def kmeans_regimes(df: DataFrame, features: list[str], k: int = 2, seeds: int = 3, seed: int = 0) -> DataFrame:
    """Scaled features, the best of several starts; states by the order of their first centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    v = durable(_vector(df, features))  # read by the scaler, every start and the labels
    v = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(v).transform(v)
    models = [KMeans(k=k, seed=seed + i, featuresCol="_z", predictionCol="_k").fit(v) for i in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    order = np.argsort([c[0] for c in best.clusterCenters()], kind="stable")
    rank = F.create_map(*[F.lit(int(x)) for r, j in enumerate(order) for x in (j, r)])
    return best.transform(v).withColumn("state", rank[F.col("_k")]).drop("_x", "_z", "_k")


def mixture_regimes(df: DataFrame, features: list[str], k: int = 2, seed: int = 0) -> DataFrame:
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array

    v = _vector(df, features)
    m = GaussianMixture(k=k, seed=seed, featuresCol="_x", predictionCol="state", probabilityCol="_p").fit(v)
    return m.transform(v).withColumn("probabilities", vector_to_array("_p")).drop("_x", "_p")


def hierarchical(x: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """Agglomeration of a small series by Lance-Williams updates."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d = d if linkage == "ward" else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, alive, member = np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - k):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        other = alive.copy()
        other[[i, j]] = False
        a, b, s = size[i], size[j], size
        if linkage == "ward":
            new = ((a + s) * d[i] + (b + s) * d[j] - s * d[i, j]) / (a + b + s)
        elif linkage == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            new = np.minimum(d[i], d[j]) if linkage == "single" else np.maximum(d[i], d[j])
        d[i, other] = d[other, i] = new[other]
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]


def jump_path(cost: np.ndarray, penalty: float | np.ndarray) -> np.ndarray:
    """Least cost of the rows plus the penalties of the jumps."""
    n, k = cost.shape
    jump = penalty * (1 - np.eye(k)) if np.isscalar(penalty) else penalty
    best, back = cost[0].copy(), np.zeros((n, k), int)
    for t in range(1, n):
        total = best[:, None] + jump
        back[t] = total.argmin(0)
        best = total.min(0) + cost[t]
    out = np.empty(n, int)
    out[-1] = best.argmin()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def jump_segmentation(x: np.ndarray, k: int = 2, penalty: float | np.ndarray = 5.0, steps: int = 20, seed: int = 0, gaussian: bool = False) -> np.ndarray:
    """Centres (or diagonal normals) and the path in turn."""
    lab, _ = hmm.kmeans(x, k, np.random.default_rng(seed))
    for _ in range(steps):
        m = np.stack([x[lab == j].mean(0) if (lab == j).any() else x.mean(0) for j in range(k)])
        v = np.stack([x[lab == j].var(0) + 1e-6 if (lab == j).sum() > 1 else x.var(0) + 1e-6 for j in range(k)])
        d = (x[:, None] - m) ** 2
        new = jump_path((d / v + np.log(v)).sum(2) if gaussian else d.sum(2), penalty)
        if (new == lab).all():
            break
        lab = new
    order = np.argsort([x[lab == j, 0].mean() if (lab == j).any() else np.inf for j in range(k)], kind="stable")
    return np.argsort(order)[lab]


def kalman_switching(y: np.ndarray, models: list[dict], moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interacting multiple models: mode probabilities and the mixed state's mean. models: A, b, Q, C, R; moves: one matrix, or one for each row.

    All modes are carried side by side; a row mixes, moves and corrects them in one go.
    """
    k, d = len(models), models[0]["A"].shape[0]
    a, q, c, r = (np.stack([np.asarray(m[n], float) for m in models]) for n in ("A", "Q", "C", "R"))
    drift = np.stack([np.broadcast_to(m.get("b", 0.0), d) for m in models])
    eye = 1e-9 * np.eye(y.shape[1])
    moves = np.broadcast_to(moves, (len(y), k, k))
    centre, spread, weight = np.zeros((k, d)), np.broadcast_to(np.eye(d), (k, d, d)), np.full(k, 1 / k)
    probs, found = np.empty((len(y), k)), np.empty((len(y), d))
    for t, row in enumerate(y):
        joint = weight[:, None] * moves[t]
        ahead = joint.sum(0)
        share = joint / np.maximum(ahead, 1e-300)
        mixed = share.T @ centre
        off = centre[:, None] - mixed[None]
        around = np.einsum("ij,iab->jab", share, spread) + np.einsum("ij,ija,ijb->jab", share, off, off)
        centre = np.einsum("jab,jb->ja", a, mixed) + drift
        spread = a @ around @ a.transpose(0, 2, 1) + q
        miss = row - np.einsum("jab,jb->ja", c, centre)
        s = c @ spread @ c.transpose(0, 2, 1) + r + eye
        gain = np.linalg.solve(s, c @ spread).transpose(0, 2, 1)
        centre = centre + np.einsum("jab,jb->ja", gain, miss)
        spread = spread - gain @ c @ spread
        score = -0.5 * (np.einsum("ja,ja->j", miss, np.linalg.solve(s, miss[:, :, None])[:, :, 0]) + np.linalg.slogdet(2 * math.pi * s)[1])
        weight = ahead * np.exp(score - score.max())
        weight = weight / weight.sum()
        probs[t], found[t] = weight, weight @ centre
    return probs, found


def switching_lds(x: np.ndarray, k: int = 2, seed: int = 0, factors: int | None = None, recurrent: np.ndarray | None = None) -> np.ndarray:
    """Clusters give each mode's dynamics and noise; the filter gives the modes' probabilities.

    ``recurrent``: weights (modes, columns) by which a row tilts the moves to it.
    """
    y = x
    if factors:
        _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        y = (x - x.mean(0)) @ vt[:factors].T
    lab, cent = hmm.kmeans(y, k, np.random.default_rng(seed))
    rank = np.argsort(np.argsort(cent[:, 0], kind="stable"))
    lab = rank[lab]
    d, models = y.shape[1], []
    moves = np.ones((k, k))
    np.add.at(moves, (lab[:-1], lab[1:]), 1)
    for j in range(k):
        at = np.flatnonzero(lab[1:] == j) + 1
        if len(at) > d + 1:
            coef = np.linalg.lstsq(np.column_stack([y[at - 1], np.ones(len(at))]), y[at], rcond=None)[0]
            a, b = coef[:-1].T, coef[-1]
            e = y[at] - y[at - 1] @ a.T - b
        else:
            a, b, e = 0.5 * np.eye(d), np.zeros(d), y - y.mean(0)
        q = np.atleast_2d(np.cov(e, rowvar=False)) + 1e-4 * np.eye(d) if len(e) > 1 else np.eye(d)
        models.append({"A": a, "b": b, "Q": q, "C": np.eye(d), "R": 0.1 * np.diag(np.diag(q)) + 1e-6 * np.eye(d)})
    moves = moves / moves.sum(1, keepdims=True)
    return kalman_switching(y, models, moves if recurrent is None else recurrent_moves(moves, y, recurrent))[0]


def threshold_autoregression(y: np.ndarray, k: int = 2, order: int = 1, ridge: float = 1e-3) -> tuple[np.ndarray, list[np.ndarray]]:
    """Regimes by quantiles of the first lag, and a ridge autoregression in each; rows without lags have regime -1."""
    lag = np.column_stack([np.concatenate([np.full(j, np.nan), y[:-j]]) for j in range(1, order + 1)])
    ok = ~np.isnan(lag).any(1)
    cuts = np.quantile(lag[ok, 0], np.arange(1, k) / k)
    state = np.where(ok, np.digitize(np.nan_to_num(lag[:, 0]), cuts), -1)
    coef = []
    for j in range(k):
        at = state == j
        d = np.column_stack([np.ones(at.sum()), lag[at]])
        pen = ridge * np.eye(order + 1)
        pen[0, 0] = 0
        coef.append(np.linalg.lstsq(d.T @ d + pen, d.T @ y[at], rcond=None)[0])
    return state, coef


def smooth_transition(df: DataFrame, value: str, slope: float = 5.0, p: Panel = ASSET) -> DataFrame:
    """Weights of the second of two regimes: a logistic of the first lag about its median in the entity; missing without a lag."""
    lagged = df.withColumn("_lag", p.lag(value))
    centre = lagged.groupBy(p.key).agg(F.percentile("_lag", F.lit(0.5)).alias("_c"))
    return lagged.join(centre, p.key).withColumn("weight", 1 / (1 + F.exp(-slope * (F.col("_lag") - F.col("_c"))))).drop("_lag", "_c")


def hazard(df: DataFrame, features: list[str], state: str = "state", horizon: int = 1, p: Panel = ASSET) -> DataFrame:
    """The probability of a change within the horizon, by a logistic model of the features; a sample without a change has none."""
    from tessera.operators.states import transition_events

    events = transition_events(df, state, horizon, p).withColumn("event", F.col("event").cast("double"))
    if events.select("event").distinct().count() < 2:
        return events.withColumn("hazard", F.lit(0.0))
    scored = classify(supervised(events, features, "event"), events, features)
    return scored.withColumn("hazard", F.col("probabilities")[1]).drop("probabilities", "prediction")


def calibration(df: DataFrame, label: str = "y", probability: str = "p", bins: int = 10) -> DataFrame:
    """Bins of equal width: rows, share of positives and mean probability, beside the whole's Brier score and log loss."""
    y, q = F.col(label).cast("double"), F.col(probability)
    d = df.filter(y.isNotNull() & q.isNotNull()).withColumns({"_b": F.least(F.floor(q * bins), F.lit(bins - 1)).cast("int"), "_brier": (y - q) * (y - q), "_loss": -F.ln(F.least(F.greatest(F.when(y == 1, q).otherwise(1 - q), F.lit(1e-15)), F.lit(1.0)))})
    whole = d.agg(F.avg("_brier").alias("brier"), F.avg("_loss").alias("log_loss"))
    return d.groupBy(F.col("_b").alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("fraction_of_positives"), F.avg(q).alias("mean_predicted_probability")).crossJoin(F.broadcast(whole))  # one row


def correlation_level(df: DataFrame, features: list[str], window: int = 21, ranks: bool = False, p: Panel = ASSET) -> DataFrame:
    """level: the mean absolute correlation of all pairs of features over the trailing rows; 0 for a single row, and a pair without variance counts 0.

    With ``ranks`` the features are replaced by their ranks in the entity first.
    """
    d, names = df, features
    if ranks:
        names = [f"_rank_{f}" for f in features]
        for f, n in zip(features, names, strict=True):
            d = d.withColumn(n, F.percent_rank().over(Window.partitionBy(p.key).orderBy(f)))
    w = p.order.rowsBetween(1 - window, 0)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    r = [F.coalesce(F.when(F.count(F.lit(1)).over(w) > 1, F.abs(div(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)))), F.lit(0.0)) for a, b in pairs]
    total = r[0]
    for x in r[1:]:
        total = total + x
    return d.withColumn("level", total / len(pairs)).drop(*(names if ranks else []))


def switching_correlation(df: DataFrame, features: list[str], k: int = 2, window: int = 21, ranks: bool = False, p: Panel = ASSET) -> DataFrame:
    """States by quantiles of the entity's correlation level; with ``ranks`` the copula's stand-in."""
    d = correlation_level(df, features, window, ranks, p)
    cuts = d.groupBy(p.key).agg(F.percentile("level", F.array(*[F.lit(j / k) for j in range(1, k)])).alias("_q"))
    return d.join(cuts, p.key).withColumn("state", F.size(F.filter("_q", lambda c: F.col("level") >= c))).drop("_q")


def run_length_durations(df: DataFrame, state: str = "state", longest: int = 100, epsilon: float = 1e-12, p: Panel = ASSET) -> DataFrame:
    """Explicit durations of each state: the share of its runs of each length (longer ones count as the longest), and their mean."""
    from tessera.operators import states

    n = states.runs(df.filter(F.col(state).isNotNull()), state, p).groupBy(p.key, state, F.least("length", F.lit(longest)).alias("duration")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(p.key, state)
    n = n.withColumn("probability", (F.col("n") + epsilon) / (F.sum("n").over(whole) + longest * epsilon))
    return n.withColumn("expected_duration", F.sum(F.col("duration") * F.col("n")).over(whole) / F.sum("n").over(whole))


def graphical_lasso(cov: np.ndarray, penalty: float = 0.01, steps: int = 100, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Covariance and sparse precision, a column's lasso at a time."""
    w, d = cov + penalty * np.eye(len(cov)), len(cov)
    betas = np.zeros((d, d))
    for _ in range(steps):
        before = w.copy()
        for j in range(d):
            o = np.arange(d) != j
            v, s, b = w[np.ix_(o, o)], cov[o, j], betas[o, j]
            for _ in range(steps):
                last = b.copy()
                for i in range(d - 1):
                    rest = s[i] - v[i] @ b + v[i, i] * b[i]
                    b[i] = np.sign(rest) * max(abs(rest) - penalty, 0) / v[i, i]
                if np.abs(b - last).max(initial=0) < tolerance:
                    break
            betas[o, j] = b
            w[o, j] = w[j, o] = v @ b
        if np.abs(w - before).max() < tolerance * np.abs(cov).max():
            break
    precision = np.zeros((d, d))
    for j in range(d):
        o = np.arange(d) != j
        precision[j, j] = 1 / max(w[j, j] - w[o, j] @ betas[o, j], 1e-12)
        precision[o, j] = -betas[o, j] * precision[j, j]
    return w, (precision + precision.T) / 2


def ticc(x: np.ndarray, k: int = 2, window: int = 5, penalty: float = 5.0, lasso: float = 0.01, seed: int = 0) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Windows of rows, side by side, in segments with a price on each change; and a sparse precision for each state.

    The first rows, which end no whole window, take the first window's state.
    """
    if len(x) < window:
        raise ValueError("fewer rows than the window")
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
    side = np.lib.stride_tricks.sliding_window_view(z, window, axis=0).transpose(0, 2, 1).reshape(len(z) - window + 1, -1)
    lab = jump_segmentation(side, k, penalty, seed=seed)
    lab = np.concatenate([np.full(window - 1, lab[0]), lab])
    return lab, {int(j): graphical_lasso(np.atleast_2d(np.cov(z[lab == j], rowvar=False)), lasso)[1] for j in np.unique(lab) if (lab == j).sum() > z.shape[1]}


def recurrent_moves(moves: np.ndarray, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's matrix of moves, its target states tilted by the row's features; weights (states, features)."""
    z = x @ weights.T
    tilted = moves[None] * np.exp(z - z.max(1, keepdims=True))[:, None, :]
    return tilted / tilted.sum(2, keepdims=True)


def switching_volatility(df: DataFrame, ret: str = "ret", k: int = 2, p: Panel = ASSET) -> DataFrame:
    """States by quantiles of the log squared return of an entity."""
    x = F.ln(F.col(ret) * F.col(ret) + 1e-12)
    cuts = df.groupBy(p.key).agg(F.percentile(x, F.array(*[F.lit(j / k) for j in range(1, k)])).alias("_q"))
    return df.join(cuts, p.key).withColumn("state", F.when(F.col(ret).isNotNull(), F.size(F.filter("_q", lambda c: x >= c)))).drop("_q")


def correlation_regimes(corr: DataFrame, value: str = "mean_correlation", k: int = 2) -> DataFrame:
    """States by quantiles of the absolute mean correlation of a time."""
    cuts = corr.agg(F.percentile(F.abs(value), F.array(*[F.lit(j / k) for j in range(1, k)])).alias("_q"))
    return corr.crossJoin(F.broadcast(cuts)).withColumn("state", F.when(F.col(value).isNotNull(), F.size(F.filter("_q", lambda c: F.abs(F.col(value)) >= c)))).drop("_q")


def har_features(df: DataFrame, ret: str = "ret", p: Panel = ASSET) -> DataFrame:
    df = df.withColumn("rv", F.col(ret) * F.col(ret))
    return df.withColumns({"rv5": p.mean("rv", 5), "rv22": p.mean("rv", 22)})


def garch_features(df: DataFrame, ret: str = "ret") -> DataFrame:
    return df.withColumns({"ret2": F.col(ret) * F.col(ret), "ret_abs": F.abs(ret)})


def supervised(df: DataFrame, features: list[str], label: str, method: str = "logistic"):
    """A fitted pyspark.ml model; ``importance`` reads it."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    make = {"logistic": lambda: LogisticRegression(featuresCol="_x", labelCol=label, regParam=1e-3), "random_forest": lambda: RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=50, seed=0), "gradient_boosting": lambda: GBTClassifier(featuresCol="_x", labelCol=label, maxIter=20, seed=0)}
    return make[method]().fit(_vector(df.filter(F.col(label).isNotNull()), features))


def classify(model, df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(_vector(df, features)).withColumn("probabilities", vector_to_array("probability")).drop("_x", "rawPrediction", "probability")


def importance(model, features: list[str]) -> dict[str, float]:
    raw = np.abs(model.featureImportances.toArray() if hasattr(model, "featureImportances") else model.coefficientMatrix.toArray()).reshape(-1, len(features)).sum(0)
    return dict(zip(features, (raw / max(raw.sum(), 1e-12)).tolist(), strict=True))


def per_series(df: DataFrame, features: list[str], label, key: str = "asset", time: str = "t") -> DataFrame:
    """``label``: array of features to array of states, for each entity's complete rows in order."""
    kinds = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time).dropna(subset=features)
        return pd.DataFrame({key: g[key].to_numpy(), time: g[time].to_numpy(), "state": np.asarray(label(g[features].to_numpy(float)), "int32") if len(g) > 3 else np.zeros(len(g), "int32")})

    return df.select(key, time, *features).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {time} {kinds[time]}, state int")
