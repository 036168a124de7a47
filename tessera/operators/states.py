"""Metrics of state sequences: runs, transitions, occupancy, agreement, alignment."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, div


def with_change(df: DataFrame, state: str = "state", p: Panel = ASSET) -> DataFrame:
    """``changed`` (the first row is none) and ``segment``, the number of changes so far."""
    changed = F.coalesce((F.col(state) != p.lag(state)).cast("int"), F.lit(0))
    return df.withColumn("changed", changed).withColumn("segment", F.sum("changed").over(p.upto))


def runs(df: DataFrame, state: str = "state", p: Panel = ASSET) -> DataFrame:
    """Run-length encoding: entity, segment, state, start, stop, length."""
    return with_change(df, state, p).groupBy(p.key, "segment", state).agg(F.min(p.time).alias("start"), F.max(p.time).alias("stop"), F.count("*").alias("length"))


def persistence(df: DataFrame, state: str = "state", p: Panel = ASSET) -> DataFrame:
    """Share of rows in the state of the row before, its complement, and the number of changes."""
    same = F.when(p.lag(state).isNotNull(), (F.col(state) == p.lag(state)).cast("double"))
    got = df.withColumn("_s", same).groupBy(p.key).agg(F.coalesce(F.avg("_s"), F.lit(1.0)).alias("persistence"), F.coalesce(F.sum(1 - F.col("_s")), F.lit(0.0)).cast("long").alias("changes"))
    return got.withColumn("switching_frequency", 1 - F.col("persistence"))


def durations(df: DataFrame, state: str = "state", p: Panel = ASSET) -> DataFrame:
    """Runs of each state: how many, and their mean, least and greatest length."""
    return runs(df, state, p).groupBy(p.key, state).agg(F.count("*").alias("recurrence"), F.avg("length").alias("mean_duration"), F.min("length").alias("min_duration"), F.max("length").alias("max_duration"))


def occupancy(df: DataFrame, state: str = "state", p: Panel = ASSET) -> DataFrame:
    got = df.groupBy(p.key, state).agg(F.count("*").alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(p.key)))


def occupancy_entropy(df: DataFrame, state: str = "state", base: float = 2.0, p: Panel = ASSET) -> DataFrame:
    return occupancy(df, state, p).groupBy(p.key).agg((-F.sum(F.col("share") * F.ln("share")) / math.log(base)).alias("entropy"), F.sum(F.col("share") * F.col("share")).alias("hhi"))


def rare_states(df: DataFrame, state: str = "state", threshold: float = 0.05, p: Panel = ASSET) -> DataFrame:
    return occupancy(df, state, p).filter(F.col("share") <= threshold)


def transitions(df: DataFrame, state: str = "state", p: Panel = ASSET) -> DataFrame:
    """Counts and row-stochastic probabilities of observed moves."""
    nxt = F.lead(state).over(p.order)
    got = df.withColumn("_to", nxt).filter(F.col("_to").isNotNull()).groupBy(p.key, F.col(state).alias("from_state"), F.col("_to").alias("to_state")).agg(F.count("*").alias("n"))
    return got.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(p.key, "from_state")))


def transition_concentration(df: DataFrame, state: str = "state", p: Panel = ASSET) -> DataFrame:
    top = transitions(df, state, p).groupBy(p.key, "from_state").agg(F.max("probability").alias("top"))
    return top.groupBy(p.key).agg(F.avg("top").alias("transition_concentration"))


def transition_events(df: DataFrame, state: str = "state", horizon: int = 1, p: Panel = ASSET) -> DataFrame:
    """1 where one of the next rows is in another state; the last rows have none to look at."""
    ahead = F.collect_list(state).over(p.order.rowsBetween(1, horizon))
    differs = F.exists("_ahead", lambda x: x != F.col(state))
    got = df.withColumn("_ahead", ahead).withColumn("event", F.when(F.size("_ahead") < horizon, 0).otherwise(differs.cast("int")))
    return got.drop("_ahead")


def smooth(df: DataFrame, state: str = "state", window: int = 3, p: Panel = ASSET) -> DataFrame:
    """Centred majority; the smallest state of equals."""
    k = window // 2
    near = F.collect_list(state).over(p.order.rowsBetween(-k, k))
    votes = F.transform(F.array_distinct("_near"), lambda s: F.struct((-F.size(F.filter("_near", lambda x: x == s))).alias("n"), s.alias("s")))
    return df.withColumn("_near", near).withColumn("smoothed", F.array_min(votes)["s"]).drop("_near")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, variation of information in bits, and mutual information; from the contingency alone."""
    c = contingency(df, a, b)
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    plogp = lambda x: F.col(x) * F.log2(x)
    cells = c.agg(F.sum(two("n")).alias("cc"), F.sum(plogp("n")).alias("hc"), F.sum("n").alias("n"))
    by_a = c.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("ca"), F.sum(plogp("n")).alias("ha"))
    by_b = c.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("cb"), F.sum(plogp("n")).alias("hb"))
    t = cells.crossJoin(by_a).crossJoin(by_b)  # one row each
    expected = F.col("ca") * F.col("cb") / two("n")
    ari = F.coalesce(div(F.col("cc") - expected, (F.col("ca") + F.col("cb")) / 2 - expected), F.lit(1.0))
    vi = (F.col("ha") + F.col("hb") - 2 * F.col("hc")) / F.col("n")
    mi = F.log2("n") + (F.col("hc") - F.col("ha") - F.col("hb")) / F.col("n")
    return t.select(ari.alias("adjusted_rand"), vi.alias("variation_of_information"), mi.alias("mutual_information"))


def separability(df: DataFrame, features: list[str], state: str = "state") -> DataFrame:
    """Mean distance of the states' centroids from the grand mean over the mean spread within states."""
    grand = df.agg(*[F.avg(f).alias(f"g_{f}") for f in features])
    cent = df.groupBy(state).agg(*[F.avg(f).alias(f"c_{f}") for f in features])
    gap = cent.crossJoin(F.broadcast(grand)).select(F.sqrt(sum((F.pow(F.col(f"c_{f}") - F.col(f"g_{f}"), 2) for f in features), F.lit(0.0))).alias("d")).agg(F.avg("d").alias("between"))
    inner = df.join(cent, state).withColumn("d", F.sqrt(sum((F.pow(F.col(f) - F.col(f"c_{f}"), 2) for f in features), F.lit(0.0))))
    spread = inner.groupBy(state).agg(F.avg("d").alias("w")).agg(F.avg("w").alias("within"))
    return gap.crossJoin(spread).select((F.col("between") / F.greatest("within", F.lit(1e-12))).alias("separability"))


def hungarian(cost: np.ndarray) -> list[int]:
    """The column of each row in an assignment of least cost; rows <= columns, both few."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < low[free]
            low[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(low[free])]
            d = low[j1]
            u[match[used]] += d
            v[used] -= d
            low[~used] -= d
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def aligned_mapping(df: DataFrame, truth: str, predicted: str) -> dict:
    """Predicted to true label by the assignment of most overlap; an unmatched label keeps its name."""
    rows = contingency(df, truth, predicted).collect()  # the states' confusion, few rows
    a, b = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    n = max(len(a), len(b))
    cost = np.zeros((n, n))
    for r in rows:
        cost[b.index(r.b), a.index(r.a)] = -r.n
    return {y: a[j] if j < len(a) else y for y, j in zip(b, hungarian(cost), strict=False)}


def relabel(df: DataFrame, column: str, mapping: dict, name: str = "aligned") -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(name, F.coalesce(F.get(F.array(m[F.col(column)]), F.lit(0)), F.col(column)))


def boundaries(df: DataFrame, state: str = "state", p: Panel = ASSET) -> DataFrame:
    return with_change(df, state, p).filter("changed = 1").select(p.key, p.time)


def detection_delay(true: DataFrame, found: DataFrame, p: Panel = ASSET) -> DataFrame:
    """Mean wait from a true boundary to the first detection at or after it, by one ordered pass."""
    b = true.select(p.key, p.time, F.lit(0).alias("_k")).unionByName(found.select(p.key, p.time, F.lit(1).alias("_k")))
    w = Window.partitionBy(p.key).orderBy(F.col(p.time).desc(), F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    got = b.withColumn("_next", F.last(F.when(F.col("_k") == 1, F.col(p.time)), ignorenulls=True).over(w)).filter("_k = 0")
    return got.groupBy(p.key).agg(F.avg(F.col("_next") - F.col(p.time)).alias("detection_delay"), F.sum(F.when(F.col("_next").isNull(), 1).otherwise(0)).alias("missed"))


def false_alarm_rate(true: DataFrame, found: DataFrame, tolerance: int = 0, p: Panel = ASSET) -> DataFrame:
    """Share of detections without a true boundary within the tolerance."""
    b = true.select(p.key, p.time, F.lit(0).alias("_k")).unionByName(found.select(p.key, p.time, F.lit(1).alias("_k")))
    mark = F.when(F.col("_k") == 0, F.col(p.time))
    past = F.last(mark, ignorenulls=True).over(Window.partitionBy(p.key).orderBy(p.time, "_k").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(mark, ignorenulls=True).over(Window.partitionBy(p.key).orderBy(p.time, F.col("_k").desc()).rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col(p.time) - past, ahead - F.col(p.time))
    got = b.withColumn("_gap", gap).filter("_k = 1")
    return got.groupBy(p.key).agg(F.avg(F.when(F.col("_gap") <= tolerance, 0.0).otherwise(1.0)).alias("false_alarm_rate"))


def boundary_precision_recall(true: list[int], found: list[int], tolerance: int = 0) -> dict[str, float]:
    """Detections in order, each matched with the nearest free true boundary."""
    free, hit = sorted(true), 0
    for d in found:
        near = min(free, key=lambda t: (abs(t - d), t), default=None)
        if near is not None and abs(near - d) <= tolerance:
            free.remove(near)
            hit += 1
    precision, recall = hit / len(found) if found else 0.0, hit / len(true) if true else 0.0
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if hit else 0.0}


def pairwise_agreement(runs_: list[list]) -> float:
    """Mean adjusted Rand index over all pairs of label runs of one series; 1 for fewer than two."""
    def ari(x, y):
        t = np.zeros((len(set(x)), len(set(y))))
        np.add.at(t, (np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]), 1)
        two = lambda z: (z * (z - 1) / 2).sum()
        e = two(t.sum(0)) * two(t.sum(1)) / two(np.array([t.sum()]))
        m = (two(t.sum(0)) + two(t.sum(1))) / 2
        return 1.0 if m == e else (two(t) - e) / (m - e)

    return float(np.mean([ari(x, y) for x, y in itertools.combinations(runs_, 2)])) if len(runs_) > 1 else 1.0


def probability_entropy(probs: Column, base: float = 2.0) -> Column:
    """Entropy of a row's probabilities, normalised first; 0 where they add up to none."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    part = lambda x: F.when(x > 0, -(x / total) * F.ln(x / total) / math.log(base)).otherwise(0.0)
    return F.when(total > 0, F.aggregate(F.transform(probs, part), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
