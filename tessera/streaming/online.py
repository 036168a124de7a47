"""Online operators: the batch rules and filters with their state carried from batch to batch.

Each takes a streaming (or batch) frame of entity, time and value.  State is small
and per entity: an event, two sums, or a filtered vector; it ends after ``idle``.
Within a micro-batch an entity's rows are taken in the order of time; the watermark
says how late a row may come.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.models.hmm import OnlineFilter, Params


def carried(df: DataFrame, step: Callable[[dict, float | None], tuple[dict, dict]], output: str, key: str = "asset", time: str = "t", value: str = "value", idle: str | None = None) -> DataFrame:
    """``step``: state and value to state and output columns; the state travels as JSON."""
    names = [c.split()[0] for c in output.split(", ")]
    kinds = dict(df.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(time)
        out = []
        for v in rows[value]:
            held, got = step(held, None if pd.isna(v) else float(v))
            out.append(got)
        state.update((json.dumps(held),))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.concat([pd.DataFrame({key: k[0], time: rows[time].to_numpy()}), pd.DataFrame(out, columns=names)], axis=1)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.select(key, time, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {time} {kinds[time]}, {output}", "held string", "append", timeout)


def hysteresis(df: DataFrame, enter: float, leave: float, initial: int = 0, **names) -> DataFrame:
    def step(s, v):
        now = s.get("state", initial)
        if v is not None:
            now = 1 if v >= enter else 0 if v <= leave else now
        return {"state": now}, {"state": now}

    return carried(df, step, "state int", **names)


def cusum(df: DataFrame, threshold: float = 5.0, drift: float = 0.0, least: int = 5, **names) -> DataFrame:
    """The raw score and the alarm; the baseline is the first rows."""
    def step(s, v):
        v = s.get("last", 0.0) if v is None else v
        head = s.get("head", [])
        n = s.get("n", 0)
        if len(head) < least:
            head = [*head, v]
        if n + 1 < least:
            return s | {"head": head, "n": n + 1, "last": v}, {"score": 0.0, "alarm": False}
        if "std" not in s:
            s = s | {"mean": float(np.mean(head)), "std": (float(np.std(head, ddof=1)) if len(head) > 1 else 0.0) or 1.0, "up": 0.0, "down": 0.0}
            for x in head[:-1]:
                z = (x - s["mean"]) / s["std"]
                s = s | {"up": max(0.0, s["up"] + z - drift), "down": max(0.0, s["down"] - z - drift)}
        z = (v - s["mean"]) / s["std"]
        up, down = max(0.0, s["up"] + z - drift), max(0.0, s["down"] - z - drift)
        score = max(up, down)
        alarm = n >= least and score >= threshold
        s = s | {"n": n + 1, "last": v, "head": head, "up": 0.0 if alarm else up, "down": 0.0 if alarm else down, "mean": v if alarm else s["mean"]}
        return s, {"score": score, "alarm": bool(alarm)}

    return carried(df, step, "score double, alarm boolean", **names)


def page_hinkley(df: DataFrame, threshold: float = 50.0, delta: float = 0.005, alpha: float = 0.999, least: int = 5, **names) -> DataFrame:
    def step(s, v):
        n, mean, total, low = s.get("n", 0), s.get("mean", 0.0), s.get("total", 0.0), s.get("low", 0.0)
        v = mean if v is None else v
        mean += (v - mean) / (n + 1)
        total = alpha * total + v - mean - delta
        low = min(low, total)
        score = total - low
        alarm = n >= least and score >= threshold
        return {"n": n + 1, "mean": v if alarm else mean, "total": 0.0 if alarm else total, "low": 0.0 if alarm else low}, {"score": score, "alarm": bool(alarm)}

    return carried(df, step, "score double, alarm boolean", **names)


def hmm_filter(df: DataFrame, params: Params, **names) -> DataFrame:
    """Filtered probabilities of one feature; a missing value moves the state without evidence."""
    flat, k, d = params.packed(), *params.means.shape

    def step(s, v):
        f = OnlineFilter(Params.unpacked(flat, k, d), state=s.get("p"))
        if v is None:
            p = (f.p.start if f.state is None else f.state @ f.p.moves)
        else:
            p = f.step(np.array([v]))
        return {"p": p.tolist()}, {"state": int(p.argmax()), "probabilities": p.tolist()}

    return carried(df, step, "state int, probabilities array<double>", **names)


def point_in_time_stream(df: DataFrame, keys: list[str], publication: str = "publication_ts", received: str = "vendor_received_ts", late: str = "1 day") -> DataFrame:
    """Revisions by the time they became known, each once, as late as the watermark allows."""
    known = F.greatest(F.col(publication), F.coalesce(F.col(received), F.col(publication)))
    return df.withColumn("known_at", known).withWatermark("known_at", late).dropDuplicatesWithinWatermark([*keys, publication])


def hourly_bars(events: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """Bars of closed hours, as the watermark passes them."""
    w = events.withWatermark(time, late).groupBy(F.window(time, "1 hour"), key)
    return w.agg(F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count("*").alias("volume")).select(F.col("window.start").alias("hour"), key, "open", "high", "low", "close", "volume")
