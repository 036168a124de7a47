"""Leakage-safe validation splits as descriptors and range predicates; positions are never collected."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("train", "validation", "test")


@dataclass(frozen=True)
class Split:
    """Half-open row ranges of each role; ``blocked`` rows are taken from training."""

    train: tuple[int, int]
    validation: tuple[int, int]
    test: tuple[int, int]
    embargo: int = 0
    delay: int = 0
    purge: bool = False

    def blocked(self, n: int) -> list[tuple[int, int]]:
        if not self.embargo:
            return []
        return [(max(0, a - self.embargo), min(n, b + self.embargo)) for a, b in (self.validation, self.test) if b > a]

    def roles(self, n: int) -> np.ndarray:
        """The role of each of a series' n rows, None where it has none; the same as ``assign`` gives."""
        out = np.full(n, None, object)
        out[slice(*self.train)] = "train"
        for a, b in self.blocked(n):
            out[a:b] = None
        out[slice(*self.validation)] = "validation"
        out[slice(*self.test)] = "test"
        return out

    def execution(self, n: int) -> tuple[int, int]:
        return min(n, self.test[0] + self.delay), min(n, self.test[1] + self.delay)


@dataclass(frozen=True)
class ExpandingWindow:
    """Training from the first row on; steps while the test fits."""

    train: int
    validation: int
    test: int
    step: int | None = None
    embargo: int = 0
    purge: bool = False
    fixed: bool = False
    delays: tuple[int, ...] = (0,)

    def split(self, n: int) -> Iterator[Split]:
        end = self.train
        while end + self.validation + self.test <= n:
            start = end - self.train if self.fixed else 0
            for d in self.delays:
                yield Split((start, end), (end, end + self.validation), (end + self.validation, end + self.validation + self.test), self.embargo, d, self.purge)
            end += self.step or self.test


AnchoredWalkForward = ExpandingWindow


def rolling_window(train: int, validation: int, test: int, step: int | None = None) -> ExpandingWindow:
    return ExpandingWindow(train, validation, test, step, fixed=True)


def purged(train: int, validation: int, test: int, step: int | None = None, embargo: int = 1) -> ExpandingWindow:
    return ExpandingWindow(train, validation, test, step, embargo, purge=True)


def refit_frequency(train: int, validation: int, test: int, every: int) -> ExpandingWindow:
    return ExpandingWindow(train, validation, test, every)


def execution_delay_sensitivity(train: int, validation: int, test: int, step: int | None = None, delays: tuple[int, ...] = (0, 1, 2)) -> ExpandingWindow:
    return ExpandingWindow(train, validation, test, step, delays=delays)


def nested(outer: Split, inner: ExpandingWindow) -> list[Split]:
    """Inner splits within the outer training rows."""
    a, b = outer.train
    move = lambda r: (r[0] + a, r[1] + a)
    return [replace(s, train=move(s.train), validation=move(s.validation), test=move(s.test)) for s in inner.split(b - a)]


def with_positions(df: DataFrame, time: str = "t", key: str | None = None) -> DataFrame:
    """Row numbers from 0 in the order of time; without a key one ordered series, as the splits are."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(time)
    return df.withColumn("rn", F.row_number().over(w) - 1)


def assign(df: DataFrame, splits: list[Split], n: int, rn: str = "rn", start: str | None = None, end: str | None = None) -> DataFrame:
    """A row for each split and role of a row of ``df``; one pass, as the descriptors are an array of constants.

    With label spans, training rows whose span overlaps the evaluated rows' spans go
    where the split purges: what lies between the least start and the greatest end of
    the evaluated spans is compared span by span in ``purge_overlaps``.
    """
    out, r = [], F.col(rn)
    for k, s in enumerate(splits):
        inside = lambda x: (r >= x[0]) & (r < x[1])
        free = F.lit(True)
        for b in s.blocked(n):
            free = free & ~inside(b)
        role = F.when(inside(s.test), "test").when(inside(s.validation), "validation").when(inside(s.train) & free, "train")
        out.append(F.when(role.isNotNull(), F.struct(F.lit(k).alias("split"), role.alias("role"), F.lit(s.delay).alias("delay"))))
    got = df.withColumn("_s", F.explode(F.array_compact(F.array(*out)))).select(*df.columns, "_s.split", "_s.role", "_s.delay")
    if start and end and any(s.purge for s in splits):
        got = purge_overlaps(got, [k for k, s in enumerate(splits) if s.purge], start, end)
    return got


def purge_overlaps(assigned: DataFrame, purged_splits: list[int], start: str, end: str) -> DataFrame:
    """Without training rows whose label span overlaps the span that a split's evaluated labels cover."""
    cover = assigned.filter((F.col("role") != "train") & F.col("split").isin(purged_splits)).groupBy("split").agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    got = assigned.join(F.broadcast(cover), "split", "left")  # a row for each split
    hit = (F.col("role") == "train") & F.coalesce((F.col(start) < F.col("_hi")) & (F.col(end) > F.col("_lo")), F.lit(False))
    return got.filter(~hit).drop("_lo", "_hi")


@dataclass(frozen=True)
class Holdout:
    """Roles by the values of a column: assets, market periods, crises or geographies."""

    column: str
    validation: tuple = field(default=())
    test: tuple = field(default=())

    def assign(self, df: DataFrame) -> DataFrame:
        c = F.col(self.column)
        return df.withColumn("role", F.when(c.isin(*self.test), "test").when(c.isin(*self.validation), "validation").otherwise("train"))


def cross_sectional(assets_validation, assets_test, column: str = "asset") -> Holdout:
    return Holdout(column, tuple(assets_validation), tuple(assets_test))


asset_universe_holdout = cross_sectional


def market_period_holdout(validation, test, column: str = "period") -> Holdout:
    return Holdout(column, tuple(validation), tuple(test))


crisis_period_stress_test = market_period_holdout


def geographic_market_holdout(validation, test, column: str = "geography") -> Holdout:
    return Holdout(column, tuple(validation), tuple(test))


def windows(assigned: DataFrame, time: str = "t") -> DataFrame:
    """First and last row and time of each role."""
    return assigned.groupBy("split", "role").agg(F.min("rn").alias("first"), (F.max("rn") + 1).alias("stop"), F.min(time).alias("from"), F.max(time).alias("to"), F.count("*").alias("n"))
