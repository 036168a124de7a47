"""Point-in-time filters, as-of lookups, dataset assembly and train-only scaling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, Panel, div


def point_in_time_snapshot(df: DataFrame, decision: Column, keys: list[str], publication: str = "publication_ts", received: str = "vendor_received_ts", tie: str | None = None) -> DataFrame:
    """The latest known row of each key; among equal publications a row without receipt wins, then the latest receipt."""
    known = df.filter((F.col(publication) <= decision) & (F.col(received).isNull() | (F.col(received) <= decision)))
    order = [F.col(publication).desc(), F.col(received).desc_nulls_first(), *([F.col(tie).desc()] if tie else [])]
    return known.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def available_inputs(df: DataFrame, as_of: Column, earliest: Column | None = None, time: str = "ts", published: str = "publication_ts", lag: Column | None = None) -> DataFrame:
    """Rows of the window that are available by ``as_of``; an observation after its own availability is an error."""
    df = df.withColumn("available_at", F.col(published) + lag if lag is not None else F.col(published))
    late = F.col(time) > F.col("available_at")
    df = df.withColumn("available_at", F.when(late, F.raise_error(F.lit("a row is dated after it became available"))).otherwise(F.col("available_at")))
    ok = (F.col(time) <= as_of) & (F.col("available_at") <= as_of)
    return df.filter(ok if earliest is None else ok & (F.col(time) >= earliest))


def missing(df: DataFrame, columns: list[str], policy: str, p: Panel = ASSET) -> DataFrame:
    """error, drop, ffill (within the entity), fill_zero or leave."""
    if policy == "drop":
        return df.dropna("any", subset=columns)
    if policy == "ffill":
        return df.withColumns({c: p.filled(c) for c in columns})
    if policy == "fill_zero":
        return df.fillna(0, subset=columns)
    if policy == "error":
        gap = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
        return df.withColumns({columns[0]: F.when(gap.isNotNull(), F.raise_error(F.concat(F.lit("missing value in "), gap))).otherwise(F.col(columns[0]))})
    if policy != "leave":
        raise ValueError(f"unknown policy {policy}")
    return df


@dataclass(frozen=True)
class TimeWindow:
    """Both ends belong to the window."""

    start: object
    end: object

    def contains(self, time: str | Column) -> Column:
        return (F.col(time) if isinstance(time, str) else time).between(self.start, self.end)


@dataclass(frozen=True)
class Splits:
    train: TimeWindow
    validation: TimeWindow
    test: TimeWindow


def stamp_splits(df: DataFrame, splits: Splits, time: str = "t") -> DataFrame:
    """The later window's name where windows overlap; rows of none go."""
    part = F.when(splits.test.contains(time), "test").when(splits.validation.contains(time), "validation").when(splits.train.contains(time), "train")
    return df.withColumn("split", part).filter(F.col("split").isNotNull())


def embargo(df: DataFrame, splits: Splits, width, time: str = "t") -> DataFrame:
    """Without the rows just after the ends of training and validation."""
    t = F.col(time)
    for w in (splits.train, splits.validation):
        df = df.filter(~((t > F.lit(w.end)) & (t <= F.lit(w.end) + width)))
    return df


def execution_delay(df: DataFrame, lag, decision, horizon, time: str = "t") -> DataFrame:
    return df.withColumns({"available_at": F.col(time) + lag + decision, "label_available_at": F.col(time) + horizon})


def scale(df: DataFrame, columns: list[str], training: Column, method: str = "standard") -> DataFrame:
    """Fitted on the training rows alone: one row of statistics joined to all; a constant column keeps its width."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")] if method == "standard" else [F.min(c).alias(f"_m_{c}"), (F.max(c) - F.min(c)).alias(f"_s_{c}")]
    fitted = df.filter(training).agg(*stats)
    out = df.crossJoin(F.broadcast(fitted))  # a single row
    width = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    out = out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / width(c) for c in columns})
    return out.drop(*(f"_{k}_{c}" for k in "ms" for c in columns))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Indicators of the training values; an unknown value has none."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def as_of(left: DataFrame, right: DataFrame, value: str, time: str = "t", by: list[str] | None = None, default=None) -> DataFrame:
    """The last value at or before each row's time: one sort of both sides, no range join."""
    by = by or []
    a = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1))
    b = right.select(*by, time, F.col(value).alias("_v"), F.lit(0).alias("_side")).filter(F.col("_v").isNotNull())
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_v", "_side")
    return got if default is None else got.withColumn(value, F.coalesce(value, F.lit(default)))


def aligned(frames: dict[str, DataFrame], time: str = "t", value: str = "value") -> DataFrame:
    """Complete cases of several series, one column each."""
    out = None
    for name, f in frames.items():
        f = f.select(time, F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value)).alias(name)).dropna()
        out = f if out is None else out.join(f, time)
    return out


def lossless_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame | None:
    """The inner join where it is one to one and loses nothing on either side; else None."""
    counts = [f.agg(F.count("*"), F.countDistinct(key)).first() for f in (left, right)]
    joined = left.join(right, key)
    return joined if len({n for c in counts for n in c} | {joined.count()}) == 1 else None


def overlapping(spans: DataFrame, events: DataFrame, by: list[str], start: str = "s", end: str = "e", width: int = 64) -> DataFrame:
    """Rows of ``spans`` that overlap a row of ``events``: an equi-join on the grid cells that both touch."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    left = spans.filter(F.col(start) < F.col(end)).withColumn("_id", F.xxhash64(*spans.columns)).withColumn("_cell", cells(start, end))
    right = events.filter(F.col(start) < F.col(end)).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), cells(start, end).alias("_cell"))
    return left.join(right, [*by, "_cell"]).filter((F.col(start) < F.col("_e")) & (F.col(end) > F.col("_s"))).select(*spans.columns).distinct()


@dataclass
class FeatureDefinition:
    name: str
    version: str
    transform: object
    inputs: tuple[str, ...] = ()
    warm_up: object = None
    missing_policy: str = "leave"
    scaling: str | None = None
    outputs: tuple[str, ...] = ()
    required: tuple[str, ...] = ()


@dataclass
class FeatureRegistry:
    """Definitions by name; another definition of the same version is an error."""

    known: dict[tuple[str, str], FeatureDefinition] = field(default_factory=dict)

    def register(self, d: FeatureDefinition) -> None:
        held = self.known.get((d.name, d.version))
        if held is not None and held is not d:
            raise ValueError(f"{d.name} {d.version} is registered already")
        self.known[(d.name, d.version)] = d

    def get(self, name: str, version: str | None = None) -> FeatureDefinition:
        found = [d for (n, v), d in self.known.items() if n == name and version in (None, v)]
        if not found:
            raise KeyError(name)
        return found[-1]


@dataclass
class FeatureBuilder:
    registry: FeatureRegistry

    def build(self, name: str, inputs: dict[str, DataFrame], *, as_of: Column, training: Column | None = None, time: str = "ts", published: str = "publication_ts", earliest: Column | None = None, p: Panel = ASSET) -> DataFrame:
        """Availability, transform, warm-up, missing values, scaling: one lazy plan."""
        d = self.registry.get(name)
        if lacking := set(d.inputs) - set(inputs):
            raise ValueError(f"inputs {sorted(lacking)} are missing")
        seen = {k: available_inputs(f, as_of, earliest, time, published) for k, f in inputs.items()}
        out = d.transform(seen)
        if lacking := set(d.outputs) - set(out.columns):
            raise ValueError(f"outputs {sorted(lacking)} are missing")
        if d.warm_up is not None:
            out = out.filter(F.col(time) >= as_of - d.warm_up)
        out = missing(out, list(d.outputs), d.missing_policy, p)
        if d.scaling:
            if training is None:
                raise ValueError("scaling needs a training window")
            out = scale(out, list(d.outputs), training, d.scaling)
        return missing(out, list(d.required), "error", p) if d.required else out


def dataset_hash(df: DataFrame) -> int:
    """Independent of the order of rows and partitions."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]


def build_dataset(features: DataFrame, targets: DataFrame, splits: Splits, *, width=0, lag=0, decision=0, horizon=1, policy: str = "drop", scaling: str | None = "standard", keys: tuple[str, ...] = ("asset", "t"), labels: DataFrame | None = None, p: Panel = ASSET) -> DataFrame:
    """Stamped, delayed, embargoed, complete rows that features, targets and labels share; scaled on the training rows."""
    names = [c for c in features.columns if c not in keys]
    out = embargo(execution_delay(stamp_splits(features, splits, p.time), lag, decision, horizon, p.time), splits, width, p.time)
    out = missing(out, names, policy, p)
    out = out.join(missing(targets, [c for c in targets.columns if c not in keys], policy, p), list(keys))
    if labels is not None:
        out = out.join(labels, list(keys))
    return scale(out, names, F.col("split") == "train", scaling) if scaling else out
