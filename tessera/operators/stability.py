"""How much estimates move from fit to fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import div
from tessera.operators import states


def parameter_uncertainty(samples: DataFrame, parameter: str = "parameter", value: str = "value") -> DataFrame:
    """The deviation of each parameter over its samples; missing and NaN samples do not count."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return samples.groupBy(parameter).agg(F.count(x).alias("samples"), F.stddev_samp(x).alias("uncertainty"))


def transition_stability(matrices: DataFrame, run: str = "run", a: str = "from_state", b: str = "to_state", value: str = "probability") -> DataFrame:
    """Mean Frobenius distance of each run's matrix from that of the run before; 0 for fewer than two.

    matrices: a row for each run and move; a move that a run lacks counts as 0.
    """
    runs = matrices.select(run).distinct().withColumn("_n", F.row_number().over(Window.orderBy(run)))  # a row for each run
    m = matrices.join(F.broadcast(runs), run).select("_n", a, b, F.col(value).alias("_x"))
    both = m.unionByName(m.select((F.col("_n") + 1).alias("_n"), a, b, (-F.col("_x")).alias("_x")))
    gap = both.groupBy("_n", a, b).agg(F.sum("_x").alias("_d")).groupBy("_n").agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("_f"))
    last = runs.agg(F.max("_n").alias("_last"))
    return last.join(gap, (F.col("_n") > 1) & (F.col("_n") <= F.col("_last")), "left").agg(F.coalesce(F.avg("_f"), F.lit(0.0)).alias("transition_stability"))


def label_alignment_stability(df: DataFrame, reference: str, candidate: str) -> float:
    """Share of rows on which the labels agree once the candidate's are matched with the reference's."""
    named = states.relabel(df, candidate, states.aligned_mapping(df, reference, candidate), "_aligned")
    return float(named.agg(F.avg((F.col("_aligned") == F.col(reference)).cast("double"))).first()[0] or 0.0)


def state_centroids(df: DataFrame, features: list[str], state: str = "state") -> DataFrame:
    """Rows, share and mean features of each state, in the features' own units."""
    n = df.filter(F.col(state).isNotNull()).groupBy(state).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])
    return n.withColumn("share", div(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(F.lit(0)))))
