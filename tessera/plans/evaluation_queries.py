"""Queries of evaluation, ad-hoc SQL and set operations, each beside its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation, splits
from tessera.plans import inputs as I
from tessera.plans.feature_queries import K, r6
from tessera.plans.metric_queries import SMALL, _small

ADHOC = "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice) + 3.7e-9, 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY o_orderpriority"


def _adhoc(s, d):
    for t in ("orders", "customer"):
        I.table(s, d, t).createOrReplaceTempView(t)
    return s.sql(ADHOC)


def _models(s, d):
    """Suppliers as models, with a missing metric here and there."""
    t = I.table(s, d, "supplier")
    return t.select(F.col("s_name").alias("model"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("loss"), F.col("s_nationkey").cast("double").alias("score"))


def _ranking(s, d):
    r = I.returns(s, d).select("t", F.col("ret").alias("y"), F.col("volume").alias("f"))
    return I.rounded(evaluation.negative_spearman(r), ["t"])


def _paired(s, d):
    r = _small(s, d).withColumns({"lag1": I.ASSET.lag("ret"), "prob": (F.col("volume") > 3).cast("double")}).dropna(subset=["ret", "lag1"])
    mid = 473352 + 360
    got = evaluation.paired_task(r, evaluation.Task("ret", ("lag1",), ("prob",)), F.col("t") < mid, F.col("t") >= mid)
    return got.select(*K, "agnostic_loss", "aware_loss")


def _walk(s, d):
    r = _small(s, d).filter("ret is not null")
    make = lambda n: splits.ExpandingWindow(max(20, n // 3), max(5, n // 10), max(10, n // 6)).split(n)
    return evaluation.walk_forward(r, ["ret"], make).select("asset", "split", "t", "role", "state")


def _standardised(s, d):
    got = evaluation.preprocess(_small(s, d).dropna(subset=["ret"]), ["ret", "volume", "high"], F.col("t") < 473352 + 360)
    return I.rounded(got.select(*K, *[F.col("features")[i].alias(n) for i, n in enumerate(("ret", "volume", "high"))]), K)


def queries() -> dict:
    return {
        "sql_adhoc": _adhoc,
        "sets_union_by_name": lambda s, d: I.table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("of")).unionByName(I.table(s, d, "supplier").select(F.lit("s").alias("of"), F.col("s_nationkey").alias("nation"))).groupBy("nation", "of").agg(F.count("*").alias("n")),
        "sets_difference": lambda s, d: I.table(s, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(I.table(s, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct()),
        "eval_regime_baselines": lambda s, d: I.rounded(evaluation.regime_baselines(_small(s, d).withColumn("state", F.col("volume").cast("int") % 3)), K),
        "eval_flatten_metrics": lambda s, d: I.rounded(evaluation.flatten_metrics(_models(s, d), "model", ["loss", "score"]), ["model", "metric"]),
        "eval_rank_models": lambda s, d: I.rounded(evaluation.rank_models(_models(s, d), "loss"), ["model", "place"]),
        "eval_ranking_loss": _ranking,
        "eval_paired_task": _paired,
        "eval_walk_forward": _walk,
        "eval_preprocess": _standardised,
        "eval_preprocess_components": lambda s, d: evaluation.preprocess(_small(s, d).dropna(subset=["ret"]), ["ret", "volume", "high"], F.col("t") < 473352 + 360, 2).select(*K, F.size("features").alias("n")),
    }


def oracle_sql() -> dict[str, str]:
    models = "md AS (SELECT s_name AS model, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS loss, CAST(s_nationkey AS DOUBLE) AS score FROM supplier)"
    trend = "(PARTITION BY asset ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    rank = lambda c: f"rank() OVER (PARTITION BY t ORDER BY {c}) + (count(*) OVER (PARTITION BY t, {c}) - 1) / 2.0::DOUBLE"
    z = lambda c: f"({c} - avg({c}) FILTER (t < {473352 + 360}) OVER ()) / stddev_samp({c}) FILTER (t < {473352 + 360}) OVER ()"
    return {
        "eval_preprocess": f"WITH {I.RETURNS}, x AS (SELECT asset, t, volume, high, least(greatest(ret, -0.5), 0.5) / 10 AS ret FROM rets WHERE ret IS NOT NULL) SELECT asset, t, {r6(ret=z('ret'), volume=z('volume'), high=z('high'))} FROM x",
        "sql_adhoc": ADHOC,
        "sets_union_by_name": "SELECT nation, \"of\", count(*) AS n FROM (SELECT c_nationkey AS nation, 'c' AS \"of\" FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY 1, 2",
        "sets_difference": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem",
        "eval_regime_baselines": f"WITH {SMALL}, s AS (SELECT *, CAST(volume AS INT) % 3 AS state, coalesce(sign(avg(ret) OVER {trend}), 0) AS tr FROM sm), g AS (SELECT asset, state, sign(avg(ret)) AS sg FROM s GROUP BY 1, 2) SELECT asset, t, {r6(no_regime='coalesce(ret, 0)', simple_rule='coalesce(ret, 0) * tr', oracle='coalesce(ret, 0) * coalesce(sg, 0)')} FROM s JOIN g USING (asset, state)",
        "eval_flatten_metrics": f"WITH {models} SELECT model, metric, {r6(value='value')} FROM (SELECT model, 'loss' AS metric, loss AS value FROM md UNION ALL SELECT model, 'score', score FROM md) WHERE value IS NOT NULL",
        "eval_rank_models": f"WITH {models} SELECT model, row_number() OVER (ORDER BY loss ASC NULLS LAST, model) AS place, {r6(loss='loss', score='score')} FROM md",
        "eval_ranking_loss": f"WITH {I.RETURNS}, k AS (SELECT t, {rank('ret')} AS a, {rank('volume')} AS b FROM rets WHERE ret IS NOT NULL) SELECT t, {r6(loss='-(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0))')} FROM k GROUP BY t",
    }
