"""Queries of stability, calibration, switching levels, durations, strategies and factor timing, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alignment, backtest, downstream, stability
from tessera.operators.features import options
from tessera.operators.models import other
from tessera.plans import inputs as I
from tessera.plans.feature_queries import UPTO, K, W, r6
from tessera.plans.metric_queries import CH, GR, SMALL, ST, _graded, _small, _states
from tessera.plans.model_queries import _option_days

WEEK = 168


def _smooth(s, d):
    return I.rounded(other.smooth_transition(_small(s, d), "ret", 50.0).select(*K, "weight"), K)


def _hazard(s, d):
    x = _states(s, d).dropna(subset=["ret"])
    return other.hazard(x, ["volume", "users"], horizon=2).select(*K, "event", "hazard")


def _calibration(s, d):
    return I.rounded(other.calibration(_graded(s, d).select("y", "p")), ["bin", "n"])


def _correlation(ranks):
    return lambda s, d: I.rounded(other.switching_correlation(I.bars(s, d), ["close", "volume"], 3, ranks=ranks).select(*K, "level", "state"), [*K, "state"])


def _correlation_sql(ranks: bool) -> str:
    base = f"{I.BARS}, v AS (SELECT asset, t, " + ("percent_rank() OVER (PARTITION BY asset ORDER BY \"close\") AS a, percent_rank() OVER (PARTITION BY asset ORDER BY volume) AS b" if ranks else '"close" AS a, volume AS b') + " FROM bars)"
    w = "(PARTITION BY asset ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
    return f"""WITH {base}, l AS (SELECT asset, t, coalesce(CASE WHEN count(*) OVER {w} > 1 THEN abs(covar_pop(a, b) OVER {w} / nullif(stddev_pop(a) OVER {w} * stddev_pop(b) OVER {w}, 0)) END, 0.0::DOUBLE) AS level FROM v),
c AS (SELECT asset, quantile_cont(level, 1 / 3.0::DOUBLE) AS q1, quantile_cont(level, 2 / 3.0::DOUBLE) AS q2 FROM l GROUP BY asset) SELECT asset, t, {r6(level="level")}, CAST(level >= q1 AS INT) + CAST(level >= q2 AS INT) AS state FROM l JOIN c USING (asset)"""


def _durations(s, d):
    return I.rounded(other.run_length_durations(_states(s, d), longest=5), ["asset", "state", "duration", "n"])


def _uncertainty(s, d):
    o = I.table(s, d, "orders").select(F.col("o_orderpriority").alias("parameter"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1000).alias("value"))
    return I.rounded(stability.parameter_uncertainty(o), ["parameter", "samples"])


def _weekly_moves(s, d):
    x = _states(s, d).withColumn("to_state", F.lead("state").over(I.ASSET.order)).filter("to_state is not null").withColumn("run", F.floor(F.col("t") / WEEK))
    n = x.groupBy("run", F.col("state").alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    whole = n.groupBy("run", "from_state").agg(F.sum("n").alias("m"))
    return n.join(whole, ["run", "from_state"]).withColumn("probability", F.col("n") / F.col("m"))


def _moves_stability(s, d):
    return I.rounded(stability.transition_stability(_weekly_moves(s, d)), [])


def _label_stability(s, d):
    x = stability.label_alignment_stability(_states(s, d), "state", "pred")
    return I.rounded(s.createDataFrame([(x,)], "label_stability double"), [])


def _centroids(s, d):
    return I.rounded(stability.state_centroids(_states(s, d), ["close", "volume", "users"]), ["state", "n"])


def _alignment(s, d):
    """States of the volume matched with those of the users by what they are like."""
    x = _states(s, d)
    a, b = (alignment.describe(x, ["close", "volume"], c) for c in ("state", "pred"))
    found = alignment.align(a, b, ("state_means", "covariances", "transitions", "durations", "distributions"))
    return s.createDataFrame([(c, r, found.matched[c]) for c, r in sorted(found.mapping.items())], "candidate int, reference int, cost double")


def _traded(s, d):
    x = _small(s, d).withColumn("w", F.signum(F.col("volume") - 3))
    return downstream.strategy_returns(x, "w", "ret", 0.001, 1)


def _net(s, d):
    return I.rounded(_traded(s, d).select(*K, "turnover", "net"), K, 8)


def _worth(s, d):
    return I.rounded(downstream.economic_metrics(_traded(s, d)), ["asset"], 5)


def _improvement(s, d):
    x = _small(s, d).select("asset", (F.col("ret") * F.col("ret")).alias("agnostic_loss"), (F.col("ret") - 0.001 * (F.col("volume") - 3)).alias("e"))
    return I.rounded(downstream.improvement(x.withColumn("aware_loss", F.col("e") * F.col("e")), by=["asset"]), ["asset", "n"], 8)


TRADED = SMALL + f""", w AS (SELECT asset, t, sign(volume - 3) AS w, lead(ret) OVER ({W}) AS r FROM sm), k AS (SELECT * FROM w WHERE r IS NOT NULL), n AS (SELECT asset, t, abs(w - coalesce(lag(w) OVER ({W}), 0)) AS turnover, w * r - 0.001::DOUBLE * abs(w - coalesce(lag(w) OVER ({W}), 0)) AS net FROM k)"""


def _chain(s, d):
    chain, _ = _option_days(s, d)
    return chain.withColumn("moneyness", F.col("strike") / 100.0)


def _signals(s, d):
    c = _chain(s, d)
    return I.rounded(c.select("contract", *[backtest.strategy_signal(n, c.columns, 0.05).alias(n) for n in backtest.STRATEGIES], backtest.exercised(F.col("option_type"), F.lit(100.0), F.col("strike"), F.col("tenor"), 14.0).alias("exercised")), ["contract", "exercised"])


CHAIN = """ch AS (SELECT l_orderkey * 10 + l_linenumber AS contract, CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END AS kind, 90.0::DOUBLE + l_suppkey % 30 AS strike, l_linenumber * 7.0::DOUBLE AS tenor, 0.1::DOUBLE + l_discount AS iv FROM lineitem)"""


def _option_factors(s, d):
    o = I.options(s, d).select("t", F.col("tenor_days").alias("tenor"), (F.round(F.col("delta") * 4) / 4).alias("delta"), "iv")
    return I.rounded(options.option_factors(o, ["t"]), ["t"])


def _timing(per_asset):
    def query(s, d):
        wide = I.returns(s, d).groupBy("t").pivot("asset", ["click", "view"]).agg(F.first("ret"))
        return I.rounded(backtest.timing_multiplier(wide, ["click", "view"] if per_asset else ["click", "absent"]), ["t", "asset"])

    return query


def queries() -> dict:
    return {
        "model_smooth_transition": _smooth, "model_transition_hazard": _hazard, "model_calibration": _calibration, "model_switching_correlation": _correlation(False), "model_switching_copula": _correlation(True), "model_run_length_durations": _durations,
        "stability_parameter_uncertainty": _uncertainty, "stability_transitions": _moves_stability, "stability_labels": _label_stability, "states_centroids": _centroids, "states_alignment": _alignment,
        "downstream_strategy_returns": _net, "downstream_economic_metrics": _worth, "downstream_improvement": _improvement,
        "backtest_strategy_signals": _signals, "options_factors": _option_factors, "backtest_timing_by_asset": _timing(True), "backtest_timing_for_all": _timing(False),
    }


def oracle_sql() -> dict[str, str]:
    nearest = "iv ORDER BY abs(abs(delta) - 0.5::DOUBLE), iv"
    side = lambda e: f"sign(CASE WHEN abs({e}) >= 0.05 THEN {e} ELSE 0 END)"
    held = lambda a: f"coalesce(last_value({a} IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE)"
    wide = I.RETURNS + ", wd AS (SELECT t, max(CASE WHEN asset = 'click' THEN ret END) AS a, max(CASE WHEN asset = 'view' THEN ret END) AS b FROM rets GROUP BY t), h AS (SELECT t, " + f"{held('a')} AS a, {held('b')} AS b FROM wd)"
    permuted = " UNION ALL ".join(f"SELECT {a} AS p0, {b} AS p1, {c} AS p2" for a, b, c in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)))
    return {
        "model_smooth_transition": f"WITH {SMALL}, l AS (SELECT asset, t, lag(ret) OVER ({W}) AS x FROM sm), c AS (SELECT asset, quantile_cont(x, 0.5) AS c FROM l GROUP BY asset) SELECT asset, t, {r6(weight='1 / (1 + exp(-50.0::DOUBLE * (x - c)))')} FROM l JOIN c USING (asset)",
        "model_calibration": f"WITH {GR}, w AS (SELECT avg((y - p) * (y - p)) AS brier, avg(-ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15), 1))) AS log_loss FROM gr), b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(y) AS f, avg(p) AS m FROM gr GROUP BY 1) SELECT bin, n, {r6(fraction_of_positives='f', mean_predicted_probability='m', brier='brier', log_loss='log_loss')} FROM b, w",
        "model_switching_correlation": _correlation_sql(False),
        "model_switching_copula": _correlation_sql(True),
        "model_run_length_durations": f"WITH {CH}, rn AS (SELECT asset, segment, state, least(count(*), 5) AS duration FROM sg GROUP BY ALL), n AS (SELECT asset, state, duration, count(*) AS n FROM rn GROUP BY ALL) SELECT asset, state, duration, n, {r6(probability='(n + 1e-12) / (sum(n) OVER g + 5e-12)', expected_duration='sum(duration * n) OVER g / CAST(sum(n) OVER g AS DOUBLE)')} FROM n WINDOW g AS (PARTITION BY asset, state)",
        "stability_parameter_uncertainty": f"SELECT o_orderpriority AS parameter, count(*) FILTER (o_orderkey % 5 <> 0) AS samples, {r6(uncertainty='stddev_samp(o_totalprice / 1000) FILTER (o_orderkey % 5 <> 0)')} FROM orders GROUP BY 1",
        "stability_transitions": f"WITH {ST}, l AS (SELECT t // {WEEK} AS run, state AS a, lead(state) OVER ({W}) AS b FROM st), n AS (SELECT run, a, b, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY ALL), p AS (SELECT run, a, b, n / CAST(sum(n) OVER (PARTITION BY run, a) AS DOUBLE) AS p FROM n), r AS (SELECT run, row_number() OVER (ORDER BY run) AS k FROM (SELECT DISTINCT run FROM p)), q AS (SELECT k, a, b, p FROM p JOIN r USING (run)), f AS (SELECT r.k, s.a, s.b, coalesce(x.p, 0) - coalesce(y.p, 0) AS d FROM r CROSS JOIN (SELECT u.a, v.a AS b FROM (SELECT DISTINCT a FROM q) u, (SELECT DISTINCT b AS a FROM q) v) s LEFT JOIN q x ON x.k = r.k AND x.a = s.a AND x.b = s.b LEFT JOIN q y ON y.k = r.k - 1 AND y.a = s.a AND y.b = s.b WHERE r.k > 1), g AS (SELECT sqrt(sum(d * d)) AS g FROM f GROUP BY k) SELECT {r6(transition_stability='coalesce(avg(g), 0)')} FROM g",
        "stability_labels": f"WITH {ST}, perm AS ({permuted}) SELECT max(r) AS label_stability FROM (SELECT {r6(r='avg(CASE WHEN state = CASE pred WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END THEN 1.0::DOUBLE ELSE 0 END)')} FROM st, perm GROUP BY p0, p1, p2)",
        "states_centroids": f"WITH {ST} SELECT state, count(*) AS n, {r6(close='avg(' + chr(34) + 'close' + chr(34) + ')', volume='avg(volume)', users='avg(users)', share='count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} FROM st GROUP BY state",
        "downstream_strategy_returns": f"WITH {TRADED} SELECT asset, t, {r6(8, turnover='turnover', net='net')} FROM n",
        "downstream_economic_metrics": f"WITH {TRADED}, g AS (SELECT *, exp(sum(ln(1 + net)) OVER {UPTO}) AS w FROM n), f AS (SELECT *, w / max(w) OVER {UPTO} - 1 AS fall FROM g), m AS (SELECT asset, avg(net) * 252 AS ar, stddev_samp(net) * sqrt(252) AS v, min(fall) AS md, avg(turnover) AS tu FROM f GROUP BY asset) SELECT asset, {r6(5, annualized_return='ar', annualized_volatility='v', max_drawdown='md', turnover='tu', sharpe='CASE WHEN v > 0 THEN ar / v ELSE 0 END')} FROM m",
        "downstream_improvement": f"WITH {SMALL}, l AS (SELECT asset, ret * ret AS a, (ret - 0.001::DOUBLE * (volume - 3)) * (ret - 0.001::DOUBLE * (volume - 3)) AS b FROM sm WHERE ret IS NOT NULL), m AS (SELECT asset, count(*) AS n, avg(a) AS a, avg(b) AS b FROM l GROUP BY asset) SELECT asset, n, {r6(8, agnostic_loss='a', aware_loss='b', absolute_improvement='a - b', relative_improvement='CASE WHEN a = 0 THEN 0 ELSE (a - b) / abs(a) END')} FROM m",
        "backtest_strategy_signals": f"WITH {CHAIN} SELECT contract, {r6(delta_hedged='1.0::DOUBLE', tail_hedge=chr(67) + 'ASE WHEN kind = ' + chr(39) + 'put' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0 END', volatility_carry='-' + side('iv'), skew_trading=side('(1 - strike / 100)'), term_structure=side('(tenor - 30)'), realized_vs_implied=side('(0 - iv)'))}, tenor <= 14 AND CASE WHEN kind = 'call' THEN 100 - strike ELSE strike - 100 END > 0 AS exercised FROM ch",
        "options_factors": f"WITH {I.OPTIONS}, o AS (SELECT t, tenor_days AS tenor, round(delta * 4) / 4 AS delta, iv FROM opts), g AS (SELECT t, first({nearest}) AS atm, avg(CASE WHEN abs(delta) <= 0.25 OR abs(delta) >= 0.75 THEN iv END) AS wing, min(CASE WHEN delta = -0.25 THEN iv END) - min(CASE WHEN delta = 0.25 THEN iv END) AS skew, first(iv ORDER BY tenor, iv) AS front, first(iv ORDER BY tenor DESC, iv) AS back FROM o GROUP BY t) SELECT t, {r6(smile='coalesce(wing - atm, 0)', skew='coalesce(skew, 0)', curvature='coalesce(wing - atm, 0) - coalesce(skew, 0) / 2', term_structure='back - front')} FROM g",
        "backtest_timing_by_asset": f"WITH {wide}, u AS (SELECT t, 'click' AS asset, a AS x FROM h UNION ALL SELECT t, 'view', b FROM h) SELECT t, asset, {r6(x='x')} FROM u",
        "backtest_timing_for_all": f"WITH {wide} SELECT t, CAST(NULL AS VARCHAR) AS asset, {r6(x='(a + b) / 2')} FROM h",
    }
