"""Queries of the point-in-time, split, state, metric and rule operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics, pit, rules, splits, states
from tessera.plans import inputs as I
from tessera.plans.feature_queries import UPTO, K, W, full, r6, rows

FIRST_HOUR = 473352  # 2024-01-01 in hours


def _states(s, d):
    return I.returns(s, d).withColumns({"state": F.col("volume").cast("int") % 3, "pred": F.col("users").cast("int") % 3, "hot": (F.col("volume") >= 4).cast("int"), "seen": (F.col("users") >= 4).cast("int")})


ST = I.RETURNS + ", st AS (SELECT *, CAST(volume AS INT) % 3 AS state, CAST(users AS INT) % 3 AS pred, CAST(volume >= 4 AS INT) AS hot, CAST(users >= 4 AS INT) AS seen FROM rets)"
CH = ST + f", ch AS (SELECT *, CASE WHEN state <> lag(state) OVER ({W}) THEN 1 ELSE 0 END AS changed FROM st), sg AS (SELECT *, sum(changed) OVER {UPTO} AS segment FROM ch)"
RUNS = CH + ", runs AS (SELECT asset, segment, state, min(t) AS start, max(t) AS stop, count(*) AS length FROM sg GROUP BY ALL)"
OCC = ST + ", oc AS (SELECT asset, state, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY asset) AS DOUBLE) AS share FROM st GROUP BY asset, state)"
TR = ST + f", nx AS (SELECT asset, state AS from_state, lead(state) OVER ({W}) AS to_state FROM st), tr AS (SELECT asset, from_state, to_state, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY asset, from_state) AS DOUBLE) AS probability FROM nx WHERE to_state IS NOT NULL GROUP BY 1, 2, 3)"


def _graded(s, d):
    """Labelled documents with a score made of their length."""
    docs, lab = I.table(s, d, "documents"), I.table(s, d, "labels")
    return docs.join(lab, "doc_id").select("lang", F.col("quality").cast("double").alias("y"), ((F.col("n_chars") % 101) / 100).alias("p"), (F.col("n_chars") % 7 + 1.0).alias("f"), (F.col("n_chars") % 11 + 1.0).alias("v"))


GR = "gr AS (SELECT lang, CAST(quality AS DOUBLE) AS y, (n_chars % 101) / 100.0::DOUBLE AS p, n_chars % 7 + 1.0::DOUBLE AS f, n_chars % 11 + 1.0::DOUBLE AS v FROM documents JOIN labels USING (doc_id))"


def cdf(x: str) -> str:
    """The normal distribution by its series of positive terms, which shares nothing with the engine's approximation."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2.0::DOUBLE) - lgamma(k + 1.5::DOUBLE) + 0.5::DOUBLE * ln(pi()))"
    series = f"sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 130), lambda k: {term}))"
    return f"(CASE WHEN {x} < -8 THEN 0.0::DOUBLE WHEN {x} > 8 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE + {series} END)"


def _pit(s, d):
    li = I.table(s, d, "lineitem").select("l_partkey", F.col("l_shipdate").alias("publication_ts"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate") + F.expr("interval 2 days")).alias("vendor_received_ts"), "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"), "l_quantity")
    cut = F.expr("timestamp_ntz'1997-06-30 00:00:00'")
    # lines that agree in all of this are told apart by their price
    got = pit.point_in_time_snapshot(li.withColumn("tie2", F.struct("tie", "l_extendedprice")), cut, ["l_partkey"], tie="tie2")
    return got.select("l_partkey", F.col("tie"), "l_extendedprice")


PIT = """WITH li AS (SELECT l_partkey, l_shipdate AS p, CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate + INTERVAL 2 DAY END AS r, l_extendedprice, l_orderkey * 10 + l_linenumber AS tie FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY p DESC, r DESC NULLS FIRST, tie DESC, l_extendedprice DESC) AS n FROM li WHERE p <= TIMESTAMP '1997-06-30' AND (r IS NULL OR r <= TIMESTAMP '1997-06-30'))
SELECT l_partkey, tie, l_extendedprice FROM k WHERE n = 1"""

SPLITS = pit.Splits(pit.TimeWindow(FIRST_HOUR, FIRST_HOUR + 300), pit.TimeWindow(FIRST_HOUR + 301, FIRST_HOUR + 450), pit.TimeWindow(FIRST_HOUR + 451, FIRST_HOUR + 800))
SPLIT_SQL = f"CASE WHEN t BETWEEN {FIRST_HOUR + 451} AND {FIRST_HOUR + 800} THEN 'test' WHEN t BETWEEN {FIRST_HOUR + 301} AND {FIRST_HOUR + 450} THEN 'validation' WHEN t BETWEEN {FIRST_HOUR} AND {FIRST_HOUR + 300} THEN 'train' END"


def _dataset(s, d):
    r = I.returns(s, d)
    features, targets = r.select("asset", "t", "volume", "high"), r.select("asset", "t", F.col("ret").alias("target"))
    got = pit.build_dataset(features, targets, SPLITS, width=5, lag=1, decision=1, horizon=3)
    return I.rounded(got, [*K, "split", "available_at", "label_available_at"])


DATASET = I.RETURNS + f", sp AS (SELECT *, {SPLIT_SQL} AS split FROM rets), em AS (SELECT asset, t, split, t + 2 AS available_at, t + 3 AS label_available_at, volume, high, ret AS target FROM sp WHERE split IS NOT NULL AND ret IS NOT NULL AND NOT (t > {FIRST_HOUR + 300} AND t <= {FIRST_HOUR + 305}) AND NOT (t > {FIRST_HOUR + 450} AND t <= {FIRST_HOUR + 455})), fit AS (SELECT avg(volume) mv, stddev_pop(volume) sv, avg(high) mh, stddev_pop(high) sh FROM em WHERE split = 'train')"


def _as_of(s, d):
    b = I.bars(s, d)
    quotes = b.filter("volume >= 4").select("asset", "t", F.col("close").alias("quote"))
    return pit.as_of(b.select("asset", "t"), quotes, "quote", by=["asset"], default=0.0)


def _overlap(s, d):
    r = states.runs(_states(s, d), "hot").filter("hot = 1").select("asset", F.col("start").alias("s"), (F.col("stop") + 1).alias("e"))
    other = states.runs(_states(s, d), "seen").filter("seen = 1").select("asset", F.col("start").alias("s"), (F.col("stop") + 1).alias("e"))
    return pit.overlapping(r, other.filter("e - s >= 2"), ["asset"])


def _run_sql(col: str, cte: str) -> str:
    return f"c_{cte} AS (SELECT *, CASE WHEN {col} <> lag({col}) OVER ({W}) THEN 1 ELSE 0 END AS c FROM st), s_{cte} AS (SELECT *, sum(c) OVER {UPTO} AS g FROM c_{cte}), {cte} AS (SELECT asset, min(t) AS s, max(t) + 1 AS e FROM s_{cte} WHERE {col} = 1 GROUP BY asset, g)"


def _splits(s, d):
    o = I.table(s, d, "orders").groupBy(F.expr("timestampdiff(DAY, timestamp_ntz'1992-01-01 00:00:00', o_orderdate)").alias("t")).agg(F.sum("o_totalprice").alias("v"))
    at = splits.with_positions(o)
    n = o.count()
    some = list(splits.purged(500, 50, 100, 400, embargo=3).split(n))
    got = splits.assign(at.withColumns({"ls": F.col("rn"), "le": F.col("rn") + 5}), some, n, start="ls", end="le")
    return splits.windows(got)


SPLIT_QUERY = """WITH o AS (SELECT date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS t FROM orders GROUP BY 1), p AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS rn, count(*) OVER () AS n FROM o),
k AS (SELECT CAST(range AS INT) AS split, 500 + 400 * range AS b FROM range(100)),
a AS (SELECT split, rn, t, CASE WHEN rn >= b + 50 AND rn < b + 150 THEN 'test' WHEN rn >= b AND rn < b + 50 THEN 'validation' WHEN rn < b THEN 'train' END AS role, b FROM p JOIN k ON b + 150 <= n WHERE rn < b + 150),
f AS (SELECT * FROM a WHERE NOT (role = 'train' AND (rn >= b - 3 OR rn + 5 > b)))
SELECT split, role, min(rn) AS first, max(rn) + 1 AS stop, min(t) AS "from", max(t) AS "to", count(*) AS n FROM f GROUP BY split, role"""


def _losses(s, d):
    r = _small(s, d).filter("ret is not null")
    return r.withColumns({"a": F.pow(F.col("ret") - 0.1, 2), "b": F.abs("ret")})


def _dm(s, d):
    return I.rounded(metrics.diebold_mariano(_losses(s, d), "a", "b"), ["asset", "n"], 5)


def _dm_sql() -> str:
    lags = range(1, 10)
    terms = " + ".join(f"2 * greatest(0.0::DOUBLE, 1 - {k} / (kk + 1)) * coalesce(sum(c * l{k}), 0.0::DOUBLE) / n" for k in lags)
    near = ", ".join(f"lag(c, {k}) OVER ({W}) AS l{k}" for k in lags)
    return f"""WITH {SMALL}, l AS (SELECT asset, t, (ret - 0.1::DOUBLE) * (ret - 0.1::DOUBLE) - abs(ret) AS d FROM sm WHERE ret IS NOT NULL), m AS (SELECT asset, count(*) AS n, avg(d) AS m, floor(cbrt(count(*)) + 1e-9) AS kk FROM l GROUP BY asset),
c AS (SELECT asset, t, n, m, kk, d - m AS c FROM l JOIN m USING (asset)), k AS (SELECT *, {near} FROM c), g AS (SELECT asset, n, m, sum(c * c) / n + {terms} AS v FROM k GROUP BY asset, n, m, kk), z AS (SELECT *, CASE WHEN v > 0 THEN m / sqrt(v / n) END AS z FROM g)
SELECT asset, n, {r6(5, mean_difference="m", long_run_variance="v", statistic="z", p_value=f"2 * (1 - {cdf('abs(z)')})")} FROM z"""


def _fdr(s, d, method):
    n = I.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 37 % 1009 + 1) / 20000.0).alias("p_value"))
    return I.rounded(metrics.false_discovery(n, method=method), ["k"])


def _fdr_sql(q: str) -> str:
    return f"WITH p AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 1009 + 1) / 20000.0::DOUBLE AS p FROM supplier), m AS (SELECT *, CAST(count(*) OVER () AS DOUBLE) AS m, CAST(row_number() OVER (ORDER BY p) AS DOUBLE) AS r FROM p), q AS (SELECT *, {q} AS q FROM m) SELECT k, round(p + 3.7e-9::DOUBLE, 6) + 0 AS p_value, round(least(q, 1) + 3.7e-9::DOUBLE, 6) + 0 AS adjusted, least(q, 1) <= 0.05 AS rejected FROM q"


FDR = {
    "bonferroni": "p * m",
    "holm": "max(p * (m - r + 1)) OVER (ORDER BY r)",
    "benjamini-hochberg": "min(p * m / r) OVER (ORDER BY r DESC)",
    "benjamini-yekutieli": "min(p * m * (SELECT sum(1 / CAST(range AS DOUBLE)) FROM range(1, CAST((SELECT count(*) FROM p) AS INT) + 1)) / r) OVER (ORDER BY r DESC)",
}


def _small(s, d):
    return I.returns(s, d).withColumn("ret", F.when(F.col("ret").isNotNull(), F.least(F.greatest(F.col("ret"), F.lit(-0.5)), F.lit(0.5)) / 10))


SMALL = I.RETURNS + ", sm AS (SELECT asset, t, volume, CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.5), 0.5) / 10 END AS ret FROM rets)"
_LN = "ln(greatest(1 + ret, 1e-12))"


def _economic_sql(by: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {SMALL}, r AS (SELECT *, CAST(volume AS INT) % 2 AS part FROM sm WHERE ret IS NOT NULL), e AS (SELECT *, exp(sum({_LN}) OVER {w}) AS eq FROM r), d AS (SELECT *, eq / max(eq) OVER {w} - 1 AS dd FROM e), v AS (SELECT {by}, quantile_cont(ret, 0.05) AS va FROM r GROUP BY {by}),
g AS (SELECT {by}, count(*) AS n, exp(sum({_LN}) * 252 / count(*)) - 1 AS ar, stddev_samp(ret) AS sd, avg(ret) AS m, sqrt(avg(least(ret, 0) * least(ret, 0))) AS dn, min(dd) AS md, first(va) AS va, avg(CASE WHEN ret <= va THEN ret END) AS es, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) AS gain, sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END) AS loss FROM d JOIN v USING ({by}) GROUP BY {by})
SELECT {by}, n, {r6(5, annual_return="ar", volatility="sd * sqrt(252.0)", sharpe="m / nullif(sd, 0) * sqrt(252.0)", sortino="m / nullif(dn, 0) * sqrt(252.0)", calmar="ar / nullif(abs(md), 0)", max_drawdown="md", value_at_risk="va", expected_shortfall="es", hit_rate="hit", profit_factor="gain / nullif(loss, 0)")} FROM g"""


def _psr_sql(benchmark: float, name: str) -> str:
    z = f"(sr - {benchmark!r}::DOUBLE) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (ku - 1) / 4 * sr * sr, 1e-12))"
    return f"WITH {SMALL}, m AS (SELECT asset, CAST(count(ret) AS DOUBLE) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM sm GROUP BY asset), d AS (SELECT asset, n, m / nullif(s, 0) AS sr, avg(pow((ret - m) / s, 3)) AS sk, avg(pow((ret - m) / s, 4)) AS ku FROM sm JOIN m USING (asset) WHERE ret IS NOT NULL GROUP BY asset, n, m, s), z AS (SELECT asset, sr, {z} AS z FROM d) SELECT asset, {r6(sharpe='sr', **{name: cdf('z')})} FROM z"


def _risk_rules():
    return (rules.Threshold("volume", 4.0), rules.Threshold("ret", 0.0, False, 2.0), rules.Threshold("users", 3.0))


VOTES = "(CASE WHEN volume >= 4 THEN 1 ELSE 0 END + CASE WHEN ret IS NULL THEN 0 WHEN ret <= 0 THEN {w} ELSE 0 END + CASE WHEN users >= 3 THEN 1 ELSE 0 END)"


def queries() -> dict:
    at = lambda make, keys, digits=6: lambda s, d: I.rounded(make(s, d), keys, digits)
    st = lambda make, keys, **kw: lambda s, d: I.rounded(make(_states(s, d), **kw), keys)
    hot = lambda s, d, c: states.boundaries(_states(s, d), c)
    q = {
        "pit_snapshot": _pit,
        "pit_dataset": _dataset,
        "pit_as_of": _as_of,
        "pit_overlapping_spans": _overlap,
        "pit_forward_fill": lambda s, d: I.rounded(pit.missing(I.returns(s, d).select("asset", "t", F.when(F.col("volume") > 2, F.col("close")).alias("x")), ["x"], "ffill"), K),
        "pit_one_hot": lambda s, d: pit.one_hot(I.table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"]),
        "splits_purged_walk_forward": _splits,
        "splits_holdout": lambda s, d: splits.asset_universe_holdout(["click"], ["view", "error"]).assign(I.bars(s, d)).groupBy("role").agg(F.count("*").alias("n"), F.min("t").alias("first")),
        "states_runs": st(states.runs, ["asset", "segment", "state"]),
        "states_persistence": st(states.persistence, ["asset"]),
        "states_durations": st(states.durations, ["asset", "state"]),
        "states_occupancy": st(states.occupancy, ["asset", "state"]),
        "states_entropy": st(states.occupancy_entropy, ["asset"]),
        "states_rare": st(states.rare_states, ["asset", "state"], threshold=0.3),
        "states_transitions": st(states.transitions, ["asset", "from_state", "to_state"]),
        "states_transition_concentration": st(states.transition_concentration, ["asset"]),
        "states_transition_events": lambda s, d: states.transition_events(_states(s, d), horizon=2).select(*K, "event"),
        "states_smooth": lambda s, d: states.smooth(_states(s, d)).select(*K, "smoothed"),
        "states_agreement": st(states.agreement, [], a="state", b="pred"),
        "states_separability": st(states.separability, [], features=["open", "volume"]),
        "states_detection_delay": lambda s, d: I.rounded(states.detection_delay(hot(s, d, "hot"), hot(s, d, "seen")), ["asset"]),
        "states_false_alarms": lambda s, d: I.rounded(states.false_alarm_rate(hot(s, d, "hot"), hot(s, d, "seen"), 1), ["asset"]),
        "metrics_point_errors": at(lambda s, d: metrics.point_errors(_graded(s, d), "v", "f", ["lang"]), ["lang"]),
        "metrics_brier": at(lambda s, d: metrics.brier_score(_graded(s, d), by=["lang"]), ["lang"]),
        "metrics_calibration": at(lambda s, d: metrics.calibration(_graded(s, d)), []),
        "metrics_log_scores": at(lambda s, d: metrics.log_scores(_graded(s, d), "p"), [], 4),
        "metrics_intervals": at(lambda s, d: metrics.interval_scores(_graded(s, d).withColumns({"lower": F.col("f") - 2, "upper": F.col("f") + 2}), "v"), []),
        "metrics_crps_normal": at(lambda s, d: _graded(s, d).groupBy("lang").agg(F.avg(metrics.crps_normal(F.col("v"), F.col("f"), F.lit(2.0))).alias("crps")), ["lang"], 5),
        "metrics_crps_samples": at(lambda s, d: _graded(s, d).groupBy("lang").agg(F.avg(metrics.crps_samples(F.col("v"), F.array(F.col("f"), F.col("f") + 1, F.col("f") * 2))).alias("crps")), ["lang"]),
        "metrics_multiclass_brier": at(lambda s, d: _graded(s, d).groupBy("lang").agg(F.avg(metrics.multiclass_brier(F.array(1 - F.col("p"), F.col("p")), F.col("y").cast("int"))).alias("brier")), ["lang"]),
        "metrics_probability_entropy": at(lambda s, d: _graded(s, d).groupBy("lang").agg(F.avg(states.probability_entropy(F.array(1 - F.col("p"), F.col("p")))).alias("entropy")), ["lang"]),
        "metrics_diebold_mariano": _dm,
        "metrics_economic": at(lambda s, d: metrics.economic_metrics(_small(s, d)), ["asset", "n"], 5),
        "metrics_economic_by_slice": at(lambda s, d: metrics.conditional_economic_metrics(_small(s, d).withColumn("part", F.col("volume").cast("int") % 2), "part"), ["asset", "part", "n"], 5),
        "metrics_probabilistic_sharpe": at(lambda s, d: metrics.probabilistic_sharpe(_small(s, d)), ["asset"]),
        "metrics_deflated_sharpe": at(lambda s, d: metrics.deflated_sharpe(_small(s, d), 20, 0.05), ["asset"]),
        "rules_static": at(lambda s, d: rules.StaticRule(_risk_rules()).predict(I.returns(s, d)).select(*K, "score", "state"), [*K, "state"]),
        "rules_composite": at(lambda s, d: rules.composite(_risk_rules(), {"ret": 3.0}).predict(I.returns(s, d)).select(*K, "score", "state"), [*K, "state"]),
        "rules_percentile": at(lambda s, d: rules.PercentileRule("close", 0.8, 50, 20).predict(I.bars(s, d)).select(*K, "threshold", "state"), [*K, "state"]),
        "rules_hysteresis": lambda s, d: rules.HysteresisRule("volume", 4, 2).predict(I.bars(s, d)).select(*K, "state"),
    }
    for m in FDR:
        q[f"metrics_fdr_{m.replace('-', '_')}"] = lambda s, d, m=m: _fdr(s, d, m)
    return q


def oracle_sql() -> dict[str, str]:
    bound = lambda c, n: f"{n} AS (SELECT asset, t FROM (SELECT asset, t, {c} <> lag({c}) OVER ({W}) AS x FROM st) WHERE x)"
    both = f"WITH {ST}, {bound('hot', 'tb')}, {bound('seen', 'fb')}"
    same = f"{ST}, sp AS (SELECT asset, CASE WHEN lag(state) OVER ({W}) IS NOT NULL THEN CAST(state = lag(state) OVER ({W}) AS INT) END AS s FROM st)"
    two = lambda x: f"sum({x} * ({x} - 1) / 2)"
    cont = f"{ST}, c AS (SELECT state a, pred b, CAST(count(*) AS DOUBLE) n FROM st GROUP BY 1, 2), x AS (SELECT {two('n')} cc, sum(n * log2(n)) hc, sum(n) n FROM c), xa AS (SELECT {two('n')} ca, sum(n * log2(n)) ha FROM (SELECT sum(n) n FROM c GROUP BY a)), xb AS (SELECT {two('n')} cb, sum(n * log2(n)) hb FROM (SELECT sum(n) n FROM c GROUP BY b)), z AS (SELECT *, ca * cb / (n * (n - 1) / 2) AS e FROM x, xa, xb)"
    cal = f"{GR}, b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM gr GROUP BY 1)"
    ent = lambda x: f"CASE WHEN {x} > 0 THEN -{x} * ln({x}) / ln(2.0) ELSE 0 END"
    votes, more = VOTES.format(w=2), VOTES.format(w=3)
    cut = f"CASE WHEN count(\"close\") OVER {rows(50)} >= 20 THEN quantile_cont(\"close\", 0.8) OVER {rows(50)} END"
    o = {
        "pit_snapshot": PIT,
        "pit_dataset": f"WITH {DATASET} SELECT asset, t, split, available_at, label_available_at, {r6(volume='(volume - mv) / sv', high='(high - mh) / sh', target='target')} FROM em, fit",
        "pit_as_of": f"WITH {I.BARS}, q AS (SELECT asset, t, \"close\" AS quote FROM bars WHERE volume >= 4) SELECT b.asset, b.t, coalesce(q.quote, 0) AS quote FROM bars b ASOF LEFT JOIN q ON b.asset = q.asset AND b.t >= q.t",
        "pit_overlapping_spans": f"WITH {ST}, {_run_sql('hot', 'h')}, {_run_sql('seen', 'n')} SELECT DISTINCT h.asset, h.s, h.e FROM h JOIN n ON h.asset = n.asset AND h.s < n.e AND h.e > n.s AND n.e - n.s >= 2",
        "pit_forward_fill": f"WITH {I.BARS}, x AS (SELECT asset, t, CASE WHEN volume > 2 THEN \"close\" END AS x FROM bars) SELECT asset, t, {r6(x=f'last_value(x IGNORE NULLS) OVER {UPTO}')} FROM x",
        "pit_one_hot": "SELECT o_orderkey, o_orderstatus, CAST(o_orderstatus = 'F' AS INT) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INT) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INT) AS \"o_orderstatus_P\" FROM orders",
        "splits_purged_walk_forward": SPLIT_QUERY,
        "splits_holdout": f"WITH {I.BARS} SELECT CASE WHEN asset IN ('view', 'error') THEN 'test' WHEN asset = 'click' THEN 'validation' ELSE 'train' END AS role, count(*) AS n, min(t) AS first FROM bars GROUP BY 1",
        "states_runs": f"WITH {RUNS} SELECT * FROM runs",
        "states_persistence": f"WITH {same} SELECT asset, {r6(persistence='coalesce(avg(s), 1)', switching_frequency='1 - coalesce(avg(s), 1)')}, coalesce(sum(1 - s), 0) AS changes FROM sp GROUP BY asset",
        "states_durations": f"WITH {RUNS} SELECT asset, state, count(*) AS recurrence, {r6(mean_duration='avg(length)')}, min(length) AS min_duration, max(length) AS max_duration FROM runs GROUP BY asset, state",
        "states_occupancy": f"WITH {OCC} SELECT asset, state, n, {r6(share='share')} FROM oc",
        "states_entropy": f"WITH {OCC} SELECT asset, {r6(entropy='-sum(share * ln(share)) / ln(2.0)', hhi='sum(share * share)')} FROM oc GROUP BY asset",
        "states_rare": f"WITH {OCC} SELECT asset, state, n, {r6(share='share')} FROM oc WHERE share <= 0.3",
        "states_transitions": f"WITH {TR} SELECT asset, from_state, to_state, n, {r6(probability='probability')} FROM tr",
        "states_transition_concentration": f"WITH {TR}, m AS (SELECT asset, from_state, max(probability) AS p FROM tr GROUP BY 1, 2) SELECT asset, {r6(transition_concentration='avg(p)')} FROM m GROUP BY asset",
        "states_transition_events": f"WITH {ST} SELECT asset, t, CASE WHEN lead(state, 2) OVER ({W}) IS NULL THEN 0 WHEN lead(state, 1) OVER ({W}) <> state OR lead(state, 2) OVER ({W}) <> state THEN 1 ELSE 0 END AS event FROM st",
        "states_smooth": f"WITH {ST}, n AS (SELECT asset, t, state AS b, lag(state) OVER ({W}) AS a, lead(state) OVER ({W}) AS c FROM st) SELECT asset, t, CASE WHEN a = b OR b = c THEN b WHEN a = c THEN a ELSE least(a, b, c) END AS smoothed FROM n",
        "states_agreement": f"WITH {cont} SELECT {r6(adjusted_rand='coalesce((cc - e) / nullif((ca + cb) / 2 - e, 0), 1)', variation_of_information='(ha + hb - 2 * hc) / n', mutual_information='log2(n) + (hc - ha - hb) / n')} FROM z",
        "states_separability": f"WITH {ST}, g AS (SELECT avg(open) go, avg(volume) gv FROM st), c AS (SELECT state, avg(open) co, avg(volume) cv FROM st GROUP BY 1), b AS (SELECT avg(sqrt((co - go) * (co - go) + (cv - gv) * (cv - gv))) AS b FROM c, g), w AS (SELECT avg(w) AS w FROM (SELECT state, avg(sqrt((open - co) * (open - co) + (volume - cv) * (volume - cv))) AS w FROM st JOIN c USING (state) GROUP BY state)) SELECT {r6(separability='b / greatest(w, 1e-12)')} FROM b, w",
        "states_detection_delay": f"{both} SELECT asset, {r6(detection_delay='avg(n - t)')}, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS missed FROM (SELECT tb.asset, tb.t, (SELECT min(fb.t) FROM fb WHERE fb.asset = tb.asset AND fb.t >= tb.t) AS n FROM tb) GROUP BY asset",
        "states_false_alarms": f"{both} SELECT asset, {r6(false_alarm_rate='avg(CASE WHEN EXISTS (SELECT 1 FROM tb WHERE tb.asset = fb.asset AND abs(tb.t - fb.t) <= 1) THEN 0.0::DOUBLE ELSE 1 END)')} FROM fb GROUP BY asset",
        "metrics_point_errors": f"WITH {GR} SELECT lang, {r6(mae='avg(abs(v - f))', rmse='sqrt(avg((v - f) * (v - f)))', qlike='avg(v / f - ln(v / f) - 1)')} FROM gr GROUP BY lang",
        "metrics_brier": f"WITH {GR} SELECT lang, {r6(brier='avg((p - y) * (p - y))')} FROM gr GROUP BY lang",
        "metrics_calibration": f"WITH {cal} SELECT {r6(expected_calibration_error='sum(gap * n) / sum(n)', calibration_error='max(gap)')} FROM b",
        "metrics_log_scores": f"WITH {GR} SELECT {r6(4, predictive_log_score='-avg(ln(greatest(p, 1e-12)))', log_likelihood='sum(CASE WHEN p > 0 THEN ln(p) END)')} FROM gr",
        "metrics_intervals": f"WITH {GR} SELECT {r6(coverage='avg(CASE WHEN v BETWEEN f - 2 AND f + 2 THEN 1.0::DOUBLE ELSE 0 END)', sharpness='avg((f + 2) - (f - 2))')} FROM gr",
        "metrics_crps_normal": f"WITH {GR}, z AS (SELECT lang, (v - f) / 2 AS z FROM gr) SELECT lang, {r6(5, crps=f'avg(2 * (z * (2 * {cdf(chr(122))} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))')} FROM z GROUP BY lang",
        "metrics_crps_samples": f"WITH {GR} SELECT lang, {r6(crps='avg((abs(f - v) + abs(f + 1 - v) + abs(f * 2 - v)) / 3 - (abs(f - (f + 1)) + abs(f - f * 2) + abs(f + 1 - f * 2)) / 9)')} FROM gr GROUP BY lang",
        "metrics_multiclass_brier": f"WITH {GR} SELECT lang, {r6(brier='avg(2 * (p - y) * (p - y))')} FROM gr GROUP BY lang",
        "metrics_probability_entropy": f"WITH {GR} SELECT lang, {r6(entropy=f'avg({ent(chr(112))} + {ent(chr(40) + chr(49) + chr(45) + chr(112) + chr(41))})')} FROM gr GROUP BY lang",
        "metrics_diebold_mariano": _dm_sql(),
        "metrics_economic": _economic_sql("asset"),
        "metrics_economic_by_slice": _economic_sql("asset, part"),
        "metrics_probabilistic_sharpe": _psr_sql(0.0, "probabilistic_sharpe"),
        "metrics_deflated_sharpe": _psr_sql(metrics.expected_max_sharpe(20, 0.05), "deflated_sharpe"),
        "rules_static": f"WITH {I.RETURNS}, s AS (SELECT asset, t, {votes} / CAST(2 + CASE WHEN ret IS NULL THEN 0 ELSE 2 END AS DOUBLE) AS s FROM rets) SELECT asset, t, {r6(score='s')}, CAST(s >= 0.5 AS INT) AS state FROM s",
        "rules_composite": f"WITH {I.RETURNS}, s AS (SELECT asset, t, 1 / (1 + exp(-8 * ({more} / CAST(2 + CASE WHEN ret IS NULL THEN 0 ELSE 3 END AS DOUBLE) - 0.5::DOUBLE))) AS s FROM rets) SELECT asset, t, {r6(score='s')}, CAST(s >= 0.5 AS INT) AS state FROM s",
        "rules_percentile": f"WITH {I.BARS}, s AS (SELECT asset, t, \"close\" AS c, {cut} AS q FROM bars) SELECT asset, t, {r6(threshold='q')}, CAST(c >= q AS INT) AS state FROM s",
        "rules_hysteresis": f"WITH {I.BARS}, e AS (SELECT asset, t, CASE WHEN volume >= 4 THEN 1 WHEN volume <= 2 THEN 0 END AS e FROM bars) SELECT asset, t, coalesce(last_value(e IGNORE NULLS) OVER {UPTO}, 0) AS state FROM e",
    }
    for m, q in FDR.items():
        o[f"metrics_fdr_{m.replace('-', '_')}"] = _fdr_sql(q)
    return o
