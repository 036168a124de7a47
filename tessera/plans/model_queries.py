"""Queries of pricing, backtests, change points, models and sources; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import backtest, pricing
from tessera.operators.models import hmm, other
from tessera.plans import inputs as I
from tessera.plans.feature_queries import K, r6, rows
from tessera.plans.metric_queries import SMALL, _small, cdf
from tessera.sources import ingest, synthetic


def _contracts(s, d):
    li = I.table(s, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_returnflag") == "R", "put").otherwise("call").alias("kind"), (80.0 + F.col("l_quantity")).alias("s"), (90.0 + F.col("l_suppkey") % 30).alias("k"),
        ((F.col("l_linenumber") * 30) / 365.0).alias("t"), (F.col("l_tax") / 2).alias("r"), (F.col("l_discount") / 5).alias("q"), (0.1 + F.col("l_discount") * 3).alias("v"), "l_extendedprice", F.col("l_quantity").alias("volume"), F.col("l_discount").alias("x"),
    )


CON = """con AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END AS kind, 80.0::DOUBLE + l_quantity AS s, 90.0::DOUBLE + l_suppkey % 30 AS k,
  l_linenumber * 30 / 365.0::DOUBLE AS t, l_tax / 2 AS r, l_discount / 5 AS q, 0.1::DOUBLE + l_discount * 3 AS v, l_extendedprice, l_quantity AS volume, l_discount AS x FROM lineitem),
d AS (SELECT *, (ln(s / k) + (r - q + v * v / 2) * t) / (v * sqrt(t)) AS d1, CASE WHEN kind = 'call' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g FROM con),
e AS (SELECT *, d1 - v * sqrt(t) AS d2, exp(-q * t) AS dq, exp(-r * t) AS dr, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS ph FROM d)"""
A = ("kind", "s", "k", "t", "r", "q", "v")


def _cols():
    return [F.col(c) for c in A]


def _priced(s, d):
    return I.rounded(_contracts(s, d).select("id", pricing.black_scholes(*_cols()).alias("price")), ["id"])


def _greeks(s, d):
    return I.rounded(_contracts(s, d).select("id", pricing.greeks(*_cols()).alias("g")).select("id", "g.*"), ["id"], 5)


def _implied(s, d):
    """Volatilities back from prices: whether each reprices, and the volatility where the price depends on it."""
    c = _contracts(s, d).withColumn("price", pricing.black_scholes(*_cols())).withColumn("iv", pricing.implied_volatility("price", "kind", "s", "k", "t", "r", "q"))
    again, vega = pricing.black_scholes(*_cols()[:-1], F.col("iv")), pricing.greeks(*_cols())["vega"]
    return c.select("id", (F.abs(again - F.col("price")) < 1e-6).alias("reprices"), F.when(vega >= 0.01, F.round("iv", 3)).alias("iv"))


def _reasons(s, d):
    c = _contracts(s, d).withColumns({"bid": F.col("l_extendedprice") / 1000, "ask": F.col("l_extendedprice") / 1000 * (1 + F.col("x") * 3 - 0.02), "age": F.col("volume") * 30, "size": F.col("volume") - 3})
    cols = {"bid": F.col("bid"), "ask": F.col("ask"), "bid_size": F.col("size"), "ask_size": F.when(F.col("volume") > 5, F.col("volume")), "volume": F.col("volume"), "open_interest": F.lit(5.0)}
    return c.select("id", F.array_join(pricing.quote_reasons(cols, F.col("age"), max_spread=0.25, min_volume=3.0), ",").alias("reasons"))


def _bounds(s, d):
    c = _contracts(s, d).withColumn("b", pricing.no_arbitrage(F.col("kind"), F.col("volume"), *[F.col(x) for x in ("s", "k", "t", "r", "q")]))
    return I.rounded(c.select("id", "b.valid", "b.lower", "b.upper", F.array_join("b.reasons", ",").alias("reasons")), ["id", "valid", "reasons"])


def _normalized(s, d):
    o = I.table(s, d, "orders").select(F.concat(F.lit(" ord-"), F.col("o_orderkey"), F.lit("_x ")).alias("raw"), F.date_format("o_orderdate", "M/d/yyyy").alias("when"), F.format_number("o_totalprice", 2).alias("strike"), F.when(F.col("o_orderstatus") == "F", "C").otherwise("put").alias("kind"))
    return o.select(pricing.normalize_symbol(F.col("raw")).alias("symbol"), pricing.normalize_expiration(F.col("when")).cast("string").alias("expiration"), F.round(pricing.normalize_strike(F.col("strike")), 2).alias("strike"), pricing.normalize_type(F.col("kind")).alias("option_type"))


def _surface(s, d):
    o = I.options(s, d)
    pts = o.groupBy("t", "tenor_days", F.round(F.col("moneyness") * 10).alias("m10")).agg(F.avg("iv").alias("vol")).select("t", F.col("tenor_days").alias("tenor"), (F.col("m10") / 10).alias("moneyness"), "vol")
    q = pts.select("t").distinct().select(F.lit(1).alias("qid"), "t", F.lit(40.0).alias("tenor"), F.lit(1.05).alias("moneyness"))
    return I.rounded(pricing.interpolate_surface(q, pts, ["t"]).drop("qid"), ["t"], 5)


def _equity(s, d, **cfg):
    c = backtest.EquityConfig(**({"transaction_bps": 5.0, "slippage_bps": 2.0} | cfg))
    _, by = backtest.equity_backtest(_small(s, d).select("t", "asset", "ret"), cfg=c)
    return I.rounded(by.drop("capacity_usage"), ["t"], 8)


EQUITY = SMALL + f""", w AS (SELECT asset, t, coalesce(ret, 0) AS ret, 1.0::DOUBLE / count(*) OVER (PARTITION BY t) AS w0 FROM sm), l AS (SELECT asset, t, ret, least(greatest(coalesce(lag(w0) OVER (PARTITION BY asset ORDER BY t), 0), 0), 1) AS w FROM w),
st2 AS (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY asset ORDER BY t)), 0) AS step FROM l), b AS (SELECT t, sum(w * ret) AS g, sum(step) AS turnover, sum(abs(w)) AS gross, sum(w) AS net FROM st2 GROUP BY t), c AS (SELECT *, turnover * 7.0::DOUBLE / 1e4 AS cost FROM b)"""


def _equity_knobs(s, d):
    return _equity(s, d, gross_limit=0.8, net_limit=0.5, target_vol=0.1, max_turnover=0.3, turnover_penalty=0.1)


def _option_days(s, d):
    o = I.table(s, d, "orders").groupBy(F.expr("timestampdiff(DAY, timestamp_ntz'1992-01-01 00:00:00', o_orderdate)").alias("t")).agg((80 + F.avg("o_totalprice") / 10000).alias("spot"))
    li = I.table(s, d, "lineitem").select(F.expr("timestampdiff(DAY, timestamp_ntz'1992-01-01 00:00:00', l_shipdate)").alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("contract"), F.when(F.col("l_returnflag") == "R", "put").otherwise("call").alias("option_type"), (90.0 + F.col("l_suppkey") % 30).alias("strike"), (F.col("l_linenumber") * 7.0).alias("tenor"), (F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0) * F.col("l_quantity") / 50).alias("delta"), (F.col("l_extendedprice") / 10000).alias("bid"), (F.col("l_extendedprice") / 10000 * (1 + F.col("l_discount"))).alias("ask"), (0.1 + F.col("l_discount")).alias("iv"))
    return li, o


def _options(s, d):
    chain, prices = _option_days(s, d)
    _, daily = backtest.options_backtest(chain, prices, backtest.OptionsConfig(fee=0.5, hedge_every=5, hedge_bps=1.0))
    return I.rounded(daily, ["t"], 4)


def _selected(s, d):
    chain, _ = _option_days(s, d)
    got = backtest.select_contracts(chain)
    return I.rounded(got.select("t", "strike", "option_type", "selection_error", "spread_pct"), ["t", "option_type"])


def _performance(s, d):
    chain, _ = _option_days(s, d)
    t = backtest.select_contracts(chain).withColumn("pnl", F.col("bid") - F.col("strike") / 100)
    t = backtest.bucketed(backtest.bucketed(t, "tenor", [0, 7, 21, 60], "tenor_bucket"), "iv", [0, 0.12, 0.16, 1], "volatility_bucket")
    return I.rounded(backtest.performance_by(t, ["tenor_bucket", "volatility_bucket", "option_type"]), ["grouping", "bucket", "contracts"], 5)


SELECTED = """ch AS (SELECT date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS t, l_orderkey * 10 + l_linenumber AS contract, CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END AS option_type, 90.0::DOUBLE + l_suppkey % 30 AS strike, l_linenumber * 7.0::DOUBLE AS tenor,
 (CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * l_quantity / 50 AS delta, l_extendedprice / 10000 AS bid, l_extendedprice / 10000 * (1 + l_discount) AS ask, 0.1::DOUBLE + l_discount AS iv FROM lineitem),
m AS (SELECT *, (ask - bid) / nullif((bid + ask) / 2, 0) AS spread_pct, abs(abs(delta) - 0.3::DOUBLE) + abs(tenor - 30.0::DOUBLE) / 365 AS err FROM ch),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY err, spread_pct, strike, option_type, contract) AS n FROM m WHERE bid > 0 AND bid <= ask AND spread_pct <= 0.5 AND tenor >= 1) WHERE n = 1)"""


def _betas(s, d):
    m = I.market(s, d).select("asset", "t", "ret", F.col("market").alias("f"))
    return I.rounded(backtest.rolling_betas(m).select(*K, "beta"), K)


def _exposures(s, d):
    m = I.market(s, d)
    w = _small(s, d).select("t", "asset", (1.0 / F.length("asset")).alias("w"))
    f = m.select("t", F.lit("m").alias("factor"), F.col("market").alias("f")).distinct()
    return I.rounded(backtest.factor_exposures(w, m.select("t", "asset", "ret"), f), ["t", "factor"])


def _series(label, features=("close", "volume")):
    return lambda s, d: other.per_series(I.bars(s, d), list(features), label)


def _hmm(name, **changes):
    def query(s, d):
        b = _small(s, d)
        inputs = ("users",) if name in ("input-output-hmm", "markov-switching-regression") else ()
        return hmm.run_series(b, ["ret"], hmm.variant(name, inputs=inputs, **changes))

    return query


def _supervised(method):
    def query(s, d):
        x = I.table(s, d, "documents").join(I.table(s, d, "labels"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), F.log1p("n_chars").alias("n"), (F.length(F.regexp_replace("text", "[A-Za-z ]", "")) / F.length("text")).alias("odd"))
        m = other.supervised(x, ["n", "odd"], "y", method)
        return other.classify(m, x, ["n", "odd"]).select("doc_id", "prediction")

    return query


def _ingested(s, d):
    bars = I.bars(s, d).select((F.col("t") * 3_600_000).alias("t"), F.col("asset").alias("symbol"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    chain = ingest.mock_chain(ingest.stock_aggregates(bars).withColumn("hour", F.expr("timestampdiff(HOUR, timestamp'1970-01-01 00:00:00 UTC', timestamp)")))
    return I.rounded(chain.select("symbol", "hour", "option_type", "strike", "close"), ["symbol", "hour", "option_type"])


LIMITED = EQUITY.split("st2 AS")[0].rstrip(", \n") + """, g1 AS (SELECT asset, t, ret, w * CASE WHEN sum(abs(w)) OVER (PARTITION BY t) > 0.8 THEN 0.8::DOUBLE / sum(abs(w)) OVER (PARTITION BY t) ELSE 1 END AS w FROM l),
n1 AS (SELECT asset, t, ret, w - coalesce(greatest(abs(sum(w) OVER (PARTITION BY t)) - 0.5::DOUBLE, 0) * sign(sum(w) OVER (PARTITION BY t)) / nullif(sum(CAST(w <> 0 AS INT)) OVER (PARTITION BY t), 0), 0) AS w FROM g1),
g2 AS (SELECT asset, t, ret, w * CASE WHEN sum(abs(w)) OVER (PARTITION BY t) > 0.8 THEN 0.8::DOUBLE / sum(abs(w)) OVER (PARTITION BY t) ELSE 1 END AS w FROM n1),
po AS (SELECT t, sum(w * ret) AS r FROM g2 GROUP BY t), vo AS (SELECT t, CASE WHEN count(r) OVER k >= 2 THEN stddev_samp(r) OVER k END * sqrt(252.0::DOUBLE) AS v FROM po WINDOW k AS (ORDER BY t ROWS 19 PRECEDING)),
sc AS (SELECT t, coalesce(lag(CASE WHEN v IS NOT NULL THEN least(0.1::DOUBLE / greatest(v, 0.01), 3) END) OVER (ORDER BY t), 1) AS k, row_number() OVER (ORDER BY t) AS i FROM vo),
tg AS (SELECT i, list(coalesce(w * k, 0.0::DOUBLE) ORDER BY asset) AS w FROM (SELECT sc.t, sc.i, sc.k, a.asset FROM sc, (SELECT DISTINCT asset FROM g2) a) f LEFT JOIN g2 USING (asset, t) GROUP BY i),
rc AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(w, lambda x: 0.0::DOUBLE) AS w FROM tg WHERE i = 1
UNION ALL SELECT i, list_transform(range(1, len(now) + 1), lambda j: was[j] + (now[j] - was[j]) * CASE WHEN turn > 0.3 THEN 0.3::DOUBLE / turn ELSE 1 END / (1 + 0.1::DOUBLE * turn))
FROM (SELECT *, list_sum(list_transform(range(1, len(now) + 1), lambda j: abs(now[j] - was[j]))) AS turn FROM (SELECT tg.i, tg.w AS now, rc.w AS was FROM rc JOIN tg ON tg.i = rc.i + 1))),
ord AS (SELECT asset, row_number() OVER (ORDER BY asset) AS j FROM (SELECT DISTINCT asset FROM g2)),
wl AS (SELECT g2.asset, g2.t, g2.ret, rc.w[ord.j] AS w FROM g2 JOIN sc USING (t) JOIN rc ON rc.i = sc.i JOIN ord ON ord.asset = g2.asset),
st2 AS (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY asset ORDER BY t)), 0) AS step FROM wl)""" + EQUITY.split("FROM l)")[-1]


def _options_sql() -> str:
    mark = f"CASE WHEN u > 0 THEN g * (spot * {cdf('(g * d1)')} - strike * {cdf('(g * d2)')}) ELSE greatest(g * (spot - strike), 0) END"
    return f"""WITH {SELECTED}, pr AS (SELECT date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS t, 80 + avg(o_totalprice) / 10000 AS spot FROM orders GROUP BY 1),
hd AS (SELECT s.*, pr.t AS day, spot, greatest((s.t + round(tenor) - pr.t) / 365.0::DOUBLE, 0) AS u, CASE WHEN option_type = 'call' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g, greatest(iv, 1e-6) AS v FROM sel s JOIN pr ON pr.t BETWEEN s.t AND s.t + greatest(round(tenor), 0)),
dd AS (SELECT *, (ln(spot / strike) + v * v / 2 * greatest(u, 1e-9)) / (v * sqrt(greatest(u, 1e-9))) AS d1 FROM hd), de AS (SELECT *, d1 - v * sqrt(greatest(u, 1e-9)) AS d2 FROM dd),
ps AS (SELECT day AS t, sum(100 * ({mark})) AS value, sum(100 * delta) AS delta FROM de GROUP BY 1),
tc AS (SELECT t, sum((ask - bid) / 2 * 100 + 0.5::DOUBLE) AS trade_cost FROM sel GROUP BY t),
dy AS (SELECT pr.t, spot, coalesce(value, 0.0::DOUBLE) AS value, coalesce(delta, 0.0::DOUBLE) AS delta, coalesce(trade_cost, 0.0::DOUBLE) AS trade_cost, row_number() OVER (ORDER BY pr.t) - 1 AS i FROM pr LEFT JOIN ps USING (t) LEFT JOIN tc USING (t)),
sh AS (SELECT *, coalesce(last_value(CASE WHEN i % 5 = 0 THEN -delta END IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS shares FROM dy),
fl AS (SELECT t, spot, value, shares, value - coalesce(lag(value) OVER (ORDER BY t), 0) AS op, coalesce(lag(shares) OVER (ORDER BY t) * (spot - lag(spot) OVER (ORDER BY t)), 0) AS hp, trade_cost + abs(shares - coalesce(lag(shares) OVER (ORDER BY t), 0)) * spot * 1.0::DOUBLE / 1e4 AS cost FROM sh)
SELECT t, {r6(4, spot="spot", value="value", shares="shares", option_pnl="op", hedge_pnl="hp", cost="cost", pnl="op + hp - cost")} FROM fl"""


def queries() -> dict:
    q = {
        "pricing_black_scholes": _priced, "pricing_greeks": _greeks, "pricing_implied_volatility": _implied, "pricing_quote_reasons": _reasons, "pricing_no_arbitrage": _bounds, "pricing_normalization": _normalized, "pricing_surface": _surface,
        "backtest_equity": _equity, "backtest_equity_limits": _equity_knobs, "backtest_options": _options, "backtest_contract_selection": _selected, "backtest_performance_by": _performance, "backtest_rolling_betas": _betas, "backtest_factor_exposures": _exposures,
        "model_kmeans": lambda s, d: other.kmeans_regimes(_small(s, d).filter("ret is not null"), ["ret", "volume"]).select(*K, "state"),
        "model_gaussian_mixture": lambda s, d: other.mixture_regimes(_small(s, d).filter("ret is not null"), ["ret", "volume"]).select(*K, "state"),
        "model_hierarchical": _series(lambda x: other.hierarchical(x, 3)),
        "model_jump_segmentation": _series(lambda x: other.jump_segmentation(x, 2, 20.0)),
        "model_jump_gaussian": _series(lambda x: other.jump_segmentation(x, 2, 5.0, gaussian=True)),
        "model_switching_lds": _series(lambda x: other.switching_lds(x).argmax(1)),
        "model_switching_dynamic_factor": _series(lambda x: other.switching_lds(x, factors=1).argmax(1)),
        "model_threshold_autoregression": _series(lambda x: other.threshold_autoregression(x[:, 0])[0]),
        "model_switching_volatility": lambda s, d: other.switching_volatility(_small(s, d)).select(*K, "state"),
        "model_supervised_logistic": _supervised("logistic"), "model_supervised_forest": _supervised("random_forest"), "model_supervised_boosting": _supervised("gradient_boosting"),
        "source_mock_chain": _ingested,
    }
    for name in hmm.VARIANTS:
        q[f"model_{name.replace('-', '_')}"] = _hmm(name)
    for name in synthetic.SCENARIOS:
        q[f"synthetic_{name}"] = lambda s, d, name=name: synthetic.generate(s, name)
    return q


def oracle_sql() -> dict[str, str]:
    price = f"g * (s * dq * {cdf('(g * d1)')} - k * dr * {cdf('(g * d2)')})"
    gr = {"delta": f"g * dq * {cdf('(g * d1)')}", "gamma": "dq * ph / (s * v * sqrt(t))", "vega": "s * dq * ph * sqrt(t)", "theta": f"(-s * dq * ph * v / (2 * sqrt(t)) - g * r * k * dr * {cdf('(g * d2)')} + g * q * s * dq * {cdf('(g * d1)')}) / 365", "rho": f"g * k * t * dr * {cdf('(g * d2)')} / 100"}
    reasons = "concat_ws(',', CASE WHEN bid < 0 OR ask < 0 THEN 'negative_bid_or_ask' END, CASE WHEN bid > ask THEN 'crossed_market' END, CASE WHEN volume * 30 > 900 THEN 'stale_quote' END, CASE WHEN ask + bid > 0 AND (ask - bid) / ((ask + bid) / 2) > 0.25 THEN 'wide_spread' END, CASE WHEN volume - 3 < 1 THEN 'low_bid_size' END, CASE WHEN volume > 5 AND volume < 1 THEN 'low_ask_size' END, CASE WHEN volume < 3 THEN 'low_volume' END)"
    lo, hi = "greatest(CASE WHEN kind = 'call' THEN s * dq - k * dr ELSE k * dr - s * dq END, 0)", "CASE WHEN kind = 'call' THEN s * dq ELSE k * dr END"
    pts = I.OPTIONS + ", p AS (SELECT t, tenor_days AS tenor, round(moneyness * 10) / 10 AS m, avg(iv) AS vol FROM opts GROUP BY 1, 2, 3), z AS (SELECT t, vol, abs(40.0::DOUBLE - tenor) + abs(1.05::DOUBLE - m) AS d FROM p)"
    bw = rows(63)
    both = "CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END"
    bucket = lambda c, es: "CASE " + " ".join(f"WHEN {c} > {a} AND {c} <= {b} THEN '({a:g}, {b:g}]'" for a, b in zip(es, es[1:], strict=False)) + " END"
    pnl = "bid - strike / 100"
    group = lambda name, e: f"SELECT '{name}' AS \"grouping\", {e} AS bucket, {pnl} AS pnl FROM sel"
    stacked = " UNION ALL ".join([group("tenor_bucket", bucket("tenor", [0, 7, 21, 60])), group("volatility_bucket", bucket("iv", [0, 0.12, 0.16, 1])), group("option_type", "option_type")])
    return {
        "pricing_black_scholes": f"WITH {CON} SELECT id, {r6(price=price)} FROM e",
        "pricing_greeks": f"WITH {CON} SELECT id, {r6(5, **gr)} FROM e",
        "pricing_implied_volatility": f"WITH {CON} SELECT id, true AS reprices, CASE WHEN {gr['vega']} >= 0.01 THEN round(v, 3) END AS iv FROM e",
        "pricing_quote_reasons": f"WITH {CON}, w AS (SELECT id, volume, l_extendedprice / 1000 AS bid, l_extendedprice / 1000 * (1 + x * 3 - 0.02::DOUBLE) AS ask FROM con) SELECT id, {reasons} AS reasons FROM w",
        "pricing_no_arbitrage": f"WITH {CON}, b AS (SELECT id, volume, {lo} AS lo, {hi} AS hi FROM e) SELECT id, NOT (volume < lo OR volume > hi) AS valid, {r6(lower='lo', upper='hi')}, concat_ws(',', CASE WHEN volume < lo THEN 'below_lower_bound' END, CASE WHEN volume > hi THEN 'above_upper_bound' END) AS reasons FROM b",
        "pricing_normalization": "SELECT 'ORD' || o_orderkey || 'X' AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS expiration, round(o_totalprice, 2) AS strike, CASE WHEN o_orderstatus = 'F' THEN 'call' ELSE 'put' END AS option_type FROM orders",
        "pricing_surface": f"WITH {pts} SELECT t, {r6(5, vol='coalesce(max(CASE WHEN d = 0 THEN vol END), sum(CASE WHEN d > 0 THEN vol / d END) / nullif(sum(CASE WHEN d > 0 THEN 1 / d END), 0))')} FROM z GROUP BY t",
        "backtest_equity": f"WITH {EQUITY} SELECT t, {r6(8, gross_return='g', turnover='turnover', gross='gross', net='net', cost='cost', net_return='g - cost', equity='exp(sum(ln(greatest(1 + g - cost, 1e-12))) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING))')} FROM c",
        "backtest_equity_limits": f"WITH RECURSIVE {LIMITED} SELECT t, {r6(8, gross_return='g', turnover='turnover', gross='gross', net='net', cost='cost', net_return='g - cost', equity='exp(sum(ln(greatest(1 + g - cost, 1e-12))) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING))')} FROM c",
        "backtest_options": _options_sql(),
        "backtest_contract_selection": f"WITH {SELECTED} SELECT t, option_type, {r6(strike='strike', selection_error='err', spread_pct='spread_pct')} FROM sel",
        "backtest_performance_by": f"WITH {SELECTED}, u AS ({stacked}) SELECT \"grouping\", bucket, count(*) AS contracts, {r6(5, pnl='sum(pnl)', mean_pnl='avg(pnl)')} FROM u WHERE bucket IS NOT NULL GROUP BY 1, 2",
        "backtest_rolling_betas": f"WITH {I.MARKET} SELECT asset, t, {r6(beta=f'coalesce(CASE WHEN count({both}) OVER {bw} >= 3 THEN covar_samp(ret, market) OVER {bw} / nullif(var_samp(CASE WHEN TRUE THEN market END) OVER {bw}, 0) END, 0)')} FROM mkt",
        "backtest_factor_exposures": f"WITH {I.MARKET}, b AS (SELECT asset, coalesce(covar_samp(ret, market) / nullif(var_samp(market), 0), 0) AS beta FROM mkt GROUP BY asset) SELECT t, 'm' AS factor, {r6(exposure='sum(1.0::DOUBLE / length(asset) * beta)')} FROM rets JOIN b USING (asset) GROUP BY t",
        "model_switching_volatility": f"WITH {SMALL}, x AS (SELECT asset, t, CASE WHEN ret IS NOT NULL THEN ln(ret * ret + 1e-12) END AS x FROM sm), c AS (SELECT asset, quantile_cont(x, 0.5) AS q FROM x GROUP BY asset) SELECT asset, t, CASE WHEN x IS NOT NULL THEN CAST(x >= q AS INT) END AS state FROM x JOIN c USING (asset)",
        "model_threshold_autoregression": f"WITH {I.BARS}, l AS (SELECT asset, t, lag(\"close\") OVER (PARTITION BY asset ORDER BY t) AS x FROM bars), c AS (SELECT asset, quantile_cont(x, 0.5) AS q FROM l GROUP BY asset) SELECT asset, t, CASE WHEN x IS NULL THEN -1 ELSE CAST(x >= q AS INT) END AS state FROM l JOIN c USING (asset)",
        "source_mock_chain": f"WITH {I.BARS}, l AS (SELECT 'put' AS option_type, 0.95::DOUBLE AS m UNION ALL SELECT 'call', 1.05::DOUBLE) SELECT asset AS symbol, t AS \"hour\", option_type, {r6(strike=chr(34) + 'close' + chr(34) + ' * m', close=chr(34) + 'close' + chr(34))} FROM bars, l",
    }
