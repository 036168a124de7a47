"""Queries of the feature operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, div
from tessera.operators.features import cross_sectional, liquidity, macro, options, returns, risk
from tessera.plans import inputs as I

K = ["asset", "t"]
W = "PARTITION BY asset ORDER BY t"


def rows(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


UPTO = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN {agg} OVER {rows(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def r6(digits: int = 6, /, **cols: str) -> str:
    return ", ".join(f'round({e} + 3.7e-9::DOUBLE, {digits}) + 0 AS "{k}"' for k, e in cols.items())


def own(df, n_before: list[str], digits: int = 6):
    """The keys and the columns that an operator has added."""
    return I.rounded(df.select(*K, *[c for c in df.columns if c not in n_before and c not in K]), K, digits)


def _added(make, source, digits=6, **kw):
    def query(spark, sf_dir):
        df = source(spark, sf_dir)
        return own(make(df, **kw), df.columns, digits)

    return query


def _extra(spark, sf_dir):
    """Bars with further columns that the liquidity and macro operators take."""
    r = I.market(spark, sf_dir)
    return r.withColumns({
        "bid": F.col("low"), "ask": F.col("high"), "shares": F.lit(1000.0) + F.col("users"), "dollar_volume": F.col("amount"), "buy_volume": F.col("volume") * 2, "sell_volume": F.col("users"),
        "bid_size": F.col("volume"), "ask_size": F.col("users"), "borrow_rebate": F.col("low") / 100, "borrow_utilization": F.col("volume") / 10, "funding_rate": F.col("high") / 100,
        "equity": F.col("ret"), "rates": F.col("volume") / 100, "credit": F.col("market"), "dollar": F.col("users") / 10, "commodity": F.col("market"),
        "2y": F.col("low"), "5y": F.col("close"), "10y": F.col("high"), "spread": F.col("close"), "inflation_actual": F.col("close"), "inflation_consensus": F.col("open"), "growth_actual": F.col("high"), "growth_consensus": F.col("low"),
        "policy_rate": F.col("close"), "expected_policy_rate": F.col("open"), "central_bank_assets": F.col("amount"),
    })


X = I.MARKET + """, x AS (SELECT *, low AS bid, high AS ask, 1000 + users AS shares, amount AS dollar_volume, volume * 2 AS buy_volume, users AS sell_volume, volume AS bid_size, users AS ask_size,
  ret AS equity, volume / 100 AS rates, market AS credit, users / 10 AS dollar, market AS commodity FROM mkt)"""


def _select(base: str, name: str, cols: dict[str, str], keys: str = "asset, t", tail: str = "", digits: int = 6) -> str:
    return f"WITH {base} SELECT {keys}, {r6(digits, **cols)} FROM {name} {tail}"


def _dependence(a: str, b: str, name: str, n: int = 63) -> dict[str, str]:
    ok = f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) OVER {rows(n)} = {n}"
    cov = f"covar_samp({a}, {b}) OVER {rows(n)}"
    return {f"{name}_correlation": f"CASE WHEN {ok} THEN {cov} / nullif(stddev_samp({a}) OVER {rows(n)} * stddev_samp({b}) OVER {rows(n)}, 0) END", f"{name}_beta": f"CASE WHEN {ok} THEN {cov} / nullif(var_samp({b}) OVER {rows(n)}, 0) END"}


def _nearest(value: str, distance: str, where: str = "TRUE") -> str:
    return f"arg_min({value}, {{'d': {distance}, 'v': {value}}}) FILTER ({where})"


def queries() -> dict:
    q = {
        "feature_multi_horizon_returns": _added(returns.multi_horizon_returns, I.bars),
        "feature_momentum": _added(returns.momentum, I.bars),
        "feature_reversal": _added(returns.reversal, I.bars),
        "feature_moving_averages": _added(returns.moving_average_relationships, I.bars),
        "feature_trend_strength": _added(returns.trend_strength, I.bars),
        "feature_gap_and_overnight": _added(returns.gap_and_overnight_returns, I.bars),
        "feature_drawdown": _added(returns.drawdown, I.bars),
        "feature_realized_volatility": _added(risk.realized_volatility, I.returns),
        "feature_semivariance": _added(risk.semivariance, I.returns, 3),
        "feature_bipower_variation": _added(risk.bipower_variation, I.returns, 3),
        "feature_jump_variation": _added(risk.jump_variation, I.returns, 3),
        "feature_volatility_of_volatility": _added(risk.volatility_of_volatility, I.returns),
        "feature_tail_estimates": _added(risk.tail_estimates, I.returns),
        "feature_realized_beta": _added(risk.realized_beta, I.market),
        "feature_equity_rates_dependence": _added(macro.equity_rates_dependence, _extra),
        "feature_equity_credit_dependence": _added(macro.equity_credit_dependence, _extra),
        "feature_dollar_commodity": _added(macro.dollar_and_commodity_relationships, _extra),
        "feature_yield_curve_factors": _added(macro.yield_curve_factors, _extra, tenors=["2y", "5y", "10y"]),
        "feature_credit_spreads": _added(macro.credit_spreads, _extra),
        "feature_surprises": _added(macro.surprises, _extra),
        "feature_monetary_policy": _added(macro.monetary_policy_features, _extra),
        "feature_bid_ask_spreads": lambda s, d: own(liquidity.bid_ask_spreads(_extra(s, d).drop("spread")), [c for c in _extra(s, d).columns if c != "spread"]),
        "feature_volume": _added(liquidity.volume, _extra),
        "feature_turnover": _added(liquidity.turnover, _extra),
        "feature_amihud": _added(liquidity.amihud, _extra),
        "feature_order_imbalance": _added(liquidity.order_imbalance, _extra),
        "feature_market_depth": _added(liquidity.market_depth, _extra),
        "feature_quote_dispersion": _added(liquidity.quote_dispersion, _extra),
        "feature_funding_proxies": _added(liquidity.funding_and_borrow_proxies, _extra),
    }

    def at(make, source, keys=("t",), digits=6):
        return lambda s, d: I.rounded(make(source(s, d)), list(keys), digits)

    q |= {
        "cross_breadth": at(cross_sectional.breadth, I.returns),
        "cross_dispersion": at(cross_sectional.dispersion, I.returns),
        "cross_concentration": at(cross_sectional.concentration, _weights),
        "cross_factor_crowding": lambda s, d: I.rounded(cross_sectional.factor_crowding(_weights(s, d).withColumns({"factor": F.col("asset"), "exposure": F.col("t") % 7 - 3.0})), ["factor"]),
        "cross_factor_returns": lambda s, d: I.rounded(cross_sectional.factor_returns(_exposed(s, d), ["f1", "f2"]), ["t"]),
        "cross_correlation_distribution": at(cross_sectional.correlation_distribution, I.returns),
        "cross_residual_volatility": lambda s, d: _residual(s, d),
        "cross_eigenvalues": lambda s, d: I.rounded(_eigen(s, d), ["t"], 5),
        "cross_eigenvalues_of_two": lambda s, d: I.rounded(_eigen_pair(s, d), ["t"], 5),
        "options_atm_iv": at(options.atm_implied_volatility, I.options),
        "options_skew": at(options.skew, I.options),
        "options_curvature": at(options.curvature, I.options),
        "options_term_slope": at(options.term_structure_slope, I.options),
        "options_tail_prices": at(options.tail_risk_prices, I.options),
        "options_put_call_richness": at(options.put_call_relative_richness, I.options),
        "options_liquidity": at(options.option_liquidity, I.options),
        "options_exposures": at(options.exposure_proxies, I.options, digits=2),
        "options_implied_correlation": _implied_correlation,
        "options_variance_risk_premium": _vrp,
        "options_surface_components": _surface,
    }
    return q


def _weights(s, d):
    o = I.table(s, d, "orders")
    return o.groupBy(F.expr("year(o_orderdate) * 12 + month(o_orderdate)").alias("t"), F.expr("concat('c', o_custkey % 40)").alias("asset")).agg(F.sum("o_totalprice").alias("weight"))


WEIGHTS = "wts AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS t, concat('c', o_custkey % 40) AS asset, sum(o_totalprice) AS weight FROM orders GROUP BY 1, 2)"


def _exposed(s, d):
    return _weights(s, d).withColumns({"ret": F.col("weight") / 1e6, "f1": F.length("asset") - 1.0, "f2": (F.col("t") + F.substring("asset", 2, 3).cast("int")) % 5 - 2.0})


EXPOSED = WEIGHTS + ", ex AS (SELECT *, weight / 1e6 AS ret, length(asset) - 1.0::DOUBLE AS f1, (t + CAST(substring(asset, 2, 3) AS INT)) % 5 - 2.0::DOUBLE AS f2 FROM wts)"


def _residual(s, d):
    r = I.returns(s, d)
    betas = r.select("asset").distinct().select("asset", F.lit("m").alias("factor"), (F.length("asset") / 10.0).alias("beta"))
    f = I.market(s, d).select(F.lit("m").alias("factor"), "t", F.col("market").alias("f")).distinct()
    got = cross_sectional.residual_volatility(r, betas, f)
    return I.rounded(got.select("asset", "t", "residual", "residual_vol"), K)


def _eigen(s, d):
    wide = I.returns(s, d).groupBy("t").pivot("asset", ["click", "error", "purchase", "signup", "view"]).agg(F.first("ret"))
    return cross_sectional.leading_covariance_eigenvalues(wide, ["click", "error", "purchase", "signup", "view"])


def _eigen_pair(s, d):
    """Two assets, whose eigenvalues have a closed form."""
    wide = I.returns(s, d).groupBy("t").pivot("asset", ["click", "view"]).agg(F.first("ret"))
    return cross_sectional.leading_covariance_eigenvalues(wide, ["click", "view"], n=2)


def _implied_correlation(s, d):
    o = I.options(s, d)
    parts = o.groupBy("t", "option_type").agg(F.avg("iv").alias("iv"), F.sum("volume").alias("v"))
    whole = o.groupBy("t").agg((F.avg("iv") * 0.9).alias("index_iv"), F.sum("volume").alias("all"))
    parts = parts.join(whole, "t").select("t", "iv", (F.col("v") / F.col("all")).alias("weight"))
    return I.rounded(options.implied_correlation(whole.select("t", "index_iv"), parts), ["t"])


def _vrp(s, d):
    r = risk.realized_volatility(I.returns(s, d), windows=(21,)).withColumnsRenamed({"realized_vol_21": "realized"}).withColumn("implied", F.col("volume") / 10)
    return I.rounded(options.variance_risk_premium(r).select(*K, "implied_variance", "realized_variance", "variance_risk_premium"), K, 4)


def _surface(s, d):
    o = I.options(s, d).withColumn("b", F.concat(F.lit("k"), F.least(F.floor(F.col("moneyness") * 10), F.lit(11)).cast("string")))
    wide = o.groupBy("t").pivot("b", ["k8", "k9", "k10", "k11"]).agg(F.avg("iv"))
    return I.rounded(options.surface_principal_components(wide, ["k8", "k9", "k10", "k11"]), ["t"], 5)


def oracle_sql() -> dict[str, str]:
    c = '"close"'
    o = {}
    o["feature_multi_horizon_returns"] = _select(I.BARS, "bars", {f"return_{h}": f"{c} / nullif({lag(c, h)}, 0) - 1" for h in (1, 5, 21, 63)})
    o["feature_momentum"] = _select(I.BARS, "bars", {f"momentum_{h}": f"{lag(c, 1)} / nullif({lag(c, h + 1)}, 0) - 1" for h in (21, 63, 126, 252)})
    o["feature_reversal"] = _select(I.BARS, "bars", {f"reversal_{h}": f"-({c} / nullif({lag(c, h)}, 0) - 1)" for h in (1, 5, 21)})
    ma = {n: full(f"avg({c})", c, n) for n in (10, 20, 50, 200)}
    o["feature_moving_averages"] = _select(I.BARS, "bars", {f"price_to_ma_{n}": f"{c} / nullif({e}, 0) - 1" for n, e in ma.items()} | {f"ma_{a}_to_ma_{b}": f"({ma[a]}) / nullif({ma[b]}, 0) - 1" for a, b in ((10, 20), (20, 50), (50, 200))})
    base = I.BARS + f", s AS (SELECT *, CAST(row_number() OVER ({W}) AS DOUBLE) AS rn, abs({c} - {lag(c)}) AS step FROM bars)"
    trend = {}
    for n in (20, 60):
        trend[f"trend_slope_{n}"] = f"({full(f'regr_slope({c}, rn)', c, n)}) / nullif({c}, 0)"
        trend[f"trend_efficiency_{n}"] = f"abs({c} - {lag(c, n)}) / nullif({full('sum(step)', 'step', n)}, 0)"
    o["feature_trend_strength"] = _select(base, "s", trend)
    o["feature_gap_and_overnight"] = _select(I.BARS, "bars", {"overnight_return": f"open / nullif({lag(c)}, 0) - 1", "intraday_return": f"{c} / nullif(open, 0) - 1", "close_to_close_return": f"{c} / nullif({lag(c)}, 0) - 1", "gap_to_range": f"(open - {lag(c)}) / nullif(high - low, 0)"})
    o["feature_drawdown"] = _select(I.BARS + f", dd AS (SELECT *, {c} / nullif(max({c}) OVER {rows(252)}, 0) - 1 AS d FROM bars)", "dd", {"drawdown": "d", "max_drawdown": f"min(d) OVER {rows(252)}"})
    o["feature_realized_volatility"] = _select(I.RETURNS, "rets", {f"realized_vol_{n}": f"({full('stddev_samp(ret)', 'ret', n)}) * sqrt(252.0)" for n in (21, 63, 252)})
    semi = {}
    for n in (21, 63):
        semi[f"downside_semivariance_{n}"] = f"({full('avg(dn)', 'dn', n)}) * 252"
        semi[f"upside_semivariance_{n}"] = f"({full('avg(up)', 'up', n)}) * 252"
    o["feature_semivariance"] = _select(I.RETURNS + ", s AS (SELECT *, CASE WHEN ret IS NOT NULL THEN least(ret, 0) * least(ret, 0) END AS dn, CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) * greatest(ret, 0) END AS up FROM rets)", "s", semi, digits=3)
    bp = I.RETURNS + f", s AS (SELECT *, abs(ret) * abs({lag('ret')}) AS bp, ret * ret AS sq FROM rets)"
    biv = {n: f"pi() / 2 * ({full('sum(bp)', 'bp', n)}) * 252 / {n}" for n in (21, 63)}
    o["feature_bipower_variation"] = _select(bp, "s", {f"bipower_variation_{n}": e for n, e in biv.items()}, digits=3)
    jump = {n: f"({full('sum(sq)', 'sq', n)}) * 252 / {n} - {biv[n]}" for n in (21, 63)}
    o["feature_jump_variation"] = _select(bp, "s", {f"jump_variation_{n}": f"CASE WHEN {e} IS NOT NULL THEN greatest({e}, 0) END" for n, e in jump.items()}, digits=3)
    o["feature_volatility_of_volatility"] = _select(I.RETURNS + f", s AS (SELECT *, {full('stddev_samp(ret)', 'ret', 21)} AS v FROM rets)", "s", {f"vol_of_vol_{n}": full("stddev_samp(v)", "v", n) for n in (21, 63)})
    cuts = ", ".join(f"{full(f'quantile_cont(ret, {q})', 'ret', n)} AS v{int(q * 100):02d}_{n}" for n in (63, 252) for q in (0.01, 0.05))
    lists = ", ".join(f"{full('list(ret)', 'ret', n)} AS l{n}" for n in (63, 252))
    tail = {}
    for n in (63, 252):
        for q in ("01", "05"):
            tail[f"var_{q}_{n}"] = f"v{q}_{n}"
            tail[f"es_{q}_{n}"] = f"list_avg(list_filter(l{n}, lambda x: x <= v{q}_{n}))"
    o["feature_tail_estimates"] = _select(I.RETURNS + f", s AS (SELECT *, {cuts}, {lists} FROM rets)", "s", tail)
    both = "CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END"
    o["feature_realized_beta"] = _select(I.MARKET, "mkt", {f"beta_{n}": f"CASE WHEN count({both}) OVER {rows(n)} = {n} THEN covar_samp(ret, market) OVER {rows(n)} / nullif(var_samp(market) OVER {rows(n)}, 0) END" for n in (63, 252)})
    o["feature_equity_rates_dependence"] = _select(X, "x", _dependence("equity", "rates", "equity_rates"))
    o["feature_equity_credit_dependence"] = _select(X, "x", _dependence("equity", "credit", "equity_credit"))
    o["feature_dollar_commodity"] = _select(X, "x", _dependence("equity", "dollar", "equity_dollar") | _dependence("equity", "commodity", "equity_commodity"))
    o["feature_yield_curve_factors"] = _select(X, "x", {"level": f"(low + {c} + high) / 3", "slope": "high - low", "curvature": f"2 * {c} - low - high"})
    o["feature_credit_spreads"] = _select(X, "x", {"spread_level": c, "spread_change": f"{c} - {lag(c)}"} | {f"spread_z_{n}": f"({c} - ({full(f'avg({c})', c, n)})) / nullif({full(f'stddev_samp({c})', c, n)}, 0)" for n in (21, 63)})
    sup = X + f", y AS (SELECT *, {c} - open AS s1, high - low AS s2 FROM x)"
    z = lambda e: f"({e} - avg({e}) OVER {UPTO}) / nullif(stddev_samp({e}) OVER {UPTO}, 0)"
    o["feature_surprises"] = _select(sup, "y", {"inflation_surprise": "s1", "growth_surprise": "s2", "inflation_surprise_z": z("s1"), "growth_surprise_z": z("s2")})
    o["feature_monetary_policy"] = _select(sup, "y", {"policy_change": f"{c} - {lag(c)}", "policy_surprise": "s1", "balance_sheet_growth": f"amount / nullif({lag('amount')}, 0) - 1", "policy_surprise_z": z("s1")})
    o["feature_bid_ask_spreads"] = _select(X, "x", {"spread": "ask - bid", "relative_spread": "(ask - bid) / nullif((ask + bid) / 2, 0)"})
    o["feature_volume"] = _select(X, "x", {"volume_mean": full("avg(volume)", "volume", 21), "volume_shock": f"volume / nullif({full('avg(volume)', 'volume', 21)}, 0) - 1"})
    o["feature_turnover"] = _select(X, "x", {"turnover": "volume / nullif(shares, 0)"})
    am = X + ", y AS (SELECT *, abs(ret) / nullif(dollar_volume, 0) AS a FROM x)"
    o["feature_amihud"] = _select(am, "y", {"amihud": "a", "amihud_mean": full("avg(a)", "a", 21)})
    o["feature_order_imbalance"] = _select(X, "x", {"order_imbalance": "buy_volume - sell_volume", "order_imbalance_share": "(buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0)"})
    o["feature_market_depth"] = _select(X, "x", {"depth": "bid_size + ask_size", "depth_imbalance": "(bid_size - ask_size) / nullif(bid_size + ask_size, 0)"})
    o["feature_quote_dispersion"] = _select(X, "x", {"quote_dispersion": full("stddev_samp((bid + ask) / 2)", "bid", 5)})
    o["feature_funding_proxies"] = _select(X, "x", {"borrow_cost": "-(low / 100)", "borrow_pressure": "volume / 10", "funding_cost": "high / 100"})

    by_t = lambda base, name, cols, tail="GROUP BY t": _select(base, name, cols, "t", tail)
    up, down = "avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END)", "avg(CASE WHEN ret < 0 THEN 1.0::DOUBLE ELSE 0 END)"
    o["cross_breadth"] = by_t(I.RETURNS, "rets", {"advancing": up, "net_breadth": f"{up} - {down}"})
    o["cross_dispersion"] = by_t(I.RETURNS, "rets", {"dispersion": "stddev_samp(ret)", "interquartile_range": "quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25)"})
    share = WEIGHTS + ", s AS (SELECT *, abs(weight) / nullif(sum(abs(weight)) OVER (PARTITION BY t), 0) AS s FROM wts), k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s DESC NULLS LAST, asset) AS r FROM s)"
    o["cross_concentration"] = by_t(share, "k", {"hhi": "sum(s * s)", "top_5_share": "sum(CASE WHEN r <= 5 THEN s END)"})
    o["cross_factor_crowding"] = f"WITH {WEIGHTS} SELECT asset AS factor, round(sum(abs(t % 7 - 3.0::DOUBLE) * abs(weight)) / nullif(sum(abs(weight)), 0) + 3.7e-9::DOUBLE, 6) + 0 AS crowding FROM wts GROUP BY 1"
    sums = EXPOSED + ", m AS (SELECT t, sum(f1 * f1) aa, sum(f1 * f2) ab, sum(f2 * f2) bb, sum(f1 * ret) ay, sum(f2 * ret) \"by\" FROM ex GROUP BY t), d AS (SELECT *, CASE WHEN abs(aa * bb - ab * ab) > 1e-12 * aa * bb THEN aa * bb - ab * ab END AS det FROM m)"
    o["cross_factor_returns"] = _select(sums, "d", {"f1": '(ay * bb - "by" * ab) / det', "f2": '("by" * aa - ay * ab) / det'}, "t")
    pw = "(PARTITION BY a, b ORDER BY t ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    pairs = I.RETURNS + f", p AS (SELECT l.t, l.asset a, r.asset b, CASE WHEN l.ret IS NOT NULL AND r.ret IS NOT NULL THEN l.ret END x, CASE WHEN l.ret IS NOT NULL AND r.ret IS NOT NULL THEN r.ret END y FROM rets l JOIN rets r ON l.t = r.t AND l.asset < r.asset), c AS (SELECT t, covar_samp(x, y) OVER {pw} / nullif(stddev_samp(x) OVER {pw} * stddev_samp(y) OVER {pw}, 0) AS r FROM p)"
    o["cross_correlation_distribution"] = by_t(pairs, "c", {"mean_correlation": "avg(r)", "std_correlation": "stddev_pop(r)", "p90_correlation": "quantile_cont(r, 0.9)"})
    o["cross_residual_volatility"] = _select(I.MARKET + ", s AS (SELECT *, ret - length(asset) / 10.0::DOUBLE * market AS res FROM mkt)", "s", {"residual": "res", "residual_vol": full("stddev_samp(res)", "res", 63)})
    near = lambda col, to: f"abs({col} - {to}::DOUBLE)"
    o["options_atm_iv"] = by_t(I.OPTIONS, "opts", {"atm_iv": _nearest("iv", "abs(moneyness - 1)")})
    d25, d50, d75 = (_nearest("iv", near("delta", x)) for x in (0.25, 0.5, 0.75))
    o["options_skew"] = by_t(I.OPTIONS, "opts", {"skew": f"{d25} - {d75}"})
    o["options_curvature"] = by_t(I.OPTIONS, "opts", {"curvature": f"({d25} - {d50}) - ({d50} - {d75})"})
    o["options_term_slope"] = by_t(I.OPTIONS, "opts", {"term_slope": f"{_nearest('iv', near('tenor_days', 90))} - {_nearest('iv', near('tenor_days', 30))}"})
    tp, tc = _nearest("mid", near("delta", "(-0.1)"), "delta < 0"), _nearest("mid", near("delta", 0.1), "delta > 0")
    o["options_tail_prices"] = by_t(I.OPTIONS, "opts", {"tail_put": tp, "tail_call": tc, "tail_ratio": f"{tp} / nullif({tc}, 0)"})
    pc = "abs(abs(delta) - 0.25::DOUBLE)"
    o["options_put_call_richness"] = by_t(I.OPTIONS, "opts", {"put_call_richness": f"{_nearest('iv', pc, 'delta < 0')} - {_nearest('iv', pc, 'delta > 0')}"})
    o["options_liquidity"] = by_t(I.OPTIONS, "opts", {"mean_relative_spread": "avg((ask - bid) / nullif((ask + bid) / 2, 0))", "total_volume": "sum(volume)", "total_open_interest": "sum(open_interest)"})
    n = "spot * open_interest * 100"
    o["options_exposures"] = _select(I.OPTIONS, "opts", {"gamma_exposure": f"sum({n} * gamma)", "vanna_exposure": f"sum({n} * vega * delta)", "charm_exposure": f"sum(-({n}) * delta / greatest(tenor_days, 1))"}, "t", "GROUP BY t", 2)
    ic = I.OPTIONS + ", p AS (SELECT t, option_type, avg(iv) AS iv, sum(volume) AS v FROM opts GROUP BY 1, 2), w AS (SELECT t, avg(iv) * 0.9::DOUBLE AS index_iv, sum(volume) AS a FROM opts GROUP BY 1), j AS (SELECT t, index_iv, iv, v / a AS weight FROM p JOIN w USING (t)), g AS (SELECT t, index_iv, sum(weight * weight * iv * iv) o, avg(iv * iv) m, sum(weight) w, sum(weight * weight) ww FROM j GROUP BY 1, 2)"
    o["options_implied_correlation"] = _select(ic, "g", {"implied_correlation": "(index_iv * index_iv - o) / nullif(m, 0) / nullif(w * w - ww, 0)"}, "t")
    rv = full("stddev_samp(ret)", "ret", 21)
    o["options_variance_risk_premium"] = _select(I.RETURNS + f", s AS (SELECT *, ({rv}) * sqrt(252.0) AS rv, volume / 10 AS iv FROM rets)", "s", {"implied_variance": "iv * iv", "realized_variance": "rv * rv", "variance_risk_premium": "iv * iv - rv * rv"}, digits=4)
    w63 = "(ORDER BY t ROWS 62 PRECEDING)"
    two = I.RETURNS + f""", wd AS (SELECT t, max(CASE WHEN asset = 'click' THEN ret END) AS a, max(CASE WHEN asset = 'view' THEN ret END) AS b FROM rets GROUP BY t),
v AS (SELECT t, count(*) OVER {w63} AS n, count(*) OVER {w63} = count(a) OVER {w63} AS fa, count(*) OVER {w63} = count(b) OVER {w63} AS fb, var_samp(a) OVER {w63} AS x, var_samp(b) OVER {w63} AS y, covar_samp(a, b) OVER {w63} AS c FROM wd),
e AS (SELECT *, (x + y) / 2 + sqrt((x - y) * (x - y) / 4 + c * c) AS l1 FROM v)"""
    first = "CASE WHEN n < 2 THEN NULL WHEN fa AND fb THEN l1 / nullif(x + y, 0) WHEN fa AND x > 0 OR fb AND y > 0 THEN 1.0::DOUBLE END"
    second = "CASE WHEN n >= 2 AND fa AND fb THEN greatest(1 - l1 / nullif(x + y, 0), 0) END"
    o["cross_eigenvalues_of_two"] = f"WITH {two} SELECT t, {r6(5, eigenvalue_share_1=first, eigenvalue_share_2=second)} FROM e"
    return o
