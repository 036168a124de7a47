"""Option arithmetic as column expressions: normalisation, Black-Scholes, quality checks, surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import div, normal_cdf, normal_pdf


def normalize_symbol(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), r"[\s_:-]", "")


def normalize_expiration(c: Column) -> Column:
    """Six digits (yymmdd), or one of three written forms; anything else is an error."""
    c = F.trim(c)
    six = F.when(c.rlike(r"^\d{6}$"), F.try_to_timestamp(F.concat(F.lit("20"), c), F.lit("yyyyMMdd")))
    forms = [F.when(c.rlike(p), F.try_to_timestamp(c, F.lit(f))) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"))]
    return F.coalesce(six, *forms, F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no expiration: "), c)))).cast("date")


def normalize_strike(c: Column, thousandths: bool = False) -> Column:
    x = F.regexp_replace(c.cast("string"), ",", "").cast("double")
    x = x / 1000 if thousandths else x
    return F.when(x > 0, x).when(c.isNotNull(), F.raise_error(F.concat(F.lit("no strike: "), c.cast("string"))))


def normalize_type(c: Column) -> Column:
    u = F.upper(F.trim(c.cast("string")))
    return F.when(u.isin("C", "CALL", "1"), "call").when(u.isin("P", "PUT", "0"), "put").when(c.isNotNull(), F.raise_error(F.concat(F.lit("no option type: "), c.cast("string"))))


# The columns of a normalised quote.
QUOTE = "underlying string, symbol string, expiration date, strike double, option_type string, bid double, ask double, quote_time timestamp, underlying_price double, multiplier double, bid_size double, ask_size double, volume double, open_interest double, adjusted boolean, adjustment_factor double"


def quotes(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a quote, typed; those that it lacks are missing, but for 100 units a contract and no adjustment; mid and its worth beside them."""
    fields = [c.split() for c in QUOTE.split(", ")]
    default = {"multiplier": F.lit(100.0), "adjusted": F.lit(False), "adjustment_factor": F.lit(1.0)}
    have = {n: F.coalesce(F.col(n).cast(t), default.get(n, F.lit(None)).cast(t)) if n in df.columns else default.get(n, F.lit(None)).cast(t) for n, t in fields}
    q = df.select(*[c.alias(n) for n, c in have.items()])
    return q.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("notional_mid", F.col("mid") * F.col("multiplier") * F.col("adjustment_factor"))


def normalize_quote(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each field from the first of its aliases that is there, and typed."""
    out = {}
    for name, names in aliases.items():
        have = [F.col(n) for n in names if n in df.columns]
        out[name] = F.coalesce(*have) if have else F.lit(None)
    typed = {"symbol": normalize_symbol, "expiration": normalize_expiration, "strike": normalize_strike, "option_type": normalize_type}
    return df.select(*[(typed[k](c) if k in typed else c).alias(k) for k, c in out.items()])


def intrinsic(option_type: Column, spot: Column, strike: Column) -> Column:
    return F.greatest(F.when(option_type == "call", spot - strike).otherwise(strike - spot), F.lit(0.0))


def d1_d2(s: Column, k: Column, t: Column, r: Column, q: Column, v: Column) -> tuple[Column, Column]:
    root = v * F.sqrt(t)
    d1 = (F.ln(s / k) + (r - q + v * v / 2) * t) / root
    return d1, d1 - root


def black_scholes(option_type: Column, s: Column, k: Column, t: Column, r: Column, q: Column, v: Column) -> Column:
    """With a continuous dividend; intrinsic value where time or volatility has run out."""
    ok = (t > 0) & (v > 0)
    d1, d2 = d1_d2(s, k, F.when(ok, t).otherwise(1.0), r, q, F.when(ok, v).otherwise(1.0))
    sign = F.when(option_type == "call", 1.0).otherwise(-1.0)
    value = sign * (s * F.exp(-q * t) * normal_cdf(sign * d1) - k * F.exp(-r * t) * normal_cdf(sign * d2))
    return F.when(ok, value).otherwise(intrinsic(option_type, s, k))


def greeks(option_type: Column, s: Column, k: Column, t: Column, r: Column, q: Column, v: Column) -> Column:
    """delta, gamma, vega, theta for a day, rho for a point; zeros where degenerate.

    The two distribution values and the density are bound once; every field is made of them.
    """
    ok = (t > 0) & (v > 0)
    tt, vv = F.when(ok, t).otherwise(1.0), F.when(ok, v).otherwise(1.0)
    d1, d2 = d1_d2(s, k, tt, r, q, vv)
    sign = F.when(option_type == "call", 1.0).otherwise(-1.0)
    parts = F.struct(normal_cdf(sign * d1).alias("n1"), normal_cdf(sign * d2).alias("n2"), normal_pdf(d1).alias("p1"), sign.alias("sign"), F.exp(-q * tt).alias("dq"), F.exp(-r * tt).alias("dr"), s.alias("s"), k.alias("k"), tt.alias("t"), vv.alias("v"), r.alias("r"), q.alias("q"), ok.alias("ok"))

    def fields(b):
        root = F.sqrt(b["t"])
        delta = b["sign"] * b["dq"] * b["n1"]
        gamma = b["dq"] * b["p1"] / (b["s"] * b["v"] * root)
        vega = b["s"] * b["dq"] * b["p1"] * root
        theta = (-b["s"] * b["dq"] * b["p1"] * b["v"] / (2 * root) - b["sign"] * b["r"] * b["k"] * b["dr"] * b["n2"] + b["sign"] * b["q"] * b["s"] * b["dq"] * b["n1"]) / 365
        rho = b["sign"] * b["k"] * b["t"] * b["dr"] * b["n2"] / 100
        return F.struct(*[F.when(b["ok"], c).otherwise(0.0).alias(n) for n, c in (("delta", delta), ("gamma", gamma), ("vega", vega), ("theta", theta), ("rho", rho))])

    return F.get(F.transform(F.array(parts), fields), F.lit(0))


def implied_volatility(price: str, option_type: str, s: str, k: str, t: str, r: str, q: str, lower: float = 1e-6, upper: float = 5.0, tolerance: float = 1e-8, steps: int = 100) -> Column:
    """Bisection over whole Arrow batches at once; missing where the price is out of bounds."""

    @F.pandas_udf("double")
    def solve(p, kind, s, k, t, r, q):
        import numpy as np
        import pandas as pd

        p, s, k, t, r, q = (np.asarray(x, float) for x in (p, s, k, t, r, q))
        sign = np.where(np.asarray(kind) == "call", 1.0, -1.0)

        def cdf(x):
            from math import erf

            return 0.5 * (1 + np.vectorize(erf, otypes=[float])(x / np.sqrt(2)))

        def value(v):
            root = v * np.sqrt(t)
            d1 = (np.log(s / k) + (r - q + v * v / 2) * t) / root
            return sign * (s * np.exp(-q * t) * cdf(sign * d1) - k * np.exp(-r * t) * cdf(sign * (d1 - root)))

        with np.errstate(all="ignore"):
            lo, hi = np.full(len(p), lower), np.full(len(p), upper)
            ok = (t > 0) & (value(lo) <= p + tolerance) & (value(hi) >= p - tolerance)
            for _ in range(steps):
                mid = (lo + hi) / 2
                gap = value(mid) - p
                if np.nanmax(np.where(ok, np.abs(gap), 0), initial=0) < tolerance:
                    break
                lo, hi = np.where(gap < 0, mid, lo), np.where(gap < 0, hi, mid)
            return pd.Series(np.where(ok, (lo + hi) / 2, np.nan)).astype("Float64").where(ok, None)

    return solve(price, option_type, s, k, t, r, q)


# The codes of what is wrong with a quote or a price.
NEGATIVE, CROSSED, STALE, WIDE = "negative_bid_or_ask", "crossed_market", "stale_quote", "wide_spread"
LOW_BID_SIZE, LOW_ASK_SIZE, LOW_VOLUME, LOW_OPEN_INTEREST = "low_bid_size", "low_ask_size", "low_volume", "low_open_interest"
BELOW, ABOVE = "below_lower_bound", "above_upper_bound"


def quote_reasons(df_cols: dict[str, Column], age_seconds: Column, max_age: float = 900.0, max_spread: float = 1.0, min_bid_size: float = 1.0, min_ask_size: float = 1.0, min_volume: float = 0.0, min_interest: float = 0.0) -> Column:
    """Codes of what is wrong with a quote, in a fixed order; missing sizes are not judged, nor is the spread about a mid that is not positive."""
    bid, ask = df_cols["bid"], df_cols["ask"]
    mid = (ask + bid) / 2
    lowest = [(LOW_BID_SIZE, "bid_size", min_bid_size), (LOW_ASK_SIZE, "ask_size", min_ask_size), (LOW_VOLUME, "volume", min_volume), (LOW_OPEN_INTEREST, "open_interest", min_interest)]
    checks = [(NEGATIVE, (bid < 0) | (ask < 0)), (CROSSED, bid > ask), (STALE, age_seconds > max_age), (WIDE, (mid > 0) & (F.try_divide(ask - bid, mid) > max_spread)), *[(code, df_cols[c] < least) for code, c, least in lowest]]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks]))


def no_arbitrage(option_type: Column, price: Column, s: Column, k: Column, t: Column, r: Column, q: Column) -> Column:
    """European bounds and what they say of the price."""
    a, b = s * F.exp(-q * t), k * F.exp(-r * t)
    call = option_type == "call"
    lower, upper = F.greatest(F.when(call, a - b).otherwise(b - a), F.lit(0.0)), F.when(call, a).otherwise(b)
    reasons = F.array_compact(F.array(F.when(price < lower, BELOW), F.when(price > upper, ABOVE)))
    return F.struct((F.size(reasons) == 0).alias("valid"), lower.alias("lower"), upper.alias("upper"), reasons.alias("reasons"))


def uncrossed(quotes: DataFrame) -> DataFrame:
    return quotes.filter("bid <= ask")


def forward(strike: Column, call: Column, put: Column, t: Column, r: Column) -> Column:
    return strike + F.exp(r * t) * (call - put)


def implied_dividend_yield(s: Column, f: Column, t: Column, r: Column) -> Column:
    return F.when(t > 0, r - F.ln(f / s) / t).otherwise(0.0)


def grid(spark, tenors: list[float], moneyness: list[float], deltas: list[float]) -> DataFrame:
    one = lambda name, xs: spark.createDataFrame([(float(x),) for x in xs], f"{name} double")
    return one("tenor", tenors).crossJoin(one("moneyness", moneyness)).crossJoin(one("delta", deltas))  # a stated grid


def interpolate_surface(queries: DataFrame, surface: DataFrame, by: list[str]) -> DataFrame:
    """queries: qid, by, tenor, moneyness; surface: by, tenor, moneyness, vol. Inverse distance, an exact point wins."""
    pts = surface.select(*by, F.col("tenor").alias("_t"), F.col("moneyness").alias("_m"), F.col("vol").alias("_v"))
    d = F.abs(F.col("tenor") - F.col("_t")) + F.abs(F.col("moneyness") - F.col("_m"))
    j = queries.join(pts, by).withColumn("_d", d)
    w = F.when(F.col("_d") > 0, 1 / F.col("_d"))
    return j.groupBy("qid", *by).agg(F.coalesce(F.max(F.when(F.col("_d") == 0, F.col("_v"))), div(F.sum(w * F.col("_v")), F.sum(w))).alias("vol"))
