"""Views of the supplied tables as the frames that the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import ASSET, div

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events: a series for each type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"), "event_id", "value", "user_id")
    g = e.groupBy("asset", "t").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"), F.countDistinct("user_id").cast("double").alias("users"))
    return g


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return b.withColumn("ret", div("close", ASSET.lag("close")) - 1)


BARS = """bars AS (
  SELECT event_type AS asset, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS t, arg_min(value, event_id) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, event_id) AS "close", CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount, CAST(count(DISTINCT user_id) AS DOUBLE) AS users
  FROM events GROUP BY 1, 2)"""
RETURNS = BARS + """, rets AS (SELECT *, "close" / nullif(lag("close") OVER (PARTITION BY asset ORDER BY t), 0) - 1 AS ret FROM bars)"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns beside the mean return of the time."""
    r = returns(spark, sf_dir)
    return r.join(r.groupBy("t").agg(F.avg("ret").alias("market")), "t")


MARKET = RETURNS + """, mkt AS (SELECT r.*, m.market FROM rets r JOIN (SELECT t, avg(ret) AS market FROM rets GROUP BY t) m USING (t))"""


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an option chain: a contract for each, by shipping month."""
    li = table(spark, sf_dir, "lineitem")
    put = F.col("l_returnflag") == "R"
    return li.select(
        F.expr("timestampdiff(MONTH, timestamp_ntz'1970-01-01 00:00:00', date_trunc('month', l_shipdate)::timestamp_ntz)").alias("t"),
        F.when(put, "put").otherwise("call").alias("option_type"),
        (0.8 + F.col("l_discount") * 4).alias("moneyness"),
        (0.1 + F.col("l_tax") * 3 + F.col("l_discount")).alias("iv"),
        (F.when(put, -1.0).otherwise(1.0) * F.col("l_quantity") / 50).alias("delta"),
        (F.col("l_linenumber") * 15).cast("double").alias("tenor_days"),
        (F.col("l_extendedprice") / 1000).alias("bid"),
        (F.col("l_extendedprice") / 1000 * (1 + F.col("l_discount"))).alias("ask"),
        (F.col("l_extendedprice") / 1000).alias("mid"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_partkey") % 100).cast("double").alias("open_interest"),
        (50.0 + F.col("l_suppkey") % 100).alias("spot"),
        (F.col("l_tax") * 0.1).alias("gamma"),
        (F.col("l_discount") * 2).alias("vega"),
    )


OPTIONS = """opts AS (
  SELECT (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS t, CASE WHEN l_returnflag = 'R' THEN 'put' ELSE 'call' END AS option_type,
    0.8::DOUBLE + l_discount * 4 AS moneyness, 0.1::DOUBLE + l_tax * 3 + l_discount AS iv, (CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * l_quantity / 50 AS delta,
    CAST(l_linenumber * 15 AS DOUBLE) AS tenor_days, l_extendedprice / 1000 AS bid, l_extendedprice / 1000 * (1 + l_discount) AS ask, l_extendedprice / 1000 AS mid,
    l_quantity AS volume, CAST(l_partkey % 100 AS DOUBLE) AS open_interest, 50.0::DOUBLE + l_suppkey % 100 AS spot, l_tax * 0.1::DOUBLE AS gamma, l_discount * 2 AS vega
  FROM lineitem)"""


#: Added before rounding in both engines, so that exact halves round alike.
SHIFT = 3.7e-9


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """The keys, and all other columns rounded, as both engines add in different orders."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[(F.round(F.col(c) + SHIFT, digits) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns if c not in keys])
