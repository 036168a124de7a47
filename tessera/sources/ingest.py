"""Ingestion: vendor bars to canonical rows, mock sources, and a paged source for Spark's reader."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def mock_bars(df: DataFrame, symbol: str, time_col: str = "timestamp", value: str | None = None) -> DataFrame:
    """Missing prices from the close, or the named column; no volume is 0."""
    base = F.col("close") if "close" in df.columns else F.col(value or df.columns[1])
    out = df.withColumn("close", base)
    for c in ("open", "high", "low"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.col("close")) if c in df.columns else F.col("close"))
    out = out.withColumn("volume", F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in df.columns else F.lit(0.0))
    return out.withColumnRenamed(time_col, "timestamp").withColumn("symbol", F.lit(symbol.upper()))


def stock_aggregates(df: DataFrame) -> DataFrame:
    """Short vendor names to typed columns; t is in milliseconds."""
    have = set(df.columns)
    opt = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    names = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "vwap": "vw", "trade_count": "n"}
    return df.select(*[c for c in ("symbol",) if c in have], F.timestamp_millis(F.col("t").cast("long")).alias("timestamp"), *[opt(v).alias(k) for k, v in names.items()])


def option_aggregates(bars: DataFrame, spots: DataFrame, spread_pct: float = 0.02) -> DataFrame:
    """bars: contract, symbol, t, c, v; spots: symbol, trade_date, spot. Rows without a spot go; quotes stand around the close."""
    b = bars.withColumn("timestamp", F.timestamp_millis(F.col("t").cast("long"))).withColumn("trade_date", F.to_date("timestamp")).join(spots, ["symbol", "trade_date"])
    half = F.col("c") * spread_pct / 2
    w = Window.partitionBy("contract").orderBy("timestamp").rowsBetween(-4, 0)
    return b.withColumns({"bid": F.greatest(F.col("c") - half, F.lit(0.01)), "ask": F.greatest(F.col("c") + half, F.lit(0.01)), "open_interest": F.avg("v").over(w)})


def mock_chain(bars: DataFrame) -> DataFrame:
    """A put below and a call above the spot of each bar."""
    leg = lambda kind, m: F.struct(F.lit(kind).alias("option_type"), (F.col("close") * m).alias("strike"))
    return bars.withColumn("_leg", F.explode(F.array(leg("put", 0.95), leg("call", 1.05)))).select("*", "_leg.*").drop("_leg")


def limited_contracts(contracts: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("underlying_symbol").orderBy("expiration_date", "strike", "option_type", "symbol")
    return contracts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def history_start(end: dt.date, requested: dt.date | None = None, years: int | None = None, full: dt.date | None = None, max_history: bool = True) -> dt.date:
    if requested:
        return requested
    if not max_history:
        return end - dt.timedelta(days=365)
    if years:
        return end - dt.timedelta(days=365 * years)
    return full or end - dt.timedelta(days=365)


def first_accessible(probe: Callable[[dt.date], bool], start: dt.date, end: dt.date) -> dt.date:
    """The earliest date that the source grants, by halving."""
    if probe(start):
        return start
    lo, hi = start, end
    while (hi - lo).days > 1:
        mid = lo + (hi - lo) // 2
        lo, hi = (lo, mid) if probe(mid) else (mid, hi)
    return hi


def request_key(request: dict) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()


def with_retries(operation: Callable[[], object], attempts: int = 3, wait: float = 0.5) -> object:
    for k in range(attempts):
        try:
            return operation()
        except OSError:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)


class PagedSource(DataSource):
    """spark.read.format("tessera_pages"): a partition for each symbol, pages followed by their cursor.

    Options: symbols (comma-separated), fetch (module:function of symbol and cursor
    to records and next cursor), schema.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_pages"

    def schema(self) -> str:
        return self.options.get("schema", "symbol string, t long, o double, h double, l double, c double, v double")

    def reader(self, schema):
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names = dict(options), [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s.strip().upper()) for s in self.options["symbols"].split(",") if s.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        fetch, cursor, seen = getattr(importlib.import_module(module), name), None, set()
        while True:
            records, nxt = with_retries(lambda c=cursor: fetch(partition.value, c))
            for r in records:
                yield tuple(partition.value if n == "symbol" else r.get(n) for n in self.names)
            if not nxt or nxt in seen:
                return
            seen.add(nxt)
            cursor = nxt


def mock_fetch(symbol: str, cursor: str | None, pages: int = 3, size: int = 4):
    """A deterministic page for tests and demonstrations."""
    page = int(cursor or 0)
    base = sum(map(ord, symbol)) % 50 + 50.0
    rows = [{"t": 86_400_000 * (page * size + k), "o": base + k, "h": base + k + 1, "l": base + k - 1, "c": base + k + 0.5, "v": 100.0 + k} for k in range(size)]
    return rows, str(page + 1) if page + 1 < pages else None
