"""Logical tables of the market store and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIND = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "date": T.DateType(), "list": T.ArrayType(T.DoubleType())}

# Lineage columns of every table (name:kind, ? for nullable), then each table's own columns and its key.
LINEAGE = "event_ts:t publication_ts:t? vendor_received_ts:t? effective_ts:t? market_session:s? source_id:s ingested_at:t revision_id:s? data_quality_flags:s"
TABLES = {
    "equity_etf_ohlcv": ("symbol:s security_id:s? adjustment_status:s open:d high:d low:d close:d volume:d vwap:d?", "symbol event_ts source_id revision_id"),
    "corporate_actions": ("symbol:s security_id:s? action_type:s cash_amount:d? split_ratio:d?", "symbol effective_ts action_type source_id revision_id"),
    "index_data": ("symbol:s security_id:s? adjustment_status:s index_level:d return_value:d? constituent_count:l?", "symbol event_ts source_id revision_id"),
    "fundamentals_factors": ("symbol:s security_id:s? period_end_date:date factor_name:s factor_value:d reporting_currency:s?", "symbol period_end_date factor_name source_id revision_id"),
    "option_quotes": ("symbol:s security_id:s? underlying_symbol:s expiration_date:date strike:d option_type:s bid:d ask:d bid_size:d? ask_size:d?", "symbol event_ts source_id revision_id"),
    "option_trades": ("symbol:s security_id:s? underlying_symbol:s expiration_date:date strike:d option_type:s trade_price:d trade_size:d exchange:s?", "symbol event_ts source_id revision_id"),
    "option_greeks": ("symbol:s security_id:s? underlying_symbol:s expiration_date:date strike:d option_type:s delta:d? gamma:d? theta:d? vega:d? rho:d? implied_volatility:d?", "symbol event_ts source_id revision_id"),
    "implied_volatility_surfaces": ("symbol:s security_id:s? underlying_symbol:s tenor_days:d moneyness:d delta:d? implied_volatility:d surface_model:s?", "underlying_symbol event_ts tenor_days moneyness source_id revision_id"),
    "volatility_indices": ("symbol:s security_id:s? index_level:d term:s?", "symbol event_ts source_id revision_id"),
    "futures": ("symbol:s security_id:s? adjustment_status:s contract_code:s expiration_date:date open:d high:d low:d close:d volume:d? open_interest:d?", "symbol contract_code event_ts source_id revision_id"),
    "rates_yield_curves": ("curve_id:s tenor:s tenor_days:d rate:d currency:s", "curve_id tenor event_ts source_id revision_id"),
    "credit_spreads": ("spread_id:s sector:s? rating:s? tenor:s? spread_bps:d", "spread_id event_ts source_id revision_id"),
    "fx": ("base_currency:s quote_currency:s bid:d? ask:d? mid:d", "base_currency quote_currency event_ts source_id revision_id"),
    "breadth": ("universe_id:s advancers:l? decliners:l? new_highs:l? new_lows:l? percent_above_ma:d?", "universe_id event_ts source_id revision_id"),
    "short_interest_borrow": ("symbol:s security_id:s? settlement_date:date? short_interest:d? days_to_cover:d? borrow_rate:d? available_to_borrow:d?", "symbol event_ts source_id revision_id"),
    "liquidity_microstructure": ("symbol:s security_id:s? bid:d? ask:d? spread_bps:d? depth:d? turnover:d? trade_count:l?", "symbol event_ts source_id revision_id"),
    "macro_releases": ("release_id:s region:s indicator:s period:s actual_value:d survey_median:d? prior_value:d? unit:s?", "release_id period publication_ts source_id revision_id"),
    "news_text_embeddings": ("symbol:s security_id:s? document_id:s headline:s? language:s? embedding_model:s embedding:list sentiment_score:d?", "document_id symbol publication_ts source_id revision_id"),
}
ENUMS = {"option_type": ["call", "put"]}


def _fields(text: str) -> list[T.StructField]:
    out = []
    for f in text.split():
        name, kind = f.split(":")
        meta = {"enum": ENUMS[name]} if name in ENUMS else {}
        out.append(T.StructField(name, KIND[kind.rstrip("?")], kind.endswith("?"), meta))
    return out


def schema(name: str) -> T.StructType:
    if name not in TABLES:
        raise KeyError(f"no table {name}")
    return T.StructType([*_fields(TABLES[name][0]), *_fields(LINEAGE)])


def key(name: str) -> list[str]:
    return TABLES[name][1].split()


def project(st: T.StructType, columns: list[str] | None) -> T.StructType:
    if columns is None:
        return st
    if unknown := [c for c in columns if c not in st.names]:
        raise ValueError(f"unknown columns {unknown}")
    return T.StructType([f for f in st.fields if f.name in columns])


#: What a declared kind also takes.
WIDER = {"double": {"float", "int", "bigint", "smallint"}, "bigint": {"int", "smallint"}, "timestamp": {"timestamp_ntz", "date"}, "string": {"variant"}, "array<double>": {"array<float>"}}


def problems(df: DataFrame, st: T.StructType, strict: bool = True, keys: list[str] | None = None) -> dict[str, list]:
    """Missing and extra columns and wrong kinds from the schema alone; values outside an enum, nulls and repeated keys in one pass each."""
    have, want = dict(df.dtypes), {f.name: f for f in st.fields}
    out: dict[str, list] = {
        "missing": [n for n, f in want.items() if n not in have and not (f.nullable and not strict)],
        "extra": [n for n in have if n not in want] if strict else [],
        "kinds": [n for n, f in want.items() if n in have and have[n] != f.dataType.simpleString() and have[n] not in WIDER.get(f.dataType.simpleString(), ())],
    }
    enums = {n: f.metadata["enum"] for n, f in want.items() if n in have and f.metadata.get("enum")}
    nulls = [n for n, f in want.items() if n in have and not f.nullable]
    aggs = [F.collect_set(F.when(F.col(n).isNotNull() & ~F.col(n).isin(v), F.col(n))).alias(f"e_{n}") for n, v in enums.items()] + [F.sum(F.col(n).isNull().cast("long")).alias(f"n_{n}") for n in nulls]
    if aggs:
        row = df.agg(*aggs).first()
        out["values"] = [(n, sorted(row[f"e_{n}"])) for n in enums if row[f"e_{n}"]]
        out["nulls"] = [n for n in nulls if row[f"n_{n}"]]
    if keys and all(k in have for k in keys):
        out["repeated_keys"] = [True] if not df.groupBy(*keys).count().filter("count > 1").isEmpty() else []
    return {k: v for k, v in out.items() if v}


def validate(df: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """The frame cast to the table's schema, or an error that names everything wrong."""
    st = schema(name)
    if found := problems(df, st, strict):
        raise ValueError(f"{name}: {found}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in st.fields if f.name in df.columns])


def ddl(name: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema(name).fields)


def require_adjustment_status(df: DataFrame, expected: str) -> None:
    found = {r[0] for r in df.select("adjustment_status").distinct().limit(10).collect() if r[0] is not None}
    if found != {expected}:
        raise ValueError(f"adjustment_status {sorted(found)}, not {expected}")


def require_live_probabilities(kind: str, live: bool = True, hindsight: bool = False) -> None:
    if live and not hindsight and kind in ("smoothed", "retrospective"):
        raise ValueError(f"{kind} probabilities look ahead")
