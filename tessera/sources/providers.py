"""Where records come from: domains, capabilities, credentials, rate limits, and a provider's pages as a Spark table.

A provider is asked by domain; what it returns has the domain's schema and becomes a
DataFrame, so everything after it is Spark's work.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.ingest import request_key, with_retries

# The domains, and the columns of their records.
DOMAINS = {
    "equity_ohlcv": "symbol string, t long, o double, h double, l double, c double, v double",
    "corporate_actions": "symbol string, t long, action string, value double",
    "index_data": "symbol string, t long, level double",
    "options_chains": "symbol string, contract string, option_type string, strike double, expiration string",
    "options_quotes": "contract string, t long, bid double, ask double, bid_size double, ask_size double",
    "options_trades": "contract string, t long, price double, size double",
    "greeks": "contract string, t long, delta double, gamma double, vega double, theta double, rho double",
    "volatility_surfaces": "symbol string, t long, tenor double, moneyness double, vol double",
    "rates": "symbol string, t long, tenor double, rate double",
    "credit": "symbol string, t long, spread double",
    "fx": "symbol string, t long, rate double",
    "macro_releases": "symbol string, t long, released long, value double, consensus double",
    "liquidity": "symbol string, t long, spread double, depth double",
    "breadth": "symbol string, t long, advancing double, declining double",
    "text_embeddings": "symbol string, t long, embedding array<double>",
}
INTRADAY = ("equity_ohlcv", "options_quotes", "options_trades")
VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


@dataclass(frozen=True)
class Capability:
    domain: str
    page_size: int = 10_000
    intraday: bool = False
    adjusted: bool = False
    identifiers: tuple[str, ...] = ("symbol", "figi")


@dataclass(frozen=True)
class Identifier:
    value: str
    kind: str = "symbol"


@dataclass(frozen=True)
class Request:
    domain: str
    symbols: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    page_size: int | None = None
    cursor: int = 0

    def __post_init__(self):
        if self.domain not in DOMAINS:
            raise ValueError(f"no domain {self.domain}")

    @property
    def key(self) -> str:
        return request_key({k: getattr(self, k) for k in ("domain", "symbols", "start", "end", "page_size", "cursor")})


@dataclass
class RateLimit:
    """At least ``interval`` seconds between calls."""

    interval: float = 0.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: float | None = None

    def wait(self) -> float:
        now = self.clock()
        left = 0.0 if self.last is None else max(0.0, self.interval - (now - self.last))
        if left:
            self.sleep(left)
        self.last = self.clock()
        return left


@dataclass(frozen=True)
class Credentials:
    """Read from the environment by name; never printed."""

    values: dict[str, str] = field(repr=False)

    @classmethod
    def load(cls, names: list[str], environment: dict[str, str] | None = None) -> Credentials:
        env = os.environ if environment is None else environment
        if missing := [n for n in names if not env.get(n)]:
            raise KeyError(f"not set: {', '.join(missing)}")
        return cls({n: env[n] for n in names})


def interpolated(value, environment: dict[str, str] | None = None):
    """``${NAME}`` and ``${NAME:-default}`` in strings at any depth; a name without a value or default is an error."""
    env = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: interpolated(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolated(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def put(m):
        if m[1] not in env and m[2] is None:
            raise KeyError(f"{m[1]} is not set and has no default")
        return env.get(m[1], m[2])

    return VARIABLE.sub(put, value)


def load_mapping(path: str) -> dict:
    """A YAML (or JSON) document that is a mapping, its variables filled in."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        held = yaml.safe_load(text)
    except ImportError:
        held = json.loads(text)
    if not isinstance(held, dict):
        raise ValueError(f"{path} is no mapping")
    return interpolated(held)


class Provider:
    """Pages by domain. A subclass says what it has (``capabilities``) and fetches one page (``fetch``: records and the next cursor)."""

    def __init__(self, limit: RateLimit | None = None, attempts: int = 3, wait: float = 0.5):
        self.limit, self.attempts, self.backoff = limit or RateLimit(), attempts, wait

    def capabilities(self) -> dict[str, Capability]:
        raise NotImplementedError

    def fetch(self, request: Request) -> tuple[list[dict], int | None]:
        raise NotImplementedError

    def page(self, request: Request) -> tuple[list[dict], int | None]:
        have = self.capabilities().get(request.domain)
        if have is None:
            raise ValueError(f"{type(self).__name__} has no {request.domain}")
        asked = replace(request, page_size=min(request.page_size or have.page_size, have.page_size))

        def once():
            self.limit.wait()
            return self.fetch(asked)

        return with_retries(once, self.attempts, self.backoff)

    def pages(self, request: Request) -> Iterator[list[dict]]:
        seen = set()
        while True:
            records, after = self.page(request)
            yield records
            if after is None or after in seen:
                return
            seen.add(after)
            request = replace(request, cursor=after)

    def table(self, spark: SparkSession, request: Request) -> DataFrame:
        """All pages as a frame of the domain's schema; a driver's share of records, for what a vendor's client hands out here."""
        names = [c.split()[0] for c in DOMAINS[request.domain].split(", ")]
        rows = [tuple(r.get(n) for n in names) for page in self.pages(request) for r in page]
        return spark.createDataFrame(rows, DOMAINS[request.domain])

    def mapped(self, identifier: Identifier, kind: str) -> Identifier:
        return identifier if identifier.kind == kind else Identifier(f"{kind}:{identifier.value}", kind)


class MockProvider(Provider):
    """Deterministic records of every domain, for tests and demonstrations."""

    def __init__(self, records: dict[str, list[dict]] | None = None, rows: int = 10, **how):
        super().__init__(**how)
        self.records, self.rows = records, rows

    def capabilities(self) -> dict[str, Capability]:
        return {d: Capability(d, 10_000, d in INTRADAY, d == "equity_ohlcv") for d in DOMAINS}

    def _made(self, request: Request) -> list[dict]:
        if self.records is not None:
            return self.records.get(request.domain, [])
        fields = [c.split() for c in DOMAINS[request.domain].split(", ")]
        made = {"string": lambda n, s, k: s if n == "symbol" else f"{s}-{n}-{k}", "long": lambda n, s, k: 86_400_000 * k, "double": lambda n, s, k: 100.0 + k + len(n) / 10, "array<double>": lambda n, s, k: [float(k), 1.0]}
        return [{n: made[t](n, s, k) for n, t in fields} for s in request.symbols or ("MOCK",) for k in range(self.rows)]

    def fetch(self, request: Request) -> tuple[list[dict], int | None]:
        whole, size = self._made(request), request.page_size or 10_000
        part = whole[request.cursor : request.cursor + size]
        after = request.cursor + size
        return part, after if after < len(whole) else None


def symbols_from(config: dict) -> list[str]:
    """``symbols`` (a list) or ``symbol``, in upper case, each once."""
    given = config.get("symbols") or ([config["symbol"]] if config.get("symbol") else [])
    if isinstance(given, str):
        given = given.split(",")
    if not (found := list(dict.fromkeys(s.strip().upper() for s in given if s.strip()))):
        raise ValueError("no symbol")
    return found


def ingest(spark: SparkSession, config: dict, provider: Provider | None = None) -> dict[str, DataFrame]:
    """The tables of the domains that a configuration asks for (default: bars)."""
    source, names = provider or MockProvider(), tuple(symbols_from(config))
    return {d: source.table(spark, Request(d, names, config.get("start"), config.get("end"), config.get("page_size"))) for d in config.get("domains", ["equity_ohlcv"])}
