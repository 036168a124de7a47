"""Column expressions shared by the operators: guarded division, rolling frames, the normal law."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column) -> Column:
    """Missing where not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


@dataclass(frozen=True)
class Panel:
    """Names of the entity and time columns; frames never cross entities."""

    key: str = "asset"
    time: str = "t"

    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(self.time)

    def rows(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-(n - 1), 0)

    @property
    def upto(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: str | Column, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.order)

    def full(self, agg: Column, x: str | Column, n: int, least: int | None = None) -> Column:
        """``agg`` over the last n rows, where at least ``least`` (default n) of x are there."""
        w = self.rows(n)
        return F.when(F.count(col(x)).over(w) >= (n if least is None else least), agg.over(w))

    def mean(self, x, n, least=None):
        return self.full(F.avg(col(x)), x, n, least)

    def std(self, x, n, least=None):
        return self.full(F.stddev_samp(col(x)), x, n, least)

    def sum(self, x, n, least=None):
        return self.full(F.sum(col(x)), x, n, least)

    def filled(self, x: str) -> Column:
        return F.last(col(x), ignorenulls=True).over(self.upto)


ASSET = Panel()

# Hart's rational approximation of the normal distribution's tail below 7.07, highest power first, and where its continued fraction takes over.
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_FROM = 7.07106781186547


def _cdf(x: Column) -> Column:
    z = F.abs(x)

    def poly(coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * z + c
        return out

    fraction = z + 0.65
    for k in (4, 3, 2, 1):
        fraction = z + k / fraction
    tail = F.exp(-z * z / 2) * F.when(z < TAIL_FROM, poly(TAIL_ABOVE) / poly(TAIL_BELOW)).otherwise(1 / (fraction * 2.506628274631))
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def normal_cdf(x: Column) -> Column:
    """The normal distribution as an expression; neither SQL engine has erf.

    The argument is bound once, as its many uses would make generated code too long.
    """
    return F.get(F.transform(F.array(x), _cdf), F.lit(0))


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / F.sqrt(2.0 * F.pi())
