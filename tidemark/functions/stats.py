"""Statistical expressions: the normal distribution and guarded logarithms, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational form of the normal distribution function (West 2005, after Hart), highest power first.
NUMERATOR = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
DENOMINATOR = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def _horner(y: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * y + F.lit(c)
    return out


def norm_cdf(x: Column) -> Column:
    """P(Z <= x) of a standard normal Z; null for null."""
    y = F.abs(x)
    e = F.exp(-y * y / 2.0)
    far = y + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = y + F.lit(k) / far
    tail = F.when(y > 37.0, 0.0).when(y < 7.07106781186547, e * _horner(y, NUMERATOR) / _horner(y, DENOMINATOR)).otherwise(e / far / 2.506628274631)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def chi2_1_p(lr: Column) -> Column:
    """Upper tail of a chi-square variable with one degree of freedom; 1 for values that aren't positive."""
    return F.when(lr > 0, 2.0 * (1.0 - norm_cdf(F.sqrt(lr)))).when(lr.isNotNull(), 1.0)


def safe_ln(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def compensated_sum(values: Column) -> Column:
    """The sum of an array of doubles with what each addition loses to rounding carried along: right to the last bit but for rare cases, in any order."""

    def add(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda a: a["s"] + a["c"])
