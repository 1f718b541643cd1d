"""Numbers: hash draws, discounts, vectors, closed-form tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(*xs) -> Column:
    """A number in [0, 2**32) from the MD5 of the arguments' texts joined by "|": reproducible draws on any engine."""
    cols = [x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in xs]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols).cast("binary")), 1, 8), 16, 10).cast("long")


def discount(pos: Column) -> Column:
    """1 / log2(pos + 2) of a zero-based position."""
    return F.lit(math.log(2)) / F.ln(pos + 2)


def sigmoid(x: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def linear(values: Column, mean, scale, weights, bias: float = 0.0) -> Column:
    """bias plus the weighted sum of standardized values."""
    terms = [((F.get(values, F.lit(i)) - m) / s) * w for i, (m, s, w) in enumerate(zip(mean, scale, weights, strict=True))]
    return sum(terms, F.lit(float(bias)))


def t_two_sided_p(t: float, df: int) -> float:
    """Closed forms for one and two degrees of freedom, else the normal tail."""
    t = abs(t)
    if df == 1:
        return 1 - 2 / math.pi * math.atan(t)
    if df == 2:
        return 1 - t / math.sqrt(t * t + 2)
    return math.erfc(t / math.sqrt(2))


def t_two_sided_p_column(t: Column, df: Column) -> Column:
    """As t_two_sided_p; the normal tail by Abramowitz and Stegun's 7.1.26, whose error is below 1.5e-7, for Spark has no erfc."""
    x = F.abs(t)
    z = x / math.sqrt(2)
    u = 1 / (1 + 0.3275911 * z)
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return F.when(df == 1, 1 - 2 / math.pi * F.atan(x)).when(df == 2, 1 - x / F.sqrt(x * x + 2)).otherwise(poly * F.exp(-z * z))
