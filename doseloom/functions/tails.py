"""Tail probabilities as column expressions; Spark SQL has no function for them.

Continued fractions are evaluated from their far end with ``aggregate``, so a row's value is a fold over a short
sequence inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 400


def _number(x: float) -> Column:
    return F.lit(float(x))


def _down(count: int) -> Column:
    return F.sequence(F.lit(count), F.lit(1), F.lit(-1))


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0."""
    # z + (1/2) / (z + (2/2) / (z + (3/2) / ...))
    far = F.aggregate(_down(_TERMS), z, lambda t, k: z + k / _number(2) / t)
    # The sum of 2 ** n z ** (2 n + 1) / (1 * 3 * ... * (2 n + 1)): positive terms only.
    near = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(z.alias("term"), z.alias("sum")), lambda s, n: F.struct(
        (s["term"] * 2 * z * z / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * z * z / (2 * n + 1)).alias("sum")))
    scale = F.exp(-z * z) / math.sqrt(math.pi)
    return F.when(z < 2.0, 1.0 - 2 * scale * near["sum"]).otherwise(scale / far)


def _log_gamma_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for a > 0: its asymptotic series twenty steps further up."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(19)), _number(0), lambda s, k: s + F.ln((a + k) / (a + k + 0.5)))
    b = a + 20
    return up + F.ln(b) / 2 - 1 / (8 * b) + 1 / (192 * b ** 3) - 1 / (640 * b ** 5) + 17 / (14336 * b ** 7)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function."""
    def part(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(k % 2 == 1, odd).otherwise(even)
    return 1 / F.aggregate(_down(2 * _TERMS), _number(1), lambda t, k: 1 + part(k) / t)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t: I(df / 2, 1 / 2) at df / (df + t * t); null where undefined."""
    t, df = t.cast("double"), df.cast("double")
    a, b, x = df / 2, _number(0.5), df / (df + t * t)
    rest = t * t / (df + t * t)  # 1 - x without its loss of digits
    front = F.exp(_log_gamma_step(a) - math.lgamma(0.5) + a * F.ln(x) + F.ln(rest) / 2)
    inside = F.when(x < (a + 1) / (a + 2.5), front * _beta_fraction(a, b, x) / a) \
        .otherwise(1 - front * _beta_fraction(b, a, rest) / b)
    known = t.isNotNull() & ~F.isnan(t) & (df > 0)
    return F.when(known & (F.abs(t) == float("inf")), 0.0).when(known & (t == 0), 1.0).when(known, inside)


def chi2_p_value(x: Column) -> Column:
    """P(X >= x) for a chi-square variable with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(x.cast("double"), _number(0)) / 2))
