"""Tail probabilities as column expressions: Student t, F, chi square and normal.

The incomplete beta and gamma functions are continued fractions (and a power series), run by
higher-order functions over a fixed number of terms, so they stay in Spark's own expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Lanczos' approximation of the gamma function, with g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """log of gamma(x), x > 0."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _fraction(first: Column, terms: int, pair) -> Column:
    """1 / (first + n1 / (d1 + n2 / (d2 + ...))) by Lentz's method; pair(i) -> (n_i, d_i)."""
    start = F.struct(_away(first).alias("c"), F.lit(0.0).alias("d"), _away(first).alias("f"))

    def step(acc: Column, i: Column) -> Column:
        n, d = pair(i.cast("double"))
        down = 1 / _away(d + n * acc["d"])
        up = _away(d + n / acc["c"])
        return F.struct(up.alias("c"), down.alias("d"), (acc["f"] * up * down).alias("f"))

    # The first denominator's inverse starts Lentz's recursion at d = 0.
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: 1 / acc["f"])


def _beta_fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    def pair(i: Column) -> tuple[Column, Column]:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 0, even).otherwise(odd), F.lit(1.0)

    return _fraction(F.lit(1.0), terms, pair)


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column, terms: int = 400) -> Column:
    """The regularised incomplete beta function at x; rest: 1 - x, which the caller may know more exactly.

    Right to some 1e-12 while a and b are below 10,000, as the fraction then ends before `terms`.
    """
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(F.greatest(x, F.lit(_TINY))) + b * F.log(F.greatest(rest, F.lit(_TINY))))
    near = x * (a + b + 2) < a + 1
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).when(near, front * _beta_fraction(a, b, x, terms) / a).otherwise(1 - front * _beta_fraction(b, a, rest, terms) / b)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null without degrees of freedom."""
    df = F.when(df > 0, df.cast("double"))
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t), t * t / (df + t * t))


def f_p(f: Column, between: Column, within: Column) -> Column:
    """Upper tail of F."""
    u, v = F.when(between > 0, between.cast("double")), F.when(within > 0, within.cast("double"))
    f = F.greatest(f, F.lit(0.0))
    return incomplete_beta(v / 2, u / 2, v / (v + u * f), u * f / (v + u * f))


def upper_gamma(a: Column, x: Column, terms: int = 200) -> Column:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    front = F.exp(-x + a * F.log(F.greatest(x, F.lit(_TINY))) - log_gamma(a))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] * x / (a + i)).alias("term"), (acc["sum"] + acc["term"] * x / (a + i)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["sum"])
    fraction = _fraction(x + 1 - a, terms, lambda i: (-i * (i - a), x + 1 - a + 2 * i))
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def chi_square_p(x: Column, df: Column | float) -> Column:
    """Upper tail of chi square."""
    df = F.lit(float(df)) if isinstance(df, (int, float)) else df.cast("double")
    return upper_gamma(df / 2, x / 2)


def normal_tail(z: Column) -> Column:
    """The share of a standard normal above z."""
    half = upper_gamma(F.lit(0.5), z * z / 2) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal."""
    return upper_gamma(F.lit(0.5), z * z / 2)


#: A rational approximation of the normal quantile, good to 1.2e-9, in its middle and its tails.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The number below which a standard normal has the share p, 0 < p < 1."""
    q, low = p - 0.5, F.least(p, 1 - p)
    middle = q * _horner(QUANTILE_A, q * q) / _horner(QUANTILE_B, q * q)
    r = F.sqrt(-2 * F.log(F.greatest(low, F.lit(_TINY))))
    tail = _horner(QUANTILE_C, r) / _horner(QUANTILE_D, r)
    return F.when(low >= 0.02425, middle).when(q < 0, tail).otherwise(-tail)
