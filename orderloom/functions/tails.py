"""Tails of the normal and Student's t distribution."""

from math import exp, inf, lgamma, log, log1p, nan

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a rational-exponential fit of erfc, with a relative error of at most 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_normal(z: Column) -> Column:
    """Odds that a standard normal lies at least |z| from 0."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    return t * F.exp(poly - x * x)


def two_sided_normal_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::double))"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = f"{ERFC[-1]!r}::double"
    for c in ERFC[-2::-1]:
        poly = f"({c!r}::double + {t} * {poly})"
    return f"({t} * exp({poly} - {x} * {x}))"


def t_two_sided(t: float, df: float) -> float:
    """Odds that Student's t with df degrees of freedom lies at least |t| from 0."""
    if not df > 0 or t != t:
        return nan
    return _beta_share(df / (df + t * t), df / 2, 0.5) if abs(t) < inf else 0.0


def t_quantile(p: float, df: float) -> float:
    """The value that Student's t stays below with odds of p."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def welch_df(var_a: float, df_a: float, var_b: float, df_b: float) -> float:
    """Degrees of freedom of a difference of two estimates with these variances."""
    below = var_a * var_a / df_a + var_b * var_b / df_b
    return (var_a + var_b) ** 2 / below if below > 0 else nan


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    # continued fraction, evaluated from its tail
    depth, value = 300, 0.0
    for m in range(depth, 0, -1):
        k = m // 2
        top = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        value = top / (1 + value)
    return front / (1 + value)
