"""Means and correlations from sums, so that one pass and partial aggregation do."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_sums(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """n, sx, sy, sxx, syy and sxy over rows where both are known."""
    both = x.isNotNull() & y.isNotNull()
    of = lambda c: F.coalesce(F.sum(F.when(both, c)), F.lit(0.0))
    return [
        F.count(F.when(both, 1)).alias(f"{prefix}n"),
        of(x).alias(f"{prefix}sx"),
        of(y).alias(f"{prefix}sy"),
        of(x * x).alias(f"{prefix}sxx"),
        of(y * y).alias(f"{prefix}syy"),
        of(x * y).alias(f"{prefix}sxy"),
    ]


def merged_sums(prefix: str = "") -> list[Column]:
    return [F.sum(f"{prefix}{c}").alias(f"{prefix}{c}") for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]


def correlation(least: int = 3, prefix: str = "") -> Column:
    """Pearson's r from pair_sums; NULL below least rows or where a side is constant (up to rounding)."""
    c = lambda k: F.col(f"{prefix}{k}").cast("double")
    vx = c("n") * c("sxx") - c("sx") * c("sx")
    vy = c("n") * c("syy") - c("sy") * c("sy")
    flat = (vx <= 1e-10 * c("n") * c("sxx")) | (vy <= 1e-10 * c("n") * c("syy"))
    r = (c("n") * c("sxy") - c("sx") * c("sy")) / F.sqrt(vx * vy)
    return F.when((c("n") >= least) & ~flat & (vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


# The same as SQL over x and y, for a group of rows.
def correlation_sql(x: str, y: str, least: int = 3) -> str:
    ok = f"({x}) is not null and ({y}) is not null"
    f = lambda e: f"sum({e}) filter ({ok})"
    n = f"count(*) filter ({ok})"
    vx, vy = f"({n} * {f(f'({x})*({x})')} - {f(x)} * {f(x)})", f"({n} * {f(f'({y})*({y})')} - {f(y)} * {f(y)})"
    return (
        f"case when {n} >= {least} and {vx} > 1e-10 * {n} * {f(f'({x})*({x})')} and {vy} > 1e-10 * {n} * {f(f'({y})*({y})')} "
        f"then ({n} * {f(f'({x})*({y})')} - {f(x)} * {f(y)}) / sqrt({vx} * {vy}) end"
    )
