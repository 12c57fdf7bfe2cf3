"""Four ways to put values into bins; they differ at the edges and are never mixed.

Edges are literals: they come from an aggregate that runs first, so that every row
meets the same numbers.
"""

from collections.abc import Sequence
from math import floor, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.operators.ranks import quantiles


def log_edges(low: float, high: float, n: int) -> list[float]:
    """n + 1 edges, equal steps in log10."""
    a, b = log10(low), log10(high)
    return [10 ** (a + (b - a) * k / n) for k in range(n + 1)]


def even_edges(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * k / n for k in range(n + 1)]


def quantile_edges(df: DataFrame, value: str, n: int, merge: bool = True) -> list[float]:
    """Exact quantiles (linear between ranks) at 0, 1/n, ..., 1; equal ones merged, or an error where merge is off."""
    first = quantiles(df, [], [value], [k / n for k in range(n + 1)]).first()
    got = first[f"q_{value}"] if first else []
    edges = sorted(set(got))
    if len(edges) < len(got) and not merge:
        raise ValueError(f"{value}: quantiles coincide")
    return edges


def _below(x: Column, edges: Sequence[float], inclusive: bool) -> Column:
    """Number of edges below x (inclusive: at most x)."""
    e = F.array(*[F.lit(float(v)) for v in edges])
    return F.size(F.filter(e, (lambda v: v <= x) if inclusive else (lambda v: v < x)))


def bin_left(x: Column, edges: Sequence[float]) -> Column:
    """[a, b): the highest edge itself is outside. NULL outside."""
    k = _below(x, edges, True) - 1
    return F.when((k >= 0) & (k < len(edges) - 1), k)


def bin_right(x: Column, edges: Sequence[float]) -> Column:
    """(a, b], the lowest edge in the first bin. NULL outside."""
    k = _below(x, edges, False) - 1
    k = F.when(x == edges[0], 0).otherwise(k)
    return F.when((k >= 0) & (x <= edges[-1]), k)


def bin_left_closed(x: Column, edges: Sequence[float]) -> Column:
    """[a, b), the highest edge in the last bin. NULL outside."""
    k = F.least(_below(x, edges, True) - 1, F.lit(len(edges) - 2))
    return F.when((k >= 0) & (x <= edges[-1]), k)


def session_bin(minutes: Column, length: float, width: float) -> Column:
    """Bin of minutes since the opening in a session of this length; the close belongs to the last bin. NULL outside."""
    last = floor((length - 1e-9) / width)
    k = F.least(F.floor(minutes / width).cast("int"), F.lit(last))
    return F.when((minutes >= 0) & (minutes <= length), k)


def session_bins(df_like, length: int, width: int, open_minute: int) -> DataFrame:
    """The bins of a session: bin, label "HH:MM-HH:MM"; the last one may be short."""
    a = F.lit(open_minute) + F.col("bin") * width
    b = F.least(a + width, F.lit(open_minute + length))
    label = lambda m: F.format_string("%02d:%02d", (m / 60).cast("int"), (m % 60).cast("int"))
    many = floor((length - 1e-9) / width) + 1
    return df_like.sparkSession.range(many).select(F.col("id").cast("int").alias("bin")).withColumn(
        "label", F.concat(label(a), F.lit("-"), label(b))
    )
