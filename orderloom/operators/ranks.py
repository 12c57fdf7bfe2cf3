"""Ranks, quantiles and cumulative shares over all rows, without sorting them in one task."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_ranks(rows: DataFrame, key: list[str], value: str, slice_of: str) -> DataFrame:
    """key, value, n (rows of the value), upto (rows of at most the value) and rank (their mean rank, from 1).

    slice_of is an SQL expression over the value that never falls as it grows: its slices are ranked apart, and added up.
    Rows with a NULL value are left out; NULL keys are a key of their own.
    """
    per = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n")).withColumn("_slice", F.expr(slice_of))
    base = per.groupBy(*key, "_slice").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    on = [F.col("_slice").eqNullSafe(F.col("_s")), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]]
    w = Window.partitionBy(*key, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_base") + F.col("_sum")
    return (
        per.withColumn("_sum", F.sum("n").over(w))
        .join(base, on)
        .select(*key, value, "n", upto.alias("upto"), (upto - (F.col("n") - 1) / 2.0).alias("rank"))
    )


# A slice of every 1/256 of an octave, on both sides of 0: never falls as the value grows.
_SLICE = "cast(signum({0}) * floor(256 * log2(1 + abs({0}) * 1e9)) as int)"


def quantiles(rows: DataFrame, key: list[str], values: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Per key: n_VALUE and q_VALUE of each value column, its exact quantiles (linear between ranks) in order of the probabilities.

    Counts per slice of the values tell in which slices the wanted ranks lie; only the rows of these slices are sorted,
    each slice apart. So no task gets all values of a key. NULL and NaN are left out; a key without any value
    of a column has NULLs there; NULL keys are a key of their own; no rows give no row, without a key too.
    """
    one = F.array(*[F.struct(F.lit(v).alias("_metric"), F.col(v).cast("double").alias("_x")) for v in values])
    long = rows.select(*key, F.inline(one)).filter("_x is not null and not isnan(_x)").withColumn("_slice", F.expr(_SLICE.format("_x")))
    by = [*key, "_metric"]
    per = long.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    upto = F.sum("_n").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumns({"_upto": upto, "_all": F.sum("_n").over(w)})
    # ranks from 1: those on both sides of the wanted place
    place = [(F.col("_all") - 1) * p + 1 for p in probabilities]
    wanted = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), f(x).cast("bigint").alias("_rank")) for i, x in enumerate(place) for j, f in enumerate((F.floor, F.ceil))])
    targets = per.select(*by, "_slice", "_n", "_upto", "_all", F.inline(wanted)).filter("_rank > _upto - _n and _rank <= _upto").withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n"))
    slices = targets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_slice"])]).distinct()
    kept = long.join(slices, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_slice"])], "left_semi")
    nth = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_x")).cast("bigint"))
    nth = nth.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_slice", "_rank"])], "_x")
    found = targets.join(nth, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_slice", "_rank"])])
    at = lambda v, i, j: F.max(F.when((F.col("_metric") == v) & (F.col("_i") == i) & (F.col("_j") == j), F.col("_x")))
    out = []
    for v in values:
        n = F.max(F.when(F.col("_metric") == v, F.col("_all")))
        share = [(n - 1) * p + 1 - F.floor((n - 1) * p + 1) for p in probabilities]
        low, high = ([at(v, i, j) for i in range(len(probabilities))] for j in (0, 1))
        out += [F.coalesce(n, F.lit(0)).alias(f"n_{v}"), F.array(*[a + (b - a) * f for a, b, f in zip(low, high, share)]).alias(f"q_{v}")]
    return found.groupBy(*key).agg(*out) if key else found.agg(*out).filter(" or ".join(f"n_{v} > 0" for v in values))
