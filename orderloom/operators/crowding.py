"""Signed-volume imbalance of others: of a cell without oneself, of another group, of one's own clients."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leave_one_out(rows: DataFrame, cell: list[str], q: str, direction: str, name: str = "imbalance") -> DataFrame:
    """Adds the signed share of the others' volume in the cell; NULL where the others have none.

    Totals of a cell come from an aggregate that is joined back, not from a window: so a cell of any number of rows is
    added up in parts. Rows with NULL q or direction have and give none. NULL keys are a cell of their own.
    """
    signed = F.col(q) * F.col(direction)
    known = F.col(q).isNotNull() & F.col(direction).isNotNull()
    total = rows.filter(known).groupBy(*cell).agg(F.sum(signed).alias("_s"), F.sum(q).alias("_q"))
    right = total.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)], "_s", "_q")
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cell)]
    rest = F.col("_q") - F.col(q)
    value = F.when(known & (rest > 1e-9 * F.col("_q")), (F.col("_s") - signed) / rest)
    return rows.join(right, on, "left").withColumn(name, value).drop("_s", "_q", *[f"_k{i}" for i in range(len(cell))])


def environment(rows: DataFrame, cell: list[str], q: str, direction: str, where: Column, name: str) -> DataFrame:
    """One row per cell: the signed share of the volume of the rows that satisfy where."""
    return (
        rows.filter(where)
        .groupBy(*cell)
        .agg(F.try_divide(F.sum(F.col(q) * F.col(direction)), F.sum(q)).alias(name))
    )


def demeaned(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Adds COLUMN_within: the column less its mean in the group. Means come from an aggregate that is joined back, so a
    group of any number of rows is added up in parts. NULL is a group of its own."""
    means = rows.groupBy(F.col(by).alias("_by")).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    joined = rows.join(means, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.withColumns({f"{c}_within": F.col(c) - F.col(f"_mean_{c}") for c in columns}).drop("_by", *[f"_mean_{c}" for c in columns])
