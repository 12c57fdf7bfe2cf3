"""How metaorders are executed over their time: shares of volume, cumulative curves, paths of the price."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(children: DataFrame, order: list[str], time: str, row: str, q: str) -> DataFrame:
    """Children with tau (elapsed share of the time, 0 to 1; by rank where no time passes) and share (of the volume)."""
    w = Window.partitionBy(*order)
    n, k = F.count("*").over(w), F.row_number().over(Window.partitionBy(*order).orderBy(time, row))
    span = F.max(time).over(w) - F.min(time).over(w)
    by_rank = F.when(n > 1, (k - 1) / (n - 1)).otherwise(0.0)
    tau = F.when(span > 0, (F.col(time) - F.min(time).over(w)) / span).otherwise(by_rank)
    return children.withColumns({"tau": tau, "share": F.try_divide(F.col(q), F.sum(q).over(w))})


def shape(children: DataFrame, order: list[str]) -> DataFrame:
    """Per metaorder: share of the first and last quarter and first half, centre of volume and concentration (sum of squared shares)."""
    part = lambda where: F.coalesce(F.sum(F.when(where, F.col("share"))), F.lit(0.0))
    return children.groupBy(*order).agg(
        part(F.col("tau") <= 0.25).alias("front25"),
        part(F.col("tau") <= 0.5).alias("front50"),
        part(F.col("tau") >= 0.75).alias("back25"),
        F.sum(F.col("tau") * F.col("share")).alias("centre"),
        F.sum(F.col("share") * F.col("share")).alias("hhi"),
    )


def curve_points(children: DataFrame, order: list[str], grid: int) -> DataFrame:
    """order, k and filled: the cumulative share at tau = k / grid, linear between children and from (0, 0) to (1, 1).

    Each stretch between neighbouring children makes the grid points in it, so that no child meets all points.
    Of children at one tau the last sum counts.
    """
    per = children.groupBy(*order, "tau").agg(F.sum("share").alias("share"))
    w = Window.partitionBy(*order).orderBy("tau")
    filled = per.withColumn("y", F.least(F.lit(1.0), F.sum("share").over(w)))
    steps = filled.withColumns({"tau_next": F.coalesce(F.lead("tau").over(w), F.lit(1.0)), "y_next": F.coalesce(F.lead("y").over(w), F.lit(1.0)), "first": F.lag("tau").over(w).isNull()})
    part = F.struct(F.col("tau").alias("a"), F.col("y").alias("ya"), F.col("tau_next").alias("b"), F.col("y_next").alias("yb"))
    head = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("ya"), F.col("tau").alias("b"), F.col("y").alias("yb"))
    each = F.when(F.col("first") & (F.col("tau") > 0), F.array(head, part)).otherwise(F.array(part))
    seg = steps.select(*order, F.inline(each)).filter("a < b")
    lo, hi = F.ceil(F.col("a") * grid - 1e-9).cast("int"), (F.ceil(F.col("b") * grid - 1e-9) - 1).cast("int")
    last = F.when(F.col("b") >= 1.0, F.lit(grid)).otherwise(hi)
    points = seg.withColumn("_last", last).withColumn("_lo", lo).filter("_lo <= _last")
    points = points.select(*order, "a", "ya", "b", "yb", F.explode(F.sequence("_lo", "_last")).alias("k"))
    t = F.col("k") / grid
    y = F.col("ya") + (F.col("yb") - F.col("ya")) * (t - F.col("a")) / (F.col("b") - F.col("a"))
    return points.select(*order, "k", y.alias("filled"))
