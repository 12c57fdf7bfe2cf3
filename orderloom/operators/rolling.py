"""Totals over trailing days, days without activity included."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(
    rows: DataFrame,
    entity: list[str],
    day: str,
    daily: dict[str, Column],
    lengths: Sequence[int] = (7, 30),
    tail_days: int = 6,
    whole: bool = False,
) -> DataFrame:
    """Entity columns, day, each name in daily, and NAME_total_Nd and NAME_avg_Nd for each length N.

    The rows are aggregated per entity and day by the aggregates in daily, each entity gets every calendar day from
    its first day to tail_days after its last (whole: from the first day of all rows to their last, or to where its
    longest window has run out if that is later), and windows add up the fixed number of preceding rows. Days without
    rows count as 0 in totals and averages; an average divides by N even where fewer days lie behind. Rows with a
    NULL in an entity column or the day are left out; a NULL aggregate counts as 0. An empty table gives no row.
    day is a date column; entity columns and names must not clash.
    """
    per_day = (
        rows.withColumn("_day", F.col(day).cast("date"))
        .dropna(subset=[*entity, "_day"])
        .groupBy(*entity, "_day")
        .agg(*[c.alias(n) for n, c in daily.items()])
    )
    spans = per_day.groupBy(*entity).agg(F.min("_day").alias("_from"), F.max("_day").alias("_to"))
    if whole:
        bounds = per_day.agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
        tail_days = max(lengths) - 1
        until = F.greatest(F.date_add("_to", tail_days), "_last")
        spans = spans.crossJoin(F.broadcast(bounds)).select(*entity, F.col("_first").alias("_from"), F.date_sub(until, tail_days).alias("_to"))
    calendar = (
        spans.select(*entity, F.explode(F.sequence("_from", F.date_add("_to", tail_days), F.expr("interval 1 day"))).alias("_day"))
    )
    dense = calendar.join(per_day, [*entity, "_day"], "left").fillna(0, subset=list(daily))
    out = [*entity, F.col("_day").alias(day), *daily]
    for n in lengths:
        w = Window.partitionBy(*entity).orderBy("_day").rowsBetween(1 - n, 0)
        for name in daily:
            out += [F.sum(name).over(w).alias(f"{name}_total_{n}d"), (F.sum(name).over(w) / n).alias(f"{name}_avg_{n}d")]
    return dense.select(*out)
