"""Continuous periods and gaps of intervals, by independently ranked starts and ends.

Sorted apart from each other, the i-th start and the i-th end of an entity tell
where its cover breaks: exactly where start i+1 exceeds end i. A break pairs the
end before it with the start after it.

So that no entity has to be sorted in one task, its intervals are dealt to slices
of time by their start and ranked within each slice; per slice only one row, the
furthest end, is carried on to the later ones.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.times import floor_div
from orderloom.sources.tables import written

SLICE_US = 900_000_000


def periods_and_gaps(intervals: DataFrame, entity: list[str], start: str, end: str, slice_us: int = SLICE_US) -> DataFrame:
    """kind ("period" or "gap"), entity columns, from_us, to_us: the longest continuous stretches and what lies between.

    Intervals that meet in a point are joined; those of length zero count. Rows with a NULL in an entity column, the
    start or the end, or that end before they start, are left out. Ties and repeated rows change nothing; an empty
    table gives no row. start and end are whole numbers (microseconds) in columns of any name; entity columns must
    not be named kind, from_us or to_us.
    """
    rows = (
        intervals.select(*entity, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
        .dropna()
        .filter("_e >= _s")
        .withColumn("_slice", floor_div(F.col("_s"), slice_us))
    )
    own = [*entity, "_slice"]
    by = Window.partitionBy(*own)
    starts = rows.select(*own, "_s", F.row_number().over(by.orderBy("_s")).alias("_i"))
    ends = rows.select(*own, "_e", (F.row_number().over(by.orderBy("_e")) + 1).alias("_i"))
    # the (i-1)th end beside the i-th start; the first start has none, the last end no start
    pairs = starts.join(ends, [*own, "_i"], "full_outer")
    # few rows are left here; they are written, as they are used three times
    breaks = written(pairs.filter("_s is null or _e is null or _s > _e"), "breaks")

    reach = breaks.filter("_s is null").select(*own, F.col("_e").alias("_reach"))
    before = Window.partitionBy(*entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = reach.select(*own, F.max("_reach").over(before).alias("_carried"))
    # where a period begins: _prior is the end of the period before it (NULL before the entity's first)
    begins = (
        breaks.filter("_s is not null")
        .join(carried, own)
        .select(*own, "_s", F.greatest("_e", "_carried").alias("_prior"))
        .filter("_prior is null or _s > _prior")
    )
    # a period's end is the _prior of the next one's begin: within the slice, else of a later slice's first begin
    here = by.orderBy("_s")
    lead = begins.select(*own, "_s", "_prior", F.lead("_prior").over(here).alias("_to"), F.row_number().over(here).alias("_k"))
    firsts = begins.groupBy(*own).agg(F.min_by("_prior", "_s").alias("_first_prior"))
    later = Window.partitionBy(*entity).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    close = (
        reach.join(firsts, own, "left")
        .select(
            *own,
            F.coalesce(
                F.last("_first_prior", ignorenulls=True).over(later),
                F.max("_reach").over(Window.partitionBy(*entity)),
            ).alias("_last_to"),
        )
    )
    found = lead.join(close, own).select(*entity, "_s", "_prior", F.coalesce("_to", "_last_to").alias("_to"))
    each = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("from_us"), F.col("_to").alias("to_us")),
        F.struct(F.lit("gap").alias("kind"), F.col("_prior").alias("from_us"), F.col("_s").alias("to_us")),
    )
    return (
        found.select(*entity, F.inline(each))
        .filter("from_us is not null")
        .select("kind", *entity, "from_us", "to_us")
    )
