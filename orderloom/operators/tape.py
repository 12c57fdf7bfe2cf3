"""Time-ordered tapes: runs of one sign, as-of lookups, sums over ranges, realised measures.

Lookups and sums along a tape are done within slices of a key (a quarter of an hour), runs within days, and one
row per slice carries on what later slices need. So a key is sorted in parts; a day of one agent is sorted
in one task, as its runs go along it.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_children(tape: DataFrame, agent: list[str], day: str, time: str, row: str, sign: str, client: str, max_gap: int) -> DataFrame:
    """The tape's rows that belong to runs of one sign by one agent, with _run and _part, which number them in the agent's day.

    A run is maximal over the whole tape. It is dropped as a whole where it crosses midnight or has more than one client,
    then split where more than max_gap lies between neighbours. Rows with sign 0 or NULL break nothing. Times are whole
    numbers in the unit of max_gap.
    """
    rows = tape.filter(F.col(sign).isin(-1, 1))
    w = Window.partitionBy(*agent, day).orderBy(time, row)
    new = F.coalesce((F.col(sign) != F.lag(sign).over(w)).cast("int"), F.lit(1))
    numbered = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    # the day's first and last sign tell whether its outer runs go on in the neighbouring days
    edge = rows.groupBy(*agent, day).agg(
        F.min_by(sign, F.struct(time, row)).alias("_first"), F.max_by(sign, F.struct(time, row)).alias("_last")
    )
    along = Window.partitionBy(*agent).orderBy(day)
    edge = edge.select(
        *agent, day, (F.lag("_last").over(along) == F.col("_first")).alias("_from"), (F.lead("_first").over(along) == F.col("_last")).alias("_on")
    )
    whole = Window.partitionBy(*agent, day, "_run")
    last_run = F.max("_run").over(Window.partitionBy(*agent, day))
    kept = (
        numbered.withColumns({"_runs": last_run, "_c0": F.min(client).over(whole), "_c1": F.max(client).over(whole)})
        .join(edge, [*agent, day])
        .filter(~F.coalesce((F.col("_run") == 1) & F.col("_from"), F.lit(False)))
        .filter(~F.coalesce((F.col("_run") == F.col("_runs")) & F.col("_on"), F.lit(False)))
        .filter("_c0 = _c1")
    )
    inside = Window.partitionBy(*agent, day, "_run").orderBy(time, row)
    part = F.coalesce((F.col(time) - F.lag(time).over(inside) > max_gap).cast("int"), F.lit(0))
    split = kept.withColumn("_gap", part).withColumn("_part", F.sum("_gap").over(inside))
    return split.drop("_new", "_runs", "_c0", "_c1", "_from", "_on", "_first", "_last", "_gap")


def same_sign_runs(
    tape: DataFrame, agent: list[str], day: str, time: str, row: str, sign: str, q: str, client: str, max_gap: int, least: int, duration: int
) -> DataFrame:
    """Metaorders: agent, day, sign, first and last time, n_child, q of the parts of run_children(); parts of fewer than
    least rows or shorter than duration are left out."""
    return (
        run_children(tape, agent, day, time, row, sign, client, max_gap)
        .groupBy(*agent, day, "_run", "_part")
        .agg(F.max(sign).alias(sign), F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n_child"), F.sum(q).alias("q"))
        .filter((F.col("n_child") >= least) & (F.col("last") - F.col("first") >= duration))
        .drop("_run", "_part")
    )


def as_of(tape: DataFrame, targets: DataFrame, key: list[str], time: str, row: str, value: str, slice_of: str, name: str) -> DataFrame:
    """The targets with the tape's last value at or before their time, from any earlier slice; NULL before the first.

    Both have the key columns and time; slice_of is an SQL expression over time. Rows of the tape at equal times are ordered by
    row. Tape rows with a NULL value are passed over. targets must not have the columns _v, _k and _slice.
    """
    t = tape.filter(F.col(value).isNotNull()).select(*key, time, F.col(row).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_k"))
    both = t.unionByName(targets.withColumn("_k", F.lit(1)), allowMissingColumns=True).withColumn("_slice", F.expr(slice_of))
    w = Window.partitionBy(*key, "_slice").orderBy(time, "_k", "_row")
    here = both.withColumn(name, F.last("_v", ignorenulls=True).over(w)).filter("_k = 1").drop("_k", "_row", "_v")
    # the last value of each slice, and the one carried into each slice that has targets
    ends = t.withColumn("_slice", F.expr(slice_of)).groupBy(*key, "_slice").agg(F.max_by("_v", F.struct(time, "_row")).alias("_end"))
    slices = ends.select(*key, "_slice", "_end").unionByName(targets.withColumn("_slice", F.expr(slice_of)).select(*key, "_slice").distinct().withColumn("_end", F.lit(None)))
    per = slices.groupBy(*key, "_slice").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*key, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    return here.join(carry, [*key, "_slice"]).withColumn(name, F.coalesce(name, "_carry")).drop("_slice", "_carry")


def running_sum(tape: DataFrame, key: list[str], time: str, q: str, slice_of: str) -> DataFrame:
    """key, time and total: the sum of q at all times up to and including this one; one row per time."""
    per_time = tape.groupBy(*key, time).agg(F.sum(q).alias("_q")).withColumn("_slice", F.expr(slice_of))
    here = Window.partitionBy(*key, "_slice").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per_time.groupBy(*key, "_slice").agg(F.sum("_q").alias("_all"))
    base = base.select(*key, "_slice", F.coalesce(F.sum("_all").over(before), F.lit(0.0)).alias("_base"))
    return per_time.withColumn("_sum", F.sum("_q").over(here)).join(base, [*key, "_slice"]).select(*key, time, (F.col("_base") + F.col("_sum")).alias("total"))


def last_per_interval(tape: DataFrame, key: list[str], time: str, row: str, value: str, step: int) -> DataFrame:
    """key, interval (time div step) and the last value in it; intervals without rows are left out."""
    return tape.filter(F.col(value).isNotNull()).groupBy(*key, F.expr(f"{time} div {step}").alias("interval")).agg(
        F.max_by(value, F.struct(time, row)).alias(value)
    )


def realised(prices: DataFrame, day: list[str], order: str, price: str) -> DataFrame:
    """day, n_returns, realised volatility and bipower volatility of the log returns within each day; NULL price is left out."""
    w = Window.partitionBy(*day).orderBy(order)
    r = prices.filter(F.col(price) > 0).withColumn("_r", F.ln(price) - F.lag(F.ln(price)).over(w))
    r = r.withColumn("_b", F.abs("_r") * F.abs(F.lag("_r").over(w)))
    return r.groupBy(*day).agg(
        F.count("_r").alias("n_returns"),
        F.sqrt(F.sum(F.col("_r") * F.col("_r"))).alias("realised"),
        F.sqrt(F.sum("_b") * F.lit(1.5707963267948966)).alias("bipower"),
    )


def filled_grid(bars: DataFrame, key: list[str], interval: str, value: str) -> DataFrame:
    """key, interval and value for every interval from the key's first to its last: the last one known where an interval has none.

    key should include the day, so that a grid has a day's intervals.
    """
    span = bars.groupBy(*key).agg(F.min(interval).alias("_a"), F.max(interval).alias("_b"))
    grid = span.select(*key, F.explode(F.sequence("_a", "_b")).alias(interval))
    w = Window.partitionBy(*key).orderBy(interval).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(bars, [*key, interval], "left").withColumn(value, F.last(value, ignorenulls=True).over(w)).select(*key, interval, value)


def realised_kernel(prices: DataFrame, day: list[str], order: str, price: str) -> DataFrame:
    """day, n_returns, variance (sum of squared log returns) and kernel: the variance plus twice the products of returns h apart,
    for h up to H = floor(n ** (2/3)), with Parzen weights of h / H. Days with fewer than three returns are left out.

    prices have a row per interval of a day's grid, so that a day's returns are an array of bounded length.
    """
    w = Window.partitionBy(*day).orderBy(order)
    r = prices.filter(F.col(price) > 0).withColumn("_r", F.ln(price) - F.lag(F.ln(price)).over(w)).filter("_r is not null")
    days = r.groupBy(*day).agg(
        F.count("*").alias("n_returns"), F.sum(F.col("_r") * F.col("_r")).alias("variance"), F.transform(F.sort_array(F.collect_list(F.struct(order, "_r"))), lambda x: x["_r"]).alias("_rs")
    ).filter("n_returns >= 3")
    n = F.col("n_returns").cast("int")
    far = F.floor(F.pow(n.cast("double"), F.lit(2 / 3))).cast("int")

    def at(h):
        u = h / far
        weight = F.when(u <= 0.5, 1 - 6 * u * u + 6 * u * u * u).otherwise(2 * (1 - u) * (1 - u) * (1 - u))
        pairs = F.zip_with(F.slice("_rs", F.lit(1), n - h), F.slice("_rs", h + 1, n - h), lambda a, b: a * b)
        return 2 * weight * F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    cross = F.aggregate(F.transform(F.sequence(F.lit(1), far), at), F.lit(0.0), lambda a, x: a + x)
    return days.select(*day, "n_returns", "variance", (F.col("variance") + cross).alias("kernel"))
