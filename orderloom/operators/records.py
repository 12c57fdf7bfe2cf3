"""Records of metaorders: what they traded, what the market did meanwhile, and the price's path during and after them."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.operators import tape as ops

SLICE = "t div 900000000"


def records(tape: DataFrame, children: DataFrame, order: list[str], daily: DataFrame) -> DataFrame:
    """One row per metaorder: order, sign, client, first, last, n_child, q, p0, p1 (first and last child's price), price_change
    (of logs), volume (of the market from first to last, both included), daily_vol, q_over_v, vt_over_v, participation and
    impact (price change in the metaorder's direction over the day's volatility).

    tape and children have isin, day, t, row_id, sign, q and price, children client and the order's columns too; daily has
    isin, day, daily_vol and daily_volume. What needs a price or volume that is NULL or not positive is NULL.
    """
    at = F.struct("t", "row_id")
    meta = children.groupBy(*order).agg(
        F.max("sign").alias("sign"), F.max_by("client", at).alias("client"), F.min("t").alias("first"), F.max("t").alias("last"),
        F.count("*").alias("n_child"), F.sum("q").alias("q"), F.min_by("price", at).alias("p0"), F.max_by("price", at).alias("p1"),
    )
    total = ops.running_sum(tape, ["isin"], "t", "q", SLICE).withColumn("row", F.lit(0))
    ends = F.array(F.struct((F.col("first") - 1).alias("t"), F.lit(-1).alias("s")), F.struct(F.col("last").alias("t"), F.lit(1).alias("s")))
    upto = ops.as_of(total, meta.select(*order, F.inline(ends)), ["isin"], "t", "row", "total", SLICE, "upto")
    volume = upto.groupBy(*order).agg(F.sum(F.col("s") * F.coalesce("upto", F.lit(0.0))).alias("volume"))
    change = F.when((F.col("p0") > 0) & (F.col("p1") > 0), F.ln("p1") - F.ln("p0"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return (
        meta.join(volume, order)
        .join(daily, ["isin", "day"], "left")
        .withColumns({"price_change": change, "q_over_v": ratio("q", "daily_volume"), "vt_over_v": ratio("volume", "daily_volume"), "participation": ratio("q", "volume")})
        .withColumn("impact", _impact(F.col("p1")))
        .drop("daily_volume")
    )


def _impact(price: Column) -> Column:
    """Of a price against the metaorder's first, in its direction and in units of the day's volatility."""
    return F.when((price > 0) & (F.col("p0") > 0) & (F.col("daily_vol") > 0), (F.ln(price) - F.ln("p0")) * F.col("sign") / F.col("daily_vol"))


def partial_path(record: DataFrame, children: DataFrame, order: list[str]) -> DataFrame:
    """order, k (from 0) and impact at each child: the children joined to their record."""
    each = children.groupBy(*order).agg(F.sort_array(F.collect_list(F.struct("t", "row_id", "price"))).alias("_all")).select(*order, F.posexplode("_all").alias("k", "_c"))
    return each.join(record.select(*order, "p0", "sign", "daily_vol"), order).select(*order, "k", _impact(F.col("_c.price")).alias("impact"))


def after_path(tape: DataFrame, record: DataFrame, order: list[str], offsets: Column, name: str = "k") -> DataFrame:
    """order, k (from 0) and impact at the record's last time plus each of the offsets (an array in microseconds), by the
    tape's last price at or before it."""
    want = record.select(*order, "p0", "sign", "daily_vol", F.posexplode(offsets).alias(name, "_o"), "last").withColumn("t", F.col("last") + F.col("_o")).drop("_o", "last")
    found = ops.as_of(tape, want, ["isin"], "t", "row_id", "price", SLICE, "_price")
    return found.select(*order, name, _impact(F.col("_price")).alias("impact"))


def even_offsets(samples: int, multiplier: float) -> Column:
    """So many offsets in equal steps from 0 to the record's duration times the multiplier, whole microseconds."""
    length = (F.col("last") - F.col("first")) * F.lit(float(multiplier))
    return F.array(*[F.floor(length * (k / (samples - 1))).cast("bigint") for k in range(samples)])


def interpolated(partial: DataFrame, after: DataFrame, order: list[str], grid: Sequence[float], multiplier: float) -> DataFrame:
    """order, g (number of the grid's point) and impact on the line through the children's impacts, evenly spaced over [0, 1],
    and those after them, evenly spaced over [1, 1 + multiplier]; at 1 the last child's counts.

    Paths with a NULL impact or fewer than two points are left out.
    """
    path = lambda df, name: df.groupBy(*order).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "impact"))), lambda x: x["impact"]).alias(name), F.count_if(F.col("impact").isNull()).alias(f"_bad{name}")
    )
    both = path(partial, "_p").join(path(after, "_a"), order).filter("_bad_p = 0 and _bad_a = 0 and size(_p) + size(_a) > 2")
    last = F.element_at("_p", -1)
    tail = F.concat(F.array(last), F.slice("_a", F.lit(2), F.greatest(F.size("_a") - 1, F.lit(0))))

    def at(values: Column, x: Column) -> Column:
        i = F.least(F.floor(x).cast("int"), F.greatest(F.size(values) - 2, F.lit(0)))
        a = F.element_at(values, i + 1)
        return F.when(F.size(values) < 2, a).otherwise(a + (F.element_at(values, i + 2) - a) * (x - i))

    points = [
        F.struct(F.lit(g).alias("g"), (at(F.col("_p"), F.lit(float(x)) * (F.size("_p") - 1)) if x <= 1 else at(F.col("_t"), F.lit((x - 1) / multiplier) * (F.size("_t") - 1))).alias("impact"))
        for g, x in enumerate(grid)
    ]
    return both.withColumn("_t", tail).select(*order, F.inline(F.array(*points)))
