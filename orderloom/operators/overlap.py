"""What is active while an interval runs, without pairs.

The time-weighted volume that overlaps [s, e] is the integral from s to e of the volume that is active. It is added up
from running sums over the boundaries of all intervals: one sort of the boundaries replaces the join of all pairs, and
any class of others (a direction, a group) has sums of its own. A cell is sorted in slices of a quarter of an hour; per
slice one row carries on the sums before it, so no cell, however hot, is sorted in one task. Times count from the start
of their slice, and an integral over parts of slices is never the difference of two long ones.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_US = 900_000_000
SLICE_S = SLICE_US / 1e6


def _slice(t: Column) -> Column:
    return F.floor(t / SLICE_US).cast("bigint")


def _swept(bounds: DataFrame, cell: list[str], upto: dict[str, Column], before: dict[str, Column], flows: dict[str, Column]) -> DataFrame:
    """Adds the running sums of upto (over all times up to the row's own) and before (over earlier times) in the cell; and for
    each of flows, what it is added up to as a rate: NAME_in, its integral from the slice's start to the row's time, NAME_all,
    that to the start of the next slice, NAME_from and NAME_to, those of all slices before this and before the next one.

    bounds has t in microseconds; flows are changes of a rate at t. NULL counts as 0.
    """
    start = F.col("_slice") * SLICE_US
    b = bounds.withColumn("_slice", _slice(F.col("t"))).withColumn("_t", (F.col("t") - start) / 1e6)
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    sums = {**upto, **before}
    b = b.withColumns({f"_x_{n}": zero(c) for n, c in {**sums, **flows}.items()})
    per = b.groupBy(*cell, "_slice").agg(
        *[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in {**sums, **flows}], *[F.sum(F.col(f"_x_{n}") * (SLICE_S - F.col("_t"))).alias(f"_g_{n}") for n in flows]
    )
    along = Window.partitionBy(*cell).orderBy("_slice")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.lead("_slice").over(along), F.col("_slice") + 1) - F.col("_slice") - 1
    per = per.select(
        *cell, "_slice", *[zero(F.sum(f"_s_{n}").over(earlier)).alias(f"_c_{n}") for n in sums], *[zero(F.sum(f"_s_{n}").over(earlier)).alias(f"_r_{n}") for n in flows],
        *[f"_s_{n}" for n in flows], *[f"_g_{n}" for n in flows], ahead.alias("_ahead"),
    )
    # the integral from a slice's start to the next one's, slices without boundaries between them included
    whole = {n: F.col(f"_r_{n}") * SLICE_S + F.col(f"_g_{n}") + (F.col(f"_r_{n}") + F.col(f"_s_{n}")) * F.col("_ahead") * SLICE_S for n in flows}
    per = per.select(*cell, "_slice", *[f"_c_{n}" for n in sums], *[f"_r_{n}" for n in flows], *[c.alias(f"{n}_all") for n, c in whole.items()])
    per = per.select(
        *per.columns, *[zero(F.sum(f"{n}_all").over(earlier)).alias(f"{n}_from") for n in flows],
        *[F.sum(f"{n}_all").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{n}_to") for n in flows],
    )
    here = Window.partitionBy(*cell, "_slice").orderBy("t")
    now, past = here.rangeBetween(Window.unboundedPreceding, 0), here.rangeBetween(Window.unboundedPreceding, -1)
    joined = b.join(per, [*cell, "_slice"])
    local = {n: F.col(f"_c_{n}") + F.sum(f"_x_{n}").over(now) for n in upto}
    local |= {n: F.col(f"_c_{n}") + zero(F.sum(f"_x_{n}").over(past)) for n in before}
    local |= {f"{n}_in": F.col(f"_r_{n}") * F.col("_t") + F.col("_t") * F.sum(f"_x_{n}").over(now) - F.sum(F.col(f"_x_{n}") * F.col("_t")).over(now) for n in flows}
    keep = [c for c in joined.columns if not c.startswith(("_x_", "_c_", "_r_"))]
    return joined.select(*keep, *[c.alias(n) for n, c in local.items()])


def active_volume(rows: DataFrame, cell: list[str], key: str, start: str, end: str, q: str, classes: dict[str, Column]) -> DataFrame:
    """Per row: key, and for each class NAME_volume (time-weighted volume of the others of the class that is active while
    the row is, as a mean over the row's time) and NAME_count (others of the class that share some time with it).

    A row of length zero gets what is active at that instant. Rows with NULL or reversed times or a NULL q or key are left
    out and count nowhere; so are rows with a NULL in the cell. Columns are whole numbers for times (microseconds) and a
    double for q; key is unique. Others that only touch an end of a row don't count for it, except for rows of length zero.
    """
    own = rows.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start)) & F.col(q).isNotNull() & F.col(key).isNotNull()).dropna(subset=cell)
    flags = [f"_in_{n}" for n in classes]
    base = own.select(
        *cell, F.col(key).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(q).alias("_q"),
        *[F.coalesce(c, F.lit(False)).alias(f) for f, c in zip(flags, classes.values())],
    )
    # one row per boundary
    ends = F.array(F.struct(F.col("_s").alias("t"), F.lit(0).alias("k")), F.struct(F.col("_e").alias("t"), F.lit(1).alias("k")))
    bounds = base.select(*cell, "_id", "_q", (F.col("_e") > F.col("_s")).alias("_long"), ((F.col("_e") - F.col("_s")) / 1e6).alias("_length"), *flags, F.inline(ends))
    upto, before, flows = {}, {}, {}
    for n, f in zip(classes, flags):
        on, begun = F.col(f), F.col("k") == 0
        flows[n] = F.when(on, F.when(begun, F.col("_q")).otherwise(-F.col("_q")))
        upto |= {f"bq_{n}": F.when(on & begun, F.col("_q")), f"bn_{n}": (on & begun).cast("int"), f"el_{n}": (on & ~begun & F.col("_long")).cast("int")}
        before |= {f"eq_{n}": F.when(on & ~begun, F.col("_q")), f"en_{n}": (on & ~begun).cast("int"), f"bl_{n}": (on & begun & F.col("_long")).cast("int")}
    swept = _swept(bounds, cell, upto, before, flows)
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    point, one_slice = ~F.max("_long"), at("_slice", 0) == at("_slice", 1)
    out = []
    for n, f in zip(classes, flags):
        self_q, self_n = F.max(F.when(F.col(f), F.col("_q")).otherwise(0.0)), F.max(F.col(f).cast("int"))
        apart = (at(f"{n}_all", 0) - at(f"{n}_in", 0)) + (at(f"{n}_from", 1) - at(f"{n}_to", 0)) + at(f"{n}_in", 1)
        mean = F.when(one_slice, at(f"{n}_in", 1) - at(f"{n}_in", 0)).otherwise(apart) / F.max("_length")
        count = F.when(point, at(f"bn_{n}", 0) - at(f"en_{n}", 0)).otherwise(at(f"bl_{n}", 1) - at(f"el_{n}", 0))
        out += [
            (F.when(point, at(f"bq_{n}", 0) - at(f"eq_{n}", 0)).otherwise(mean) - self_q).alias(f"{n}_volume"),
            (count - self_n).cast("bigint").alias(f"{n}_count"),
        ]
    return swept.groupBy(*cell, F.col("_id").alias(key)).agg(*out)


def neighbours(rows: DataFrame, cell: list[str], time: str, sign: str, window_us: int) -> DataFrame:
    """Adds same_before, same_after, opposite_before and opposite_after: others of the cell whose time lies within the window
    before or after, of the same or the other sign; those at the very same time count in neither.

    A cell is worked on in slices of four windows, to which rows near their edges are lent. Rows with a NULL time are left
    out.
    """
    length = 4 * window_us
    of_slice = lambda t: F.floor(t / length).cast("bigint")
    slices = F.sequence(of_slice(F.col(time) - window_us), of_slice(F.col(time) + window_us))
    lent = rows.filter(F.col(time).isNotNull()).withColumn("_slice", F.explode(slices))
    by = Window.partitionBy(*cell, "_slice").orderBy(time)
    before, after = by.rangeBetween(-window_us, -1), by.rangeBetween(1, window_us)
    plus = F.when(F.col(sign) == 1, 1)
    minus = F.when(F.col(sign) == -1, 1)
    of = lambda c, w: F.count(c).over(w)
    mine = F.col(sign) == 1
    counted = lent.withColumns(
        {
            f"{kind}_{side}": F.when(mine if kind == "same" else ~mine, of(plus, w)).otherwise(of(minus, w))
            for kind in ("same", "opposite")
            for side, w in (("before", before), ("after", after))
        }
    )
    return counted.filter(F.col("_slice") == of_slice(F.col(time))).drop("_slice")


def binned_neighbours(rows: DataFrame, cell: list[str], time: str, sign: str, actor: str, width_us: int, bins: int) -> DataFrame:
    """One row per row and bin: the row's columns, bin (from -bins to -1 before, from 1 to bins after), same and opposite: how
    many of the cell's other rows of other actors have their time in the bin, by whether their sign is the row's.

    Bin -k is [t - k widths, t - (k - 1) widths), bin k is (t + (k - 1) widths, t + k widths]; those at the very same time are in
    none. Rows of a NULL actor are of one actor. A cell is worked on in slices of four reaches, to which rows near their
    edges are lent. Rows with a NULL time or a sign other than 1 and -1 are left out.
    """
    reach = width_us * bins
    length = 4 * reach
    of_slice = lambda t: F.floor(t / length).cast("bigint")
    own = rows.filter(F.col(time).isNotNull() & F.col(sign).isin(-1, 1))
    lent = own.withColumn("_slice", F.explode(F.sequence(of_slice(F.col(time) - reach), of_slice(F.col(time) + reach))))
    everyone, oneself = Window.partitionBy(*cell, "_slice").orderBy(time), Window.partitionBy(*cell, "_slice", actor).orderBy(time)
    frames = {-k: (-k * width_us, -(k - 1) * width_us - 1) for k in range(bins, 0, -1)} | {k: ((k - 1) * width_us + 1, k * width_us) for k in range(1, bins + 1)}
    plus, minus = F.when(F.col(sign) == 1, 1), F.when(F.col(sign) == -1, 1)
    counts = {}
    for k, (a, b) in frames.items():
        others = lambda c: F.count(c).over(everyone.rangeBetween(a, b)) - F.count(c).over(oneself.rangeBetween(a, b))  # noqa: B023, E731
        counts[f"_u{k + bins}"], counts[f"_d{k + bins}"] = others(plus), others(minus)
    counted = lent.withColumns(counts).filter(F.col("_slice") == of_slice(F.col(time)))
    up = F.col(sign) == 1
    each = [
        F.struct(
            F.lit(k).alias("bin"),
            F.when(up, F.col(f"_u{k + bins}")).otherwise(F.col(f"_d{k + bins}")).alias("same"),
            F.when(up, F.col(f"_d{k + bins}")).otherwise(F.col(f"_u{k + bins}")).alias("opposite"),
        )
        for k in frames
    ]
    return counted.select(*rows.columns, F.inline(F.array(*each)))


def lead_lag(rows: DataFrame, cell: list[str], key: str, start: str, end: str, q: str, mine: Column, other: Column) -> DataFrame:
    """Per row of mine: key, and number and volume of the others that were already active at its start (begun at or before
    it, not ended before it) and that began while it ran (after its start, at or before its end).

    Running sums over the boundaries of both kinds; a row that is of both kinds doesn't count for itself. Rows with NULL or
    reversed times, a NULL q, key or cell are left out.
    """
    own = rows.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start)) & F.col(q).isNotNull() & F.col(key).isNotNull()).dropna(subset=cell)
    no = F.lit(False)
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("k")), F.struct(F.col(end).alias("t"), F.lit(1).alias("k")))
    b = own.select(*cell, F.col(key).alias("_id"), F.col(q).alias("_q"), F.coalesce(mine, no).alias("_m"), F.coalesce(other, no).alias("_o"), F.inline(ends)).filter("_m or _o")
    begun, ended = F.col("_o") & (F.col("k") == 0), F.col("_o") & (F.col("k") == 1)
    upto = {"s_n": begun.cast("int"), "s_v": F.when(begun, F.col("_q"))}
    before = {"e_n": ended.cast("int"), "e_v": F.when(ended, F.col("_q"))}
    swept = _swept(b, cell, upto, before, {}).filter("_m")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    self_n, self_v = F.max(F.col("_o").cast("double")), F.max(F.when(F.col("_o"), F.col("_q")).otherwise(0.0))
    return swept.groupBy(*cell, F.col("_id").alias(key)).agg(
        (at("s_n", 0) - at("e_n", 0) - self_n).cast("bigint").alias("preexisting"), (at("s_v", 0) - at("e_v", 0) - self_v).alias("preexisting_volume"),
        (at("s_n", 1) - at("s_n", 0)).cast("bigint").alias("started"), (at("s_v", 1) - at("s_v", 0)).alias("started_volume"),
    )
