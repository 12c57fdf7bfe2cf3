"""Reconstruction of metaorders from a tape, lookups along it, and daily metrics.

The events table stands for the tape: one instrument, four agents (user_id modulo
4), clicks and views buy, all else sells, the value is the quantity and the price
less 1.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.numbers import finite
from orderloom.functions.text import canonical_isin
from orderloom.functions.times import DAY_US, wall_us
from orderloom.operators import tape as ops
from orderloom.plans.registry import Registry
from orderloom.sources.tables import table

R = Registry()

HOUR = 3_600_000_000


def tape(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("X").alias("isin"),
        F.col("event_id").alias("row_id"),
        wall_us(F.col("ts")).alias("t"),
        F.pmod("user_id", F.lit(4)).alias("member"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("sign"),
        F.col("value").alias("q"),
        (F.col("value") + 1).alias("price"),
        (F.col("event_type").isin("purchase", "click")).alias("own_account"),
    ).withColumn("day", F.expr(f"t div {DAY_US}"))


TAPE_SQL = f"""
tape as (
  select 'X' as isin, event_id as row_id, epoch_us(ts::timestamp) as t, user_id % 4 as member,
         case when event_type in ('click', 'view') then 1 else -1 end as sign, value as q, value + 1 as price,
         event_type in ('purchase', 'click') as own_account, epoch_us(ts::timestamp) // {DAY_US} as day
  from events)"""

SLICE = "t div 900000000"  # a quarter of an hour


@R.add(f"""
with {TAPE_SQL},
c as (select *, case when sign = lag(sign) over w then 0 else 1 end as new from tape window w as (partition by isin, member order by t, row_id)),
r as (select *, sum(new) over (partition by isin, member order by t, row_id rows unbounded preceding) as run from c),
v as (select *, min(day) over (partition by isin, member, run) as d0, max(day) over (partition by isin, member, run) as d1,
             t - lag(t) over (partition by isin, member, run order by t, row_id) as since from r),
p as (select *, sum(case when since > {12 * HOUR} then 1 else 0 end) over (partition by isin, member, run order by t, row_id rows unbounded preceding) as part
      from v where d0 = d1)
select isin, member, day, max(sign) as sign, min(t) as first, max(t) as last, count(*) as n_child, round(sum(q), 4) as q
from p group by isin, member, day, run, part having count(*) >= 3 and max(t) - min(t) >= 120000000""")
def m01_m05_metaorders(spark, sf_dir):
    """Runs of one sign per agent over the whole tape, whole runs across midnight dropped, split at 12 hours, at least 3 trades and 120 s."""
    got = ops.same_sign_runs(tape(spark, sf_dir), ["isin", "member"], "day", "t", "row_id", "sign", "q", "member", 12 * HOUR, 3, 120_000_000)
    return got.withColumn("q", F.round("q", 4))


@R.add(f"""
with {TAPE_SQL},
c as (select *, case when sign = lag(sign) over (partition by member order by t, row_id) then 0 else 1 end as new from tape),
r as (select *, sum(new) over (partition by member order by t, row_id rows unbounded preceding) as run from c),
g as (select member, run, count(*) as n, max(t) - min(t) as d, min(day) = max(day) as ok from r group by all)
select count(*) as runs, count(*) filter (ok) as within_day, count(*) filter (ok and n >= 3) as of_three,
       count(*) filter (ok and n >= 3 and d >= 120000000) as lasting from g""")
def m05_stage_counters(spark, sf_dir):
    """How many runs each rule leaves."""
    t = tape(spark, sf_dir)
    w = Window.partitionBy("member", "day").orderBy("t", "row_id")
    rows = t.withColumn("_new", F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(w))
    runs = rows.groupBy("member", "day", "run").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("d"), F.max("sign").alias("sign"))
    # only a day's first and last run can go on in another day; these are few and are joined where they meet
    ends = Window.partitionBy("member", "day")
    runs = runs.withColumns({"a": F.min("run").over(ends), "b": F.max("run").over(ends)})
    outer = runs.filter("run = a or run = b")
    along = Window.partitionBy("member").orderBy("day", "run")
    on = F.coalesce(((F.lag("sign").over(along) == F.col("sign")) & (F.lag("day").over(along) < F.col("day"))).cast("int"), F.lit(0))
    joined = outer.withColumn("_on", on).withColumn("_k", F.sum(1 - F.col("_on")).over(along)).groupBy("member", "_k").agg(
        F.sum("n").alias("n"), F.max("d").alias("d"), (F.min("day") == F.max("day")).alias("ok")
    )
    whole = joined.select("n", "d", "ok").unionByName(runs.filter("run > a and run < b").select("n", "d", F.lit(True).alias("ok")))
    ok = F.col("ok")
    return whole.agg(
        F.count("*").alias("runs"),
        F.count_if(ok).alias("within_day"),
        F.count_if(ok & (F.col("n") >= 3)).alias("of_three"),
        F.count_if(ok & (F.col("n") >= 3) & (F.col("d") >= 120_000_000)).alias("lasting"),
    )


@R.add(f"""
with {TAPE_SQL},
target as (select epoch_us(o_orderdate::timestamp) + 43200000000 + (o_orderkey % 36000) * 1000000 as tt, o_orderkey from orders),
inside as (select o_orderkey, (select min(day) from tape) + (o_orderkey % 30) as d, o_orderkey % 86400 as s from orders),
want as (select o_orderkey, d * {DAY_US} + s * 1000000 as t from inside)
select o_orderkey, w.t, round(p.price, 6) as price
from want w asof left join (select t, arg_max(price, row_id) as price from tape group by t) p on w.t >= p.t""")
def j02_as_of(spark, sf_dir):
    """The tape's last price at or before one instant per order, in any earlier day if need be."""
    t = tape(spark, sf_dir)
    first = t.agg(F.min("day")).first()[0]
    k = F.col("o_orderkey")
    want = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("X").alias("isin"), ((F.lit(first) + k % 30) * DAY_US + (k % 86400) * 1_000_000).alias("t")
    )
    got = ops.as_of(t, want, ["isin"], "t", "row_id", "price", SLICE, "price")
    return got.select("o_orderkey", "t", F.round("price", 6).alias("price"))


@R.add(f"""
with {TAPE_SQL}, m as (select row_id, t, t + {HOUR} as until from tape)
select m.row_id, round(sum(x.q), 4) as volume from m join tape x on x.t between m.t and m.until and x.day in (m.t // {DAY_US}, m.until // {DAY_US}) group by m.row_id""")
def j03_range_volume(spark, sf_dir):
    """Volume traded in the hour from each trade on, both ends included, by two lookups of a running sum."""
    t = tape(spark, sf_dir)
    total = ops.running_sum(t, ["isin"], "t", "q", SLICE).withColumn("row", F.lit(0))
    want = t.select("isin", "row_id", F.explode(F.array(F.struct((F.col("t") - 1).alias("t"), F.lit(-1).alias("s")), F.struct((F.col("t") + HOUR).alias("t"), F.lit(1).alias("s")))).alias("x"))
    got = ops.as_of(total, want.select("isin", "row_id", "x.t", "x.s"), ["isin"], "t", "row", "total", SLICE, "upto")
    return got.groupBy("row_id").agg(F.round(F.sum(F.col("s") * F.coalesce("upto", F.lit(0.0))), 4).alias("volume"))


@R.add(f"with {TAPE_SQL} select isin, day, member, sign, round(sum(q), 4) as q, min(price) as low, max(price) as high, count(*) as n, arg_min(own_account, (t, row_id)) as first_kind from tape group by isin, day, member, sign")
def a01_trade_aggregate(spark, sf_dir):
    """Trades added up per day, agent and side: quantity, lowest and highest price, the first one's kind."""
    return tape(spark, sf_dir).groupBy("isin", "day", "member", "sign").agg(
        F.round(F.sum("q"), 4).alias("q"), F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("n"),
        F.min_by("own_account", F.struct("t", "row_id")).alias("first_kind"),
    )


STEP = 1_000_000_000


@R.add(f"""
with {TAPE_SQL},
l as (select isin, day, t // {STEP} as interval, arg_max(price, (t, row_id)) as price from tape group by all),
r as (select *, ln(price) - lag(ln(price)) over (partition by isin, day order by interval) as r from l),
b as (select *, abs(r) * abs(lag(r) over (partition by isin, day order by interval)) as b from r),
v as (select isin, day, round(sum(q), 4) as volume from tape group by all)
select isin, day, volume, count(r) as n_returns, round(sqrt(sum(r * r)), 6) as realised, round(sqrt(sum(b) * 1.5707963267948966), 6) as bipower
from b join v using (isin, day) group by isin, day, volume""")
def a02_a03_a04_daily_cache(spark, sf_dir):
    """Per day, volume, and realised and bipower volatility of the last prices of 1000-second intervals."""
    t = tape(spark, sf_dir)
    last = ops.last_per_interval(t, ["isin", "day"], "t", "row_id", "price", STEP)
    vol = ops.realised(last, ["isin", "day"], "interval", "price")
    volume = t.groupBy("isin", "day").agg(F.round(F.sum("q"), 4).alias("volume"))
    return vol.join(volume, ["isin", "day"]).select("isin", "day", "volume", "n_returns", F.round("realised", 6).alias("realised"), F.round("bipower", 6).alias("bipower"))


@R.add(f"""
with {TAPE_SQL}, c as (select isin, day, arg_max(price, (t, row_id)) as close from tape where price > 0 group by all)
select isin, day, close, round(ln(close) - lag(ln(close)) over (partition by isin order by day), 9) as daily_return from c""")
def a06_daily_return(spark, sf_dir):
    """Log return of each day's last price over that of the day before."""
    close = tape(spark, sf_dir).filter("price > 0").groupBy("isin", "day").agg(F.max_by("price", F.struct("t", "row_id")).alias("close"))
    w = Window.partitionBy("isin").orderBy("day")
    return close.select("isin", "day", "close", F.round(F.ln("close") - F.lag(F.ln("close")).over(w), 9).alias("daily_return"))


def daily_metric(spark, sf_dir):
    """The last computed row of each ISIN and day, numbers that are none left out."""
    d = table(spark, sf_dir, "daily_metric").withColumn("isin", canonical_isin(F.col("isin")))
    w = Window.partitionBy("isin", "trade_date").orderBy(F.col("computed_at").desc_nulls_last(), F.col("vol").desc_nulls_last(), F.col("volume").desc_nulls_last())
    return (
        d.filter("isin is not null and trade_date is not null")
        .withColumn("_n", F.row_number().over(w))
        .filter("_n = 1")
        .select("isin", "trade_date", finite(F.col("vol")).alias("vol"), finite(F.col("volume")).alias("volume"))
    )


METRIC_SQL = r"""
canon as (select *, nullif(upper(regexp_replace(isin, '^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$', '', 'g')), '') as i from daily_metric),
metric as (
  select i as isin, trade_date, case when isfinite(vol) then vol end as vol, case when isfinite(volume) then volume end as volume
  from canon where i is not null and trade_date is not null
  qualify row_number() over (partition by i, trade_date order by computed_at desc nulls last, vol desc nulls last, volume desc nulls last) = 1)"""


@R.add(f"""
with {METRIC_SQL}
select isin, trade_date, vol as same_day, lag(vol) over w as prev_day,
       round(case when count(vol) over w5 = count(*) over w5 then avg(vol) over w5 end, 9) as avg_5d
from metric window w as (partition by isin order by trade_date), w5 as (partition by isin order by trade_date rows between 4 preceding and current row)""")
def j04_w04_metric_modes(spark, sf_dir):
    """Volatility of the day, of the day before with a row, and the mean of the last five rows (NULL if one of them is)."""
    w = Window.partitionBy("isin").orderBy("trade_date")
    w5 = w.rowsBetween(-4, 0)
    mean = F.when(F.count("vol").over(w5) == F.count(F.lit(1)).over(w5), F.avg("vol").over(w5))
    return daily_metric(spark, sf_dir).select(
        "isin", "trade_date", F.col("vol").alias("same_day"), F.lag("vol").over(w).alias("prev_day"), F.round(mean, 9).alias("avg_5d")
    )


@R.add(f"""
with {METRIC_SQL}
select isin, trade_date, round(case when count(vol) over w >= 3 then avg(vol) over w end, 9) as smoothed
from metric window w as (partition by isin order by trade_date rows between 2 preceding and current row)""")
def w05_rolling_mean(spark, sf_dir):
    """Trailing mean over three rows where all three are known."""
    w = Window.partitionBy("isin").orderBy("trade_date").rowsBetween(-2, 0)
    smooth = F.when(F.count("vol").over(w) >= 3, F.avg("vol").over(w))
    return daily_metric(spark, sf_dir).select("isin", "trade_date", F.round(smooth, 9).alias("smoothed"))
