"""Records of metaorders on a tape of several instruments and clients.

The events table stands for the tape: the user gives the instrument (one of three), the agent (one of four) and the client
(one of two); clicks and views buy, all else sells; the value is the quantity and the price less 1.
"""

from pyspark.sql import functions as F

from orderloom.functions.times import DAY_US, wall_us
from orderloom.operators import records as ops
from orderloom.operators import tape as tape_ops
from orderloom.plans.registry import Registry
from orderloom.sources.tables import table, written

R = Registry()

HOUR = 3_600_000_000
BAR = 900_000_000
ORDER = ["isin", "member", "day", "_run", "_part"]
HORIZONS = (1, 10, 30, 60)  # minutes
SAMPLES, MULTIPLIER = 5, 2.0
GRID = [k / 4 for k in range(13)]  # 0 to 3 times the duration


def market(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("X"), F.pmod("user_id", F.lit(3)).cast("string")).alias("isin"),
        F.col("event_id").alias("row_id"),
        wall_us(F.col("ts")).alias("t"),
        F.pmod(F.floor(F.col("user_id") / 3).cast("bigint"), F.lit(4)).alias("member"),
        F.pmod("user_id", F.lit(2)).alias("client"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("sign"),
        F.col("value").alias("q"),
        (F.col("value") + 1).alias("price"),
    ).withColumn("day", F.expr(f"t div {DAY_US}"))


def recorded(spark, sf_dir):
    """(tape, children, record): children and record written, as several queries' parts start from them."""
    tape = market(spark, sf_dir)
    rows = tape_ops.run_children(tape, ["isin", "member"], "day", "t", "row_id", "sign", "client", 2 * HOUR)
    enough = rows.groupBy(*ORDER).agg(F.count("*").alias("_n"), (F.max("t") - F.min("t")).alias("_d")).filter("_n >= 3 and _d >= 120000000").select(*ORDER)
    children = written(rows.join(enough, ORDER, "left_semi").select(*ORDER, "client", "t", "row_id", "sign", "q", "price"), "children")
    bars = tape_ops.last_per_interval(tape, ["isin", "day"], "t", "row_id", "price", BAR)
    vol = tape_ops.realised(bars, ["isin", "day"], "interval", "price").select("isin", "day", F.col("realised").alias("daily_vol"))
    daily = tape.groupBy("isin", "day").agg(F.sum("q").alias("daily_volume")).join(vol, ["isin", "day"], "left")
    return tape, children, written(ops.records(tape, children, ORDER, daily), "record")


RECORD_SQL = f"""
market as (
  select 'X' || (user_id % 3)::varchar as isin, event_id as row_id, epoch_us(ts::timestamp) as t, (user_id // 3) % 4 as member, user_id % 2 as client,
         case when event_type in ('click', 'view') then 1 else -1 end as sign, value as q, value + 1 as price, epoch_us(ts::timestamp) // {DAY_US} as day
  from events),
c as (select *, case when sign = lag(sign) over w then 0 else 1 end as new from market window w as (partition by isin, member order by t, row_id)),
r as (select *, sum(new) over (partition by isin, member order by t, row_id rows unbounded preceding) as run from c),
v as (select *, min(day) over o as d0, max(day) over o as d1, min(client) over o as c0, max(client) over o as c1,
             t - lag(t) over (partition by isin, member, run order by t, row_id) as since from r window o as (partition by isin, member, run)),
p as (select *, sum(case when since > {2 * HOUR} then 1 else 0 end) over (partition by isin, member, run order by t, row_id rows unbounded preceding) as part
      from v where d0 = d1 and c0 = c1),
child as (select * from p window o as (partition by isin, member, run, part) qualify count(*) over o >= 3 and max(t) over o - min(t) over o >= 120000000),
meta as (
  select isin, member, day, run, part, max(sign) as sign, arg_max(client, (t, row_id)) as client, min(t) as first, max(t) as last, count(*) as n_child, sum(q) as q,
         arg_min(price, (t, row_id)) as p0, arg_max(price, (t, row_id)) as p1 from child group by all),
vt as (select m.isin, m.member, m.run, m.part, sum(x.q) as volume from meta m join market x on x.isin = m.isin and x.day = m.day and x.t between m.first and m.last group by all),
bars as (select isin, day, t // {BAR} as i, arg_max(price, (t, row_id)) as price from market where price is not null group by all),
rets as (select isin, day, ln(price) - lag(ln(price)) over (partition by isin, day order by i) as x from bars where price > 0),
vols as (select isin, day, sqrt(sum(x * x)) as daily_vol from rets group by all),
days as (select isin, day, sum(q) as daily_volume from market group by all),
record as (
  select m.*, volume, daily_vol, q / daily_volume as q_over_v, volume / daily_volume as vt_over_v, q / volume as participation, ln(p1) - ln(p0) as price_change,
         case when daily_vol > 0 then (ln(p1) - ln(p0)) * sign / daily_vol end as impact
  from meta m join vt using (isin, member, run, part) join days using (isin, day) left join vols using (isin, day)),
last_price as (select isin, t, arg_max(price, row_id) as price from market where price is not null group by all)"""


@R.add(f"""
with {RECORD_SQL}
select isin, member, client, day, sign, first, last, n_child, round(q, 6) as q, round(volume, 6) as volume, round(daily_vol, 9) as daily_vol, round(q_over_v, 9) as q_over_v,
       round(vt_over_v, 9) as vt_over_v, round(participation, 9) as participation, round(price_change, 9) + 0.0 as price_change, round(impact, 8) + 0.0 as impact
from record""")
def m06_p05_record(spark, sf_dir):
    """Metaorders (one client, within a day, gaps of up to two hours) with size, market volume, participation and impact."""
    r = lambda c, k: (F.round(c, k) + 0.0).alias(c)
    return recorded(spark, sf_dir)[2].select(
        "isin", "member", "client", "day", "sign", "first", "last", "n_child", r("q", 6), r("volume", 6), r("daily_vol", 9), r("q_over_v", 9), r("vt_over_v", 9),
        r("participation", 9), r("price_change", 9), r("impact", 8),
    )


@R.add(f"""
with {RECORD_SQL},
path as (select c.*, row_number() over (partition by isin, member, run, part order by t, row_id) - 1 as k from child c)
select p.isin, p.member, r.first, p.k::int as k, round((ln(p.price) - ln(r.p0)) * r.sign / r.daily_vol, 8) + 0.0 as impact
from path p join record r using (isin, member, run, part) where r.daily_vol > 0""")
def m08_j05_partial_path(spark, sf_dir):
    """Impact at each child of each metaorder."""
    _, children, record = recorded(spark, sf_dir)
    path = ops.partial_path(record, children, ORDER).join(record.select(*ORDER, "first"), ORDER)
    return path.filter("impact is not null").select("isin", "member", "first", "k", (F.round("impact", 8) + 0.0).alias("impact"))


AFTER_SQL = f"""
target as (select r.*, k, last + floor((last - first) * {MULTIPLIER} * (k / {SAMPLES - 1}.0))::bigint as t from record r, (select unnest(range({SAMPLES})) as k)),
after as (select x.*, case when x.daily_vol > 0 then (ln(p.price) - ln(x.p0)) * x.sign / x.daily_vol end as path from target x asof left join last_price p on x.isin = p.isin and x.t >= p.t)"""


@R.add(f"with {RECORD_SQL}, {AFTER_SQL} select isin, member, first, k::int as k, round(path, 8) + 0.0 as impact from after where path is not null")
def m09_aftermath(spark, sf_dir):
    """Impact at five times from the end on, up to twice the duration after it."""
    tape, _, record = recorded(spark, sf_dir)
    path = ops.after_path(tape, record, ORDER, ops.even_offsets(SAMPLES, MULTIPLIER)).join(record.select(*ORDER, "first"), ORDER)
    return path.filter("impact is not null").select("isin", "member", "first", "k", (F.round("impact", 8) + 0.0).alias("impact"))


@R.add(f"""
with {RECORD_SQL}, {AFTER_SQL},
kids as (select isin, member, run, part, n_child, (row_number() over (partition by isin, member, run, part order by c.t, row_id) - 1) / (n_child - 1) as tau,
                (ln(price) - ln(p0)) * record.sign / daily_vol as y from child c join record using (isin, member, run, part) where daily_vol > 0),
pts as (select isin, member, run, part, tau, y from kids union all select isin, member, run, part, 1 + {MULTIPLIER} * k / {SAMPLES - 1}, path from after where k > 0 and path is not null),
seg as (select *, lead(tau) over o as tau1, lead(y) over o as y1 from pts window o as (partition by isin, member, run, part order by tau)),
g as (select unnest(range({len(GRID)})) as g),
gv as (select g, y + (y1 - y) * (g / 4.0 - tau) / (tau1 - tau) as x from seg, g where g / 4.0 >= tau and (g / 4.0 < tau1 or (g = {len(GRID) - 1} and tau1 >= {GRID[-1]} - 1e-9)) and tau1 is not null)
select g::int as g, count(*) as n, round(avg(x), 7) + 0.0 as mean, round(stddev_samp(x) / sqrt(count(*)), 7) as sem from gv group by g""")
def r01_a39_interpolated(spark, sf_dir):
    """Mean path of the impact, during and after metaorders, on a common grid of times in units of the duration."""
    tape, children, record = recorded(spark, sf_dir)
    partial = ops.partial_path(record, children, ORDER)
    after = ops.after_path(tape, record, ORDER, ops.even_offsets(SAMPLES, MULTIPLIER))
    points = ops.interpolated(partial, after, ORDER, GRID, MULTIPLIER)
    return points.groupBy("g").agg(
        F.count("*").alias("n"), (F.round(F.avg("impact"), 7) + 0.0).alias("mean"), F.round(F.stddev_samp("impact") / F.sqrt(F.count("*")), 7).alias("sem")
    )


@R.add(f"""
with {RECORD_SQL},
target as (select r.*, h, last + h::bigint * 60000000 as t from record r, (select unnest({list(HORIZONS)}) as h)),
a as (select x.isin, x.member, x.run, x.part, h, (ln(p.price) - ln(x.p0)) * x.sign / x.daily_vol as y from target x asof left join last_price p on x.isin = p.isin and x.t >= p.t where x.daily_vol > 0),
peak as (select isin, member, run, part, max(abs((ln(price) - ln(p0)) * record.sign / daily_vol)) as peak from child join record using (isin, member, run, part) where daily_vol > 0 group by all)
select isin, member, first, round(abs(impact), 8) as abs_end, {', '.join(f'round(max(y) filter (h = {h}), 8) + 0.0 as impact_{h}m' for h in HORIZONS)},
       round(max(y) filter (h = 30) / nullif(any_value(impact), 0), 6) + 0.0 as retention_30, round(max(y) filter (h = 60) / nullif(any_value(impact), 0), 6) + 0.0 as retention_60,
       round(any_value(peak), 8) as peak, round(any_value(peak) / nullif(abs(any_value(impact)), 0), 6) as overshoot
from record join a using (isin, member, run, part) join peak using (isin, member, run, part) group by isin, member, run, part, first, impact""")
def r04_horizons_peak(spark, sf_dir):
    """Impact 1 to 60 minutes after the end, what is left of it, its largest size on the way, and that over the end's."""
    tape, children, record = recorded(spark, sf_dir)
    offsets = F.array(*[F.lit(h * 60_000_000) for h in HORIZONS])
    later = ops.after_path(tape, record, ORDER, offsets).groupBy(*ORDER).agg(*[F.max(F.when(F.col("k") == i, F.col("impact"))).alias(f"impact_{h}m") for i, h in enumerate(HORIZONS)])
    peak = ops.partial_path(record, children, ORDER).groupBy(*ORDER).agg(F.max(F.abs("impact")).alias("peak"))
    r = lambda c, k, n: (F.round(c, k) + 0.0).alias(n)
    rows = record.filter("daily_vol > 0").join(later, ORDER).join(peak, ORDER)
    keep = lambda c: F.when(F.col("impact") != 0, F.col(c) / F.col("impact"))
    return rows.select(
        "isin", "member", "first", r(F.abs("impact"), 8, "abs_end"), *[r(f"impact_{h}m", 8, f"impact_{h}m") for h in HORIZONS],
        r(keep("impact_30m"), 6, "retention_30"), r(keep("impact_60m"), 6, "retention_60"), r("peak", 8, "peak"),
        r(F.when(F.col("impact") != 0, F.col("peak") / F.abs("impact")), 6, "overshoot"),
    )
