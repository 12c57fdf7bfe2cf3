"""Event study around the starts of metaorders of high participation: who else starts in the minutes before and after."""

from pyspark.sql import functions as F

from orderloom.functions.times import DAY_US
from orderloom.operators import resampling as re
from orderloom.operators.overlap import binned_neighbours
from orderloom.operators.ranks import quantiles
from orderloom.plans.crowding_queries import CELL, CLOSE, OPEN, facts, facts_sql
from orderloom.plans.registry import Registry
from orderloom.sources.tables import written

R = Registry()

BINS, WIDTH = 6, 5  # of five minutes, to either side
RUNS = 200
MINUTE = 60_000_000


def binned(spark, sf_dir):
    """Per start and bin: day, high (participation at or above the median), same and opposite (starts of others), exposure."""
    rows = facts(spark, sf_dir, "participation_rate").filter("start_us is not null and member_id is not null")
    rows = rows.select("metaorder_id", *CELL, "member_id", "start_us", "direction", "participation_rate")
    cut = quantiles(rows.filter("participation_rate > 0"), [], ["participation_rate"], [0.5]).first()
    each = binned_neighbours(rows, CELL, "start_us", "direction", "member_id", WIDTH * MINUTE, BINS).filter("participation_rate > 0")
    minute = F.pmod("start_us", F.lit(DAY_US)) / float(MINUTE)
    k = F.col("bin")
    a = minute + F.when(k < 0, k * WIDTH).otherwise((k - 1) * WIDTH)
    exposure = F.greatest(F.lit(0.0), F.least(a + WIDTH, F.lit(float(CLOSE))) - F.greatest(a, F.lit(float(OPEN))))
    high = F.col("participation_rate") >= F.lit(cut["q_participation_rate"][0] if cut else None)
    return each.select("day", high.alias("high"), "bin", "same", "opposite", exposure.alias("exposure"))


BINNED_SQL = f"""{facts_sql('participation_rate')},
s as (select * from fact where start_us is not null and member_id is not null),
e as (select *, (start_us % {DAY_US}) / {MINUTE}.0::double as m, participation_rate >= (select quantile_cont(participation_rate, 0.5) from s where participation_rate > 0) as high
      from s where participation_rate > 0),
k as (select b as bin from (select unnest(range(-{BINS}, {BINS + 1})) as b) where b <> 0),
pair as (select a.metaorder_id, a.direction = b.direction as same, b.start_us - a.start_us as d from e a join s b
         on a.isin = b.isin and a.day = b.day and a.member_id <> b.member_id and b.start_us <> a.start_us and abs(b.start_us - a.start_us) <= {BINS * WIDTH * MINUTE}),
n as (select metaorder_id, (case when d < 0 then -ceil(-d / {WIDTH * MINUTE}.0) else ceil(d / {WIDTH * MINUTE}.0) end)::int as bin,
             count(*) filter (same) as same, count(*) filter (not same) as opposite from pair group by all),
binned as (select e.day, e.high, k.bin::int as bin, coalesce(n.same, 0) as same, coalesce(n.opposite, 0) as opposite,
                  greatest(0.0, least(m + (case when k.bin < 0 then k.bin else k.bin - 1 end) * {WIDTH} + {WIDTH}, {CLOSE}.0) - greatest(m + (case when k.bin < 0 then k.bin else k.bin - 1 end) * {WIDTH}, {OPEN}.0)) as exposure
           from e cross join k left join n on n.metaorder_id = e.metaorder_id and n.bin = k.bin)"""


@R.add(f"""
with {BINNED_SQL}
select high, bin, count(*) as anchors, sum(same)::bigint as same, sum(opposite)::bigint as opposite, round(sum(exposure), 5) as minutes,
       round(sum(same) / nullif(sum(exposure), 0), 8) as same_rate, round(sum(opposite) / nullif(sum(exposure), 0), 8) as opposite_rate from binned group by high, bin""")
def j11_p17_a36_event_rates(spark, sf_dir):
    """Starts of other members in the ISIN per minute of the session, by five-minute bin around a start, its sign and participation."""
    b = binned(spark, sf_dir).groupBy("high", "bin").agg(
        F.count("*").alias("anchors"), F.sum("same").alias("same"), F.sum("opposite").alias("opposite"), F.sum("exposure").alias("_m")
    )
    rate = lambda c: F.round(F.when(F.col("_m") != 0, F.col(c) / F.col("_m")), 8).alias(f"{c}_rate")
    return b.select("high", "bin", "anchors", "same", "opposite", F.round("_m", 5).alias("minutes"), rate("same"), rate("opposite"))


@R.add(f"""
with {BINNED_SQL},
d as (select bin > 0 as after, day, coalesce(sum(same) filter (high), 0)::double as s1, coalesce(sum(exposure) filter (high), 0) as m1,
             coalesce(sum(same) filter (not high), 0)::double as s0, coalesce(sum(exposure) filter (not high), 0) as m0 from binned group by all),
num as (select *, row_number() over (partition by after order by day) - 1 as i, count(*) over (partition by after) as k from d),
runs as (select unnest(range({RUNS + 1})) as run),
pick as (select after, run, case when run = 0 then i else {re.hashed_sql('3', 'run', 'i')} % k end as j from num, runs),
rep as (select p.after, run, sum(s1) / nullif(sum(m1), 0) - sum(s0) / nullif(sum(m0), 0) as x from pick p join num on num.after = p.after and num.i = p.j group by all)
select after, round(max(x) filter (run = 0), 8) + 0.0 as excess, round(quantile_cont(x, 0.025) filter (run > 0), 8) + 0.0 as low, round(quantile_cont(x, 0.975) filter (run > 0), 8) + 0.0 as high
from rep group by after""")
def b10_event_excess(spark, sf_dir):
    """Rate of starts of the same sign around starts of high participation less that around others, before and after, over resampled days."""
    of = lambda c, w: F.sum(F.when(w, F.col(c)).otherwise(0.0))
    high = F.col("high")
    days = binned(spark, sf_dir).groupBy((F.col("bin") > 0).alias("after"), "day").agg(
        of("same", high).alias("s1"), of("exposure", high).alias("m1"), of("same", ~high).alias("s0"), of("exposure", ~high).alias("m0")
    )
    runs = re.drawn(written(days, "days"), ["after"], "day", RUNS, 3).groupBy("after", "run").agg(*[F.sum(c).alias(c) for c in ("s1", "m1", "s0", "m0")])
    got = re.interval(runs.withColumn("excess", F.try_divide("s1", "m1") - F.try_divide("s0", "m0")), ["after"], "excess")
    return got.select("after", *[(F.round(c, 8) + 0.0).alias(n) for c, n in (("excess", "excess"), ("low", "low"), ("high", "high"))])
