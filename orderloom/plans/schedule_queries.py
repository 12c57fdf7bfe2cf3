"""Execution schedules of the metaorders on the tape (runs of one sign of an agent within a day)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.operators.schedules import curve_points, normalised, shape
from orderloom.plans.registry import Registry
from orderloom.plans.tape_queries import TAPE_SQL, tape

R = Registry()

ORDER = ["member", "day", "run"]
GRID = 20


def children(spark, sf_dir):
    """Trades of runs of at least three, with tau and share."""
    w = Window.partitionBy("member", "day").orderBy("t", "row_id")
    rows = tape(spark, sf_dir).withColumn("_new", F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("_new").over(w).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy(*ORDER)))
    return normalised(rows.filter("n >= 3 and q is not null"), ORDER, "t", "row_id", "q")


CHILDREN_SQL = f"""{TAPE_SQL},
c as (select *, case when sign = lag(sign) over w then 0 else 1 end as new from tape window w as (partition by member, day order by t, row_id)),
r as (select *, (sum(new) over (partition by member, day order by t, row_id rows unbounded preceding))::bigint as run from c),
n as (select *, count(*) over (partition by member, day, run) as n from r qualify count(*) over (partition by member, day, run) >= 3),
child as (select *, (t - min(t) over o) / (max(t) over o - min(t) over o) as tau, q / sum(q) over o as share from n window o as (partition by member, day, run))"""


@R.add(f"""
with {CHILDREN_SQL}
select member, day, run, round(coalesce(sum(share) filter (tau <= 0.25), 0), 7) as front25, round(coalesce(sum(share) filter (tau <= 0.5), 0), 7) as front50,
       round(coalesce(sum(share) filter (tau >= 0.75), 0), 7) as back25, round(sum(tau * share), 7) as centre, round(sum(share * share), 7) as hhi
from child group by all""")
def m07_r03_r05_schedule_shape(spark, sf_dir):
    """Front, back, centre and concentration of each metaorder's volume over its time."""
    got = shape(children(spark, sf_dir), ORDER)
    return got.select(*ORDER, *[F.round(c, 7).alias(c) for c in got.columns if c not in ORDER])


@R.add(f"""
with {CHILDREN_SQL},
y as (select member, day, run, tau, least(1.0, sum(share) over (partition by member, day, run order by tau)) as y from child),
p as (select distinct * from y union select distinct member, day, run, 0.0, case when min(tau) = 0 then null else 0.0 end from y group by all),
pts as (select member, day, run, tau as a, y as ya, lead(tau) over o as b, lead(y) over o as yb from p where y is not null window o as (partition by member, day, run order by tau)),
g as (select unnest(range({GRID + 1})) as k),
v as (select k, case when k = {GRID} then 1.0 else ya + (yb - ya) * (k / {GRID} - a) / (b - a) end as filled
      from pts, g where b is not null and ((k / {GRID} >= a - 1e-12 and k / {GRID} < b - 1e-12) or (k = {GRID} and b >= 1.0)))
select k::int as k, count(*) as n, round(avg(filled), 6) as mean, round(stddev_samp(filled) / sqrt(count(*)), 6) as sem from v group by k""")
def r02_a37_schedule_curve(spark, sf_dir):
    """Mean cumulative schedule and its error on 21 points of the time."""
    points = curve_points(children(spark, sf_dir), ORDER, GRID)
    return points.groupBy("k").agg(
        F.count("*").alias("n"), F.round(F.avg("filled"), 6).alias("mean"), F.round(F.stddev_samp("filled") / F.sqrt(F.count("*")), 6).alias("sem")
    )


@R.add(f"""
with {CHILDREN_SQL},
p as (select *, (ln(price) - ln(first_value(price) over (partition by member, day, run order by t, row_id))) * sign as path from child),
b as (select least(floor(tau * 10)::int, 9) as bin, path from p where price > 0)
select bin, count(*) as n, round(avg(path), 6) + 0.0 as mean, round(stddev_samp(path) / sqrt(count(*)), 6) as sem from b group by bin""")
def m08_a39_impact_path(spark, sf_dir):
    """Mean log price against the first child's, in the direction of the metaorder, per tenth of its time."""
    w = Window.partitionBy(*ORDER).orderBy("t", "row_id")
    path = (F.ln("price") - F.ln(F.first("price").over(w))) * F.col("sign")
    rows = children(spark, sf_dir).filter("price > 0").withColumn("path", path)
    return rows.groupBy(F.least(F.floor(F.col("tau") * 10).cast("int"), F.lit(9)).alias("bin")).agg(
        F.count("*").alias("n"), (F.round(F.avg("path"), 6) + 0.0).alias("mean"), F.round(F.stddev_samp("path") / F.sqrt(F.count("*")), 6).alias("sem")
    )


@R.add(f"""
with {CHILDREN_SQL},
v as (select day, sum(q) as v from tape group by day),
g as (select *, t - lag(t) over (partition by member, day, run order by t, row_id) as gap from child)
select member, g.day, run, max(sign) as sign, count(*) as n_child, round((max(t) - min(t)) / 1e6, 6) as duration_s, round(sum(q), 4) as q,
       round(sum(q) / any_value(v), 7) as phi_same_day, avg(gap) / 1e6 as mean_gap_s, median(gap) / 1e6 as median_gap_s
from g join v on v.day = g.day group by member, g.day, run""")
def m10_sample(spark, sf_dir):
    """Duration, number of trades, size, share of the day's volume and gaps between trades of each metaorder."""
    rows = children(spark, sf_dir)
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*ORDER).orderBy("t", "row_id"))
    volume = tape(spark, sf_dir).groupBy("day").agg(F.sum("q").alias("v"))
    got = rows.withColumn("gap", gap).groupBy(*ORDER).agg(
        F.max("sign").alias("sign"), F.count("*").alias("n_child"), ((F.max("t") - F.min("t")) / 1e6).alias("duration_s"), F.sum("q").alias("total"),
        (F.avg("gap") / 1e6).alias("mean_gap_s"), (F.median("gap") / 1e6).alias("median_gap_s"),
    )
    return got.join(volume, "day").select(
        *ORDER, "sign", "n_child", F.round("duration_s", 6).alias("duration_s"), F.round("total", 4).alias("q"),
        F.round(F.col("total") / F.col("v"), 7).alias("phi_same_day"), "mean_gap_s", "median_gap_s",
    )
