"""Intervals and tests of crowding correlations, by resampling of days and clusters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.times import DAY_US
from orderloom.operators import resampling as re
from orderloom.operators.crowding import leave_one_out
from orderloom.operators.moments import correlation, correlation_sql, merged_sums, pair_sums
from orderloom.operators.ranks import quantiles
from orderloom.plans.crowding_queries import CELL, LOCAL_SQL, facts, facts_sql
from orderloom.plans.registry import Registry
from orderloom.sources.tables import written

R = Registry()

RUNS = 200


def daily(spark, sf_dir):
    """day, x and y: the signed share of own-account and of client volume."""
    share = lambda flow: F.try_divide(F.sum(F.when(F.col("flow") == flow, F.col("q") * F.col("direction"))), F.sum(F.when(F.col("flow") == flow, F.col("q"))))
    rows = facts(spark, sf_dir).groupBy("day").agg(share("proprietary").alias("x"), share("client").alias("y")).dropna()
    return written(rows.withColumn("g", F.lit(0)), "daily")


DAILY_SQL = f"""{facts_sql()},
daily as (
  select day, sum(q * direction) filter (flow = 'proprietary') / sum(q) filter (flow = 'proprietary') as x,
         sum(q * direction) filter (flow = 'client') / sum(q) filter (flow = 'client') as y from fact group by day),
num as (select *, row_number() over (order by day) - 1 as i, count(*) over () as n from daily where x is not null and y is not null),
runs as (select unnest(range({RUNS + 1})) as run)"""


@R.add(f"""
with {DAILY_SQL},
pick as (select run, case when run = 0 then i else {re.hashed_sql('0', 'run', 'i')} % n end as j from num, runs),
rep as (select run, {correlation_sql('x', 'y')} as r from pick join num on num.i = pick.j group by run),
moved as (select run, i, row_number() over (partition by run order by case when run = 0 then i else {re.hashed_sql('1', 'run', 'i')} end, i) - 1 as j from num, runs),
perm as (select m.run, {correlation_sql('a.x', 'b.y')} as r from moved m join num a on a.i = m.j join num b on b.i = m.i group by m.run),
own as (select r as r0 from rep where run = 0)
select (select count(*) from num) as n, round((select r0 from own), 8) as r, round((select quantile_cont(r, 0.025) from rep where run > 0), 8) as low,
       round((select quantile_cont(r, 0.975) from rep where run > 0), 8) as high,
       round((select least(1.0, 2 * least(avg((r >= r0 - 1e-12)::int), avg((r <= r0 + 1e-12)::int))) from perm, own where run > 0 and r is not null), 6) as p""")
def b01_b02_daily_correlation(spark, sf_dir):
    """Correlation over days of own-account and client imbalance, its interval over resampled days, and its p by exchanging days."""
    rows = daily(spark, sf_dir)
    sums = lambda df: df.groupBy("g", "run").agg(*pair_sums(F.col("x"), F.col("y"))).select("g", "run", "n", correlation().alias("r"))
    again = sums(re.drawn(rows, ["g"], "day", RUNS, 0))
    low = re.interval(again, ["g"], "r")
    p = re.two_sided(sums(re.shuffled(rows, ["g"], "day", "y", RUNS, 1)), ["g"], "r").select("g", "p")
    n = again.filter("run = 0").select("g", "n")
    return low.join(p, "g").join(n, "g").select("n", *[F.round(c, 8).alias(c) for c in ("r", "low", "high")], F.round("p", 6).alias("p"))


@R.add(f"""
with {facts_sql()}, {LOCAL_SQL},
d as (select flow, day, count(*) as n, sum(imbalance) as sx, sum(direction)::double as sy, sum(imbalance * imbalance) as sxx, count(*)::double as syy, sum(imbalance * direction) as sxy
      from local where imbalance is not null and flow is not null group by all),
num as (select *, row_number() over (partition by flow order by day) - 1 as i, count(*) over (partition by flow) as k from d),
runs as (select unnest(range({RUNS + 1})) as run),
pick as (select flow, run, case when run = 0 then i else {re.hashed_sql('0', 'run', 'i')} % k end as j from num, runs),
rep as (select p.flow, run, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(syy) as syy, sum(sxy) as sxy from pick p join num on num.flow = p.flow and num.i = p.j group by all),
v as (select flow, run, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) as r, sxy / n as m from rep)
select flow, round(max(r) filter (run = 0), 8) + 0.0 as r, round(quantile_cont(r, 0.025) filter (run > 0), 8) + 0.0 as r_low, round(quantile_cont(r, 0.975) filter (run > 0), 8) + 0.0 as r_high,
       round(max(m) filter (run = 0), 8) + 0.0 as mean, round(quantile_cont(m, 0.025) filter (run > 0), 8) + 0.0 as mean_low, round(quantile_cont(m, 0.975) filter (run > 0), 8) + 0.0 as mean_high
from v group by flow""")
def b03_b04_day_clusters(spark, sf_dir):
    """Per flow: correlation of direction and the others' imbalance and mean alignment with them, with intervals over resampled days."""
    rows = leave_one_out(facts(spark, sf_dir), CELL, "q", "direction").filter("imbalance is not null and flow is not null")
    days = written(rows.groupBy("flow", "day").agg(*pair_sums(F.col("imbalance"), F.col("direction").cast("double"))), "days")
    runs = re.drawn(days, ["flow"], "day", RUNS, 0).groupBy("flow", "run").agg(*merged_sums())
    runs = runs.select("flow", "run", correlation().alias("r"), (F.col("sxy") / F.col("n")).alias("mean"))
    eight = lambda c, n: (F.round(c, 8) + 0.0).alias(n)
    r = re.interval(runs, ["flow"], "r").select("flow", eight("r", "r"), eight("low", "r_low"), eight("high", "r_high"))
    m = re.interval(runs, ["flow"], "mean").select("flow", eight("mean", "mean"), eight("low", "mean_low"), eight("high", "mean_high"))
    return r.join(m, "flow")


@R.add(f"""
with {DAILY_SQL},
d as (select num.day, i, num.y, count(*) as n, sum(direction)::double as sx, count(*)::double as sxx from num join fact on fact.day = num.day and fact.flow = 'proprietary' group by all),
e as (select *, row_number() over (order by day) - 1 as k from d),
moved as (select run, k, row_number() over (partition by run order by case when run = 0 then k else {re.hashed_sql('2', 'run', 'k')} end, k) - 1 as j from e, runs),
s as (select m.run, sum(b.n) as n, sum(b.sx) as sx, sum(b.n * a.y) as sy, sum(b.sxx) as sxx, sum(b.n * a.y * a.y) as syy, sum(b.sx * a.y) as sxy
      from moved m join e a on a.k = m.k join e b on b.k = m.j group by m.run),
v as (select run, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) as r from s)
select (select count(*) from e) as clusters, round((select r from v where run = 0), 8) as r,
       round((select least(1.0, 2 * least(avg((v.r >= o.r - 1e-12)::int), avg((v.r <= o.r + 1e-12)::int))) from v, (select r from v where run = 0) o where run > 0), 6) as p""")
def b03_cluster_permutation(spark, sf_dir):
    """Correlation of own-account directions with the day's client imbalance, and its p by exchanging the imbalances of whole days."""
    y = daily(spark, sf_dir).select("g", "day", "y")
    own = facts(spark, sf_dir).filter("flow = 'proprietary'").groupBy("day").agg(F.count("*").alias("m"), F.sum("direction").cast("double").alias("sx"))
    days = written(own.join(y, "day"), "days")
    moved = re.shuffled(days, ["g"], "day", "y", RUNS, 2)
    m = F.col("m").cast("double")
    sums = moved.groupBy("g", "run").agg(
        F.sum("m").alias("n"), F.sum("sx").alias("sx"), F.sum(m * F.col("y")).alias("sy"), F.sum(m).alias("sxx"), F.sum(m * F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("sx") * F.col("y")).alias("sxy")
    )
    got = re.two_sided(sums.select("g", "run", correlation().alias("r")), ["g"], "r")
    clusters = days.groupBy("g").agg(F.count("*").alias("clusters"))
    return got.join(clusters, "g").select("clusters", F.round("r", 8).alias("r"), F.round("p", 6).alias("p"))


@R.add(f"""
with {facts_sql('impact_1m', 'impact_60m')},
d as (select day, coalesce(sum(impact_1m) filter (flow = 'proprietary'), 0) as pa, coalesce(sum(impact_60m) filter (flow = 'proprietary'), 0) as pb,
             coalesce(sum(impact_1m) filter (flow = 'client'), 0) as ca, coalesce(sum(impact_60m) filter (flow = 'client'), 0) as cb
      from fact where flow is not null and impact_1m is not null and impact_60m is not null group by day),
num as (select *, row_number() over (order by day) - 1 as i, count(*) over () as n from d),
runs as (select unnest(range({RUNS + 1})) as run),
pick as (select run, case when run = 0 then i else {re.hashed_sql('3', 'run', 'i')} % n end as j from num, runs),
rep as (select run, sum(pb) / nullif(sum(pa), 0) as p, sum(cb) / nullif(sum(ca), 0) as c from pick join num on num.i = pick.j group by run),
v as (select *, p - c as d from rep), o as (select p as p0, c as c0, d as d0 from v where run = 0)
select (select count(*) from d) as days, round(p0, 7) + 0.0 as proprietary, round(c0, 7) + 0.0 as client, round(d0, 7) + 0.0 as difference,
       round((select quantile_cont(d, 0.025) from v where run > 0), 7) + 0.0 as low, round((select quantile_cont(d, 0.975) from v where run > 0), 7) + 0.0 as high,
       round((select (1 + count(*) filter (abs(v.d - d0) >= abs(d0))) / (1.0 + count(v.d)) from v where run > 0), 7) as p
from o""")
def b08_retention_difference(spark, sf_dir):
    """Impact left after an hour (ratio of sums), own-account less client, with an interval over resampled days common to both, and a centred p."""
    of = lambda flow, c: F.coalesce(F.sum(F.when(F.col("flow") == flow, F.col(c))), F.lit(0.0))
    rows = facts(spark, sf_dir, "impact_1m", "impact_60m").filter("flow is not null and impact_1m is not null and impact_60m is not null")
    days = rows.groupBy("day").agg(*[of(f, c).alias(n) for n, f, c in (("pa", "proprietary", "impact_1m"), ("pb", "proprietary", "impact_60m"), ("ca", "client", "impact_1m"), ("cb", "client", "impact_60m"))])
    days = written(days.withColumn("g", F.lit(0)), "days")
    runs = re.drawn(days, ["g"], "day", RUNS, 3).groupBy("g", "run").agg(*[F.sum(c).alias(c) for c in ("pa", "pb", "ca", "cb")])
    runs = runs.select("g", "run", F.try_divide("pb", "pa").alias("p"), F.try_divide("cb", "ca").alias("c")).withColumn("d", F.col("p") - F.col("c"))
    runs = written(runs, "runs")
    own = runs.filter("run = 0").select("g", F.col("p").alias("proprietary"), F.col("c").alias("client"), F.col("d").alias("d0"))
    far = F.count(F.when(F.abs(F.col("d") - F.col("d0")) >= F.abs("d0"), 1))
    p = runs.filter("run > 0").join(F.broadcast(own), "g").groupBy("g").agg(((1 + far) / (1 + F.count("d"))).alias("p_value"))
    got = own.join(re.interval(runs, ["g"], "d"), "g").join(p, "g").join(days.groupBy("g").agg(F.count("*").alias("days")), "g")
    seven = lambda c, n: (F.round(c, 7) + 0.0).alias(n)
    return got.select("days", seven("proprietary", "proprietary"), seven("client", "client"), seven("d0", "difference"), seven("low", "low"), seven("high", "high"), seven("p_value", "p"))


CELLS = 1024  # of a histogram over 0 to 1
MEDIAN_RUNS = 100


@R.add(f"""
with {facts_sql('participation_rate')},
h as (select flow, day, least({CELLS - 1}, floor(participation_rate * {CELLS}))::int as bin, count(*) as n from fact
      where flow is not null and participation_rate >= 0 and participation_rate <= 1 group by all),
num as (select flow, day, row_number() over (partition by flow order by day) - 1 as i, count(*) over (partition by flow) as k from (select distinct flow, day from h)),
runs as (select unnest(range({MEDIAN_RUNS + 1})) as run),
pick as (select flow, run, case when run = 0 then i else {re.hashed_sql('4', 'run', 'i')} % k end as j from num, runs),
w as (select p.flow, p.run, num.day, count(*) as copies from pick p join num on num.flow = p.flow and num.i = p.j group by all),
b as (select w.flow, run, bin, sum(copies * n) as n from w join h on h.flow = w.flow and h.day = w.day group by all),
c as (select *, sum(n) over (partition by flow, run order by bin) as upto, sum(n) over (partition by flow, run) as total from b),
m as (select flow, run, (bin + (total / 2.0 - (upto - n)) / n) / {CELLS} as x from c where upto >= total / 2.0 and upto - n < total / 2.0)
select flow, round(max(x) filter (run = 0), 8) as median, round(quantile_cont(x, 0.025) filter (run > 0), 8) as low, round(quantile_cont(x, 0.975) filter (run > 0), 8) as high
from m group by flow""")
def b09_histogram_medians(spark, sf_dir):
    """Median participation rate per flow from 1,024 cells of histogram, with an interval over resampled days: a run only adds up the days' histograms."""
    rows = facts(spark, sf_dir, "participation_rate").filter("flow is not null and participation_rate >= 0 and participation_rate <= 1")
    cell = F.least(F.lit(CELLS - 1), F.floor(F.col("participation_rate") * CELLS)).cast("int")
    days = written(rows.groupBy("flow", "day", cell.alias("bin")).agg(F.count("*").alias("n")), "histograms")
    copies = re.drawn(days.select("flow", "day").distinct(), ["flow"], "day", MEDIAN_RUNS, 4).groupBy("flow", "run", "day").agg(F.count("*").alias("copies"))
    sums = days.join(copies, ["flow", "day"]).groupBy("flow", "run", "bin").agg(F.sum(F.col("copies") * F.col("n")).alias("n"))
    w = Window.partitionBy("flow", "run")
    sums = sums.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)})
    at = (F.col("bin") + (F.col("total") / 2.0 - (F.col("upto") - F.col("n"))) / F.col("n")) / CELLS
    runs = sums.filter("upto >= total / 2.0 and upto - n < total / 2.0").select("flow", "run", at.alias("median"))
    return re.interval(runs, ["flow"], "median").select("flow", *[F.round(c, 8).alias(c) for c in ("median", "low", "high")])


STRATA_RUNS = 50


@R.add(f"""
with {facts_sql('participation_rate', 'impact')},
e as (select *, participation_rate >= (select quantile_cont(participation_rate, 0.5) from fact where participation_rate > 0) as high,
             isin || '|' || day || '|' || ((start_us % {DAY_US}) // 60000000 // 20) as stratum
      from fact where start_us is not null and participation_rate > 0 and impact is not null),
k as (select stratum, count(*) filter (high) as k, count(*) as n, sum(impact) as total from e group by stratum having count(*) filter (high) > 0 and count(*) filter (high) < count(*)),
runs as (select unnest(range({STRATA_RUNS + 1})) as run),
r as (select run, e.stratum, impact, row_number() over (partition by run, e.stratum order by case when run = 0 then (not high)::bigint else {re.hashed_sql('5', 'run', 'metaorder_id')} end, metaorder_id) as nth, k.k
      from e join k using (stratum), runs),
s as (select run, stratum, sum(impact) as own from r where nth <= k group by all),
v as (select run, sum(own - k * (total - own) / (n - k)) / sum(k) as x from s join k using (stratum) group by run),
o as (select x as x0 from v where run = 0)
select (select count(*) from k) as strata, round(x0, 8) + 0.0 as effect, round((select avg(x) from v where run > 0), 8) + 0.0 as mean_drawn,
       round((select (1 + count(*) filter (abs(x) >= abs(x0))) / (1.0 + count(*)) from v where run > 0), 7) as p
from o""")
def b11_strata_permutation(spark, sf_dir):
    """Impact at high participation less others' of the same ISIN, day and 20 minutes, and how often drawing the high ones at random
    within these strata gives as much."""
    rows = facts(spark, sf_dir, "participation_rate", "impact").filter("participation_rate > 0")
    slot = F.expr(f"pmod(start_us, {DAY_US}) div 60000000 div 20")
    rows = written(rows.select("isin", "day", slot.alias("slot"), "metaorder_id", "impact", "participation_rate"), "strata")
    cut = quantiles(rows, [], ["participation_rate"], [0.5]).select(F.col("q_participation_rate")[0]).first()
    rows = rows.filter("slot is not null and impact is not null").withColumn("high", F.col("participation_rate") >= F.lit(cut and cut[0]))
    stratum = ["isin", "day", "slot"]
    runs = written(re.strata_permutation(rows, stratum, "metaorder_id", "high", "impact", STRATA_RUNS, 5), "runs")
    own = runs.filter("run = 0").select(F.col("effect").alias("x0"))
    far = F.count(F.when(F.abs("effect") >= F.abs("x0"), 1))
    drawn = runs.filter("run > 0").join(F.broadcast(own)).groupBy("x0").agg(F.avg("effect").alias("mean"), ((1 + far) / (1 + F.count("*"))).alias("p"))
    strata = rows.groupBy(*stratum).agg(F.count_if("high").alias("k"), F.count("*").alias("n")).filter("k > 0 and k < n").agg(F.count("*").alias("strata"))
    return drawn.join(F.broadcast(strata)).select("strata", (F.round("x0", 8) + 0.0).alias("effect"), (F.round("mean", 8) + 0.0).alias("mean_drawn"), F.round("p", 7).alias("p"))
