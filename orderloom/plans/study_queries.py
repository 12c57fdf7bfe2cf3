"""Event time, retention, autocorrelation, alternative curves and tails, and counters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.text import canonical_id
from orderloom.functions.times import DAY_US
from orderloom.operators import bins, models
from orderloom.operators.tape import last_per_interval, realised
from orderloom.operators.ranks import quantiles
from orderloom.plans.crowding_queries import CLOSE, OPEN, facts, facts_sql
from orderloom.plans.registry import Registry
from orderloom.plans.summary_queries import FIT_SQL, NATIONALITY_SQL, QV, _fit_ready, nationality
from orderloom.plans.tape_queries import TAPE_SQL, tape
from orderloom.sources.tables import table, written

R = Registry()

LAGS = 5


@R.add(f"""
with {facts_sql()},
d as (select isin, day, sum(q * direction) / sum(q) as x from fact group by all),
m as (select *, x - avg(x) over (partition by isin) as c, count(*) over (partition by isin) as n from d),
l as (select isin, n, c, {', '.join(f'lag(c, {k}) over (partition by isin order by day) as c{k}' for k in range(1, LAGS + 1))} from m where n > {LAGS})
select isin, {', '.join(f'round(sum(c * c{k}) / nullif(sum(c * c), 0), 6) + 0.0 as acf_{k}' for k in range(1, LAGS + 1))} from l group by isin""")
def r06_autocorrelation(spark, sf_dir):
    """Autocorrelation of an ISIN's daily signed share, at lags of one to five of its days (mean removed, biased)."""
    d = facts(spark, sf_dir).groupBy("isin", "day").agg((F.sum(F.col("q") * F.col("direction")) / F.sum("q")).alias("x"))
    w, o = Window.partitionBy("isin"), Window.partitionBy("isin").orderBy("day")
    m = d.withColumns({"c": F.col("x") - F.avg("x").over(w), "n": F.count("*").over(w)}).filter(F.col("n") > LAGS)
    m = m.withColumns({f"c{k}": F.lag("c", k).over(o) for k in range(1, LAGS + 1)})
    acf = lambda k: (F.round(F.try_divide(F.sum(F.col("c") * F.col(f"c{k}")), F.sum(F.col("c") * F.col("c"))), 6) + 0.0).alias(f"acf_{k}")
    return m.groupBy("isin").agg(*[acf(k) for k in range(1, LAGS + 1)])


W_MIN, B_MIN = 20, 5


@R.add(f"""
with {facts_sql()},
s as (select (start_us % {DAY_US}) / 6e7 as m from fact where start_us is not null),
g as (select unnest(range({-W_MIN // B_MIN}, {W_MIN // B_MIN})) as k)
select k::int as bin, count(*) as metaorders, round(sum(greatest(0, least(m + (k + 1) * {B_MIN}, {CLOSE}) - greatest(m + k * {B_MIN}, {OPEN}))), 4) as minutes
from s, g group by k""")
def p17_p18_exposure(spark, sf_dir):
    """Minutes of the session that lie in each five-minute bin from 20 minutes before to 20 after a start."""
    m = (F.pmod("start_us", F.lit(DAY_US)) / 6e7).alias("m")
    rows = facts(spark, sf_dir).filter("start_us is not null").select(m)
    k = F.col("bin")
    each = rows.select("m", F.explode(F.sequence(F.lit(-W_MIN // B_MIN), F.lit(W_MIN // B_MIN - 1))).alias("bin"))
    time = F.greatest(F.lit(0.0), F.least(F.col("m") + (k + 1) * B_MIN, F.lit(float(CLOSE))) - F.greatest(F.col("m") + k * B_MIN, F.lit(float(OPEN))))
    return each.groupBy("bin").agg(F.count("*").alias("metaorders"), F.round(F.sum(time), 4).alias("minutes"))


@R.add(f"""
with {facts_sql('impact_1m', 'impact_60m')}
select flow, day, count(*) as n, round(sum(impact_60m) / nullif(sum(impact_1m), 0), 6) + 0.0 as retention
from fact where flow is not null and impact_1m is not null and impact_60m is not null group by all""")
def r07_retention(spark, sf_dir):
    """Impact left after an hour, as a ratio of sums per flow and day."""
    rows = facts(spark, sf_dir, "impact_1m", "impact_60m").filter("flow is not null and impact_1m is not null and impact_60m is not null")
    return rows.groupBy("flow", "day").agg(
        F.count("*").alias("n"), (F.round(F.try_divide(F.sum("impact_60m"), F.sum("impact_1m")), 6) + 0.0).alias("retention")
    )


@R.add(f"""
with {facts_sql()}, {NATIONALITY_SQL},
c as (select isin, nationality, count(*) as n from fact f join nat using (member_id) where nationality is not null group by all)
select isin, nationality as majority, n, count(*) over (partition by isin) > 1 as mixed from c
qualify row_number() over (partition by isin order by n desc, nationality) = 1""")
def m11_majority_nationality(spark, sf_dir):
    """The nationality of most metaorders of an ISIN, the alphabetically first one at a tie, and whether there are several."""
    rows = facts(spark, sf_dir).join(F.broadcast(nationality(spark, sf_dir).filter("nationality is not null")), "member_id")
    c = rows.groupBy("isin", "nationality").agg(F.count("*").alias("n"))
    w = Window.partitionBy("isin")
    return (
        c.withColumns({"mixed": F.count("*").over(w) > 1, "_k": F.row_number().over(w.orderBy(F.desc("n"), "nationality"))})
        .filter("_k = 1")
        .select("isin", F.col("nationality").alias("majority"), "n", "mixed")
    )


STEPS = [500, 1000, 2000, 4000]


@R.add(f"""
with {TAPE_SQL}, st as (select unnest({STEPS}) as step),
l as (select step, day, t // (step::bigint * 1000000) as interval, arg_max(price, (t, row_id)) as price from tape, st group by all),
r as (select step, day, ln(price) - lag(ln(price)) over (partition by step, day order by interval) as r from l where price > 0),
v as (select step, day, sqrt(sum(r * r)) as rv from r group by all having count(r) > 0)
select step::int as step, count(*) as days, round(avg(rv), 6) as mean, round(stddev_samp(rv) / sqrt(count(*)), 6) as se from v group by step""")
def a05_signature(spark, sf_dir):
    """Mean realised volatility and its error for four sampling intervals in seconds."""
    return _signature(spark, sf_dir, F.array(*[F.lit(x) for x in STEPS])).select("step", "days", "mean", "se")


def _signature(spark, sf_dir, steps):
    """Means and errors of realised and bipower volatility over days, per sampling interval: prices at the ends of seconds are made once and
    sampled anew for each interval."""
    seconds = last_per_interval(tape(spark, sf_dir), ["isin", "day"], "t", "row_id", "price", 1_000_000).withColumnRenamed("interval", "second")
    each = seconds.withColumn("step", F.explode(steps.cast("array<int>")))
    key = ["step", "isin", "day"]
    sampled = each.groupBy(*key, F.expr("second div step").alias("interval")).agg(F.max_by("price", "second").alias("price"))
    v = realised(sampled, key, "interval", "price").filter("n_returns > 0")
    error = lambda c: F.round(F.stddev_samp(c) / F.sqrt(F.count("*")), 6)
    return v.groupBy("step").agg(
        F.count("*").alias("days"), F.round(F.avg("realised"), 6).alias("mean"), error("realised").alias("se"), F.round(F.avg("bipower"), 6).alias("mean_bipower"), error("bipower").alias("se_bipower")
    )


@R.add(f"""
with {TAPE_SQL}, st as (select unnest(range(1, 2000, 20)) as step),
s as (select isin, day, t // 1000000 as second, arg_max(price, (t, row_id)) as price from tape group by all),
l as (select step, isin, day, second // step as interval, arg_max(price, second) as price from s, st group by all),
r as (select step, isin, day, interval, ln(price) - lag(ln(price)) over (partition by step, isin, day order by interval) as r from l where price > 0),
b as (select *, abs(r) * abs(lag(r) over (partition by step, isin, day order by interval)) as b from r),
v as (select step, isin, day, sqrt(sum(r * r)) as rv, sqrt(sum(b) * 1.5707963267948966) as bv from b group by all having count(r) > 0)
select step::int as step, count(*) as days, round(avg(rv), 6) as mean, round(stddev_samp(rv) / sqrt(count(*)), 6) as se,
       round(avg(bv), 6) as mean_bipower, round(stddev_samp(bv) / sqrt(count(*)), 6) as se_bipower from v group by step""")
def a05_signature_plot(spark, sf_dir):
    """Mean realised and bipower volatility and their errors for the 100 sampling intervals 1, 21, ... 1981 seconds."""
    return _signature(spark, sf_dir, F.sequence(F.lit(1), F.lit(1999), F.lit(20)))


@R.add(r"""
with m as (select distinct member_id from summary), raw as (select distinct nullif(regexp_replace(member_id, '^[\s]+|[\s]+$', '', 'g'), '') as t from overlap),
o as (select distinct case when regexp_full_match(t, '[+-]?[0-9]{1,30}([.]0{0,8})?') then cast(cast(t as decimal(38, 8)) as decimal(30, 0))::varchar else t end as member_id
      from raw where t is not null)
select coalesce(m.member_id, o.member_id) as member_id, m.member_id is not null as in_summary, o.member_id is not null as in_overlap from m full join o using (member_id)""")
def t05_member_sets(spark, sf_dir):
    """All members, and in which of the two tables they are."""
    one = lambda df, a, b: df.distinct().select("member_id", F.lit(a).alias("in_summary"), F.lit(b).alias("in_overlap"))
    m = one(table(spark, sf_dir, "summary").select("member_id"), True, False)
    o = one(table(spark, sf_dir, "overlap").select(canonical_id(F.col("member_id")).alias("member_id")).filter("member_id is not null"), False, True)
    return m.unionByName(o).groupBy("member_id").agg(F.bool_or("in_summary").alias("in_summary"), F.bool_or("in_overlap").alias("in_overlap"))


@R.add(f"""
with {facts_sql('q_over_v', 'participation_rate', 'impact')}
select count(*) as metaorders, count(*) filter (flow is null) as no_flow, count(*) filter (start_us is null or end_us is null) as no_times,
       count(*) filter (end_us < start_us) as reversed, count(*) filter (q_over_v > 1e-5 and impact is not null) as fit_ready,
       count(*) filter (q_over_v > 1e-5 and impact is not null and participation_rate < 1) as under_cap, count(distinct isin) as isins, count(distinct day) as days
from fact""")
def a45_diagnostics(spark, sf_dir):
    """How many metaorders each filter leaves."""
    n = lambda e: F.count(F.when(F.expr(e), 1))
    ready = "q_over_v > 1e-5 and impact is not null"
    return facts(spark, sf_dir, "q_over_v", "participation_rate", "impact").agg(
        F.count("*").alias("metaorders"), n("flow is null").alias("no_flow"), n("start_us is null or end_us is null").alias("no_times"), n("end_us < start_us").alias("reversed"),
        n(ready).alias("fit_ready"), n(ready + " and participation_rate < 1").alias("under_cap"), F.count_distinct("isin").alias("isins"), F.count_distinct("day").alias("days"),
    )


def _cells(rows):
    rows = rows.withColumn("bin", bins.bin_left(F.col("q_over_v"), QV)).filter("bin is not null and flow is not null")
    cells = rows.groupBy("flow", "bin").agg(F.count("*").alias("n"), F.avg("impact").alias("m"), (F.stddev_samp("impact") / F.sqrt(F.count("*"))).alias("sem"))
    e = F.array(*[F.lit(v) for v in QV])
    x = F.sqrt(F.element_at(e, F.col("bin") + 1) * F.element_at(e, F.col("bin") + 2))
    return cells.filter("n >= 20 and sem > 0").select("flow", x.alias("x"), F.col("m").alias("y"), (1 / (F.col("sem") * F.col("sem"))).alias("w"))


@R.add(f"""
with {FIT_SQL},
p as (select flow, sqrt(list_extract({[float(e) for e in QV]}, (bin + 1)::bigint) * list_extract({[float(e) for e in QV]}, (bin + 2)::bigint)) as x, m as y, 1 / (sem * sem) as w
      from cells where sem > 0),
b as (select pow(10, unnest(range(0, 121)) / 20.0) as b),
f as (select flow, b, sum(w * y * log10(1 + b * x)) / sum(w * log10(1 + b * x) * log10(1 + b * x)) as a, sum(w * y * y) as yy, sum(w * y * log10(1 + b * x)) as yf from p, b group by all),
k as (select *, yy - a * yf as sse from f)
select flow, round(log10(arg_min(b, sse)), 4) + 0.0 as log10_b, round(arg_min(a, sse), 5) + 0.0 as a from k group by flow""")
def g02_log_curve(spark, sf_dir):
    """a log10(1 + b x) through the impact curve: a in closed form for each b of a grid (20 a decade), the b of least weighted error."""
    p = _cells(_fit_ready(spark, sf_dir)).withColumn("b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(120)), lambda i: F.pow(F.lit(10.0), i / 20.0))))
    g = F.log10(1 + F.col("b") * F.col("x"))
    s = p.groupBy("flow", "b").agg(F.sum(F.col("w") * F.col("y") * g).alias("yf"), F.sum(F.col("w") * g * g).alias("ff"), F.sum(F.expr("w * y * y")).alias("yy"))
    s = s.withColumn("a", F.expr("yf / ff")).withColumn("sse", F.expr("yy - a * yf"))
    return s.groupBy("flow").agg((F.round(F.log10(F.min_by("b", "sse")), 4) + 0.0).alias("log10_b"), (F.round(F.min_by("a", "sse"), 5) + 0.0).alias("a"))


@R.add(f"""
with {facts_sql()}, x as (select flow, q from fact where flow is not null and q >= 1000),
s as (select flow, count(*) as n, sum(ln(q / 1000)) as l, sum(q - 1000) as d from x group by flow)
select flow, n, round(1 + n / l, 6) as alpha, round(n / d, 9) as rate, round(n * ln(n / l / 1000) - (1 + n / l) * l, 3) as ll_power, round(n * ln(n / d) - n, 3) as ll_exponential
from s where n > 1""")
def g16_tail_models(spark, sf_dir):
    """Power law and exponential for sizes from 1,000 on: estimates and log-likelihoods from sums."""
    x = facts(spark, sf_dir).filter("flow is not null and q >= 1000").groupBy("flow").agg(
        F.count("*").alias("n"), F.sum(F.ln(F.col("q") / 1000)).alias("l"), F.sum(F.col("q") - 1000).alias("d")
    )
    r = lambda e, k, name: F.round(F.expr(e), k).alias(name)
    return x.filter("n > 1").select(
        "flow", "n", r("1 + n / l", 6, "alpha"), r("n / d", 9, "rate"), r("n * ln(n / l / 1000) - (1 + n / l) * l", 3, "ll_power"), r("n * ln(n / d) - n", 3, "ll_exponential")
    )


@R.add()
def g06_g10_cell_regression(spark, sf_dir):
    """ln mean impact of the curve's bins on ln Q/V and flow, weighted by the bins' precision, errors by bin."""
    c = _cells(_fit_ready(spark, sf_dir)).filter("y > 0")
    c = c.select(F.ln("y").alias("ln_y"), F.ln("x").alias("ln_x"), (F.col("flow") == "proprietary").cast("int").alias("proprietary"), (F.col("w") * F.col("y") * F.col("y")).alias("w"), "x")
    return models.least_squares(c, "ln_y", ["ln_x", "proprietary"], "x", "w")


@R.add(f"""
with {facts_sql('q_over_v', 'impact', 'participation_rate')},
cells as (select isin, day, sum(q * direction) as s, sum(q) as v from fact group by all),
l as (select f.*, direction * (s - q * direction) / (v - q) as align from fact f join cells using (isin, day) where v - q > 1e-9 * v),
x as (select * from l where q_over_v > 1e-5 and impact > 0),
e as (select list_sort(quantile_cont(align, [0.3333333333333333, 0.6666666666666666])) as c from x),
k as (select case when align <= c[1] then 'low' when align <= c[2] then 'middle' else 'high' end as crowding, ln(q_over_v) as a, ln(impact) as b from x, e)
select crowding, count(*) as n, round(regr_slope(b, a), 5) + 0.0 as gamma, round(exp(regr_intercept(b, a) + regr_slope(b, a) * ln(1e-3)), 6) as at_benchmark from k group by crowding""")
def g08_impact_by_crowding(spark, sf_dir):
    """Exponent and level at Q/V = 0.001 of positive impacts, per third of the alignment with the others."""
    from orderloom.operators.crowding import leave_one_out
    from orderloom.plans.crowding_queries import CELL

    rows = leave_one_out(facts(spark, sf_dir, "q_over_v", "impact"), CELL, "q", "direction").filter("imbalance is not null and q_over_v > 1e-5 and impact > 0")
    rows = rows.select((F.col("direction") * F.col("imbalance")).alias("align"), F.ln("q_over_v").alias("a"), F.ln("impact").alias("b"))
    rows = written(rows, "aligned")
    thirds = quantiles(rows, [], ["align"], [0.3333333333333333, 0.6666666666666666]).first()
    lo, hi = thirds["q_align"] if thirds else (0.0, 0.0)
    kind = F.when(F.col("align") <= lo, "low").when(F.col("align") <= hi, "middle").otherwise("high")
    s = rows.groupBy(kind.alias("crowding")).agg(F.count("*").alias("n"), F.regr_slope("b", "a").alias("g"), F.regr_intercept("b", "a").alias("c"))
    return s.select("crowding", "n", (F.round("g", 5) + 0.0).alias("gamma"), F.round(F.exp(F.col("c") + F.col("g") * F.ln(F.lit(1e-3))), 6).alias("at_benchmark"))
