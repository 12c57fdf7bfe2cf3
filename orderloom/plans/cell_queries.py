"""Surfaces, transforms, selections and samples of metaorders; the realised kernel of the tape."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.times import DAY_US
from orderloom.operators import models, resampling
from orderloom.operators import tape as tape_ops
from orderloom.operators.ranks import quantiles
from orderloom.plans.crowding_queries import facts, facts_sql
from orderloom.plans.record_queries import market
from orderloom.plans.registry import Registry
from orderloom.sources.tables import written

R = Registry()

PER_DECADE = 3  # log bins
LEAST = 20  # rows of a cell


CELLS_SQL = f"""{facts_sql('q_over_v', 'participation_rate', 'impact')},
x as (select floor(log10(q_over_v) * {PER_DECADE}) as i, floor(log10(participation_rate) * {PER_DECADE}) as j, impact from fact where q_over_v > 0 and participation_rate > 0 and impact is not null),
cell as (select i, j, count(*) as n, avg(impact) as m, (i + 0.5) / {PER_DECADE} * ln(10) as a, (j + 0.5) / {PER_DECADE} * ln(10) as b from x group by i, j
         having count(*) >= {LEAST} and avg(impact) > 0)"""


def cells(spark, sf_dir):
    """Mean impact of each cell of log bins of Q/V and participation that has enough rows and a positive mean."""
    x = facts(spark, sf_dir, "q_over_v", "participation_rate", "impact").filter("q_over_v > 0 and participation_rate > 0 and impact is not null")
    of = lambda c: F.floor(F.log10(c) * PER_DECADE)
    c = x.groupBy(of("q_over_v").alias("i"), of("participation_rate").alias("j")).agg(F.count("*").alias("n"), F.avg("impact").alias("m")).filter(f"n >= {LEAST} and m > 0")
    centre = lambda k: (F.col(k) + 0.5) / PER_DECADE * F.ln(F.lit(10.0))
    return c.select("i", "j", "n", "m", centre("i").alias("a"), centre("j").alias("b"))


@R.add(f"""
with {CELLS_SQL},
s as (select count(*) as cells, sum(n)::double as w, sum(n * a) as a, sum(n * b) as b, sum(n * a * a) as aa, sum(n * a * b) as ab, sum(n * b * b) as bb, sum(n * ln(m)) as y,
             sum(n * a * ln(m)) as ay, sum(n * b * ln(m)) as cy from cell),
c as (select cells, y / w as my, a / w as ma, b / w as mb, aa - a * a / w as saa, ab - a * b / w as sab, bb - b * b / w as sbb, ay - a * y / w as say, cy - b * y / w as sby from s),
f as (select *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) as delta, (saa * sby - sab * say) / (saa * sbb - sab * sab) as gamma from c)
select cells, round(exp(my - delta * ma - gamma * mb), 6) as level, round(delta, 6) + 0.0 as delta, round(gamma, 6) + 0.0 as gamma from f""")
def g03_power_surface(spark, sf_dir):
    """Impact as level x (Q/V)^delta x participation^gamma, by weighted least squares of the cells' logarithms."""
    c = written(cells(spark, sf_dir).select("a", "b", F.ln("m").alias("y"), F.col("n").cast("double").alias("n"), F.concat_ws("|", "i", "j").alias("cell")), "cells")
    got = models.least_squares(c, "y", ["a", "b"], "cell", "n")
    at = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate")))
    return got.agg(
        F.max("n").alias("cells"), F.round(F.exp(at("const")), 6).alias("level"), (F.round(at("a"), 6) + 0.0).alias("delta"), (F.round(at("b"), 6) + 0.0).alias("gamma")
    ).filter("cells is not null")


LOG_GRID = [10 ** (k / 4) for k in range(0, 25)]  # what Q/V is multiplied by in the logarithm


@R.add(f"""
with {CELLS_SQL},
g as (select unnest({LOG_GRID!r}::double[]) as k),
v as (select k, n, m, ln(1 + k * exp(a)) as u, b from cell, g),
s as (select k, sum(n * u * exp(b / 2) * m) as um, sum(n * u * u * exp(b)) as uu, sum(n * m * m) as mm from v group by k),
e as (select k, um / uu as level, mm - um * um / uu as sse, row_number() over (order by round((mm - um * um / uu) / mm, 10), k) as place from s)
select round(k, 6) as k, round(level, 7) + 0.0 as level, round(sse, 7) as sse from e where place = 1""")
def g04_log_surface(spark, sf_dir):
    """Impact as level x ln(1 + k Q/V) x the root of participation: the level by weighted sums for each k of a grid, the k of the least error."""
    c = cells(spark, sf_dir).withColumn("k", F.explode(F.array(*[F.lit(x) for x in LOG_GRID])))
    c = c.select("k", "n", "m", F.ln(1 + F.col("k") * F.exp("a")).alias("u"), "b")
    s = c.groupBy("k").agg(
        F.sum(F.expr("n * u * exp(b / 2) * m")).alias("um"), F.sum(F.expr("n * u * u * exp(b)")).alias("uu"), F.sum(F.expr("n * m * m")).alias("mm")
    ).withColumns({"level": F.expr("um / uu"), "sse": F.expr("mm - um * um / uu")})
    best = s.agg(F.min_by(F.struct("k", "level", "sse"), F.struct(F.round(F.col("sse") / F.col("mm"), 10), "k")).alias("x"))
    return best.select(F.round("x.k", 6).alias("k"), (F.round("x.level", 7) + 0.0).alias("level"), F.round("x.sse", 7).alias("sse")).filter("k is not null")


@R.add(f"""
with {facts_sql('impact', 'q_over_v', 'participation_rate')},
x as (select floor(log10(q_over_v) * 2)::int as i, floor(log10(participation_rate) * 2)::int as j, direction, flow, impact from fact
      where q_over_v > 0 and participation_rate > 0 and impact is not null and flow is not null)
select flow, i, j, direction, count(*) as n, round(avg(impact), 10) + 0.0 as mean_impact, round(stddev_samp(impact), 7) as sd from x group by all having count(*) >= 5""")
def a33_cells_3d(spark, sf_dir):
    """Mean impact per flow in cells of size, participation and direction."""
    x = facts(spark, sf_dir, "impact", "q_over_v", "participation_rate").filter("q_over_v > 0 and participation_rate > 0 and impact is not null and flow is not null")
    of = lambda c: F.floor(F.log10(c) * 2).cast("int")
    c = x.groupBy("flow", of("q_over_v").alias("i"), of("participation_rate").alias("j"), "direction")
    return c.agg(F.count("*").alias("n"), (F.round(F.avg("impact"), 10) + 0.0).alias("mean_impact"), F.round(F.stddev_samp("impact"), 7).alias("sd")).filter("n >= 5")


@R.add(f"""
with {facts_sql('impact', 'q_over_v')},
e as (select quantile_cont(impact, [0.01, 0.99]) as ci, quantile_cont(q_over_v, [0.01, 0.99]) as cq from fact where impact is not null and q_over_v >= 0)
select metaorder_id, round(asinh(least(greatest(impact, ci[1]), ci[2])), 8) + 0.0 as asinh_impact, round(ln(1 + least(greatest(q_over_v, cq[1]), cq[2])), 8) + 0.0 as log1p_qv
from fact, e where impact is not null and q_over_v >= 0""")
def p04_p23_winsorised(spark, sf_dir):
    """Impact and Q/V, cut to their 1st and 99th percentile, on an asinh and a log1p scale."""
    rows = facts(spark, sf_dir, "impact", "q_over_v").filter("impact is not null and q_over_v >= 0")
    cut = quantiles(rows, [], ["impact", "q_over_v"], [0.01, 0.99]).first()
    if not cut:
        return rows.select("metaorder_id", F.lit(0.0).alias("asinh_impact"), F.lit(0.0).alias("log1p_qv"))
    within = lambda c: F.least(F.greatest(F.col(c), F.lit(cut[f"q_{c}"][0])), F.lit(cut[f"q_{c}"][1]))
    return rows.select("metaorder_id", (F.round(F.asinh(within("impact")), 8) + 0.0).alias("asinh_impact"), (F.round(F.log1p(within("q_over_v")), 8) + 0.0).alias("log1p_qv"))


@R.add(f"""
with {facts_sql()},
v as (select flow, isin, sum(q) as q from fact where flow is not null group by all),
s as (select *, 100 * q / sum(q) over (partition by flow) as pct, sum(q) over (partition by flow order by q desc, isin rows unbounded preceding) / sum(q) over (partition by flow) as upto from v)
select flow, isin, round(pct, 7) as pct, round(upto, 9) as upto from s where upto - pct / 100 < 0.8 - 1e-9""")
def p24_w10_contribution(spark, sf_dir):
    """The largest ISINs of each flow that together make up 80 % of its volume, with their shares."""
    v = facts(spark, sf_dir).filter("flow is not null").groupBy("flow", "isin").agg(F.sum("q").alias("q"))
    w = Window.partitionBy("flow")
    whole = F.sum("q").over(w)
    upto = F.sum("q").over(w.orderBy(F.col("q").desc(), "isin").rowsBetween(Window.unboundedPreceding, 0))
    s = v.withColumns({"pct": 100 * F.col("q") / whole, "upto": upto / whole}).filter(F.col("upto") - F.col("pct") / 100 < 0.8 - 1e-9)
    return s.select("flow", "isin", F.round("pct", 7).alias("pct"), F.round("upto", 9).alias("upto"))


@R.add(f"""
with {facts_sql()}
select metaorder_id, day, {resampling.hashed_sql('7', 'day')} % 2 = 0 as day_kept from fact where {resampling.hashed_sql('0', 'metaorder_id')} % 10 = 0""")
def t07_bernoulli_sample(spark, sf_dir):
    """Each metaorder with odds of one in ten by a hash of its id, and whether its day is in a sample of half the days."""
    rows = facts(spark, sf_dir).filter(resampling.hashed(F.lit(0), F.col("metaorder_id")) % 10 == 0)
    return rows.select("metaorder_id", "day", (resampling.hashed(F.lit(7), F.col("day")) % 2 == 0).alias("day_kept"))


@R.add(f"""
with {facts_sql()},
d as (select isin, day, sum(q * direction) / sum(q) as x from fact group by all),
m as (select *, x - avg(x) over (partition by isin) as c, count(*) over (partition by isin) as n from d),
l as (select *, lag(c) over (partition by isin order by day) as c1 from m where n > 5),
a as (select isin, max(n) as n, sum(c * c1) / nullif(sum(c * c), 0) as r from l group by isin)
select isin, n, round(1.959963984540054 / sqrt(n), 8) as band, round(r, 6) + 0.0 as acf_1, abs(r) > 1.959963984540054 / sqrt(n) as beyond from a""")
def b12_noise_band(spark, sf_dir):
    """First autocorrelation of an ISIN's daily signed share, and whether it is beyond the band of white noise."""
    d = facts(spark, sf_dir).groupBy("isin", "day").agg((F.sum(F.col("q") * F.col("direction")) / F.sum("q")).alias("x"))
    w, o = Window.partitionBy("isin"), Window.partitionBy("isin").orderBy("day")
    m = d.withColumns({"c": F.col("x") - F.avg("x").over(w), "n": F.count("*").over(w)}).filter("n > 5").withColumn("c1", F.lag("c").over(o))
    a = m.groupBy("isin").agg(F.max("n").alias("n"), F.try_divide(F.sum(F.col("c") * F.col("c1")), F.sum(F.col("c") * F.col("c"))).alias("r"))
    band = F.lit(1.959963984540054) / F.sqrt("n")
    return a.select("isin", "n", F.round(band, 8).alias("band"), (F.round("r", 6) + 0.0).alias("acf_1"), (F.abs("r") > band).alias("beyond"))


BAR = 120_000_000  # two minutes


@R.add(f"""
with market as (select 'X' || (user_id % 3)::varchar as isin, event_id as row_id, epoch_us(ts::timestamp) as t, value + 1 as price, value as q, epoch_us(ts::timestamp) // {DAY_US} as day from events),
bar as (select isin, day, t // {BAR} as i, arg_max(price, (t, row_id)) as p from market where price > 0 group by all),
ends as (select isin, day, min(i) as i0, max(i) as i1 from bar group by all),
grid as (select isin, day, unnest(range(i0, i1 + 1)) as i from ends),
full_ as (select isin, day, i, last_value(p ignore nulls) over (partition by isin, day order by i rows unbounded preceding) as p from grid left join bar using (isin, day, i)),
r as (select isin, day, i, ln(p) - lag(ln(p)) over (partition by isin, day order by i) as r from full_),
n as (select isin, day, count(r) as n, sum(r * r) as variance, floor(pow(count(r), 0.6666666666666666::double)) as h from r group by all having count(r) >= 3),
c as (select a.isin, a.day, b.i - a.i as lag, any_value(h) as h, sum(a.r * b.r) as g from r a join n using (isin, day) join r b on a.isin = b.isin and a.day = b.day and b.i - a.i between 1 and h
      where a.r is not null and b.r is not null group by all),
k as (select isin, day, sum(2 * g * case when lag / h <= 0.5 then 1 - 6 * pow(lag / h, 2) + 6 * pow(lag / h, 3) else 2 * pow(1 - lag / h, 3) end) as cross_ from c group by all),
v as (select isin, day, sum(q) as volume from market group by all)
select isin, day, n as n_returns, round(volume, 4) as volume, round(variance, 6) as variance, round(variance + coalesce(cross_, 0), 6) + 0.0 as kernel,
       round(pow(greatest(variance + coalesce(cross_, 0), 0), 0.25), 6) as daily_vol from n left join k using (isin, day) join v using (isin, day)""")
def a02_a04_w07_daily_cache(spark, sf_dir):
    """Volume and volatility per ISIN and day: the realised kernel (Parzen weights up to lag n^(2/3)) of last prices on a grid of two
    minutes filled forward, and its double root."""
    t = market(spark, sf_dir)
    last = tape_ops.last_per_interval(t.filter("price > 0"), ["isin", "day"], "t", "row_id", "price", BAR)
    full = tape_ops.filled_grid(last, ["isin", "day"], "interval", "price")
    volume = t.groupBy("isin", "day").agg(F.round(F.sum("q"), 4).alias("volume"))
    got = tape_ops.realised_kernel(full, ["isin", "day"], "interval", "price").join(volume, ["isin", "day"])
    return got.select(
        "isin", "day", "n_returns", "volume", F.round("variance", 6).alias("variance"), (F.round("kernel", 6) + 0.0).alias("kernel"),
        F.round(F.pow(F.greatest(F.col("kernel"), F.lit(0.0)), 0.25), 6).alias("daily_vol"),
    )


@R.add(f"""
with market as (select 'X' || (user_id % 3)::varchar as isin, event_id as row_id, epoch_us(ts::timestamp) as t, value + 1 as price, (user_id // 3) % 4 as member, value as q,
                       case when event_type in ('click', 'view') then 1 else -1 end as sign, epoch_us(ts::timestamp) // {DAY_US} as day from events),
c as (select isin, day, arg_max(price, (t, row_id)) as p from market where price > 0 group by all),
r as (select isin, day, ln(p) - lag(ln(p)) over (partition by isin order by day) as daily_return from c),
m as (select isin, member, day, sum(q * sign) / sum(q) as imbalance from market group by all)
select isin, member, day, round(imbalance, 9) + 0.0 as imbalance, round(daily_return, 9) + 0.0 as daily_return from m left join r using (isin, day)""")
def j08_return_attach(spark, sf_dir):
    """Each member's daily signed share in an ISIN beside the ISIN's return of the day."""
    t = market(spark, sf_dir)
    close = t.filter("price > 0").groupBy("isin", "day").agg(F.max_by("price", F.struct("t", "row_id")).alias("p"))
    r = close.select("isin", "day", (F.ln("p") - F.lag(F.ln("p")).over(Window.partitionBy("isin").orderBy("day"))).alias("daily_return"))
    m = t.groupBy("isin", "member", "day").agg((F.sum(F.col("q") * F.col("sign")) / F.sum("q")).alias("imbalance"))
    nine = lambda c: (F.round(c, 9) + 0.0).alias(c)
    return m.join(r, ["isin", "day"], "left").select("isin", "member", "day", nine("imbalance"), nine("daily_return"))


GRID = 50  # points on either side of 0


@R.add(f"""
with {facts_sql()},
d as (select flow, sum(q * direction) / sum(q) as x from fact where flow is not null group by flow, isin, day),
s as (select flow, count(*) as n, stddev_samp(x) * pow(count(*), -0.2) as h from d group by flow having count(*) >= 2 and stddev_samp(x) > 0),
g as (select unnest(range({-GRID}, {GRID + 1})) as i)
select d.flow, i::int as point, round(avg(exp(-0.5 * pow((i / {GRID}.0 - x) / h, 2))) / max(h) / sqrt(2 * pi()), 8) as density
from d join s using (flow), g group by d.flow, i""")
def a43_kernel_density(spark, sf_dir):
    """Gaussian kernel density (Scott's width) of the signed share of each ISIN's day, per flow, at 101 points from -1 to 1.

    The kernel runs over ISIN-days, of which there are days times ISINs, not over metaorders.
    """
    d = facts(spark, sf_dir).filter("flow is not null").groupBy("flow", "isin", "day").agg((F.sum(F.col("q") * F.col("direction")) / F.sum("q")).alias("x"))
    d = written(d.select("flow", "x"), "shares")
    s = d.groupBy("flow").agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd")).filter("n >= 2 and sd > 0").select("flow", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h"))
    each = d.join(F.broadcast(s), "flow").withColumn("point", F.explode(F.sequence(F.lit(-GRID), F.lit(GRID))))
    z = (F.col("point") / float(GRID) - F.col("x")) / F.col("h")
    mean = F.avg(F.exp(-0.5 * z * z)) / F.max("h") / F.sqrt(2 * F.pi())
    return each.groupBy("flow", "point").agg(F.round(mean, 8).alias("density"))


LEAST_SECONDS, LEAST_QV, CAP = 60, 1e-5, 1.0
_STAGES = {
    "long_enough": f"end_us - start_us >= {LEAST_SECONDS * 1_000_000}",
    "large_enough": f"q_over_v > {LEAST_QV}",
    "under_cap": f"participation_rate < {CAP}",
    "kept": "price_change * direction / nullif(daily_vol, 0) is not null",
}


def _upto(stage: str) -> str:
    names = list(_STAGES)
    return " and ".join(_STAGES[n] for n in names[: names.index(stage) + 1])


@R.add(f"""
with {facts_sql('q_over_v', 'participation_rate', 'price_change', 'daily_vol')}
select flow, direction, count(*) as metaorders, {', '.join(f"count(*) filter ({_upto(n)}) as {n}" for n in _STAGES)},
       round(avg(price_change * direction / nullif(daily_vol, 0)) filter ({_upto('kept')}), 8) + 0.0 as mean_impact
from fact where flow is not null group by all""")
def f04_overlay_sample(spark, sf_dir):
    """What a sample's filters leave one after the other, per flow and side: duration, size, participation, and a known impact; and its mean impact."""
    rows = facts(spark, sf_dir, "q_over_v", "participation_rate", "price_change", "daily_vol").filter("flow is not null")
    impact = F.expr("price_change * direction / nullif(daily_vol, 0)")
    counts = [F.count(F.when(F.expr(_upto(n)), 1)).alias(n) for n in _STAGES]
    return rows.groupBy("flow", "direction").agg(
        F.count("*").alias("metaorders"), *counts, (F.round(F.avg(F.when(F.expr(_upto("kept")), impact)), 8) + 0.0).alias("mean_impact")
    )
