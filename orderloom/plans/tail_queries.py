"""Tails of sizes and child orders: where they begin, which models they follow, and by how much."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.tails import two_sided_normal_sql
from orderloom.operators import models
from orderloom.operators.tail_models import power_density, power_survival, tail_models
from orderloom.plans.crowding_queries import facts, facts_sql
from orderloom.plans.registry import Registry
from orderloom.sources.tables import written

R = Registry()

KEY = ["flow", "metric"]


def sizes(spark, sf_dir):
    """flow, metric (q or n_child) and x."""
    rows = facts(spark, sf_dir, "n_child").filter("flow is not null")
    long = rows.select("flow", F.col("q").alias("q"), F.col("n_child").cast("double").alias("n_child")).unpivot("flow", ["q", "n_child"], "metric", "x")
    return long.filter("x is not null")


TAIL_SQL = f"""{facts_sql()},
tx as (select flow, 'q' as metric, q as x from fact where flow is not null
       union all select f.flow, 'n_child', m.n_child::double from fact f join mo m using (row_id) where f.flow is not null and m.n_child > 0),
td as (select distinct * from (
       select flow, metric, x, count(*) over (partition by flow, metric order by x desc) as tail, count(*) over (partition by flow, metric) as n from tx)),
cls as (select *, floor(ln(tail) * 40 / ln(n)) as k, floor(ln(tail) * 200 / ln(n)) as j from td),
cand as (select flow, metric, max(x) as xmin, arg_max(tail, x) as many from cls group by flow, metric, k having arg_max(tail, x) >= 50),
pts as (select flow, metric, max(x) as x, arg_max(tail, x) as from_x from cls group by flow, metric, j),
fit as (select c.flow, c.metric, c.xmin, c.many as tail, 1 + c.many / sum(ln(t.x / c.xmin)) as alpha
        from cand c join tx t on t.flow = c.flow and t.metric = c.metric and t.x >= c.xmin group by c.flow, c.metric, c.xmin, c.many),
apart as (select f.flow, f.metric, f.xmin, f.tail, f.alpha, max(abs(p.from_x / f.tail - pow(p.x / f.xmin, 1 - f.alpha))) as ks
          from fit f join pts p on p.flow = f.flow and p.metric = f.metric and p.x >= f.xmin group by all),
tail as (select flow, metric, xmin, alpha, tail as n_tail, ks from apart qualify row_number() over (partition by flow, metric order by ks, xmin) = 1)"""


@R.add(f"with {TAIL_SQL} select flow, metric, xmin, round(alpha, 6) as alpha, n_tail, round(ks, 7) as ks from tail")
def g13_power_law_tail(spark, sf_dir):
    """Power-law tail of the size and the number of child orders per flow."""
    got = models.power_law_tail(sizes(spark, sf_dir), KEY, "x")
    return got.select(*KEY, "xmin", F.round("alpha", 6).alias("alpha"), "n_tail", F.round("ks", 7).alias("ks"))


def fits(spark, sf_dir):
    x = written(sizes(spark, sf_dir), "sizes")
    tails = written(models.power_law_tail(x, KEY, "x"), "tails")
    return x, tails


@R.add()
def g16_tail_fits(spark, sf_dir):
    """Four models of each tail: parameters, log-likelihood, AIC, BIC, the best of them, and the likelihood ratio test against the power law."""
    x, tails = fits(spark, sf_dir)
    return tail_models(x, tails, KEY, "x")


@R.add(f"""
with {TAIL_SQL},
y as (select t.flow, t.metric, t.xmin, ln(x / xmin) as y, x / xmin - 1 as u from tail t join tx on tx.flow = t.flow and tx.metric = t.metric and tx.x >= t.xmin),
s as (select flow, metric, xmin, count(*) as n, avg(y) as my, avg(u) as mu from y group by all),
d as (select flow, metric, avg(d) as m, stddev_pop(d) as s from (
        select y.flow, y.metric, -y / my - ln(my) - (y - u / mu - ln(mu)) as d from y join s on s.flow = y.flow and s.metric = y.metric) group by all),
e as (select s.*, n * (-1 - ln(my) - my - ln(xmin)) as lp, n * (-1 - ln(mu) - ln(xmin)) as le, d.m * sqrt(n) / d.s as z from s join d on d.flow = s.flow and d.metric = s.metric)
select flow, metric, 'power_law' as model, n as n_tail, round(lp, 3) as ll, round(2 - 2 * lp, 3) as aic, round(ln(n) - 2 * lp, 3) as bic, null::double as z, null::double as p, true as at_least_power from e
union all select flow, metric, 'exponential', n, round(le, 3), round(2 - 2 * le, 3), round(ln(n) - 2 * le, 3), round(z, 5), round({two_sided_normal_sql('z')}, 7) + 0.0, le >= lp from e
union all select flow, metric, unnest(['lognormal', 'truncated_power_law']), n, null, null, null, null, null, true from e""")
def g16_tail_scores(spark, sf_dir):
    """The same, rounded: figures of the models in closed form, and whether each model's likelihood reaches the power law's, as those
    must that have it as a special case."""
    got = g16_tail_fits(spark, sf_dir)
    power = F.max(F.when(F.col("model") == "power_law", F.col("ll"))).over(Window.partitionBy(*KEY))
    closed = F.col("model").isin("power_law", "exponential")
    r = lambda c, k: F.when(closed, F.round(c, k) + 0.0).alias(c)
    return got.withColumn("_power", power).select(
        *KEY, "model", "n_tail", r("ll", 3), r("aic", 3), r("bic", 3), r("z", 5), r("p", 7), (F.col("ll") >= F.col("_power") - 1e-6 * F.abs("_power")).alias("at_least_power")
    )


STEPS = 12  # half octaves


@R.add(f"""
with {TAIL_SQL},
k as (select t.*, xmin * pow(2, i / 2.0) as x from tail t, (select unnest(range(0, {STEPS + 1})) as i))
select k.flow, k.metric, round(k.x, 6) as x, round((alpha - 1) / xmin * pow(k.x / xmin, -alpha), 12) as density, round(pow(k.x / xmin, 1 - alpha), 9) as survival,
       round(count(tx.x) / n_tail, 9) as observed
from k left join tx on tx.flow = k.flow and tx.metric = k.metric and tx.x >= k.x group by k.flow, k.metric, k.x, alpha, xmin, n_tail""")
def g18_density_survival(spark, sf_dir):
    """Density and survival of each fitted power law at half octaves above its xmin, and the share of the tail found there."""
    x, tails = fits(spark, sf_dir)
    edges = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.col("xmin") * F.pow(F.lit(2.0), i / 2.0))
    points = tails.withColumn("edges", edges)
    # the last edge that each row reaches; then counts from above
    at = x.join(F.broadcast(points.select(*KEY, "edges")), KEY).select(*KEY, F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("i")).filter("i > 0")
    counts = at.groupBy(*KEY, "i").agg(F.count("*").alias("n"))
    grid = points.select(*KEY, "xmin", "alpha", "n_tail", F.posexplode("edges").alias("_i", "x")).withColumn("i", F.col("_i") + 1)
    above = Window.partitionBy(*KEY).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    got = grid.join(counts, [*KEY, "i"], "left").withColumn("_n", F.sum(F.coalesce("n", F.lit(0))).over(above))
    c = F.col
    return got.select(
        *KEY, F.round("x", 6).alias("x"), F.round(power_density(c("x"), c("alpha"), c("xmin")), 12).alias("density"),
        F.round(power_survival(c("x"), c("alpha"), c("xmin")), 9).alias("survival"), F.round(c("_n") / c("n_tail"), 9).alias("observed"),
    )
