"""Fits, resampling and clustering of metaorders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.tails import two_sided_normal, two_sided_normal_sql
from orderloom.operators import models
from orderloom.operators.crowding import demeaned, leave_one_out
from orderloom.operators.moments import correlation, correlation_sql, pair_sums
from orderloom.operators.ranks import quantiles
from orderloom.plans.crowding_queries import CELL, LOCAL_SQL, facts, facts_sql
from orderloom.plans.registry import Registry
from orderloom.sources.tables import written

R = Registry()


def _crowded(spark, sf_dir, *more):
    return leave_one_out(facts(spark, sf_dir, *more), CELL, "q", "direction").filter("imbalance is not null")


@R.add(f"""
with {facts_sql()}, {LOCAL_SQL},
s as (select count(*) as n, avg(imbalance) as mx, avg(direction) as my, regr_slope(direction, imbalance) as b, regr_intercept(direction, imbalance) as a
      from local where imbalance is not null)
select 'const' as term, round(a, 6) + 0.0 as estimate, n from s union all select 'imbalance', round(b, 6) + 0.0, n from s""")
def g09_direction_on_imbalance(spark, sf_dir):
    """Direction on the others' imbalance, by sums."""
    got = models.least_squares(_crowded(spark, sf_dir), "direction", ["imbalance"], "day")
    return got.select("term", (F.round("estimate", 6) + 0.0).alias("estimate"), "n")


@R.add(f"""
with {facts_sql()}, {LOCAL_SQL},
x as (select day, imbalance as x, direction::double as y from local where imbalance is not null),
s as (select count(*)::double as n, sum(x) as sx, sum(x * x) as sxx, sum(y) as sy, sum(x * y) as sxy, count(distinct day)::double as g from x),
b as (select *, n * sxx - sx * sx as det, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) as b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b1 from s),
u as (select sum(y - b0 - b1 * x) as u0, sum(x * (y - b0 - b1 * x)) as u1 from x, b group by day),
m as (select sum(u0 * u0) as m00, sum(u0 * u1) as m01, sum(u1 * u1) as m11 from u),
v as (select b.*, (g / (g - 1)) * ((n - 1) / (n - 2)) as f, (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det) as v0,
             (sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (det * det) as v1 from b, m)
select 'const' as term, round(b0, 7) + 0.0 as estimate, round(sqrt(f * v0), 7) as se, round(b0 / sqrt(f * v0), 4) + 0.0 as t, n::bigint as n, g::bigint as clusters from v
union all select 'imbalance', round(b1, 7) + 0.0, round(sqrt(f * v1), 7), round(b1 / sqrt(f * v1), 4) + 0.0, n::bigint, g::bigint from v""")
def g09_g12_clustered(spark, sf_dir):
    """The same with errors clustered by day."""
    got = models.least_squares(_crowded(spark, sf_dir), "direction", ["imbalance"], "day")
    r = lambda c, k: (F.round(c, k) + 0.0).alias(c)
    return got.select("term", r("estimate", 7), r("se", 7), r("t", 4), "n", "clusters")


@R.add(f"""
with {facts_sql('participation_rate')}, {LOCAL_SQL},
x as (select day, direction::double as y, imbalance as a, imbalance * ln(participation_rate) as b from local where imbalance is not null and participation_rate > 0),
w as (select y - avg(y) over o as y, a - avg(a) over o as a, b - avg(b) over o as b from x window o as (partition by day)),
s as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as cy, count(*) as n from w)
select 'imbalance' as term, round((bb * ay - ab * cy) / (aa * bb - ab * ab), 6) + 0.0 as estimate, n from s
union all select 'imbalance_ln_eta', round((aa * cy - ab * ay) / (aa * bb - ab * ab), 6) + 0.0, n from s""")
def g11_within_day_interaction(spark, sf_dir):
    """Direction on the others' imbalance and its product with ln participation, all less their means of the day."""
    rows = _crowded(spark, sf_dir, "participation_rate").filter("participation_rate > 0")
    rows = rows.select("day", F.col("direction").cast("double").alias("y"), F.col("imbalance").alias("a"), (F.col("imbalance") * F.ln("participation_rate")).alias("b"))
    within = demeaned(rows, "day", "y", "a", "b").select("day", F.col("y_within").alias("y"), F.col("a_within").alias("imbalance"), F.col("b_within").alias("imbalance_ln_eta"))
    got = models.least_squares(within, "y", ["imbalance", "imbalance_ln_eta"], "day")
    return got.filter("term <> 'const'").select("term", (F.round("estimate", 6) + 0.0).alias("estimate"), "n")


@R.add()
def g07_g11_pooled_regression(spark, sf_dir):
    """ln |impact| on ln Q/V, ln participation, |imbalance| and flow, with errors clustered by day."""
    rows = _crowded(spark, sf_dir, "q_over_v", "participation_rate", "impact").filter("q_over_v > 0 and participation_rate > 0 and impact <> 0 and flow is not null")
    rows = rows.select(
        "day", F.ln(F.abs("impact")).alias("ln_impact"), F.ln("q_over_v").alias("ln_qv"), F.ln("participation_rate").alias("ln_eta"),
        F.abs("imbalance").alias("abs_imbalance"), (F.col("flow") == "proprietary").cast("int").alias("proprietary"),
    )
    return models.least_squares(rows, "ln_impact", ["ln_qv", "ln_eta", "abs_imbalance", "proprietary"], "day")


@R.add()
def b03_b05_bootstrap(spark, sf_dir):
    """Correlation of direction and imbalance per flow, with an interval over 1,000 resamples of the days."""
    rows = _crowded(spark, sf_dir).filter("flow is not null")
    sums = rows.groupBy("flow", F.col("day").alias("cluster")).agg(*pair_sums(F.col("direction").cast("double"), F.col("imbalance")))
    return models.cluster_bootstrap_correlation(sums, ["flow"])


@R.add()
def b06_within_day_placebo(spark, sf_dir):
    """The same correlation with directions shuffled within each day, 200 times."""
    return models.within_permutation(_crowded(spark, sf_dir), ["day"], "metaorder_id", "direction", "imbalance")


@R.add(f"""
with {facts_sql()}, {LOCAL_SQL},
c as (select flow, member_id, count(imbalance) as n, {correlation_sql('direction', 'imbalance', 30)} as r from local
      where member_id is not null and flow is not null group by all),
t as (select *, {two_sided_normal_sql('z')} as p from (select *, abs(atanh(r)) * sqrt(n - 3) as z from c where r is not null and abs(r) < 1)),
k as (select *, p * count(*) over (partition by flow) / count(*) over (partition by flow order by p) as raw from t)
select flow, member_id, n, round(r, 6) + 0.0 as r, round(p, 9) as p,
       round(least(1.0, min(raw) over (partition by flow order by p desc rows unbounded preceding)), 9) as p_adjusted from k""")
def w09_adjusted_members(spark, sf_dir):
    """Members' correlations with the others, a normal two-sided p (Fisher's z) and its adjusted value."""
    rows = _crowded(spark, sf_dir).filter("member_id is not null and flow is not null")
    sums = rows.groupBy("flow", "member_id").agg(*pair_sums(F.col("direction").cast("double"), F.col("imbalance")))
    r = sums.select("flow", "member_id", "n", correlation(30).alias("r")).filter("r is not null and abs(r) < 1")
    z = F.abs(F.atanh("r")) * F.sqrt(F.col("n") - 3)
    got = models.benjamini_hochberg(r.withColumn("p", two_sided_normal(z)), ["flow"], "p")
    six = lambda c: (F.round(c, 6) + 0.0).alias(c)
    nine = lambda c: (F.round(c, 9) + 0.0).alias(c)
    return got.select("flow", "member_id", "n", six("r"), nine("p"), nine("p_adjusted"))


@R.add(f"""
with {facts_sql('q_over_v', 'participation_rate', 'vt_over_v')},
f as (select metaorder_id, ln(q_over_v) as a, ln(participation_rate) as b from fact where q_over_v > 0 and participation_rate > 0),
s as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from f)
select metaorder_id, round((a - ma) / sa, 6) + 0.0 as z_qv, round((b - mb) / sb, 6) + 0.0 as z_eta,
       case when (a - ma) / sa > 0.5 then 'large' when (a - ma) / sa < -0.5 then 'small' else 'medium' end as kind from f, s""")
def g19_g23_scores(spark, sf_dir):
    """Standard scores of ln Q/V and ln participation, and a label cut at half a deviation."""
    f = facts(spark, sf_dir, "q_over_v", "participation_rate").filter("q_over_v > 0 and participation_rate > 0")
    f = f.select("metaorder_id", F.ln("q_over_v").alias("a"), F.ln("participation_rate").alias("b"))
    ma, sa, mb, sb = f.agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b")).first()
    z = (F.col("a") - F.lit(ma)) / F.lit(sa)
    kind = F.when(z > 0.5, "large").when(z < -0.5, "small").otherwise("medium")
    return f.select("metaorder_id", (F.round(z, 6) + 0.0).alias("z_qv"), (F.round((F.col("b") - F.lit(mb)) / F.lit(sb), 6) + 0.0).alias("z_eta"), kind.alias("kind"))


@R.add()
def g20_g21_clusters(spark, sf_dir):
    """k-means (k from 2 to 4 by silhouette) on the principal components, up to 90 % of the variance, of scaled features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    names = ["q_over_v", "participation_rate", "vt_over_v", "impact_1m", "impact_60m"]
    rows = facts(spark, sf_dir, *names)
    ln = [F.ln(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in names[:3]]
    rows = written(rows.select("metaorder_id", "flow", *ln, *[F.abs(c).alias(c) for c in names[3:]]).dropna(subset=names), "features")
    v = VectorAssembler(inputCols=names, outputCol="raw").transform(rows)
    v = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(v).transform(v)
    pca = PCA(k=len(names), inputCol="scaled", outputCol="all").fit(v)
    share, k = 0.0, 0
    for x in pca.explainedVariance.toArray():
        k, share = k + 1, share + float(x)
        if share >= 0.9:
            break
    v = PCA(k=k, inputCol="scaled", outputCol="features").fit(v).transform(v)
    best = None
    for n in (2, 3, 4):
        made = KMeans(k=n, seed=1, maxIter=10).fit(v).transform(v)
        s = ClusteringEvaluator().evaluate(made)
        if best is None or s > best[0] + 1e-9:
            best = (s, made)
    labelled = written(best[1].select("prediction", "flow", *names), "labelled")
    counts = labelled.groupBy("prediction", "flow").agg(F.count("*").alias("n"))
    quartiles = quantiles(labelled, ["prediction", "flow"], names, [0.25, 0.5, 0.75])
    own = [F.col("prediction").eqNullSafe(F.col("_p")), F.col("flow").eqNullSafe(F.col("_f"))]
    quartiles = quartiles.select(F.col("prediction").alias("_p"), F.col("flow").alias("_f"), *[F.col(f"q_{c}").alias(f"{c}_quartiles") for c in names])
    return counts.join(quartiles, own).drop("_p", "_f")


@R.add(f"""
with {facts_sql('impact')},
p as (select member_id, avg(impact) as m, count(impact) as n from fact where member_id is not null group by member_id having count(impact) >= 5)
select member_id, n, round(m, 7) + 0.0 as mean_impact, (row_number() over (order by (m > 0) desc, m desc, member_id))::int as place from p
qualify row_number() over (order by (m > 0) desc, m desc, member_id) <= 10""")
def t03_j12_top_members(spark, sf_dir):
    """The ten members of the highest mean impact, positive ones first."""
    p = facts(spark, sf_dir, "impact").filter("member_id is not null").groupBy("member_id").agg(F.avg("impact").alias("m"), F.count("impact").alias("n")).filter("n >= 5")
    top = p.orderBy((F.col("m") > 0).desc(), F.col("m").desc(), "member_id").limit(10)
    w = Window.orderBy((F.col("m") > 0).desc(), F.col("m").desc(), "member_id")  # over ten rows
    return top.select("member_id", "n", (F.round("m", 7) + 0.0).alias("mean_impact"), F.row_number().over(w).alias("place"))
