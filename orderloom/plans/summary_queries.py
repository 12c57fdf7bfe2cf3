"""Summaries of metaorders: distributions, volumes and shares, members, curves and surfaces, strata."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.numbers import finite
from orderloom.functions.text import canonical_id, trimmed
from orderloom.functions.times import DAY_US
from orderloom.operators import bins
from orderloom.operators.moments import correlation, correlation_sql, pair_sums
from orderloom.operators.ranks import quantiles, value_ranks
from orderloom.plans.crowding_queries import CLOSE, OPEN, WIDTH, facts, facts_sql
from orderloom.plans.registry import Registry
from orderloom.plans.tape_queries import METRIC_SQL, daily_metric
from orderloom.sources.tables import table

R = Registry()

FEATURES = ["q", "q_over_v", "participation_rate", "vt_over_v", "impact"]
POINTS = [0.05, 0.25, 0.5, 0.75, 0.95]


def _long(spark, sf_dir):
    rows = facts(spark, sf_dir, *FEATURES[1:]).filter("flow is not null")
    return rows.select("flow", *FEATURES).unpivot("flow", FEATURES, "metric", "x")


LONG_SQL = f"""{facts_sql(*FEATURES[1:])},
long as (select flow, metric, x from (unpivot (select flow, {', '.join(FEATURES)} from fact where flow is not null)
         on {', '.join(FEATURES)} into name metric value x))"""


@R.add(f"""
with {LONG_SQL}
select flow, metric, count(x) as n, round(avg(x), 8) as mean, round(stddev_samp(x), 6) as sd, min(x) as low, max(x) as high,
       {', '.join(f'round(quantile_cont(x, {p}), 9) as p{round(p * 100):02d}' for p in POINTS)}
from long group by all""")
def a24_a42_feature_summary(spark, sf_dir):
    """Count, mean, deviation, extremes and quantiles of each feature per flow."""
    long = _long(spark, sf_dir).filter("x is not null")
    points = quantiles(long, ["flow", "metric"], ["x"], POINTS)
    named = [F.round(F.col("q_x")[i], 9).alias(f"p{round(q * 100):02d}") for i, q in enumerate(POINTS)]
    sums = long.groupBy("flow", "metric").agg(
        F.count("x").alias("n"), F.round(F.avg("x"), 8).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("sd"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    return sums.join(points, ["flow", "metric"]).select("flow", "metric", "n", "mean", "sd", "low", "high", *named)


@R.add(f"""
with {facts_sql()},
m as (select flow, day, (start_us % {DAY_US}) / 6e7 - {OPEN} as minute from fact where start_us is not null and flow is not null),
b as (select flow, case when minute between 0 and {CLOSE - OPEN} then least(floor(minute / {WIDTH})::int, {(CLOSE - OPEN) // WIDTH - 1}) end as bin from m),
n as (select flow, count(*) as total from b where bin is not null group by flow),
g as (select flow, unnest(range({(CLOSE - OPEN) // WIDTH}))::int as bin from (select distinct flow from b)),
c as (select flow, bin, count(*) as k from b where bin is not null group by all)
select g.flow, g.bin, printf('%02d:%02d-%02d:%02d', ({OPEN} + g.bin * {WIDTH}) // 60, ({OPEN} + g.bin * {WIDTH}) % 60,
       ({OPEN} + g.bin * {WIDTH} + {WIDTH}) // 60, ({OPEN} + g.bin * {WIDTH} + {WIDTH}) % 60) as label,
       coalesce(k, 0) as n, round(coalesce(k, 0) / total, 9) as share
from g left join c using (flow, bin) join n using (flow)""")
def a25_p13_p15_start_histogram(spark, sf_dir):
    """Starts per ten minutes of the session and flow, bins without any included; the close belongs to the last bin."""
    rows = facts(spark, sf_dir).filter("start_us is not null and flow is not null")
    minute = F.pmod("start_us", F.lit(DAY_US)) / 6e7 - OPEN
    counts = rows.groupBy("flow", bins.session_bin(minute, CLOSE - OPEN, WIDTH).alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")
    total = counts.groupBy("flow").agg(F.sum("n").alias("total"))
    frame = bins.session_bins(rows, CLOSE - OPEN, WIDTH, OPEN)
    every = total.select("flow", "total", F.explode(F.sequence(F.lit(0), F.lit((CLOSE - OPEN) // WIDTH - 1))).alias("bin"))
    out = every.join(F.broadcast(frame), "bin").join(counts, ["flow", "bin"], "left").fillna(0, subset=["n"])
    return out.select("flow", "bin", "label", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@R.add(f"""
with {facts_sql()}, {METRIC_SQL},
v as (select isin, day, coalesce(sum(q) filter (flow = 'proprietary'), 0) as prop, coalesce(sum(q) filter (flow = 'client'), 0) as client from fact group by all)
select m.isin, m.trade_date, m.volume, round(coalesce(prop, 0), 3) as prop_volume, round(coalesce(client, 0), 3) as client_volume,
       round(coalesce(prop, 0) / nullif(m.volume, 0), 9) as prop_share, round(coalesce(client, 0) / nullif(m.volume, 0), 9) as client_share
from metric m left join v on v.isin = m.isin and v.day = m.trade_date""")
def a26_a27_daily_share(spark, sf_dir):
    """Volume of proprietary and client metaorders per ISIN and day, and its share of the market's."""
    of = lambda f: F.coalesce(F.sum(F.when(F.col("flow") == f, F.col("q"))), F.lit(0.0))
    v = facts(spark, sf_dir).groupBy("isin", F.col("day").alias("trade_date")).agg(of("proprietary").alias("prop"), of("client").alias("client"))
    m = daily_metric(spark, sf_dir).join(v, ["isin", "trade_date"], "left").fillna(0.0, subset=["prop", "client"])
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("volume")), 9).alias(f"{c}_share")
    return m.select("isin", "trade_date", "volume", F.round("prop", 3).alias("prop_volume"), F.round("client", 3).alias("client_volume"), share("prop"), share("client"))


# Labels of the two nationalities.
HOME, FOREIGN = ("it", "ita", "italy", "italian", "domestic"), ("foreign", "non-it", "nonit", "non_it", "non it", "for", "foreigner")


def nationality(spark, sf_dir):
    """The first known row per member: IT or FOREIGN."""
    n = table(spark, sf_dir, "member_nationality")
    label = F.lower(trimmed(F.col("nationality")))
    n = n.select("file_row", canonical_id(F.col("member_id")).alias("member_id"), F.when(label.isin(*HOME), "IT").when(label.isin(*FOREIGN), "FOREIGN").alias("nationality"))
    return n.filter("member_id is not null").groupBy("member_id").agg(F.min_by("nationality", "file_row").alias("nationality"))


NATIONALITY_SQL = f"""
nat as (
  select m as member_id, arg_min(n, file_row) filter (true) as first_n, min_by({{'n': n}}, file_row).n as nationality from (
    select file_row, case when regexp_full_match(t, '[+-]?[0-9]{{1,30}}([.]0{{0,8}})?') then cast(cast(t as decimal(38, 8)) as decimal(30, 0))::varchar else t end as m,
           case when l in {HOME} then 'IT' when l in {FOREIGN} then 'FOREIGN' end as n
    from (select file_row, nullif(trim(member_id, ' ' || chr(9)), '') as t, lower(trim(nationality, ' ' || chr(9))) as l from member_nationality))
  where m is not null group by m)"""


@R.add(f"""
with {facts_sql()}, {NATIONALITY_SQL}
select coalesce(flow, 'all') as flow, coalesce(nationality, 'unknown') as nationality, count(*) as n, round(sum(q), 3) as volume
from (select f.flow, coalesce(n.nationality, 'unknown') as nationality, f.q from fact f left join nat n on f.member_id = n.member_id where f.flow is not null)
group by grouping sets ((flow, nationality), (nationality))""")
def j01_a28_nationality(spark, sf_dir):
    """Metaorders and volume by the member's nationality, per flow and for all."""
    rows = facts(spark, sf_dir).filter("flow is not null").join(F.broadcast(nationality(spark, sf_dir)), "member_id", "left")
    rows = rows.select("flow", F.coalesce("nationality", F.lit("unknown")).alias("nationality"), "q")
    per = rows.groupBy("flow", "nationality").agg(F.count("*").alias("n"), F.sum("q").alias("volume"))
    every = per.groupBy("nationality").agg(F.sum("n").alias("n"), F.sum("volume").alias("volume")).withColumn("flow", F.lit("all"))
    return per.unionByName(every).select("flow", "nationality", "n", F.round("volume", 3).alias("volume"))


@R.add(f"""
with {facts_sql('n_child')},
a as (select member_id, flow, count(*) as metaorders, sum(n_child)::bigint as children from fact where member_id is not null and flow is not null group by all),
s as (select member_id, flow, sum(n_metaorders)::bigint as profile_metaorders, sum(total_trades)::bigint as trades from summary group by all)
select member_id, flow, coalesce(metaorders, 0) as metaorders, coalesce(children, 0) as children, coalesce(profile_metaorders, 0) as profile_metaorders,
       coalesce(trades, 0) as trades from a full join s using (member_id, flow)""")
def a29_j14_member_profile(spark, sf_dir):
    """Per member and flow, what was counted now and in the profile; members of either side are kept."""
    rows = facts(spark, sf_dir, "n_child").filter("member_id is not null and flow is not null")
    a = rows.groupBy("member_id", "flow").agg(F.count("*").alias("metaorders"), F.sum("n_child").cast("bigint").alias("children"))
    s = table(spark, sf_dir, "summary").groupBy("member_id", "flow").agg(F.sum("n_metaorders").alias("profile_metaorders"), F.sum("total_trades").alias("trades"))
    return a.join(s, ["member_id", "flow"], "full_outer").fillna(0)


@R.add(f"""
with {facts_sql()}
select isin, count(distinct member_id) as members, count(distinct day) as days, count(*) filter (flow = 'client') as n_client,
       count(*) filter (flow = 'proprietary') as n_prop,
       round(count(*) filter (flow = 'client') / nullif(count(*) filter (flow = 'proprietary'), 0), 9) as client_to_prop
from fact group by isin""")
def a30_a32_coverage(spark, sf_dir):
    """Members, days and metaorders by flow of each ISIN."""
    n = lambda f: F.count(F.when(F.col("flow") == f, 1))
    return facts(spark, sf_dir).groupBy("isin").agg(
        F.count_distinct("member_id").alias("members"), F.count_distinct("day").alias("days"), n("client").alias("n_client"),
        n("proprietary").alias("n_prop"), F.round(F.try_divide(n("client"), n("proprietary")), 9).alias("client_to_prop"),
    )


@R.add(f"""
with {facts_sql()}
select day, member_id, count(*) filter (direction = 1) as buys, count(*) filter (direction = -1) as sells,
       (rank() over (partition by day order by count(*) desc, member_id))::int as rank
from fact where member_id is not null group by day, member_id""")
def a31_w06_p26_activity(spark, sf_dir):
    """Buys and sells per day and member, side by side, and the member's rank of the day."""
    per = facts(spark, sf_dir).filter("member_id is not null").groupBy("day", "member_id").pivot("direction", [1, -1]).count().fillna(0)
    w = Window.partitionBy("day").orderBy((F.col("1") + F.col("-1")).desc(), "member_id")
    return per.select("day", "member_id", F.col("1").alias("buys"), F.col("-1").alias("sells"), F.row_number().over(w).alias("rank"))


QV = bins.log_edges(1e-5, 1.0, 30)
ETA = bins.log_edges(1e-3, 1.0, 10)


def _bin_sql(x: str, edges: list[float]) -> str:
    return f"len(list_filter({[float(e) for e in edges]}, lambda v: v <= {x})) - 1"


def _fit_ready(spark, sf_dir):
    return facts(spark, sf_dir, "q_over_v", "participation_rate", "impact", "vt_over_v").filter(
        "q_over_v > 1e-5 and impact is not null and participation_rate > 0 and participation_rate < 1"
    )


FIT_SQL = f"""{facts_sql('q_over_v', 'participation_rate', 'impact', 'vt_over_v')},
ready as (select * from fact where q_over_v > 1e-5 and impact is not null and participation_rate > 0 and participation_rate < 1),
cells as (
  select flow, {_bin_sql('q_over_v', QV)} as bin, count(*) as n, avg(impact) as m, stddev_samp(impact) / sqrt(count(*)) as sem
  from ready where flow is not null and q_over_v < {QV[-1]!r} group by all having count(*) >= 20)"""


@R.add(f"with {FIT_SQL} select flow, bin::int as bin, n, round(m, 10) + 0.0 as mean_impact, round(sem, 7) as sem from cells")
def a10_f02_f03_impact_curve(spark, sf_dir):
    """Mean impact and its error in 30 logarithmic bins of Q/V, of fit-ready metaorders, per flow (bins of at least 20)."""
    rows = _fit_ready(spark, sf_dir).filter("flow is not null").withColumn("bin", bins.bin_left(F.col("q_over_v"), QV))
    return rows.filter("bin is not null").groupBy("flow", "bin").agg(
        F.count("*").alias("n"), (F.round(F.avg("impact"), 10) + 0.0).alias("mean_impact"),
        F.round(F.stddev_samp("impact") / F.sqrt(F.count("*")), 7).alias("sem"),
    ).filter("n >= 20")


@R.add(f"""
with {FIT_SQL},
p as (select flow, log10(sqrt(lo * hi)) as x, log10(m) as y, (m / sem) * (m / sem) as w from (
        select c.*, list_extract({[float(e) for e in QV]}, (bin + 1)::bigint) as lo, list_extract({[float(e) for e in QV]}, (bin + 2)::bigint) as hi from cells c) where m > 0 and sem > 0),
s as (select flow, count(*) as n, sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy, sum(w * y * y) as syy from p group by flow)
select flow, n as bins, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 5) as gamma,
       round(pow(10, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw), 5) as prefactor,
       round(pow(sw * sxy - sx * sy, 2) / ((sw * sxx - sx * sx) * (sw * syy - sy * sy)), 5) as r2
from s where n >= 3""")
def g01_g05_power_law(spark, sf_dir):
    """Weighted straight line through the logarithms of the impact curve, by sums over its bins: exponent, factor and R2 per flow."""
    rows = _fit_ready(spark, sf_dir).filter("flow is not null").withColumn("bin", bins.bin_left(F.col("q_over_v"), QV))
    cells = rows.filter("bin is not null").groupBy("flow", "bin").agg(
        F.count("*").alias("n"), F.avg("impact").alias("m"), (F.stddev_samp("impact") / F.sqrt(F.count("*"))).alias("sem")
    ).filter("n >= 20 and m > 0 and sem > 0")
    e = F.array(*[F.lit(v) for v in QV])
    x, y = F.log10(F.sqrt(F.element_at(e, F.col("bin") + 1) * F.element_at(e, F.col("bin") + 2))), F.log10("m")
    w = (F.col("m") / F.col("sem")) * (F.col("m") / F.col("sem"))
    s = cells.select("flow", x.alias("x"), y.alias("y"), w.alias("w")).groupBy("flow").agg(
        F.count("*").alias("n"), F.sum("w").alias("sw"), *[F.sum(F.expr(f"w * {k}")).alias(n) for k, n in (("x", "sx"), ("y", "sy"), ("x * x", "sxx"), ("x * y", "sxy"), ("y * y", "syy"))]
    ).filter("n >= 3")
    slope = F.expr("(sw * sxy - sx * sy) / (sw * sxx - sx * sx)")
    return s.select(
        "flow", F.col("n").alias("bins"), F.round(slope, 5).alias("gamma"), F.round(F.pow(F.lit(10.0), (F.col("sy") - slope * F.col("sx")) / F.col("sw")), 5).alias("prefactor"),
        F.round(F.expr("pow(sw * sxy - sx * sy, 2) / ((sw * sxx - sx * sx) * (sw * syy - sy * sy))"), 5).alias("r2"),
    )


@R.add(f"""
with {FIT_SQL}
select {_bin_sql('q_over_v', QV)}::int as qv_bin, ({_bin_sql('participation_rate', ETA)})::int as eta_bin, count(*) as n,
       round(avg(impact), 10) + 0.0 as mean_impact, round(avg(ln(vt_over_v)) filter (vt_over_v > 0), 7) + 0.0 as mean_ln_vt
from ready where q_over_v < {QV[-1]!r} and participation_rate >= {ETA[0]!r} and participation_rate < {ETA[-1]!r} group by all having count(*) >= 10""")
def a09_a33_a34_surface(spark, sf_dir):
    """Mean impact and a mean control on a grid of logarithmic bins of Q/V and participation rate (cells of at least 10)."""
    rows = _fit_ready(spark, sf_dir).withColumns({"qv_bin": bins.bin_left(F.col("q_over_v"), QV), "eta_bin": bins.bin_left(F.col("participation_rate"), ETA)})
    return rows.filter("qv_bin is not null and eta_bin is not null").groupBy("qv_bin", "eta_bin").agg(
        F.count("*").alias("n"), (F.round(F.avg("impact"), 10) + 0.0).alias("mean_impact"),
        (F.round(F.avg(F.when(F.col("vt_over_v") > 0, F.ln("vt_over_v"))), 7) + 0.0).alias("mean_ln_vt"),
    ).filter("n >= 10")


@R.add(f"""
with {LONG_SQL}, v as (select flow, x, count(*) as n from long where metric = 'q' group by all)
select flow, x, n, (sum(n) over w)::bigint as upto, round(sum(n) over w / sum(n) over (partition by flow), 9) as share
from v window w as (partition by flow order by x rows unbounded preceding)""")
def a44_ecdf(spark, sf_dir):
    """Cumulative distribution of the size per flow."""
    q = facts(spark, sf_dir).filter("flow is not null").select("flow", F.col("q").alias("x"))
    ranks = value_ranks(q, ["flow"], "x", "floor(16 * log2(x))")
    n = q.groupBy("flow").agg(F.count("*").alias("all"))
    return ranks.join(F.broadcast(n), "flow").select("flow", "x", "n", "upto", F.round(F.col("upto") / F.col("all"), 9).alias("share"))


@R.add(f"""
with {facts_sql('q_over_v', 'participation_rate')},
p as (select flow, q_over_v as x, participation_rate as y from fact where flow is not null and q_over_v > 0 and participation_rate > 0),
k as (select flow, rank() over (partition by flow order by x) + (count(*) over (partition by flow, x) - 1) / 2.0 as rx,
             rank() over (partition by flow order by y) + (count(*) over (partition by flow, y) - 1) / 2.0 as ry from p)
select flow, count(*) as n, round({correlation_sql('rx::double', 'ry::double')}, 6) + 0.0 as spearman from k group by flow""")
def a19_spearman(spark, sf_dir):
    """Rank correlation of Q/V and participation rate per flow; ties have their mean rank."""
    p = facts(spark, sf_dir, "q_over_v", "participation_rate").filter("flow is not null and q_over_v > 0 and participation_rate > 0")
    p = p.select("flow", F.col("q_over_v").alias("x"), F.col("participation_rate").alias("y"))
    rank = lambda c, name: value_ranks(p, ["flow"], c, f"floor(16 * log2({c}))").select("flow", c, F.col("rank").alias(name))
    both = p.join(rank("x", "rx"), ["flow", "x"]).join(rank("y", "ry"), ["flow", "y"])
    sums = both.groupBy("flow").agg(*pair_sums(F.col("rx"), F.col("ry")))
    return sums.select("flow", "n", (F.round(correlation(), 6) + 0.0).alias("spearman"))


DENSITY = bins.log_edges(1.0, 1e6, 24)


@R.add(f"""
with {LONG_SQL},
b as (select flow, {_bin_sql('x', DENSITY)} as bin from long where metric = 'q' and x >= {DENSITY[0]!r} and x < {DENSITY[-1]!r}),
c as (select flow, bin, count(*) as n from b group by all)
select flow, bin::int as bin, n, round(n / (sum(n) over (partition by flow)
       * (list_extract({[float(e) for e in DENSITY]}, (bin + 2)::bigint) - list_extract({[float(e) for e in DENSITY]}, (bin + 1)::bigint))), 12) as density from c""")
def a43_density(spark, sf_dir):
    """Density of the size in logarithmic bins per flow."""
    rows = facts(spark, sf_dir).filter("flow is not null").withColumn("bin", bins.bin_left(F.col("q"), DENSITY)).filter("bin is not null")
    c = rows.groupBy("flow", "bin").agg(F.count("*").alias("n"))
    e = F.array(*[F.lit(v) for v in DENSITY])
    width = F.element_at(e, F.col("bin") + 2) - F.element_at(e, F.col("bin") + 1)
    return c.select("flow", "bin", "n", F.round(F.col("n") / (F.sum("n").over(Window.partitionBy("flow")) * width), 12).alias("density"))


SESSIONS = {"morning": (570, 810), "evening": (810, 1050)}


@R.add(f"""
with {facts_sql('impact', 'q_over_v')},
m as (select *, (start_us % {DAY_US}) / 6e7 as a, (end_us % {DAY_US}) / 6e7 as b from fact where start_us is not null and end_us is not null),
c as (select *, case when a >= 570 and a < 810 then 'morning' when a >= 810 and a <= 1050 then 'evening' end as sa,
                case when b >= 570 and b < 810 then 'morning' when b >= 810 and b <= 1050 then 'evening' end as sb from m)
select case when sa = sb then sa end as session, count(*) as n, round(avg(impact), 10) + 0.0 as mean_impact, round(median(q_over_v), 9) as median_qv from c group by 1""")
def p16_sessions_of_day(spark, sf_dir):
    """Metaorders within the morning, the evening, or (NULL) neither: the last session has its close, a start and an end apart have none."""
    rows = facts(spark, sf_dir, "impact", "q_over_v").filter("start_us is not null and end_us is not null")

    def of(c):
        m = F.pmod(c, F.lit(DAY_US)) / 6e7
        return F.when((m >= 570) & (m < 810), "morning").when((m >= 810) & (m <= 1050), "evening")

    a, b = of("start_us"), of("end_us")
    rows = rows.withColumn("session", F.when(a == b, a))
    sums = rows.groupBy("session").agg(F.count("*").alias("n"), (F.round(F.avg("impact"), 10) + 0.0).alias("mean_impact"))
    medians = quantiles(rows, ["session"], ["q_over_v"], [0.5]).select(F.col("session").alias("_s"), F.round(F.col("q_q_over_v")[0], 9).alias("median_qv"))
    return sums.join(medians, F.col("session").eqNullSafe(F.col("_s")), "left").drop("_s")


@R.add(f"""
with {facts_sql('participation_rate', 'impact')},
e as (select *, participation_rate >= (select quantile_cont(participation_rate, 0.5) from fact where participation_rate > 0) as high,
             isin || '|' || day || '|' || ((start_us % {DAY_US}) // 60000000 // 20) as stratum
      from fact where start_us is not null and participation_rate > 0),
s as (select stratum, count(*) filter (high) as n1, count(*) filter (not high) as n0, count(impact) filter (high) as v1, count(impact) filter (not high) as v0,
             sum(impact) filter (high) as s1, sum(impact) filter (not high) as s0 from e group by stratum),
ok as (select *, s1 / v1 as m1, s0 / v0 as m0 from s where v1 > 0 and v0 > 0)
select count(*) as strata, sum(n1)::bigint as treated, sum(n0)::bigint as control, round(sum(v1 * m1) / sum(v1), 7) + 0.0 as treated_mean,
       round(sum(v1 * m0) / sum(v1), 7) + 0.0 as control_mean, round(sum(v1 * (m1 - m0)) / sum(v1), 7) + 0.0 as excess from ok""")
def a35_p19_p20_matched(spark, sf_dir):
    """Impact of metaorders of high participation less that of others of the same ISIN, day and 20 minutes, weighted by the former."""
    rows = facts(spark, sf_dir, "participation_rate", "impact").filter("start_us is not null and participation_rate > 0")
    cut = facts(spark, sf_dir, "participation_rate").filter("participation_rate > 0")
    cut = quantiles(cut, [], ["participation_rate"], [0.5]).select(F.col("q_participation_rate")[0]).first()
    cut = cut and cut[0]
    high = F.col("participation_rate") >= F.lit(cut)
    stratum = ["isin", "day", F.expr(f"pmod(start_us, {DAY_US}) div 60000000 div 20").alias("slot")]
    of = lambda f, c, w: f(F.when(w, c))
    s = rows.groupBy(*stratum).agg(
        of(F.count, F.lit(1), high).alias("n1"), of(F.count, F.lit(1), ~high).alias("n0"), of(F.count, F.col("impact"), high).alias("v1"),
        of(F.count, F.col("impact"), ~high).alias("v0"), of(F.sum, F.col("impact"), high).alias("s1"), of(F.sum, F.col("impact"), ~high).alias("s0"),
    ).filter("v1 > 0 and v0 > 0")
    r = lambda e, n: (F.round(F.expr(e), 7) + 0.0).alias(n)
    return s.agg(
        F.count("*").alias("strata"), F.sum("n1").alias("treated"), F.sum("n0").alias("control"), r("sum(s1) / sum(v1)", "treated_mean"),
        r("sum(v1 * s0 / v0) / sum(v1)", "control_mean"), r("sum(s1 - v1 * s0 / v0) / sum(v1)", "excess"),
    )


@R.add(f"""
with {facts_sql('impact_1m', 'impact_10m', 'impact_60m', 'impact')}
select metaorder_id, round(abs(impact_1m), 9) as abs_1m, round(abs(impact_60m), 9) as abs_60m,
       round(impact_10m / nullif(impact_1m, 0), 9) + 0.0 as retention_10, round(impact_60m / nullif(impact_1m, 0), 9) + 0.0 as retention_60,
       round((end_us - start_us) / 1e6, 6) as duration_s from fact where impact_1m is not null""")
def r04_p08_p22_impact_shape(spark, sf_dir):
    """Size of the impact, what of it is left after 10 and 60 minutes, and the duration."""
    rows = facts(spark, sf_dir, "impact_1m", "impact_10m", "impact_60m", "impact").filter("impact_1m is not null")
    keep = lambda c, n: (F.round(F.try_divide(F.col(c), F.col("impact_1m")), 9) + 0.0).alias(n)
    return rows.select(
        "metaorder_id", F.round(F.abs("impact_1m"), 9).alias("abs_1m"), F.round(F.abs("impact_60m"), 9).alias("abs_60m"),
        keep("impact_10m", "retention_10"), keep("impact_60m", "retention_60"), F.round((F.col("end_us") - F.col("start_us")) / 1e6, 6).alias("duration_s"),
    )


@R.add(f"""
with {facts_sql()}, r as (select metaorder_id, flow, row_number() over (partition by flow order by md5(metaorder_id::varchar), metaorder_id) as k from fact where flow is not null)
select metaorder_id, flow from r where k <= 500""")
def t06_stratified_sample(spark, sf_dir):
    """500 metaorders of each flow, by a hash of their id."""
    rows = facts(spark, sf_dir).filter("flow is not null").select("metaorder_id", "flow")
    w = Window.partitionBy("flow").orderBy(F.md5(F.col("metaorder_id").cast("string")), "metaorder_id")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k <= 500").drop("_k")
