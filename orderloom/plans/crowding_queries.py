"""Crowding: imbalance of others, its correlations, overlap and neighbourhood of metaorders."""

from pyspark.sql import functions as F

from orderloom.functions.numbers import finite
from orderloom.functions.times import DAY_US
from orderloom.operators import bins
from orderloom.operators.crowding import demeaned, environment, leave_one_out
from orderloom.operators.moments import correlation, correlation_sql, merged_sums, pair_sums
from orderloom.operators.overlap import active_volume, lead_lag, neighbours
from orderloom.operators.ranks import quantiles
from orderloom.plans.problem_queries import METAORDERS_SQL
from orderloom.plans.registry import Registry
from orderloom.sources.tables import metaorders, written

R = Registry()

CELL = ["isin", "day"]


def facts(spark, sf_dir, *more):
    """Metaorders with ISIN, day, direction +1 or -1 and a positive size; flow is "proprietary" or "client"."""
    cols = ["isin", "member_id", "flow", "trade_date", "start_us", "end_us", "direction", "q", *more]
    rows = metaorders(spark, sf_dir, *cols)
    day = F.coalesce("trade_date", F.date_from_unix_date(F.expr(f"start_us div {DAY_US}").cast("int")))
    clean = {c: finite(F.col(c)) for c in ("q", *more) if rows.schema[c].dataType.simpleString() == "double"}
    rows = rows.withColumns({"day": day, **clean}).drop("trade_date")
    return rows.filter("isin is not null and day is not null and direction in (-1, 1) and q > 0")


def facts_sql(*more: str) -> str:
    clean = "".join(f", case when isfinite({c}) then {c} end as {c}" for c in more)
    return f"""{METAORDERS_SQL},
fact as (
  select * from (
    select metaorder_id, row_id, isin, member_id, start_us, end_us, direction, case when isfinite(q) then q end as q{clean},
           case when lower(trim(flow_group)) in ('prop', 'proprietary', 'own', 'own_account', 'own account') then 'proprietary'
                when lower(trim(flow_group)) in ('client', 'nonprop', 'non-prop', 'non_proprietary', 'non-proprietary', 'nonproprietary') then 'client' end as flow,
           coalesce(trade_date, (date '1970-01-01' + (start_us // {DAY_US})::int)::date) as day
    from mo)
  where isin is not null and day is not null and direction in (-1, 1) and q > 0)"""


LOCAL_SQL = """
cells as (select isin, day, sum(q * direction) as s, sum(q) as v from fact group by all),
local as (
  select f.*, case when v - q > 1e-9 * v then (s - q * direction) / (v - q) end as imbalance
  from fact f join cells using (isin, day))"""


@R.add(f"with {facts_sql()}, {LOCAL_SQL} select metaorder_id, isin, day, round(imbalance, 6) + 0.0 as imbalance from local")
def a07_local_imbalance(spark, sf_dir):
    """Signed share of the other metaorders' volume of the ISIN and day."""
    rows = leave_one_out(facts(spark, sf_dir), CELL, "q", "direction")
    return rows.select("metaorder_id", "isin", "day", (F.round("imbalance", 6) + 0.0).alias("imbalance"))


@R.add(f"""
with {facts_sql()},
p as (select isin, day, sum(q * direction) / sum(q) as prop_imbalance from fact where flow = 'proprietary' group by all),
c as (select isin, day, sum(q * direction) / sum(q) as client_imbalance from fact where flow = 'client' group by all),
m as (select member_id, day, sum(q * direction) / sum(q) as member_client_imbalance from fact where flow = 'client' and member_id is not null group by all)
select f.metaorder_id, round(prop_imbalance, 6) + 0.0 as prop_imbalance, round(client_imbalance, 6) + 0.0 as client_imbalance,
       round(member_client_imbalance, 6) + 0.0 as member_client_imbalance
from fact f left join p using (isin, day) left join c using (isin, day)
left join m on f.member_id = m.member_id and f.day = m.day""")
def a08_j06_j07_environments(spark, sf_dir):
    """Imbalance of all proprietary and all client flow of the ISIN and day, and of the member's clients on the day."""
    rows = facts(spark, sf_dir)
    out = rows.select("metaorder_id", "member_id", *CELL)
    for flow, name in (("proprietary", "prop_imbalance"), ("client", "client_imbalance")):
        out = out.join(environment(rows, CELL, "q", "direction", F.col("flow") == flow, name), CELL, "left")
    mine = (F.col("flow") == "client") & F.col("member_id").isNotNull()
    own = environment(rows, ["member_id", "day"], "q", "direction", mine, "member_client_imbalance")
    out = out.join(own, ["member_id", "day"], "left")
    names = ("prop_imbalance", "client_imbalance", "member_client_imbalance")
    return out.select("metaorder_id", *[(F.round(c, 6) + 0.0).alias(c) for c in names])


@R.add(f"""
with {facts_sql()}, {LOCAL_SQL}
select day, flow, count(*) as n, round({correlation_sql('direction', 'imbalance', 100)}, 6) + 0.0 as r
from local where flow is not null group by day, flow having count(*) >= 100""")
def a21_daily_crowding(spark, sf_dir):
    """Per day and flow, the correlation of direction and local imbalance (from 100 metaorders on)."""
    rows = leave_one_out(facts(spark, sf_dir), CELL, "q", "direction").filter("flow is not null")
    sums = rows.groupBy("day", "flow").agg(F.count("*").alias("rows"), *pair_sums(F.col("direction").cast("double"), F.col("imbalance")))
    return sums.filter("rows >= 100").select("day", "flow", F.col("rows").alias("n"), (F.round(correlation(100), 6) + 0.0).alias("r"))


@R.add(f"""
with {facts_sql()}
select day, count(*) filter (flow = 'proprietary') as n_prop, count(*) filter (flow = 'client') as n_client,
       round((count(*) filter (flow = 'proprietary') - count(*) filter (flow = 'client'))
             / nullif(count(*) filter (flow in ('proprietary', 'client')), 0), 9) + 0.0 as count_imbalance
from fact group by day""")
def a22_count_imbalance(spark, sf_dir):
    """Per day, (proprietary - client) / (proprietary + client) numbers of metaorders."""
    p, c = F.count_if(F.coalesce(F.col("flow") == "proprietary", F.lit(False))), F.count_if(F.coalesce(F.col("flow") == "client", F.lit(False)))
    return facts(spark, sf_dir).groupBy("day").agg(
        p.alias("n_prop"), c.alias("n_client"), (F.round(F.try_divide(p - c, p + c), 9) + 0.0).alias("count_imbalance")
    )


def _eta_frame(spark, sf_dir):
    rows = leave_one_out(facts(spark, sf_dir, "participation_rate", "q_over_v"), CELL, "q", "direction")
    rows = rows.filter("participation_rate > 0 and participation_rate <= 1 and imbalance is not null and q_over_v > 0")
    # written, as its bins' edges, sums and medians each read it
    rows = rows.select("day", "direction", "participation_rate", "q_over_v", "imbalance", (F.col("direction") * F.col("imbalance")).alias("align"))
    return written(rows, "eta")


ETA_SQL = f"""{facts_sql('participation_rate', 'q_over_v')}, {LOCAL_SQL},
eta as (select *, direction * imbalance as align from local
        where participation_rate > 0 and participation_rate <= 1 and imbalance is not null and q_over_v > 0),
eta_edges as (select list_sort(list_distinct(quantile_cont(participation_rate, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as ee,
                     list_sort(list_distinct(quantile_cont(q_over_v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as qe from eta),
binned as (select eta.*, greatest(len(list_filter(ee, lambda v: v < participation_rate)) - 1, 0) as eta_bin,
                  greatest(len(list_filter(qe, lambda v: v < q_over_v)) - 1, 0) as qv_bin from eta, eta_edges)"""


@R.add(f"""
with {ETA_SQL}
select eta_bin::int as eta_bin, count(*) as n, round(median(participation_rate), 9) as median_eta, round(avg(participation_rate), 9) as mean_eta,
       round(avg(align), 6) + 0.0 as mean_align, round(avg(abs(imbalance)), 6) as mean_abs_imbalance,
       round({correlation_sql('direction', 'imbalance', 100)}, 6) + 0.0 as r
from binned group by eta_bin""")
def a15_per_eta_bin(spark, sf_dir):
    """Per decile of the participation rate: medians, mean alignment with the others and correlation."""
    rows = _eta_frame(spark, sf_dir)
    edges = bins.quantile_edges(rows, "participation_rate", 10)
    b = rows.withColumn("eta_bin", bins.bin_right(F.col("participation_rate"), edges))
    sums = b.groupBy("eta_bin").agg(
        F.avg("participation_rate").alias("mean_eta"),
        F.avg("align").alias("mean_align"),
        F.avg(F.abs("imbalance")).alias("mean_abs_imbalance"),
        *pair_sums(F.col("direction").cast("double"), F.col("imbalance")),
    )
    sums = sums.join(quantiles(b, ["eta_bin"], ["participation_rate"], [0.5]), "eta_bin")
    r6 = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return sums.select(
        "eta_bin", "n", F.round(F.col("q_participation_rate")[0], 9).alias("median_eta"), F.round("mean_eta", 9).alias("mean_eta"),
        r6("mean_align"), r6("mean_abs_imbalance"), (F.round(correlation(100), 6) + 0.0).alias("r"),
    )


@R.add(f"""
with {ETA_SQL}
select qv_bin::int as qv_bin, eta_bin::int as eta_bin, count(*) as n, round(avg(align), 6) + 0.0 as mean_align,
       round(median(q_over_v), 9) as median_qv, round(median(participation_rate), 9) as median_eta
from binned group by all""")
def a20_quantile_heatmap(spark, sf_dir):
    """Mean alignment per quintile of Q/V and decile of the participation rate."""
    rows = _eta_frame(spark, sf_dir)
    ee, qe = bins.quantile_edges(rows, "participation_rate", 10), bins.quantile_edges(rows, "q_over_v", 5)
    cell = ["qv_bin", "eta_bin"]
    rows = rows.withColumns({"qv_bin": bins.bin_right(F.col("q_over_v"), qe), "eta_bin": bins.bin_right(F.col("participation_rate"), ee)})
    sums = rows.groupBy(*cell).agg(F.count("*").alias("n"), (F.round(F.avg("align"), 6) + 0.0).alias("mean_align"))
    medians = quantiles(rows, cell, ["q_over_v", "participation_rate"], [0.5])
    return sums.join(medians, cell).select(
        *cell, "n", "mean_align", F.round(F.col("q_q_over_v")[0], 9).alias("median_qv"), F.round(F.col("q_participation_rate")[0], 9).alias("median_eta")
    )


@R.add(f"""
with {ETA_SQL}
select eta_bin::int as eta_bin, day, count(*) as n, sum(direction)::double + 0.0::double as sx, round(sum(imbalance), 4) + 0.0 as sy,
       round(sum(imbalance * imbalance), 4) as syy, round(sum(direction * imbalance), 4) + 0.0 as sxy
from binned group by all""")
def a16_sufficient_statistics(spark, sf_dir):
    """Count and moments of direction and imbalance per day and decile of the participation rate."""
    rows = _eta_frame(spark, sf_dir)
    edges = bins.quantile_edges(rows, "participation_rate", 10)
    b = rows.withColumn("eta_bin", bins.bin_right(F.col("participation_rate"), edges))
    sums = b.groupBy("eta_bin", "day").agg(*pair_sums(F.col("direction").cast("double"), F.col("imbalance")))
    r = lambda c, k: (F.round(c, k) + 0.0).alias(c)
    return sums.select("eta_bin", "day", "n", r("sx", 6), r("sy", 4), r("syy", 4), r("sxy", 4))


@R.add(f"""
with {ETA_SQL}, stats as (select eta_bin, day, count(*) as n, sum(direction)::double as sx, sum(imbalance) as sy, sum(direction * direction)::double as sxx,
       sum(imbalance * imbalance) as syy, sum(direction * imbalance) as sxy from binned group by all),
total as (select eta_bin, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(syy) as syy, sum(sxy) as sxy from stats group by eta_bin)
select eta_bin::int as eta_bin, n::bigint as n, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) + 0.0 as r from total where n >= 3""")
def a17_correlation_from_sums(spark, sf_dir):
    """Correlation per decile, from the days' sums."""
    rows = _eta_frame(spark, sf_dir)
    edges = bins.quantile_edges(rows, "participation_rate", 10)
    b = rows.withColumn("eta_bin", bins.bin_right(F.col("participation_rate"), edges))
    days = b.groupBy("eta_bin", "day").agg(*pair_sums(F.col("direction").cast("double"), F.col("imbalance")))
    return days.groupBy("eta_bin").agg(*merged_sums()).filter("n >= 3").select("eta_bin", "n", (F.round(correlation(), 6) + 0.0).alias("r"))


@R.add(f"""
with {facts_sql()}, {LOCAL_SQL}
select metaorder_id, round(imbalance - avg(imbalance) over (partition by day), 6) + 0.0 as imbalance_within from local""")
def w08_within_day(spark, sf_dir):
    """Local imbalance less its mean of the day."""
    rows = demeaned(leave_one_out(facts(spark, sf_dir), CELL, "q", "direction"), "day", "imbalance")
    return rows.select("metaorder_id", (F.round("imbalance_within", 6) + 0.0).alias("imbalance_within"))


CLASSES = {"all": None, "same": None, "prop": "proprietary", "client": "client"}


@R.add(f"""
with {facts_sql()},
iv as (select * from fact where start_us is not null and end_us >= start_us),
pairs as (
  select a.metaorder_id, a.q as q_own, b.metaorder_id as other, b.q, b.direction as d, b.flow as f,
         case when a.end_us = a.start_us then (b.start_us <= a.start_us and b.end_us >= a.start_us)::int::double
              else greatest(least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us), 0) / (a.end_us - a.start_us) end as w
  from iv a left join iv b on a.isin = b.isin and a.day = b.day and a.metaorder_id <> b.metaorder_id)
select metaorder_id, count(other) filter (w > 0) as all_count, count(*) filter (w > 0 and f = 'proprietary') as prop_count,
       count(*) filter (w > 0 and f = 'client') as client_count,
       round(coalesce(sum(w * q), 0), 2) + 0.0 as gross, round(coalesce(sum(w * q * d), 0), 2) + 0.0 as net,
       round(coalesce(sum(w * q) filter (f = 'proprietary'), 0), 2) + 0.0 as prop_gross,
       round(coalesce(sum(w * q) filter (f = 'client'), 0), 2) + 0.0 as client_gross
from pairs group by metaorder_id""")
def j09_overlap(spark, sf_dir):
    """What else is active in the ISIN while a metaorder runs: numbers, and time-weighted gross and signed volume."""
    rows = facts(spark, sf_dir)
    d, f = F.col("direction"), F.col("flow")
    classes = {"prop_up": (f == "proprietary") & (d == 1), "prop_down": (f == "proprietary") & (d == -1), "client_up": (f == "client") & (d == 1),
               "client_down": (f == "client") & (d == -1), "other_up": f.isNull() & (d == 1), "other_down": f.isNull() & (d == -1)}
    got = active_volume(rows, CELL, "metaorder_id", "start_us", "end_us", "q", classes)
    add = lambda names, what: sum((F.col(f"{n}_{what}") for n in names[1:]), F.col(f"{names[0]}_{what}"))
    every, up, down = list(classes), [n for n in classes if n.endswith("up")], [n for n in classes if n.endswith("down")]
    of = lambda g: [n for n in classes if n.startswith(g)]
    r = lambda c, name: (F.round(c, 2) + 0.0).alias(name)
    return got.select(
        "metaorder_id",
        add(every, "count").alias("all_count"), add(of("prop"), "count").alias("prop_count"), add(of("client"), "count").alias("client_count"),
        r(add(every, "volume"), "gross"), r(add(up, "volume") - add(down, "volume"), "net"),
        r(add(of("prop"), "volume"), "prop_gross"), r(add(of("client"), "volume"), "client_gross"),
    )


@R.add(f"""
with {facts_sql()},
iv as (select * from fact where start_us is not null and end_us >= start_us and member_id is not null),
pairs as (
  select a.metaorder_id, b.metaorder_id as other, b.q, b.direction as d,
         case when a.end_us = a.start_us then (b.start_us <= a.start_us and b.end_us >= a.start_us)::int::double
              else greatest(least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us), 0) / (a.end_us - a.start_us) end as w
  from iv a left join iv b on a.member_id = b.member_id and a.isin = b.isin and a.day = b.day and b.flow = 'client'
  where a.flow = 'proprietary')
select metaorder_id, count(other) filter (w > 0) as clients, round(coalesce(sum(w * q), 0), 2) + 0.0 as client_gross,
       round(coalesce(sum(w * q * d), 0), 2) + 0.0 as client_net
from pairs group by metaorder_id""")
def j10_member_overlap(spark, sf_dir):
    """Client flow of the same member and ISIN that is active while a proprietary metaorder runs."""
    rows = facts(spark, sf_dir).filter("member_id is not null and flow is not null")
    cell = ["member_id", *CELL]
    classes = {"up": (F.col("flow") == "client") & (F.col("direction") == 1), "down": (F.col("flow") == "client") & (F.col("direction") == -1)}
    got = active_volume(rows, cell, "metaorder_id", "start_us", "end_us", "q", classes)
    own = rows.filter("flow = 'proprietary'").select("metaorder_id")
    return got.join(own, "metaorder_id", "left_semi").select(
        "metaorder_id",
        (F.col("up_count") + F.col("down_count")).alias("clients"),
        (F.round(F.col("up_volume") + F.col("down_volume"), 2) + 0.0).alias("client_gross"),
        (F.round(F.col("up_volume") - F.col("down_volume"), 2) + 0.0).alias("client_net"),
    )


@R.add(f"""
with {facts_sql()},
iv as (select * from fact where start_us is not null and end_us >= start_us and member_id is not null),
pairs as (
  select a.metaorder_id, b.q, b.start_us <= a.start_us and b.end_us >= a.start_us as pre, b.start_us > a.start_us and b.start_us <= a.end_us as during
  from iv a left join iv b on a.member_id = b.member_id and a.day = b.day and b.flow = 'client' where a.flow = 'proprietary')
select metaorder_id, count(*) filter (pre) as preexisting, round(coalesce(sum(q) filter (pre), 0), 3) + 0.0 as preexisting_volume,
       count(*) filter (during) as started, round(coalesce(sum(q) filter (during), 0), 3) + 0.0 as started_volume from pairs group by metaorder_id""")
def j10_lead_lag(spark, sf_dir):
    """Client metaorders of the member, in any ISIN, that run when a proprietary one starts, and that start while it runs."""
    rows = facts(spark, sf_dir).filter("member_id is not null and flow is not null")
    got = lead_lag(rows, ["member_id", "day"], "metaorder_id", "start_us", "end_us", "q", F.col("flow") == "proprietary", F.col("flow") == "client")
    r = lambda c: (F.round(c, 3) + 0.0).alias(c)
    return got.select("metaorder_id", "preexisting", r("preexisting_volume"), "started", r("started_volume"))


WINDOW_US = 20 * 60 * 1_000_000


@R.add(f"""
with {facts_sql()},
s as (select * from fact where start_us is not null)
select a.metaorder_id,
       count(b.metaorder_id) filter (b.direction = a.direction and b.start_us < a.start_us) as same_before,
       count(b.metaorder_id) filter (b.direction = a.direction and b.start_us > a.start_us) as same_after,
       count(b.metaorder_id) filter (b.direction <> a.direction and b.start_us < a.start_us) as opposite_before,
       count(b.metaorder_id) filter (b.direction <> a.direction and b.start_us > a.start_us) as opposite_after
from s a left join s b on a.isin = b.isin and a.day = b.day and abs(b.start_us - a.start_us) <= {WINDOW_US}
group by a.metaorder_id""")
def j11_start_neighbours(spark, sf_dir):
    """Other starts in the ISIN within 20 minutes before and after, of the same and the other direction."""
    rows = facts(spark, sf_dir).filter("start_us is not null")
    names = [f"{k}_{s}" for k in ("same", "opposite") for s in ("before", "after")]
    return neighbours(rows, CELL, "start_us", "direction", WINDOW_US).select("metaorder_id", *names)


OPEN, CLOSE, WIDTH = 570, 1050, 10  # minutes of the day: 09:30, 17:30; bins of 10


@R.add(f"""
with {facts_sql()},
m as (select *, (start_us % {DAY_US}) / 6e7 - {OPEN} as minute from fact where start_us is not null),
b as (select *, case when minute between 0 and {CLOSE - OPEN} then least(floor(minute / {WIDTH})::int, {(CLOSE - OPEN) // WIDTH - 1}) end as bin from m),
c as (select isin, day, bin, sum(q * direction) as s, sum(q) as v from b where bin is not null group by all),
l as (select b.flow, b.day, b.bin, case when v - q > 1e-9 * v then (s - q * direction) / (v - q) end * direction as align from b join c using (isin, day, bin)),
panel as (select flow, bin, day, count(*) as n, avg(align) as mean_align from l where align is not null and flow is not null group by all having count(*) >= 5)
select flow, bin, count(*) as days, round(avg(mean_align), 6) + 0.0 as mean_of_days, round(median(mean_align), 6) + 0.0 as median_of_days
from panel group by all""")
def a23_intraday_crowding(spark, sf_dir):
    """Alignment with the others of the same ISIN, day and ten minutes: mean per day and bin (of at least 5), then over days."""
    rows = facts(spark, sf_dir).filter("start_us is not null")
    minute = F.pmod("start_us", F.lit(DAY_US)) / 6e7 - OPEN
    rows = rows.withColumn("bin", bins.session_bin(minute, CLOSE - OPEN, WIDTH)).filter("bin is not null")
    rows = leave_one_out(rows, [*CELL, "bin"], "q", "direction").filter("imbalance is not null and flow is not null")
    panel = rows.groupBy("flow", "bin", "day").agg(F.count("*").alias("n"), F.avg(F.col("direction") * F.col("imbalance")).alias("m")).filter("n >= 5")
    return panel.groupBy("flow", "bin").agg(
        F.count("*").alias("days"),
        (F.round(F.avg("m"), 6) + 0.0).alias("mean_of_days"),
        (F.round(F.median("m"), 6) + 0.0).alias("median_of_days"),
    )


@R.add(f"""
with {facts_sql()}, {LOCAL_SQL},
ranked as (select *, (dense_rank() over (order by day) - 1) // 3 as block from local)
select member_id, block::bigint as block, count(*) as n, round({correlation_sql('direction', 'imbalance', 5)}, 6) + 0.0 as r
from ranked where member_id is not null and flow = 'proprietary' group by all having count(*) >= 5""")
def a40_a41_member_windows(spark, sf_dir):
    """Correlation of direction and imbalance per member over blocks of three trading days that don't overlap."""
    from pyspark.sql import Window

    rows = leave_one_out(facts(spark, sf_dir), CELL, "q", "direction")
    # trading days are few: they are numbered apart and joined back, so that no task has to sort all rows
    days = rows.select("day").distinct()
    blocks = days.select("day", F.expr("(dense_rank() over (order by day) - 1) div 3").alias("block"))
    own = rows.filter("member_id is not null and flow = 'proprietary'").join(F.broadcast(blocks), "day")
    sums = own.groupBy("member_id", "block").agg(F.count("*").alias("rows"), *pair_sums(F.col("direction").cast("double"), F.col("imbalance")))
    return sums.filter("rows >= 5").select("member_id", "block", F.col("rows").alias("n"), (F.round(correlation(5), 6) + 0.0).alias("r"))
