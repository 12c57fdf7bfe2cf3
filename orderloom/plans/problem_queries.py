"""The numbered problems of the core: sessions, hot keys, intervals, trailing totals."""

from pyspark.sql import functions as F

from orderloom.functions.numbers import finite
from orderloom.functions.times import DAY_US
from orderloom.operators.hotkeys import per_key
from orderloom.operators.intervals import periods_and_gaps
from orderloom.operators.rolling import trailing_totals
from orderloom.operators.sessions import sessionize
from orderloom.plans.registry import Registry
from orderloom.sources.tables import metaorders, table, written

R = Registry()

SESSION_GAP_US = 20 * 60 * 1_000_000
HOT_SHARE = 0.04

# The metaorders of overlap in canonical writing, as SQL.
METAORDERS_SQL = r"""
latest as (
  select * from overlap
  qualify row_number() over (partition by metaorder_id, case when metaorder_id is null then row_id end
                             order by ingest_ts desc nulls last, row_id desc nulls last) = 1),
trimmed as (
  select *, nullif(regexp_replace(member_id, '^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$', '', 'g'), '') as m,
         nullif(upper(regexp_replace(isin, '^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$', '', 'g')), '') as i
  from latest),
mo as (
  select * exclude (member_id, isin, m, i), i as isin,
         case when regexp_full_match(m, '[+-]?[0-9]{1,30}([.]0{0,8})?') then cast(cast(m as decimal(38, 8)) as decimal(30, 0))::varchar
              else m end as member_id,
         coalesce(epoch_us(start_timestamp), start_ns // 1000) as start_us,
         coalesce(epoch_us(end_timestamp), end_ns // 1000) as end_us
  from trimmed)"""


def member_sessions(spark, sf_dir):
    return sessionize(metaorders(spark, sf_dir, "member_id", "start_us"), ["member_id"], "start_us", SESSION_GAP_US)


SESSIONS_SQL = f"""
with {METAORDERS_SQL},
seen as (
  select member_id, start_us, start_us // {DAY_US} as frame,
         start_us - lag(start_us) over (partition by member_id, start_us // {DAY_US} order by start_us) as since
  from mo where member_id is not null and start_us is not null),
counted as (
  select *, sum(case when since > {SESSION_GAP_US} then 1 else 0 end)
              over (partition by member_id, frame order by start_us rows unbounded preceding) as k
  from seen)
select member_id, frame, min(start_us) as session_start_us, max(start_us) as session_end_us,
       max(start_us) - min(start_us) as duration_us, count(*) as n_events
from counted group by member_id, frame, k"""


@R.add(f"select member_id, session_start_us, session_end_us from ({SESSIONS_SQL})")
def p1_found(spark, sf_dir):
    """Every session of a member's metaorders within a day, at most 20 minutes between starts."""
    return member_sessions(spark, sf_dir).select("member_id", "session_start_us", "session_end_us")


@R.add(SESSIONS_SQL)
def p1_sessions(spark, sf_dir):
    """Sessions with duration and number of metaorders."""
    return member_sessions(spark, sf_dir)


HOT_MEASURES = ("q", "n_child", "impact")


def _per_key(spark, sf_dir, *measures):
    """(key field, per-key results, number of metaorders) for members and ISINs; the metaorders are made once."""
    rows = written(metaorders(spark, sf_dir, "member_id", "isin", *measures), "metaorders")
    profile = (
        table(spark, sf_dir, "summary").groupBy("member_id").agg(F.sum("n_metaorders").alias("profile_metaorders"))
    )
    n = rows.count()
    sums = {m: finite(F.col(m)) for m in measures}
    for key, dim in (("isin", None), ("member_id", profile if measures else None)):
        yield key, per_key(rows, key, sums, share=HOT_SHARE, profile=dim), n


@R.add(f"""
with {METAORDERS_SQL},
n as (select count(*) as n from mo),
keys as (select 'isin' as key_field, isin as key_value, count(*) as c from mo where isin is not null group by isin
         union all select 'member_id', member_id, count(*) from mo where member_id is not null group by member_id)
select key_field, key_value from keys, n where c >= {HOT_SHARE} * n""")
def p3_found(spark, sf_dir):
    """Each ISIN and member with at least 4 % of all metaorders."""
    parts = [
        r.filter(F.col("n_rows") >= HOT_SHARE * n).select(F.lit(k).alias("key_field"), F.col(k).alias("key_value"))
        for k, r, n in _per_key(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1])


@R.add(f"""
with {METAORDERS_SQL},
n as (select count(*) as n from mo),
f as (select isin, member_id, case when isfinite(q) then q end as q, n_child, case when isfinite(impact) then impact end as impact from mo),
keys as (
  select 'isin' as key_field, isin as key_value, count(*) as n_metaorders, sum(q) as volume, sum(n_child) as child_orders,
         avg(impact) as impact_mean, null::bigint as profile_metaorders
  from f where isin is not null group by isin
  union all
  select 'member_id', member_id, count(*), sum(q), sum(n_child), avg(impact), any_value(p)
  from f left join (select member_id as id, sum(n_metaorders)::bigint as p from summary group by 1) s on s.id = f.member_id
  where member_id is not null group by member_id)
select key_field, key_value, n_metaorders, round(volume, 3) as volume, child_orders::bigint as child_orders,
       round(impact_mean, 10) as impact_mean, profile_metaorders, n_metaorders >= {HOT_SHARE} * n as is_hot
from keys, n""")
def p3_per_key(spark, sf_dir):
    """Count, volume, child orders and mean impact of each ISIN and member, and whether the key is hot."""
    parts = []
    for k, r, n in _per_key(spark, sf_dir, *HOT_MEASURES):
        mine = F.col("profile_metaorders") if "profile_metaorders" in r.columns else F.lit(None).cast("bigint")
        parts.append(
            r.select(
                F.lit(k).alias("key_field"),
                F.col(k).alias("key_value"),
                F.col("n_rows").alias("n_metaorders"),
                F.round("q_sum", 3).alias("volume"),
                F.col("n_child_sum").cast("bigint").alias("child_orders"),
                F.round(F.try_divide("impact_sum", "impact_n"), 10).alias("impact_mean"),
                mine.alias("profile_metaorders"),
                (F.col("n_rows") >= HOT_SHARE * n).alias("is_hot"),
            )
        )
    return parts[0].unionByName(parts[1])


@R.add(f"""
with {METAORDERS_SQL},
iv as (select isin, start_us as s, end_us as e from mo where isin is not null and start_us is not null and end_us >= start_us),
seen as (select *, max(e) over (partition by isin order by s, e rows between unbounded preceding and 1 preceding) as reach from iv),
numbered as (select *, sum(case when reach is null or s > reach then 1 else 0 end)
                         over (partition by isin order by s, e rows unbounded preceding) as k from seen),
period as (select isin, min(s) as f, max(e) as t from numbered group by isin, k),
gap as (select isin, lag(t) over (partition by isin order by f) as f, f as t from period)
select 'period' as kind, isin, f as from_us, t as to_us from period
union all
select 'gap', isin, f, t from gap where f // {DAY_US} = t // {DAY_US}""")
def p4_found(spark, sf_dir):
    """Active periods of each ISIN and the gaps between them within a day."""
    rows = metaorders(spark, sf_dir, "isin", "start_us", "end_us")
    same_day = F.expr(f"from_us div {DAY_US} = to_us div {DAY_US}")
    return periods_and_gaps(rows, ["isin"], "start_us", "end_us").filter((F.col("kind") == "period") | same_day)


def _trailing(spark, sf_dir, whole=False):
    rows = metaorders(spark, sf_dir, "isin", "trade_date", "start_us", "daily_vol")
    start_day = F.date_from_unix_date(F.expr(f"start_us div {DAY_US}").cast("int"))
    rows = rows.withColumn("day", F.coalesce("trade_date", start_day))
    daily = {"metaorders": F.count("*"), "daily_vol": F.max(finite(F.col("daily_vol")))}
    return trailing_totals(rows, ["isin"], "day", daily, whole=whole)


TRAILING_SQL = f"""
with {METAORDERS_SQL},
d as (select isin, coalesce(trade_date, (date '1970-01-01' + (start_us // {DAY_US})::int)::date) as day, daily_vol from mo),
per_day as (
  select isin, day, count(*) as metaorders, max(case when isfinite(daily_vol) then daily_vol end) as daily_vol
  from d where isin is not null and day is not null group by all),
calendar as (
  select isin, unnest(generate_series(min(day)::timestamp, max(day)::timestamp + interval 6 day, interval 1 day))::date as day
  from per_day group by isin),
dense as (
  select isin, day, coalesce(metaorders, 0) as metaorders, coalesce(daily_vol, 0) as daily_vol
  from calendar left join per_day using (isin, day))
"""


@R.add(
    TRAILING_SQL
    + """, r as (select *, sum(metaorders) over (partition by isin order by day rows between 6 preceding and current row) as n7 from dense)
select isin, strftime(day, '%Y-%m-%d') as idle_day from r where metaorders = 0 and n7 > 0"""
)
def p5_found(spark, sf_dir):
    """Days on which an ISIN has no metaorder but had one in the six days before."""
    idle = _trailing(spark, sf_dir).filter("metaorders = 0 and metaorders_total_7d > 0")
    return idle.select("isin", F.date_format("day", "yyyy-MM-dd").alias("idle_day"))


@R.add(
    TRAILING_SQL
    + "select isin, day, metaorders, round(daily_vol, 9) as daily_vol"
    + "".join(
        f", (sum(metaorders) over w{n})::bigint as metaorders_total_{n}d, round(sum(metaorders) over w{n} / {n}, 9) as metaorders_avg_{n}d"
        f", round(sum(daily_vol) over w{n}, 9) as daily_vol_total_{n}d, round(sum(daily_vol) over w{n} / {n}, 9) as daily_vol_avg_{n}d"
        for n in (7, 30)
    )
    + " from dense window "
    + ", ".join(f"w{n} as (partition by isin order by day rows between {n - 1} preceding and current row)" for n in (7, 30))
)
def p5_trailing(spark, sf_dir):
    """7-day and 30-day totals and averages of each ISIN's metaorders and daily volatility, to six days after its last day.

    p5_calendar has every calendar day."""
    out = _trailing(spark, sf_dir)
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# As TRAILING_SQL, but over the product of ISINs and calendar days.
CALENDAR_SQL = f"""
with {METAORDERS_SQL},
d as (select isin, coalesce(trade_date, (date '1970-01-01' + (start_us // {DAY_US})::int)::date) as day, daily_vol from mo),
per_day as (
  select isin, day, count(*) as metaorders, max(case when isfinite(daily_vol) then daily_vol end) as daily_vol
  from d where isin is not null and day is not null group by all),
bounds as (select min(day)::timestamp as f, max(day)::timestamp as t from per_day),
calendar as (
  select isin, unnest(generate_series(any_value(f), greatest(max(day)::timestamp + interval 29 day, any_value(t)), interval 1 day))::date as day
  from per_day, bounds group by isin),
dense as (
  select isin, day, coalesce(metaorders, 0) as metaorders, coalesce(daily_vol, 0) as daily_vol
  from calendar left join per_day using (isin, day))
"""


@R.add(
    CALENDAR_SQL
    + "select isin, day, metaorders, round(daily_vol, 9) as daily_vol"
    + "".join(
        f", (sum(metaorders) over w{n})::bigint as metaorders_total_{n}d, round(sum(metaorders) over w{n} / {n}, 9) as metaorders_avg_{n}d"
        f", round(sum(daily_vol) over w{n}, 9) as daily_vol_total_{n}d, round(sum(daily_vol) over w{n} / {n}, 9) as daily_vol_avg_{n}d"
        for n in (7, 30)
    )
    + " from dense window "
    + ", ".join(f"w{n} as (partition by isin order by day rows between {n - 1} preceding and current row)" for n in (7, 30))
)
def p5_calendar(spark, sf_dir):
    """As p5_trailing, for each ISIN on every calendar day of the table, and on until its 30 days have run out."""
    out = _trailing(spark, sf_dir, whole=True)
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
