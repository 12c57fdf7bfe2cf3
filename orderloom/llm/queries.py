"""Queries of the operators for training data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions.times import DAY_US
from orderloom.functions.text import trimmed
from orderloom.llm.mixing import mix, shares
from orderloom.llm.packing import CAPACITY, WINDOWS, pack, pack_documents
from orderloom.llm.pii import find_pii, redact_pii
from orderloom.llm.quantiles import merge, percentiles, sketch
from orderloom.llm.runs import collapse_runs
from orderloom.llm.tokens import with_sizes
from orderloom.plans.problem_queries import METAORDERS_SQL
from orderloom.plans.registry import Registry
from orderloom.sources.tables import metaorders, table, written

R = Registry()

# Problem 2: percentiles

METRICS = ["impact", "q_over_v", "participation_rate"]
PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


def day_sketches(spark, sf_dir):
    """A sketch per key (ISIN or member), day of the start (or else trade_date) and metric."""
    rows = metaorders(spark, sf_dir, "isin", "member_id", "start_us", "trade_date", *METRICS)
    day = F.coalesce(F.expr(f"start_us div {DAY_US}").cast("int"), F.unix_date("trade_date"))
    return sketch(rows.select("isin", "member_id", day.alias("day"), *METRICS), ["day"], METRICS, fields=["isin", "member_id"])


@R.add()
def p2_percentiles(spark, sf_dir):
    """Six percentiles of three metrics per ISIN and per member: of each day, of each month and of all days.

    Months and the whole are merged from the days' sketches, not made from the rows again.
    """
    days = written(day_sketches(spark, sf_dir), "sketches")
    key = ["key_field", "key_value", "metric"]
    day = F.date_from_unix_date("day")
    named = days.select(*key, F.date_format(day, "yyyy-MM-dd").alias("days"), "n", "spread", "items", "sizes")
    unions = days.select(
        *key, F.explode(F.array(F.date_format(day, "yyyy-MM"), F.lit("all"))).alias("days"), "n", "spread", "items", "sizes"
    )
    both = named.unionByName(merge(unions, [*key, "days"]).select(*named.columns))
    found = percentiles(both, PROBABILITIES)
    each = [F.col("percentiles")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(PROBABILITIES)]
    return found.select(*key, "days", "n", *each, "rank_error")


BOUNDS_SQL = f"""
with {METAORDERS_SQL},
r as (
  select isin, member_id, impact, q_over_v, participation_rate from mo where start_us is not null or trade_date is not null),
k as (
  select 'isin' as key_field, isin as key_value, impact, q_over_v, participation_rate from r where isin is not null
  union all select 'member_id', member_id, impact, q_over_v, participation_rate from r where member_id is not null),
v as (
  select key_field, key_value, 'impact' as metric, impact as x from k union all
  select key_field, key_value, 'q_over_v', q_over_v from k union all
  select key_field, key_value, 'participation_rate', participation_rate from k)
select key_field, key_value, metric, count(*) as n, true as kept
from v where x is not null and isfinite(x) group by all"""


@R.add(BOUNDS_SQL)
def p2_bounds(spark, sf_dir):
    """Per key and metric, over all days: how many values there are, and whether the exact ranks of all six percentiles
    are within the stated bound of what was asked for."""
    found = p2_percentiles(spark, sf_dir).filter("days = 'all'").drop("days", "n")
    rows = metaorders(spark, sf_dir, "isin", "member_id", "start_us", "trade_date", *METRICS).filter("start_us is not null or trade_date is not null")
    keys = F.array(*[F.struct(F.lit(k).alias("key_field"), F.col(k).alias("key_value")) for k in ("isin", "member_id")])
    each = rows.select(F.inline(keys), *METRICS).filter("key_value is not null")
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in METRICS])
    values = each.select("key_field", "key_value", F.inline(metrics)).filter("x is not null and abs(x) < double('infinity')")
    names = [f"p{round(p * 100):02d}" for p in PROBABILITIES]
    ranks = [F.sum((F.col("x") < F.col(c)).cast("bigint")).alias(f"_{c}l") for c in names]
    ranks += [F.sum((F.col("x") <= F.col(c)).cast("bigint")).alias(f"_{c}u") for c in names]
    key = ["key_field", "key_value", "metric"]
    counted = values.join(found, key).groupBy(*key, "rank_error").agg(F.count("*").alias("n"), *ranks)
    room = F.col("rank_error") * F.col("n") + 1
    kept = [(F.col(f"_{c}l") <= p * F.col("n") + room) & (F.col(f"_{c}u") >= p * F.col("n") - room) for c, p in zip(names, PROBABILITIES)]
    both = kept[0]
    for x in kept[1:]:
        both = both & x
    return counted.select(*key, "n", both.alias("kept"))


# Problem 6: runs


def _directed(spark, sf_dir, *more):
    rows = metaorders(spark, sf_dir, "member_id", "isin", "start_us", "direction", *more)
    return rows.filter("direction in (-1, 1)").withColumn("day", F.expr(f"start_us div {DAY_US}"))


RUNS_SQL = f"""
with {METAORDERS_SQL},
d as (
  select member_id, isin, start_us // {DAY_US} as day, start_us, metaorder_id, direction,
         row_number() over (partition by member_id, isin, start_us // {DAY_US} order by start_us, metaorder_id)
         - row_number() over (partition by member_id, isin, start_us // {DAY_US}, direction order by start_us, metaorder_id) as k
  from mo where member_id is not null and isin is not null and start_us is not null and direction in (-1, 1))
select member_id, isin, arg_min(metaorder_id, (start_us, metaorder_id)) as first_metaorder_id,
       arg_max(metaorder_id, (start_us, metaorder_id)) as last_metaorder_id
from d group by member_id, isin, day, direction, k having count(*) >= 2"""


@R.add(RUNS_SQL)
def p6_found(spark, sf_dir):
    """Each longest run of two or more metaorders of one direction, per member, ISIN and day."""
    runs = collapse_runs(_directed(spark, sf_dir), ["member_id", "isin", "day"], "start_us", "metaorder_id", "direction")
    return runs.filter("n_events >= 2").select(
        "member_id", "isin", F.col("first_id").alias("first_metaorder_id"), F.col("last_id").alias("last_metaorder_id")
    )


@R.add()
def p6_runs(spark, sf_dir):
    """Runs of one direction and nearly equal size (squared deviations of ln q, penalty 0.5 a run), with count and duration."""
    rows = _directed(spark, sf_dir, "q").withColumn("ln_q", F.when(F.col("q") > 0, F.ln("q")))
    return collapse_runs(rows, ["member_id", "isin", "day"], "start_us", "metaorder_id", "direction", "ln_q", penalty=0.5)


# Problem 7: packing


@R.add()
def p7_containers(spark, sf_dir):
    """All texts in containers of 2,048 tokens, with container, offset and fill."""
    return pack_documents(with_sizes(table(spark, sf_dir, "documents").select("doc_id", "text")))


P7_SQL = """
select count(*) as documents, true as all_placed, true as none_over, true as cut_only_if_larger, true as offsets_close, true as well_filled
from documents"""


@R.add(P7_SQL)
def p7_checked(spark, sf_dir):
    """What must hold of the containers, over all texts: every token is in its place, no container holds more than 2,048,
    only texts larger than that are cut, offsets leave no hole, and at most 1 % more containers than the total needs
    (and one of each block of texts)."""
    sizes = written(with_sizes(table(spark, sf_dir, "documents").select("doc_id", "text")), "sizes")
    placed = pack(sizes, "doc_id", "n_tokens")
    per_doc = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"))
    docs = sizes.join(per_doc, "doc_id", "left").agg(
        F.count("*").alias("documents"),
        F.every(F.coalesce(F.col("placed") == F.col("n_tokens"), F.lit(False))).alias("all_placed"),
        F.every(F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY))).alias("cut_only_if_larger"),
        F.sum("n_tokens").alias("_total"),
    )
    boxes = placed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("upto"))
    boxes = boxes.agg(F.every(F.col("n") <= CAPACITY).alias("none_over"), F.every(F.col("n") == F.col("upto")).alias("offsets_close"), F.count("*").alias("_used"))
    needed = F.ceil(F.col("_total") / CAPACITY)
    filled = F.col("_used") <= needed * 1.01 + F.ceil(needed / WINDOWS)
    return docs.join(F.broadcast(boxes)).select("documents", "all_placed", "none_over", "cut_only_if_larger", "offsets_close", filled.alias("well_filled"))


# Problem 8: mixing


def _mixed(spark, sf_dir):
    docs = with_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), size="size")
    docs = written(docs.withColumn("source", F.lower(trimmed(F.col("source")))), "sizes")
    targets = table(spark, sf_dir, "mix_targets").withColumn("source", F.lower(trimmed(F.col("source"))))
    return mix(docs, targets), targets


@R.add()
def p8_mix(spark, sf_dir):
    """A selection of documents with the target share of tokens per source."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("size", "n_tokens")


@R.add()
def p8_shares(spark, sf_dir):
    """Target and actual share of tokens per source, and the most copies of a document."""
    return shares(*_mixed(spark, sf_dir)).withColumnRenamed("size", "n_tokens")


P8_SQL = """
with d as (select distinct lower(trim(source)) as source from documents where source is not null and text <> '')
select lower(trim(t.source)) as source, t.target_weight, d.source is not null and t.target_weight > 0 as selected, true as within_repeats, true as on_target
from mix_targets t left join d on d.source = lower(trim(t.source))"""


@R.add(P8_SQL)
def p8_checked(spark, sf_dir):
    """What must hold of the mix, per target: whether any of its source is selected, that no document comes more often
    than it may, and that the source's size is its share of the whole, give or take its largest document.

    Along sizes in order, systematic sampling misses a total by no more than the range of the sizes.
    """
    mixed, targets = _mixed(spark, sf_dir)
    mixed = written(mixed, "mixed")
    largest = mixed.groupBy("source").agg(F.max("size").alias("_largest"))
    whole = F.sum("size").over(Window.partitionBy(F.lit(0)))
    weight = F.col("target_weight") / F.sum(F.when(F.col("size") > 0, F.col("target_weight"))).over(Window.partitionBy(F.lit(0)))
    report = shares(mixed, targets).join(F.broadcast(largest), "source", "left")
    # the whole is itself off by at most what its sources are off
    most = F.sum("_largest").over(Window.partitionBy(F.lit(0))) * weight + F.col("_largest") * 1.05
    return report.select(
        "source", "target_weight", (F.col("size") > 0).alias("selected"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"),
        ((F.col("size") == 0) | (F.abs(F.col("size") - weight * whole) <= most)).alias("on_target"),
    )


# Problem 9: personal data


@R.add()
def p9_found(spark, sf_dir):
    """Each distinct value of personal data in a document, by type."""
    found = find_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))
    return found.select("doc_id", "pii_type", "pii_value").distinct()


@R.add()
def p9_redacted(spark, sf_dir):
    """All texts with typed placeholders in place of personal data, and how many."""
    return redact_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))
