"""Resampling of days, clusters or short series: every replicate is a set of rows drawn by hashes, and ends as sums.

A draw is the row whose number is a hash of seed, run and place modulo the number of rows, so anyone who knows the hash
(the first 32 bits of an MD5) gets the same replicates, on any number of tasks.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16  # rows of whole strata drawn from at once


def hashed(*parts: Column) -> Column:
    """A whole number below 2**32 from the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def hashed_sql(*parts: str) -> str:
    """The same as SQL."""
    text = " || '|' || ".join(f"({p})::varchar" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def numbered(rows: DataFrame, by: list[str], row: str) -> DataFrame:
    """Adds _i, the row's number from 0 in order of row, and _n, how many there are in the group. Meant for days or clusters, of
    which a group has hundreds."""
    w = Window.partitionBy(*by)
    return rows.withColumns({"_i": F.row_number().over(w.orderBy(row)).cast("bigint") - 1, "_n": F.count("*").over(w)})


def drawn(rows: DataFrame, by: list[str], row: str, runs: int, seed: int = 0) -> DataFrame:
    """The rows drawn with replacement, as many as there are, once for each run from 1; run 0 has every row once."""
    own = numbered(rows, by, row)
    places = own.select(*by, F.col("_i").alias("_place"), "_n", F.explode(F.sequence(F.lit(0), F.lit(runs))).alias("run"))
    pick = F.when(F.col("run") == 0, F.col("_place")).otherwise(F.pmod(hashed(F.lit(seed), F.col("run"), F.col("_place")), F.col("_n")))
    return places.select(*by, "run", pick.alias("_i")).join(own.drop("_n"), [*by, "_i"]).drop("_i")


def shuffled(rows: DataFrame, by: list[str], row: str, value: str, runs: int, seed: int = 0) -> DataFrame:
    """The rows with value exchanged among them, once for each run from 1; run 0 is as it is."""
    own = numbered(rows, by, row)
    each = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs))).alias("run"))
    order = F.when(F.col("run") == 0, F.col("_i")).otherwise(hashed(F.lit(seed), F.col("run"), F.col("_i")))
    ranked = each.withColumn("_to", F.row_number().over(Window.partitionBy(*by, "run").orderBy(order, "_i")).cast("bigint") - 1)
    values = ranked.select(*by, "run", F.col("_to").alias("_i"), F.col(value).alias("_v"))
    return each.drop(value).join(values, [*by, "run", "_i"]).withColumnRenamed("_v", value).drop("_i", "_n")


def interval(replicates: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """by, VALUE (of run 0), low and high: percentiles of the other runs, of which NULLs are left out."""
    other = F.when(F.col("run") > 0, F.col(value))
    return replicates.groupBy(*by).agg(
        F.max(F.when(F.col("run") == 0, F.col(value))).alias(value), F.percentile(other, F.lit(alpha / 2)).alias("low"), F.percentile(other, F.lit(1 - alpha / 2)).alias("high")
    )


def two_sided(replicates: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, VALUE (of run 0) and p: twice the smaller share of the other runs on either side of it, at most 1."""
    w = Window.partitionBy(*by)
    own = replicates.withColumn("_own", F.max(F.when(F.col("run") == 0, F.col(value))).over(w)).filter("run > 0")
    share = lambda c: F.avg(F.when(F.col(value).isNotNull(), c.cast("int")))
    above, below = share(F.col(value) >= F.col("_own") - 1e-12), share(F.col(value) <= F.col("_own") + 1e-12)
    return own.groupBy(*by).agg(F.max("_own").alias(value), F.least(F.lit(1.0), 2 * F.least(above, below)).alias("p"))


def _hashes(seed: int, run: int, rows: list[bytes | None]) -> np.ndarray:
    """hashed() of seed, run and each row's text; of a missing row the largest number."""
    start = f"{seed}|{run}|".encode()
    digests = b"".join([b"\xff\xff\xff\xff" if r is None else hashlib.md5(start + r).digest()[:4] for r in rows])
    return np.frombuffer(digests, ">u4").astype(np.int64)


def strata_permutation(
    rows: DataFrame, stratum: list[str], row: str, treated: str, value: str, runs: int, seed: int = 0, slices: int = 64, most: int = 1 << 18
) -> DataFrame:
    """run and effect: the mean of value of treated rows less that of the others of their stratum, weighted by the strata's treated rows.

    Run 0 is as it is; in each other run as many rows of a stratum as were treated are drawn for it, those of the least hashes
    of seed, run and row (ties by row, missing rows last). Rows with a NULL value, and strata without both kinds, are left out;
    no rows give no run.

    Strata of up to most rows are shuffled once, whole, and all runs drawn within the task, which keeps a sum per run. Of
    larger ones (their list is broadcast) no row moves: hashes are counted per slice of their range, and only the one slice
    in which a run's last drawn row lies is shuffled and sorted.
    """
    keys = [f"_s{i}" for i in range(len(stratum))]
    own = rows.filter(F.col(value).isNotNull() & F.col(treated).isNotNull())
    own = own.select(*[F.col(c).alias(k) for c, k in zip(stratum, keys)], F.col(row).alias("_row"), F.col(treated).alias("_t"), F.col(value).cast("double").alias("_v"))
    count = own.groupBy(*keys).agg(F.count(F.when(F.col("_t"), 1)).alias("_k"), F.count("*").alias("_n"), F.sum("_v").alias("_all"), F.sum(F.when(F.col("_t"), F.col("_v"))).alias("_own"))
    large = count.filter(F.col("_n") > most).withColumnsRenamed({k: f"{k}c" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in keys]
    small = _drawn_whole(own.join(F.broadcast(large.select(*[f"{k}c" for k in keys])), same, "left_anti"), keys, runs, seed)
    large = large.filter("_k > 0 and _k < _n")
    both = small.unionByName(_drawn_by_slices(own, large, keys, same, runs, seed, slices))
    return both.groupBy("run").agg((F.sum("_up") / F.sum("_k")).alias("effect")).filter("effect is not null")


def _drawn_whole(own: DataFrame, keys: list[str], runs: int, seed: int) -> DataFrame:
    """run, _up (effects times treated rows) and _k (treated rows), summed over the strata of a task."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_row").asc_nulls_last()))
    in_order = own.withColumn("_nth", nth).select((F.col("_nth") == 1).alias("_new"), F.col("_row").cast("string").alias("_row"), "_t", "_v")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up, treated, kept, size = np.zeros(runs + 1), 0, [], 0
        for batch in batches:
            kept.append(batch)
            size += len(batch)
            if size >= CHUNK and batch["_new"].any():
                part = pd.concat(kept, ignore_index=True)
                open_from = np.flatnonzero(part["_new"])[-1]  # the last stratum may go on in the next batch
                treated += add(part.iloc[:open_from], up)
                kept, size = [part.iloc[open_from:]], len(part) - open_from
        if size:
            treated += add(pd.concat(kept, ignore_index=True), up)
        if treated:
            yield pd.DataFrame({"run": np.arange(runs + 1), "_up": up, "_k": treated})

    def add(part: pd.DataFrame, up: np.ndarray) -> int:
        group = np.cumsum(part["_new"].to_numpy(bool)) - 1
        is_treated = part["_t"].to_numpy(bool)
        n, k = np.bincount(group), np.bincount(group[is_treated], minlength=group[-1] + 1 if len(group) else 0)
        mixed = (0 < k) & (k < n)
        if not mixed.any():
            return 0
        of = mixed[group]
        group, is_treated, v = (np.cumsum(mixed) - 1)[group[of]], is_treated[of], part["_v"].to_numpy(float)[of]
        names = [None if r is None else r.encode() for r in part["_row"].to_numpy(object)[of]]
        n, k = n[mixed], k[mixed]
        total = np.bincount(group, v)
        drawn = np.arange(len(group)) - (np.cumsum(n) - n)[group] < k[group]
        for run in range(runs + 1):
            at = np.flatnonzero(is_treated) if run == 0 else np.argsort(group << 32 | _hashes(seed, run, names), kind="stable")[drawn]
            had = np.bincount(group[at], v[at], len(n))
            up[run] += (had - k * (total - had) / (n - k)).sum()
        return int(k.sum())

    return in_order.mapInPandas(sums, "run int, _up double, _k bigint")


def _drawn_by_slices(own: DataFrame, large: DataFrame, keys: list[str], same: list[Column], runs: int, seed: int, slices: int) -> DataFrame:
    """The same of the strata in large, a row for each run and stratum."""
    each = own.join(F.broadcast(large.select(*[f"{k}c" for k in keys], "_k")), same).select(*keys, "_k", "_row", "_v", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    hash_ = F.when(F.col("_row").isNull(), F.lit((1 << 32) - 1)).otherwise(hashed(F.lit(seed), F.col("run"), F.col("_row")))
    each = each.withColumn("_h", hash_).withColumn("_slice", F.expr(f"_h div {(1 << 32) // slices}"))
    per = each.groupBy("run", *keys, "_k", "_slice").agg(F.count("*").alias("_m"), F.sum("_v").alias("_sum"))
    upto = F.sum("_m").over(Window.partitionBy("run", *keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("_upto", upto)
    whole = per.filter("_upto <= _k").select("run", *keys, "_sum")
    last = per.filter("_upto > _k and _upto - _m < _k").select("run", *keys, "_slice", (F.col("_k") - F.col("_upto") + F.col("_m")).alias("_left"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}l")) for c in ("run", *keys, "_slice")]
    cut = each.join(F.broadcast(last.select(*[F.col(c).alias(f"{c}l") for c in ("run", *keys, "_slice")], "_left")), on)
    nth = F.row_number().over(Window.partitionBy("run", *keys, "_slice").orderBy("_h", F.col("_row").asc_nulls_last()))
    part = cut.withColumn("_nth", nth).filter("_nth <= _left").select("run", *keys, F.col("_v").alias("_sum"))
    drawn_sum = whole.unionByName(part).groupBy("run", *keys).agg(F.sum("_sum").alias("_own"))
    renamed = large.select(*[f"{k}c" for k in keys], "_k", "_n", "_all", F.col("_own").alias("_first"))
    other = drawn_sum.join(F.broadcast(renamed), same).select("run", "_k", "_n", "_all", "_own")
    first = renamed.select(F.lit(0).alias("run"), "_k", "_n", "_all", F.col("_first").alias("_own"))
    return first.unionByName(other).select("run", F.expr("_own - _k * (_all - _own) / (_n - _k)").alias("_up"), "_k")
