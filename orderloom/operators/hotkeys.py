"""Per-key results where a few keys hold most rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ITEMS = 16_384  # counters of the frequent-items sketch: it misses no key with a share of 1/4000 or more


def hot_keys(rows: DataFrame, key: str, share: float) -> list:
    """Every value of key that may hold at least this share of the rows, by a frequent-items sketch; NULLs are no key.

    The sketch is merged from one per task and has at most SKETCH_ITEMS counters, so it costs the same at any
    size. It names keys of a little less than the share too: at most 2 / share of them in all.
    """
    most = max(1, round(2 / share))
    found = rows.filter(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(most), F.lit(SKETCH_ITEMS)).alias("top"), F.count("*").alias("n")
    ).first()
    return [x["item"] for x in found["top"] or [] if x["count"] >= share * found["n"] * 0.9]


def per_key(
    rows: DataFrame,
    key: str,
    sums: dict[str, Column],
    share: float = 0.01,
    salts: int = 64,
    profile: DataFrame | None = None,
    spread: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Per value of key: key, n_rows, is_hot, and for each name in sums its sum (NAME_sum) and non-null count (NAME_n).

    Hot keys are found by hot_keys(); their rows get a salt, from a broadcast join with the list of hot keys, and are
    added up per key and salt, then per key; the remaining rows take an ordinary shuffle; the two are united.
    profile, if given, has at most one row per key: its hot part is broadcast and the rest joined by shuffle, as a
    left join. Rows with a NULL key have no result. NaN and infinities are the caller's to remove. spread names the
    columns that deal a hot key's rows to the salts; where they are equal or NULL in all rows, the partial sums
    that Spark makes before the shuffle still keep the work even. Ties, repeated rows and empty tables need no care.
    """
    spark = rows.sparkSession
    hot = hot_keys(rows, key, share)
    kind = rows.schema[key].dataType.simpleString()
    listed = spark.createDataFrame([(x,) for x in hot], f"`{key}` {kind}")
    named = rows.filter(F.col(key).isNotNull()).select(key, *spread, *[c.alias(n) for n, c in sums.items()])
    add = lambda names: [
        F.count("*").alias("n_rows"),
        *[a for n in names for a in (F.sum(n).alias(f"{n}_sum"), F.count(n).alias(f"{n}_n"))],
    ]
    join = lambda df, p: df if p is None else df.join(p, key, "left")
    cold = join(
        named.join(F.broadcast(listed), key, "left_anti").groupBy(key).agg(*add(sums)),
        None if profile is None else profile.join(F.broadcast(listed), key, "left_anti"),
    )
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).alias("_salt")
    parts = named.join(F.broadcast(listed), key).groupBy(key, salt).agg(*add(sums))
    total = [F.sum("n_rows").alias("n_rows"), *[F.sum(f"{n}_{x}").alias(f"{n}_{x}") for n in sums for x in ("sum", "n")]]
    warm = join(
        parts.groupBy(key).agg(*total),
        None if profile is None else F.broadcast(profile.join(F.broadcast(listed), key)),
    )
    return cold.withColumn("is_hot", F.lit(False)).unionByName(warm.withColumn("is_hot", F.lit(True)))
