"""Fits and resampling on sums that Spark makes: only tables as small as the model's cells or days leave the cluster."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.tails import t_quantile, t_two_sided
from orderloom.operators.ranks import value_ranks


def least_squares(rows: DataFrame, y: str, xs: Sequence[str], cluster: str, weight: str | None = None) -> DataFrame:
    """term, estimate, se, t, p, low and high of a linear model with a constant, with errors clustered by a column (such as the
    day); p and the 95 % interval by Student's t with as many degrees of freedom as clusters less 1.

    Two passes of sums: the normal equations, then each cluster's score at the estimate, of which only the sum of outer
    products is kept. Rows with a NULL in any used column are left out. No row, or a singular model, gives no term.
    """
    names = ["const", *xs]
    own = rows.select(F.lit(1.0).alias("const"), *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("_y"),
                      (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"), F.col(cluster).alias("_c")).dropna()
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    got = own.agg(
        F.count("*"), F.count_distinct("_c"),
        *[total(F.col("_w") * F.col(names[i]) * F.col(names[j])) for i, j in pairs], *[total(F.col("_w") * F.col(n) * F.col("_y")) for n in names],
    ).first()
    n, clusters = got[0], got[1]
    a = np.zeros((k, k))
    for (i, j), v in zip(pairs, got[2 : 2 + len(pairs)]):
        a[i, j] = a[j, i] = v
    schema = "term string, estimate double, se double, t double, p double, low double, high double, n bigint, clusters bigint"
    spark = rows.sparkSession
    if n <= k or clusters < 2 or np.linalg.matrix_rank(a) < k:
        return spark.createDataFrame([], schema)
    beta = np.linalg.solve(a, np.array(got[2 + len(pairs) :]))
    left = F.col("_y") - sum((F.col(m) * float(b) for m, b in zip(names, beta)), F.lit(0.0))
    scores = own.groupBy("_c").agg(*[F.sum(F.col("_w") * F.col(m) * left).alias(f"s{i}") for i, m in enumerate(names)])
    meat = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs]).first()
    m = np.zeros((k, k))
    for (i, j), v in zip(pairs, meat):
        m[i, j] = m[j, i] = v
    inv = np.linalg.inv(a)
    cov = inv @ m @ inv * (clusters / (clusters - 1)) * ((n - 1) / (n - k))
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    far = t_quantile(0.975, clusters - 1)
    out = [
        (t, float(b), float(s), *((float(b / s), t_two_sided(float(b / s), clusters - 1)) if s > 0 else (None, None)), float(b - far * s), float(b + far * s), n, clusters)
        for t, b, s in zip(names, beta, se)
    ]
    return spark.createDataFrame(out, schema)


def cluster_bootstrap_correlation(sums: DataFrame, by: list[str], runs: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """by, r, low and high: correlation from per-cluster sums (n, sx, sy, sxx, syy, sxy) with a percentile interval over
    resamples of the clusters.

    Each cluster gets, for each run, a Poisson number of copies from a hash of the run and the cluster's name, so that runs
    are rows of sums and no cluster is collected. sums has a row per group and cluster, with the cluster in "cluster".
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "run", "cluster"), F.lit(1 << 30)) / float(1 << 30)
    # Poisson(1): cumulative odds
    odds = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(7)])
    copies = sum(((u >= float(o)).cast("int") for o in odds), F.lit(0))
    parts = ("n", "sx", "sy", "sxx", "syy", "sxy")
    each = sums.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs)))).withColumn("copies", F.when(F.col("run") == 0, 1).otherwise(copies))
    runs_of = each.groupBy(*by, "run").agg(*[F.sum(F.col(c) * F.col("copies")).cast("double").alias(c) for c in parts])
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    r = F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), F.expr("n * sxy - sx * sy") / F.sqrt(vx * vy))
    got = runs_of.withColumn("r", r)
    drawn = F.when(F.col("run") > 0, F.col("r"))
    return got.groupBy(*by).agg(
        F.max(F.when(F.col("run") == 0, F.col("r"))).alias("r"), F.percentile(drawn, F.lit(alpha / 2)).alias("low"), F.percentile(drawn, F.lit(1 - alpha / 2)).alias("high")
    )


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str) -> DataFrame:
    """Adds p_adjusted within each family of tests; NULL p stays NULL and doesn't count."""
    known = F.col(p).isNotNull()
    m = F.count(p).over(Window.partitionBy(*family))
    rank = F.count(p).over(Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last()))
    raw = tests.withColumn("_raw", F.when(known, F.col(p) * m / rank))
    down = Window.partitionBy(*family).orderBy(F.col(p).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("p_adjusted", F.when(known, F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw")


def power_law_tail(rows: DataFrame, key: list[str], value: str, candidates: int = 40, least_tail: int = 50, points: int = 200) -> DataFrame:
    """key, xmin, alpha, n_tail and ks of a continuous power law: the candidate xmin of the least Kolmogorov-Smirnov distance.

    Candidates are values at log-spaced tail sizes; each one's exponent comes from the sum of logarithms above it, and its
    distance from the value ranks at log-spaced points of its tail (so it is exact at these). Only positive finite values count.
    """
    x = rows.filter((F.col(value) > 0) & (F.col(value) < float("inf"))).select(*key, F.col(value).cast("double").alias("x"))
    ranks = value_ranks(x, key, "x", "floor(16 * log2(x))")
    total = x.groupBy(*key).agg(F.count("*").alias("all"), F.sum(F.ln("x")).alias("all_ln"))
    tail = ranks.join(F.broadcast(total), key).withColumn("tail", F.col("all") - F.col("upto") + F.col("n"))  # rows of at least x
    # where the tail's size enters a new log-spaced class there is a candidate; a finer grid makes the points
    def grid(many: int) -> DataFrame:
        cls = F.floor(F.ln("tail") * many / F.ln("all"))
        return tail.withColumn("_cls", cls).groupBy(*key, "_cls").agg(F.max("x").alias("x"), F.max_by("tail", "x").alias("tail"), F.max("all").alias("all")).drop("_cls")

    cand = grid(candidates).filter(F.col("tail") >= least_tail).withColumnRenamed("x", "xmin")
    at = grid(points).select(*key, "x", F.col("tail").alias("from_x"))
    # sums of logarithms at or above each candidate: per class between candidates, then added up from above
    edges = cand.groupBy(*key).agg(F.sort_array(F.collect_list("xmin")).alias("_edges"))  # at most one a class
    sums = x.join(F.broadcast(edges), key).withColumn("_i", F.size(F.filter("_edges", lambda e: e <= F.col("x")))).filter("_i > 0")
    per = sums.groupBy(*key, "_i").agg(F.sum(F.ln("x")).alias("_ln"), F.first("_edges").alias("_edges"))
    above = Window.partitionBy(*key).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    logs = per.select(*key, F.element_at("_edges", F.col("_i")).alias("xmin"), F.sum("_ln").over(above).alias("_ln"))
    fit = cand.join(logs, [*key, "xmin"]).withColumn("alpha", 1 + F.try_divide(F.col("tail"), F.col("_ln") - F.col("tail") * F.ln("xmin")))
    # a few hundred points against a few dozen candidates of the key
    apart = fit.join(F.broadcast(at), key).filter("x >= xmin").withColumn("_d", F.abs(F.col("from_x") / F.col("tail") - F.pow(F.col("x") / F.col("xmin"), 1 - F.col("alpha"))))
    ks = apart.groupBy(*key, "xmin", "alpha", "tail").agg(F.max("_d").alias("ks"))
    best = Window.partitionBy(*key).orderBy("ks", "xmin")
    return ks.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select(*key, "xmin", "alpha", F.col("tail").alias("n_tail"), "ks")


def within_permutation(rows: DataFrame, block: list[str], row: str, x: str, y: str, runs: int = 200, seed: int = 0, most: int = 20_000) -> DataFrame:
    """run and r: correlation of x and y with x shuffled within blocks; run 0 is as it is.

    A block of more than about most rows is dealt at random (by a hash of row) to parts that are shuffled apart, which is a
    shuffle within the block all the same; parts are shuffled in tasks of their own, and only the runs' sums leave them.
    Rows with a NULL x or y are left out.
    """
    own = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    size = own.groupBy(*block).agg(F.ceil(F.count("*") / most).alias("_parts"))
    key = F.concat_ws("|", *block, F.pmod(F.xxhash64(row, F.lit(seed)), F.col("_parts")).cast("string"))
    dealt = own.join(size, block).select(key.alias("b"), F.col(row).cast("string").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def shuffled(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "x", "y"])
        rng = np.random.default_rng([seed, *key[0].encode()])
        a, b = part["x"].to_numpy(), part["y"].to_numpy()
        sxy = [float(a @ b), *[float(rng.permutation(a) @ b) for _ in range(runs)]]
        return pd.DataFrame({"run": np.arange(runs + 1), "n": len(a), "sx": a.sum(), "sy": b.sum(), "sxx": a @ a, "syy": b @ b, "sxy": sxy})

    sums = dealt.groupBy("b").applyInPandas(shuffled, "run int, n bigint, sx double, sy double, sxx double, syy double, sxy double")
    s = sums.groupBy("run").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return s.select("run", (F.expr("n * sxy - sx * sy") / F.sqrt(F.expr("(n * sxx - sx * sx) * (n * syy - sy * sy)"))).alias("r"))
