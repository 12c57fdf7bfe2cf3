"""Fits, resampling, bins and overlaps against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators import bins, models
from orderloom.operators.moments import correlation, pair_sums
from orderloom.operators.overlap import active_volume, lead_lag
from orderloom.operators.ranks import value_ranks


def test_least_squares_with_clusters(spark):
    rng = np.random.default_rng(1)
    n, x, z = 900, rng.normal(size=900), rng.normal(size=900)
    c = rng.integers(0, 30, n)
    y = 2 + 0.5 * x - z + rng.normal(size=n) + rng.normal(size=30)[c]
    rows = [(int(a), float(b), float(d), float(e)) for a, b, d, e in zip(c, x, z, y)] + [(1, None, 1.0, 1.0)]
    got = {r["term"]: r for r in models.least_squares(spark.createDataFrame(rows, "c int, x double, z double, y double"), "y", ["x", "z"], "c").collect()}
    X = np.column_stack([np.ones(n), x, z])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    u = y - X @ beta
    s = np.stack([(X[c == k] * u[c == k, None]).sum(0) for k in range(30)])
    inv = np.linalg.inv(X.T @ X)
    cov = inv @ s.T @ s @ inv * 30 / 29 * (n - 1) / (n - 3)
    for i, t in enumerate(("const", "x", "z")):
        assert got[t]["estimate"] == pytest.approx(beta[i]) and got[t]["se"] == pytest.approx(np.sqrt(cov[i, i]))
    assert models.least_squares(spark.createDataFrame([], "c int, x double, y double"), "y", ["x"], "c").count() == 0


def test_power_law_recovers_its_exponent(spark):
    x = 5 * (1 - np.random.default_rng(0).random(8000)) ** (-1 / 1.5)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("a", -1.0)], "k string, x double")
    got = models.power_law_tail(df, ["k"], "x").collect()
    assert len(got) == 1 and got[0]["alpha"] == pytest.approx(2.5, abs=0.1) and got[0]["ks"] < 0.03


def test_bootstrap_and_permutation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=2000)
    y = 0.5 * x + rng.normal(size=2000)
    df = spark.createDataFrame([(i, i % 40, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, d int, x double, y double")
    r = np.corrcoef(x, y)[0, 1]
    sums = df.groupBy(F.lit("g").alias("g"), F.col("d").alias("cluster")).agg(*pair_sums(F.col("x"), F.col("y")))
    got = models.cluster_bootstrap_correlation(sums, ["g"], runs=300).first()
    assert got["r"] == pytest.approx(r) and got["low"] < r < got["high"] < got["low"] + 0.2
    runs = {x["run"]: x["r"] for x in models.within_permutation(df, ["d"], "i", "x", "y", runs=100, most=30).collect()}
    assert runs[0] == pytest.approx(r) and max(abs(v) for k, v in runs.items() if k) < 0.15
    assert df.agg(*pair_sums(F.col("x"), F.col("y"))).select(correlation()).first()[0] == pytest.approx(r)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert flat.agg(*pair_sums(F.col("x"), F.col("y"))).select(correlation()).first()[0] is None


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    got = {r["p"]: r["p_adjusted"] for r in models.benjamini_hochberg(spark.createDataFrame([("f", x) for x in p], "f string, p double"), ["f"], "p").collect()}
    assert got[None] is None and got[0.01] == pytest.approx(0.04) and got[0.03] == got[0.04] == pytest.approx(0.16 / 3) and got[0.5] == 0.5


def test_bins_differ_at_their_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0)], "x double")
    e = [0.0, 1.0, 2.0]
    x = F.col("x")
    got = df.select(bins.bin_left(x, e), bins.bin_right(x, e), bins.bin_left_closed(x, e)).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (0, 0, 0), (0, 0, 0), (1, 0, 1), (None, 1, 1), (None, None, None)]
    minutes = spark.createDataFrame([(m,) for m in (-0.1, 0.0, 9.99, 10.0, 24.9, 25.0, 25.1)], "m double")
    assert [r[0] for r in minutes.select(bins.session_bin(F.col("m"), 25, 10)).collect()] == [None, 0, 0, 1, 2, 2, None]
    assert [r["label"] for r in bins.session_bins(df, 25, 10, 570).orderBy("bin").collect()] == ["09:30-09:40", "09:40-09:50", "09:50-09:55"]
    with pytest.raises(ValueError):
        bins.quantile_edges(spark.createDataFrame([(1.0,)] * 3, "x double"), "x", 4, merge=False)


def test_value_ranks(spark):
    r = random.Random(3)
    xs = [r.choice([1.0, 2.0, 3.5, 70.0, 1e6]) * r.choice([1, 1, 1.5]) for _ in range(200)]
    got = value_ranks(spark.createDataFrame([("k", x) for x in xs] + [(None, 1.0), ("k", None)], "k string, x double"), ["k"], "x", "floor(log2(x))")
    for row in got.filter("k is not null").collect():
        below, same = sum(x < row["x"] for x in xs), xs.count(row["x"])
        assert (row["n"], row["upto"], row["rank"]) == (same, below + same, below + (same + 1) / 2)


@pytest.mark.parametrize("seed", range(3))
def test_active_volume_is_that_of_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(120):
        s = 1_000_000 * r.randrange(0, 60)
        rows.append((i, r.choice("ab"), s, s + 1_000_000 * r.choice([0, 0, 1, 5, 20]), float(r.randint(1, 9)), r.choice([True, False, None])))
    df = spark.createDataFrame(rows, "id int, c string, s bigint, e bigint, q double, up boolean")
    got = active_volume(df, ["c"], "id", "s", "e", "q", {"up": F.col("up"), "all": F.lit(True)})
    for row in got.collect():
        i, c, s, e, *_ = rows[row["id"]]
        for name, ok in (("up", lambda x: x[5]), ("all", lambda x: True)):
            volume, n = 0.0, 0
            for x in rows:
                if x[0] == i or x[1] != c or not ok(x):
                    continue
                w = float(x[2] <= s <= x[3]) if s == e else max(0, min(e, x[3]) - max(s, x[2])) / (e - s)
                volume, n = volume + w * x[4], n + (w > 0)
            assert row[f"{name}_volume"] == pytest.approx(volume, abs=1e-6) and row[f"{name}_count"] == n


def test_lead_and_lag_are_those_of_all_pairs(spark):
    r = random.Random(9)
    rows = []
    for i in range(150):
        s = r.randrange(0, 40)
        rows.append((i, r.choice("ab"), s, s + r.choice([0, 0, 1, 5, 20]), float(r.randint(1, 9)), r.random() < 0.6, r.random() < 0.6))
    df = spark.createDataFrame(rows, "id int, c string, s bigint, e bigint, q double, mine boolean, other boolean")
    got = {x["id"]: x for x in lead_lag(df, ["c"], "id", "s", "e", "q", F.col("mine"), F.col("other")).collect()}
    assert set(got) == {x[0] for x in rows if x[5]}
    for i, x in got.items():
        _, c, s, e, *_ = rows[i]
        others = [y for y in rows if y[0] != i and y[1] == c and y[6]]
        pre, during = [y for y in others if y[2] <= s <= y[3]], [y for y in others if s < y[2] <= e]
        assert (x["preexisting"], x["started"]) == (len(pre), len(during))
        assert x["preexisting_volume"] == pytest.approx(sum(y[4] for y in pre)) and x["started_volume"] == pytest.approx(sum(y[4] for y in during))
