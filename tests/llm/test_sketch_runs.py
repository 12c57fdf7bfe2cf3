"""Percentile sketches against exact ranks; runs against brute force."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm.quantiles import merge, percentiles, sketch
from orderloom.llm.runs import collapse_runs, segment

PS = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


def test_rank_errors_keep_to_their_bound(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.pareto(1.5, 60_000), "b": rng.normal(size=20_000), "c": np.repeat([1.0, 2.0], 150), "d": np.array([7.0])}
    rows = [(k, i % 4, float(x)) for k, v in values.items() for i, x in enumerate(v)]
    rows += [("a", 0, float("nan")), ("b", 1, float("inf")), ("e", 0, None), (None, 0, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, day int, x double").repartition(6).withColumn("n", F.lit("clash"))
    days = sketch(df, ["k", "day"], ["x"])
    for label, found, of in (
        ("day", percentiles(days, PS), lambda k, d: values[k][d::4]),
        ("all", percentiles(merge(days.drop("day"), ["k", "metric"]), PS), lambda k, d: values[k]),
    ):
        for r in found.collect():
            x = np.sort(of(r["k"], r["day"] if label == "day" else 0))
            assert r["n"] == len(x)
            assert r["rank_error"] < 0.02
            for p, v in zip(PS, r["percentiles"]):
                low, high = np.searchsorted(x, v, "left"), np.searchsorted(x, v, "right")
                want = np.ceil(p * len(x) - 1e-9)
                off = max(0, low + 1 - want, want - high) / len(x)
                assert off <= r["rank_error"] + 1e-12, (label, r["k"], p)
            if len(x) <= 400 and label == "day":
                assert r["rank_error"] == 0
    assert {r["k"] for r in days.select("k").collect()} == {"a", "b", "c", "d"}


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert percentiles(merge(sketch(none, ["k"], ["x"]), ["k", "metric"]), PS).count() == 0


def cost(kind, level, heads, penalty, weight):
    total = 0.0
    for a, b in zip(heads, [*heads[1:], len(kind)]):
        if len(set(kind[a:b])) > 1:
            return float("inf")
        x = [v for v in level[a:b] if v == v]
        if x:
            total += weight * sum((v - sum(x) / len(x)) ** 2 for v in x)
        total += penalty
    return total


@pytest.mark.parametrize("seed", range(30))
def test_segmentation_is_optimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    kind = [r.choice([1, 1, 1, -1]) for _ in range(n)]
    level = [r.choice([0.0, 0.1, 3.0, 3.2, float("nan")]) for _ in range(n)]
    penalty, weight = r.choice([0.05, 0.5, 2.0]), r.choice([0.0, 1.0])
    best = min(cost(kind, level, [0, *[i for i, c in enumerate(cut, 1) if c]], penalty, weight) for cut in product([0, 1], repeat=n - 1))
    assert cost(kind, level, segment(kind, level, penalty, weight), penalty, weight) == pytest.approx(best)


def test_runs(spark):
    rows = [("m", 1, 1, 1, 2.0), ("m", 2, 2, 1, 2.1), ("m", 3, 3, -1, 2.0), ("m", 3, 4, -1, 9.0), ("n", 5, 5, 1, None),
            ("n", 6, 6, 1, 1.0), (None, 1, 7, 1, 1.0), ("n", None, 8, 1, 1.0), ("n", 7, 9, None, 1.0), ("n", 8, None, 1, 1.0)]
    df = spark.createDataFrame(rows, "who string, t bigint, id bigint, d int, x double").withColumn("kind", F.lit("clash"))
    got = collapse_runs(df, ["who"], "t", "id", "d").select("who", "kind", "first_id", "last_id", "n_events", "start_us", "duration_us").collect()
    assert {tuple(x) for x in got} == {("m", 1, 1, 2, 2, 1, 1), ("m", -1, 3, 4, 2, 3, 0), ("n", 1, 5, None, 3, 5, 3)}
    sized = collapse_runs(df, ["who"], "t", "id", "d", "x", penalty=1.0).filter("who = 'm'").count()
    assert sized == 3
    assert collapse_runs(df.limit(0), ["who"], "t", "id", "d").count() == 0


def test_runs_that_go_on_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(5)
        rows = [(r.choice("ab"), i, i, r.choice([1, 1, 1, 1, -1])) for i in range(400)]
        df = spark.createDataFrame(rows, "who string, t bigint, id bigint, d int")
        got = {tuple(x) for x in collapse_runs(df, ["who"], "t", "id", "d").select("who", "first_id", "last_id", "n_events").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = set()
    for who in "ab":
        run = []
        for _, _, i, d in [x for x in rows if x[0] == who] + [(0, 0, 0, 0)]:
            if run and d != run[-1][1]:
                want.add((who, run[0][0], run[-1][0], len(run)))
                run = []
            run.append((i, d))
    assert got == want
