"""Competing tail models and permutation within strata against direct computation."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators.resampling import strata_permutation
from orderloom.operators.tail_models import power_density, power_survival, tail_models


def _fits(spark, x, xmin=1.0):
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("a", 0.2), (None, 3.0)], "k string, x double")
    tails = spark.createDataFrame([("a", xmin), ("b", 2.0), ("c", None)], "k string, xmin double")
    return {r["model"]: r for r in tail_models(rows, tails, ["k"], "x").collect()}


def test_each_model_is_recovered_and_preferred(spark):
    rng = np.random.default_rng(3)
    power = (1 - rng.random(20_000)) ** (-1 / 1.5)
    got = _fits(spark, power)
    assert got["power_law"]["a"] == pytest.approx(2.5, abs=0.05) and got["power_law"]["z"] is None and got["exponential"]["z"] > 5
    assert got["power_law"]["n_tail"] == len(power)
    bell = np.exp(rng.normal(1.0, 0.7, 40_000))
    bell = bell[bell >= 1]
    got = _fits(spark, bell)
    assert got["lognormal"]["a"] == pytest.approx(1.0, abs=0.05) and got["lognormal"]["b"] == pytest.approx(0.7, abs=0.03)
    assert got["lognormal"]["best"] and got["lognormal"]["z"] < -5 and got["lognormal"]["p"] < 1e-6
    cut = (1 - rng.random(400_000)) ** (-1 / 0.8)
    cut = cut[rng.random(len(cut)) < np.exp(-0.05 * (cut - 1))][:40_000]
    got = _fits(spark, cut)
    assert got["truncated_power_law"]["a"] == pytest.approx(1.8, abs=0.05) and got["truncated_power_law"]["b"] == pytest.approx(0.05, rel=0.15) and got["truncated_power_law"]["best"]
    flat = 1 + rng.exponential(2.0, 20_000)
    got = _fits(spark, flat)
    assert got["exponential"]["a"] == pytest.approx(0.5, abs=0.02) and got["exponential"]["best"]
    # the likelihood by its definition, and of models that have the power law as a special case
    assert got["exponential"]["ll"] == pytest.approx(float(np.sum(np.log(got["exponential"]["a"]) - got["exponential"]["a"] * (flat - 1))), rel=1e-9)
    assert all(got[m]["ll"] >= got["power_law"]["ll"] - 1e-6 for m in ("lognormal", "truncated_power_law"))
    # a scale changes no comparison
    wide = _fits(spark, flat * 7, 7.0)
    assert all(wide[m]["lr"] == pytest.approx(got[m]["lr"], abs=1e-4) for m in got)


def test_tails_without_spread_or_rows(spark):
    assert _fits(spark, [1.0, 1.0, 1.0]) == {} and _fits(spark, []) == {} and _fits(spark, [2.0]) == {}
    df = spark.createDataFrame([(2.0, 2.5, 1.0), (0.5, 2.5, 1.0)], "x double, a double, m double")
    got = df.select(power_density(F.col("x"), F.col("a"), F.col("m")), power_survival(F.col("x"), F.col("a"), F.col("m"))).collect()
    assert got[0][0] == pytest.approx(1.5 * 2**-2.5) and got[0][1] == pytest.approx(2**-1.5) and got[1][0] is None


def _hash(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_strata_permutation_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 50 == 0 else "hot" if rng.random() < 0.6 else f"s{rng.integers(6)}", i, bool(rng.random() < 0.4), float(rng.normal()) if i % 17 else None) for i in range(600)]
    rows += [("only", 1000, True, 1.0), ("only", 1001, True, 2.0), ("s1", 1002, None, 1.0)]
    df = spark.createDataFrame(rows, "s string, id bigint, t boolean, v double")
    got = {r["run"]: r["effect"] for r in strata_permutation(df, ["s"], "id", "t", "v", 5, 9).collect()}
    strata = {}
    for s, i, t, v in rows:
        if t is not None and v is not None:
            strata.setdefault(s, []).append((i, t, v))
    strata = {s: x for s, x in strata.items() if 0 < sum(t for _, t, _ in x) < len(x)}
    for run in range(6):
        up = down = 0.0
        for x in strata.values():
            k = sum(t for _, t, _ in x)
            order = sorted(x, key=lambda r: (not r[1], r[0]) if run == 0 else (_hash(9, run, r[0]), r[0]))
            up += sum(v for *_, v in order[:k]) - k * sum(v for *_, v in order[k:]) / (len(x) - k)
            down += k
        assert got[run] == pytest.approx(up / down, abs=1e-9)
    assert strata_permutation(df.filter("false"), ["s"], "id", "t", "v", 2).count() == 0


def _shuffled_rows(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_strata_permutation_moves_rows_once(spark):
    """What is shuffled doesn't grow with the runs; a row without a number is drawn last, as SQL has it."""
    rng = np.random.default_rng(5)
    rows = [(f"s{rng.integers(900)}", None if i == 7 else i, bool(rng.random() < 0.4), float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame([*rows, ("a", None, True, 1e6), ("a", 1, True, 1.0), ("a", 2, False, 3.0)], "s string, id bigint, t boolean, v double")
    before = _shuffled_rows(spark)
    whole = {r["run"]: r["effect"] for r in strata_permutation(df, ["s"], "id", "t", "v", 40, 3).collect()}
    assert len(whole) == 41 and _shuffled_rows(spark) - before < 4 * df.count()
    assert all(e < 0 for run, e in whole.items() if run > 0) and whole[0] > 0


@pytest.mark.parametrize("most", [100, 0])
def test_strata_drawn_by_slices_are_the_same(spark, most):
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 3 else f"s{i % 11}", None if i in (7, 8) else i, bool(rng.random() < 0.4), float(rng.normal())) for i in range(900)]
    df = spark.createDataFrame(rows, "s string, id bigint, t boolean, v double")
    whole, parts = ({r["run"]: r["effect"] for r in strata_permutation(df, ["s"], "id", "t", "v", 6, 3, most=m).collect()} for m in (1 << 18, most))
    assert len(whole) == 7 and parts == pytest.approx(whole, abs=1e-9)
