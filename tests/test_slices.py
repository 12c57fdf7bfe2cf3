"""Sweeps, quantiles and means of hot cells: exact, and in parts."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators.crowding import demeaned
from orderloom.operators.overlap import SLICE_US, active_volume, neighbours
from orderloom.operators.ranks import quantiles
from orderloom.sources import tables
from orderloom.sources.tables import written

DAY = 19_000 * 86_400_000_000


def brute(rows):
    out = {}
    for i, cell, s, e, q in rows:
        vol = n = 0
        for j, c2, s2, e2, q2 in rows:
            if i == j or c2 != cell:
                continue
            if e == s:
                if s2 <= s <= e2:
                    vol, n = vol + q2, n + 1
            else:
                w = max(0, min(e, e2) - max(s, s2))
                vol, n = vol + q2 * w / (e - s), n + (w > 0)
        out[i] = (vol, n)
    return out


def test_overlap_across_slices(spark):
    r = random.Random(3)
    rows = []
    for i in range(260):
        cell = "hot" if r.random() < 0.9 else r.choice("ab")
        s = DAY + r.choice([0, 5, 5, 30]) * SLICE_US + r.randrange(0, 2 * SLICE_US, 250_000)
        length = r.choice([0, 1_000_000, 1_000_000, 60_000_000, SLICE_US, 7 * SLICE_US, 25 * SLICE_US])
        rows.append((i, cell, s, s + length, r.choice([1.0, 1e9 + 0.5, 37.25])))
    df = spark.createDataFrame(rows, "id int, cell string, s bigint, e bigint, q double")
    got = {x["id"]: (x["all_volume"], x["all_count"]) for x in active_volume(df, ["cell"], "id", "s", "e", "q", {"all": F.lit(True)}).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (vol, n) in want.items():
        assert got[i][1] == n
        assert got[i][0] == pytest.approx(vol, rel=1e-9, abs=1e-4)


def test_overlap_known_case(spark):
    at = lambda h, m: DAY + (h * 60 + m) * 60_000_000
    rows = [(1, "A", at(9, 30), at(9, 40), 100.0, 1), (2, "A", at(9, 35), at(9, 45), 50.0, 1), (3, "A", at(9, 32), at(9, 37), 30.0, -1), (4, "B", at(9, 35), at(9, 45), 1000.0, 1)]
    df = spark.createDataFrame(rows, "id int, isin string, s bigint, e bigint, q double, d int")
    got = {x["id"]: x for x in active_volume(df, ["isin"], "id", "s", "e", "q", {"up": F.col("d") == 1, "down": F.col("d") == -1}).collect()}
    x = got[1]
    assert (x["up_count"], x["down_count"], round(x["up_volume"], 9), round(x["down_volume"], 9)) == (1, 1, 25.0, 15.0)
    assert (got[4]["up_count"], got[4]["up_volume"]) == (0, 0.0)


def test_a_hot_cell_is_swept_in_parts(spark):
    """A cell of nine tenths of all rows, over a day: no slice of it gets more than a tenth of the rows."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise("b").alias("cell"), (F.col("id") * 1_500_000 + DAY).alias("t"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("d"))
    per = df.groupBy("cell", F.expr(f"t div {SLICE_US}")).count().agg(F.max("count")).first()[0]
    assert per < 2_000
    got = neighbours(df, ["cell"], "t", "d", 3_000_000).filter("id = 10004").first()
    assert (got["same_before"], got["same_after"], got["opposite_before"], got["opposite_after"]) == (1, 1, 1, 1)


def test_quantiles(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([r.gauss(0, 1), r.gauss(0, 1e6), 0.0, 2.5, -2.5, 1e-12, None, float("nan")])) for _ in range(3000)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, x double").withColumn("_n", F.lit("clash"))
    ps = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = {x["k"]: (x["n_x"], x["q_x"]) for x in quantiles(df.drop("_n"), ["k"], ["x"], ps).collect()}
    for k in ("a", "b", None, "one"):
        xs = np.array([x for kk, x in rows if kk == k and x is not None and x == x])
        assert got[k][0] == len(xs)
        assert got[k][1] == pytest.approx(np.quantile(xs, ps).tolist(), rel=1e-12, abs=1e-15)
    assert quantiles(df.limit(0).drop("_n"), [], ["x"], ps).count() == 0


def test_demeaned(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0), (None, 7.0)], "k string, x double")
    got = sorted((x["x"], x["x_within"]) for x in demeaned(df, "k", "x").collect() if x["x"] is not None)
    assert got == [(1.0, -1.0), (3.0, 1.0), (5.0, -1.0), (7.0, 1.0)]


def test_written_tables_are_removed(spark):
    df = written(spark.range(5).toDF("x"), "t")
    folder = f"{tables.shared_dir(spark)}/tables-{spark.sparkContext.applicationId}".removeprefix("file:")
    assert df.count() == 5 and os.listdir(folder)
    tables.remove_written(spark)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(Session())
