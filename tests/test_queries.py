"""Every registered query of the core against its SQL on the smallest tables, and the canonical writings."""

import datetime as dt

import pytest
from compare import DATA, differ
from pyspark.sql import functions as F

from orderloom.functions.numbers import finite
from orderloom.functions.text import canonical_id, canonical_isin, flow_label
from orderloom.functions.times import day_of_us, wall_us
from orderloom.plans.catalog import registries
from orderloom.sources.tables import latest_deliveries

QUERIES = {n: (q, r.sql.get(n)) for r in registries() for n, q in r.queries.items()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(spark, name):
    query, sql = QUERIES[name]
    got, want, why = differ(query, sql, spark, DATA)
    assert not why and got == want, why


def test_queries_without_sql_are_tested_elsewhere():
    """test_inference.py holds them against NumPy."""
    assert {n for n, (_, sql) in QUERIES.items() if not sql} == {
        "g07_g11_pooled_regression", "b03_b05_bootstrap", "b06_within_day_placebo", "g16_tail_fits", "g20_g21_clusters", "g06_g10_cell_regression",
    }


def test_canonical_writings(spark):
    ids = ["62", " 62.0", "00062", "\t62.00 ", "MKWPK13 ", "", "  ", None, "0", "+7", "7.50", "1e3", "M 1"]
    df = spark.createDataFrame([(x,) for x in ids], "x string")
    got = [r[0] for r in df.select(canonical_id(F.col("x"))).collect()]
    assert got == ["62", "62", "62", "62", "MKWPK13", None, None, None, "0", "7", "7.5", "1e3", "M 1"]
    isins = [r[0] for r in spark.createDataFrame([(" qx1\t",), (" ",), (None,)], "x string").select(canonical_isin(F.col("x"))).collect()]
    assert isins == ["QX1", None, None]
    flows = [r[0] for r in spark.createDataFrame([("Prop",), (" nonprop",), ("x",), (None,)], "x string").select(flow_label(F.col("x"))).collect()]
    assert flows == ["proprietary", "client", None, None]


def test_wall_clock(spark):
    t = dt.datetime(2000, 1, 3, 9, 46, 48, 801388)
    df = spark.createDataFrame([(t,), (None,)], "t timestamp_ntz")
    us = [r[0] for r in df.select(wall_us(F.col("t"))).collect()]
    assert us == [(t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), None]
    days = spark.createDataFrame([(-1,), (0,), (86_400_000_000,)], "u bigint").select(day_of_us(F.col("u"))).collect()
    assert [r[0] for r in days] == [-1, 0, 1]


def test_finite(spark):
    xs = [1.5, float("nan"), float("inf"), -float("inf"), None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(finite(F.col("x"))).collect()] == [1.5, None, None, None, None]


def test_latest_delivery_counts_with_whatever_it_lacks(spark):
    t = lambda h: dt.datetime(2000, 1, 3, h)
    rows = [(1, 10, t(1), "a"), (2, 10, t(2), None), (3, None, t(1), "b"), (4, None, t(1), "c"), (5, 11, t(1), "x"), (6, 11, t(1), "y"), (7, 12, None, "z")]
    df = spark.createDataFrame(rows, "row_id int, metaorder_id int, ingest_ts timestamp_ntz, v string")
    got = {(r["row_id"], r["v"]) for r in latest_deliveries(df, "v").collect()}
    assert got == {(2, None), (3, "b"), (4, "c"), (6, "y"), (7, "z")}
