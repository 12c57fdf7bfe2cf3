"""Sessions, hot keys, intervals and trailing totals against brute force, and their edge cases."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from orderloom.operators.hotkeys import hot_keys, per_key
from orderloom.operators.intervals import periods_and_gaps
from orderloom.operators.rolling import trailing_totals
from orderloom.operators.sessions import close_bits, sessionize

DAY = 86_400_000_000
EVENTS = "who string, t bigint, frame int, _us string, n_events int"


def brute_sessions(events, gap):
    by = defaultdict(list)
    for who, t in events:
        if who is not None and t is not None:
            by[who, t // DAY].append(t)
    out = []
    for (who, _), ts in by.items():
        ts.sort()
        start = last = ts[0]
        n = 1
        for t in ts[1:]:
            if t - last > gap:
                out.append((who, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((who, start, last, n))
    return sorted(out)


@pytest.mark.parametrize("gap", [0, 1, 999_999, 1_000_000, 1_500_000, 1_200_000_000])
def test_sessions_are_exact(spark, gap):
    r = random.Random(gap)
    step = max(1, gap)
    events = [(r.choice("abc"), r.randrange(0, 3) * DAY + r.randrange(0, 40) * step + r.choice([-1, 0, 1, 0, 0])) for _ in range(600)]
    events += events[:20] + [(None, 5), ("a", None)]
    df = spark.createDataFrame([(w, t, 1, "x", 2) for w, t in events], EVENTS)
    got = sessionize(df, ["who"], "t", gap).select("who", "session_start_us", "session_end_us", "n_events").collect()
    assert sorted(map(tuple, got)) == brute_sessions(events, gap)


def test_sessions_of_nothing(spark):
    assert sessionize(spark.createDataFrame([], EVENTS), ["who"], "t", 5).count() == 0


def test_closing_fills_gaps_of_its_reach():
    assert close_bits(0b1_0001, 3) == 0b1_1111
    assert close_bits(0b10_0001, 3) == 0b10_0001
    assert close_bits(0b101, 0) == 0b101


def test_hot_keys_and_per_key(spark):
    r = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"k{r.randrange(300)}", float(i % 7) if i % 5 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_id int, key string, x double").withColumn("n_rows", F.lit(0)).withColumn("is_hot", F.lit("?"))
    assert hot_keys(df, "key", 0.04) == ["hot"]
    want = defaultdict(lambda: [0, 0.0, 0])
    for _, k, x in rows:
        if k is not None:
            want[k][0] += 1
            if x is not None:
                want[k][1] += x
                want[k][2] += 1
    profile = spark.createDataFrame([("hot", 7), ("k1", 8), ("none", 9)], "key string, p int")
    got = {x["key"]: x for x in per_key(df, "key", {"x": F.col("x")}, share=0.04, profile=profile).collect()}
    assert {k: [x["n_rows"], x["x_sum"] or 0.0, x["x_n"]] for k, x in got.items()} == want
    assert [k for k, x in got.items() if x["is_hot"]] == ["hot"]
    assert got["hot"]["p"] == 7 and got["k1"]["p"] == 8 and got["k2"]["p"] is None


def test_per_key_of_nothing(spark):
    df = spark.createDataFrame([], "row_id int, key string, x double")
    assert per_key(df, "key", {"x": F.col("x")}).count() == 0
    only_null = spark.createDataFrame([(1, None, 2.0)], "row_id int, key string, x double")
    assert per_key(only_null, "key", {"x": F.col("x")}).count() == 0


def brute_periods(rows):
    by = defaultdict(list)
    for k, s, e in rows:
        if None not in (k, s, e) and e >= s:
            by[k].append((s, e))
    out = set()
    for k, iv in by.items():
        iv.sort()
        merged = []
        for s, e in iv:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out |= {("period", k, s, e) for s, e in merged}
        out |= {("gap", k, a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_periods_and_gaps(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(300):
        s = r.randrange(3000)
        rows.append((r.choice(["a", "b", None]), s if r.random() > 0.02 else None, s + r.choice([-5, 0, 0, 1, 3, 40, 700 if seed % 2 else 5])))
    rows += rows[:30]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint").withColumn("kind", F.lit(1)).withColumn("_slice", F.lit(2))
    got = [tuple(x) for x in periods_and_gaps(df, ["k"], "s", "e", slice_us=100).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_periods(rows)


def test_periods_of_nothing(spark):
    assert periods_and_gaps(spark.createDataFrame([], "k string, s bigint, e bigint"), ["k"], "s", "e").count() == 0


def test_trailing_totals(spark):
    d = lambda n: date(2000, 1, 1) + timedelta(n)
    rows = [("a", d(0), 1.0), ("a", d(0), 1.0), ("a", d(3), None), ("a", d(9), 4.0), ("b", d(5), 2.0), (None, d(1), 9.0), ("c", None, 9.0)]
    df = spark.createDataFrame(rows, "k string, d date, x double").withColumn("_day", F.lit("clash"))
    got = trailing_totals(df, ["k"], "d", {"n": F.count("*"), "x": F.sum("x")}, (7,), 6).collect()
    by = {(x["k"], x["d"]): x for x in got}
    assert {k for k, _ in by} == {"a", "b"}
    assert sorted(x for k, x in by if k == "a") == [d(i) for i in range(16)]
    assert by["a", d(3)]["n_total_7d"] == 3 and by["a", d(3)]["x_total_7d"] == 2.0
    assert by["a", d(8)]["n"] == 0 and by["a", d(8)]["n_total_7d"] == 1 and by["a", d(9)]["x_avg_7d"] == pytest.approx(4 / 7)
    assert trailing_totals(spark.createDataFrame([], "k string, d date"), ["k"], "d", {"n": F.count("*")}).count() == 0


def test_trailing_totals_over_the_whole_calendar(spark):
    d = lambda n: date(2000, 1, 1) + timedelta(n)
    df = spark.createDataFrame([("a", d(0)), ("a", d(2)), ("b", d(1)), ("c", d(60))], "k string, d date")
    got = trailing_totals(df, ["k"], "d", {"n": F.count("*")}, (7, 30), whole=True).collect()
    by = {(x["k"], x["d"]): x for x in got}
    assert len(by) == len(got) and sorted(x for k, x in by if k == "a") == [d(i) for i in range(61)]
    assert sorted(x for k, x in by if k == "c") == [d(i) for i in range(90)]
    assert by["a", d(9)]["n_total_30d"] == 2 and by["a", d(31)]["n_total_30d"] == 1 and by["a", d(32)]["n_total_30d"] == 0
    assert by["b", d(0)]["n_total_7d"] == 0 and by["b", d(30)]["n_total_30d"] == 1 and by["a", d(9)]["n_total_7d"] == 0
    assert trailing_totals(df.limit(0), ["k"], "d", {"n": F.count("*")}, whole=True).count() == 0
