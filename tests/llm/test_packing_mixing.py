"""Packing and mixing: every item is placed once and nothing exceeds its limits."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm.mixing import mix, shares
from orderloom.llm.packing import difference, pack, windows
from orderloom.llm.tokens import TOKENIZER, encoding, with_sizes
from orderloom.sources.tables import written


def test_differencing_balances():
    at, totals = difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(totals.tolist()) == [14, 16]  # the method's known answer for these
    assert [sum(x for x, w in zip([8, 7, 6, 5, 4], at) if w == k) for k in range(2)] == totals.tolist()
    r = random.Random(2)
    sizes = np.array([r.randint(0, 100) for _ in range(200)])
    at = windows(sizes, 100)
    assert np.bincount(at, weights=sizes).max() <= 100
    # the least windows there can be, or nearly; items that leave half a window unused; nothing but zeros
    sizes = np.sort(np.array([int(r.paretovariate(0.8) * 80) % 2048 for _ in range(1000)]))[::-1]
    assert np.bincount(windows(sizes, 2048), weights=sizes).max() <= 2048
    assert len(set(windows(sizes, 2048).tolist())) <= -(-sizes.sum() // 2048) * 1.01 + 1
    assert len(set(windows(np.array([1025] * 400), 2048).tolist())) == 400 and len(set(windows(np.array([683] * 40), 2048).tolist())) == 20
    assert windows(np.array([0, 0]), 2048).tolist() == [0, 0]


def test_differencing_by_its_definition():
    """Against merging of whole partitions with all their windows."""
    r = random.Random(6)
    for m in (1, 2, 3, 7, 40):
        sizes = np.array(sorted((r.randint(0, 50) for _ in range(30)), reverse=True))
        parts = [sorted([int(x)] + [0] * (m - 1), reverse=True) for x in sizes]
        while len(parts) > 1:
            parts.sort(key=lambda p: p[-1] - p[0])
            one, two = parts.pop(0), parts.pop(0)
            parts.append(sorted((x + y for x, y in zip(one, reversed(two))), reverse=True))
        at, totals = difference(sizes, m)
        assert np.bincount(at, weights=sizes, minlength=m).tolist() == totals.tolist()
        assert sum(totals) == sum(parts[0]) and abs((totals[0] - totals[-1]) - (parts[0][0] - parts[0][-1])) <= sizes[0]


def test_packing(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0, 1, 5, 40, 99, 100, 101, 250, 1000])) for i in range(500)] + [(None, 30), (None, 30), (7, None), (8, -3), (9, 55), (9, 55)]
    df = written(spark.createDataFrame(rows, "id int, n int").withColumn("offset", F.lit("clash")), "t")
    got = pack(df, "id", "n", capacity=100).collect()
    per_item, per_container = defaultdict(int), defaultdict(list)
    for x in got:
        per_item[x["id"]] += x["n_tokens"]
        per_container[x["container"]].append((x["offset"], x["n_tokens"], x["fill"]))
        assert x["token_from"] == x["piece"] * 100
    want = Counter()
    for i, n in rows:
        want[i] += max(0, n or 0)
    assert per_item == want
    for places in per_container.values():
        at = 0
        for o, n, fill in sorted(places):
            assert o == at
            at += n
        assert at <= 100 and fill == pytest.approx(at / 100)
    cut_items = Counter(x["id"] for x in got)
    assert all(cut_items[i] == 1 for i, n in rows[:500] if n <= 100 and i not in (7, 8, 9))
    assert pack(df.limit(0), "id", "n", capacity=100).count() == 0


def test_packing_fills(spark):
    r = random.Random(5)
    df = written(spark.createDataFrame([(i, int(r.paretovariate(0.8) * 30) % 2048) for i in range(6000)], "id int, n int"), "t")
    got = pack(df, "id", "n").select("container", "fill").distinct()
    assert got.agg(F.avg("fill")).first()[0] > 0.95


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 4)]


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, r.choice("aaaaaabbc") if i % 50 else None, r.randint(0, 400)) for i in range(4000)] + [(5001, "x", 5), (5002, "a", None)]
    docs = written(spark.createDataFrame(rows, "doc_id int, source string, size int").withColumn("rate", F.lit("clash")), "t")
    targets = spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int")
    mixed = written(mix(docs, targets), "m")
    used = Counter((x["source"], x["doc_id"]) for x in mixed.collect())
    most = {s: m for s, _, m in TARGETS}
    assert {s for s, _ in used} == {"a", "b", "c"} and all(n <= most[s] for (s, _), n in used.items())
    for s in "abc":  # each document of a source comes as often as any other, give or take once
        n = [used.get((s, i), 0) for i, src, _ in rows if src == s]
        assert max(n) - min(n) <= 1
    report = {x["source"]: x for x in shares(mixed, targets).collect()}
    assert report["gone"]["size"] == 0
    for s, w, _ in TARGETS[:3]:
        assert report[s]["actual_share"] == pytest.approx(w / 0.9, abs=0.01)
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0


def test_mixing_is_fair(spark):
    """Over 500 seeds, each document's mean copies are its rate, within three standard errors (and none is always chosen)."""
    sizes = [3, 5, 8, 900, 20, 20, 20, 7, 1, 0, 60, 400]
    docs = written(spark.createDataFrame([(i, "a", n) for i, n in enumerate(sizes)] + [(99, "b", 300)], "doc_id int, source string, size int"), "t")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_weight double, max_repeats int")
    rate = 300 / 0.3 * 0.7 / sum(sizes)
    drawn = [mix(docs, targets, seed=s).filter("source = 'a'").select("doc_id", F.lit(s).alias("s")) for s in range(3)]
    assert all(x.count() for x in drawn)
    # the seeds' offsets on the same numbering, without 500 jobs
    nth = {d: k for k, (n, d) in enumerate(sorted((n, d) for d, n in enumerate(sizes)))}
    seeds = spark.range(500).select(F.pmod(F.xxhash64(F.lit("a"), F.col("id").cast("int")), F.lit(1_000_003)) / 1_000_003.0)
    offsets = [x[0] for x in seeds.collect()]
    low = rate - np.floor(rate)
    error = 3 * np.sqrt(low * (1 - low) / 500)
    for k in nth.values():
        copies = [np.floor((k + 1) * rate + u) - np.floor(k * rate + u) for u in offsets]
        assert abs(np.mean(copies) - rate) <= error + 1e-9


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
def test_sizes_are_of_whole_texts(spark):
    texts = ["hello world", "", None, "x " * 50_000, "naïve — 測試"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = dict(map(tuple, with_sizes(df).collect()))
    assert got == {i: len(encoding(TOKENIZER).encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
