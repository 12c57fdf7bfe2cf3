"""Known values of tails, resampling, the event study, paths and the realised kernel; queries without SQL against NumPy."""

import math

import duckdb
import numpy as np
import pytest
from compare import DATA, views
from pyspark.sql import functions as F

from orderloom.functions import tails
from orderloom.operators import records, resampling
from orderloom.operators.overlap import binned_neighbours
from orderloom.operators.tape import filled_grid, realised_kernel
from orderloom.plans.catalog import registries
from orderloom.plans.crowding_queries import LOCAL_SQL, facts_sql

QUERIES = {n: q for r in registries() for n, q in r.queries.items()}
MINUTE = 60_000_000


def test_tails(spark):
    zs = [0.0, 0.5, 1.96, 4.0, 8.0, -3.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(tails.two_sided_normal(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=2e-7)
    sql = duckdb.sql(f"select {tails.two_sided_normal_sql('z')} from (select unnest({zs}::double[]) as z)").fetchall()
    assert [r[0] for r in sql] == pytest.approx(got, rel=1e-12)
    # from tables of Student's t
    assert [round(tails.t_quantile(0.975, d), 3) for d in (1, 2, 10, 30)] == [12.706, 4.303, 2.228, 2.042]
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-5)
    assert tails.welch_df(1.0, 9, 1.0, 9) == pytest.approx(18)


def test_resampling(spark):
    rows = spark.createDataFrame([("g", i, float(i)) for i in range(12)], "g string, day int, x double")
    drawn = resampling.drawn(rows, ["g"], "day", 300).groupBy("run").agg(F.count("*").alias("n"), F.avg("x").alias("m")).toPandas().set_index("run")
    assert set(drawn["n"]) == {12} and drawn.loc[0, "m"] == 5.5
    assert abs(drawn["m"].mean() - 5.5) < 0.2 and 0.7 < drawn["m"].std() / (math.sqrt(143 / 12) / math.sqrt(12)) < 1.3
    moved = resampling.shuffled(rows, ["g"], "day", "x", 50).toPandas()
    for run, part in moved.groupby("run"):
        assert sorted(part["x"]) == [float(i) for i in range(12)]
        assert (run == 0) == (part.sort_values("day")["x"].tolist() == [float(i) for i in range(12)])
    again = resampling.drawn(rows.repartition(7), ["g"], "day", 300).groupBy("run").agg(F.avg("x").alias("m")).toPandas().set_index("run")
    assert (again["m"].sort_index() == drawn["m"].sort_index()).all()


def test_event_bins(spark):
    at = lambda h, m: (h * 60 + m) * MINUTE
    rows = [(1, "AAA", "M1", at(9, 58), 1), (2, "AAA", "M2", at(10, 0), 1), (3, "AAA", "M3", at(10, 3), 1), (4, "AAA", "M4", at(10, 4), -1), (5, "AAA", "M2", at(10, 2), 1), (6, "AAA", "M5", at(10, 0), 1)]
    df = spark.createDataFrame(rows, "id int, isin string, member string, t bigint, d int")
    got = {x["bin"]: (x["same"], x["opposite"]) for x in binned_neighbours(df, ["isin"], "t", "d", "member", 5 * MINUTE, 1).filter("id = 2").collect()}
    assert got == {-1: (1, 0), 1: (1, 1)}  # not the member's own start at 10:02, not the other one of 10:00


def test_paths(spark):
    order = ["isin", "day"]
    partial = spark.createDataFrame([("X", 1, k, v) for k, v in enumerate([0.0, 2.0])], "isin string, day int, k int, impact double")
    after = spark.createDataFrame([("X", 1, k, v) for k, v in enumerate([9.0, 1.0, 0.0])], "isin string, day int, k int, impact double")
    got = {x["g"]: x["impact"] for x in records.interpolated(partial, after, order, [0, 0.5, 1, 1.5, 2, 3], 2.0).collect()}
    assert [got[g] for g in range(6)] == pytest.approx([0.0, 1.0, 2.0, 1.5, 1.0, 0.0])  # at the end the last child's impact counts


def test_kernel(spark):
    rng = np.random.default_rng(2)
    p = np.exp(np.cumsum(rng.standard_normal(40) * 0.01))
    keep = [i for i in range(40) if i not in (3, 4, 17)]
    bars = spark.createDataFrame([(1, int(i), float(p[i])) for i in keep] + [(2, 5, 1.0)], "day int, i bigint, p double")
    full = p.copy()
    for i in (3, 4, 17):
        full[i] = full[i - 1]
    r = np.diff(np.log(full))
    h = int(np.floor(len(r) ** (2 / 3)))
    w = lambda u: 1 - 6 * u**2 + 6 * u**3 if u <= 0.5 else 2 * (1 - u) ** 3
    want = r @ r + sum(2 * w(k / h) * (r[k:] @ r[:-k]) for k in range(1, h + 1))
    got = realised_kernel(filled_grid(bars, ["day"], "i", "p"), ["day"], "i", "p").collect()
    assert len(got) == 1 and got[0]["n_returns"] == 39
    assert got[0]["kernel"] == pytest.approx(want, rel=1e-9) and got[0]["variance"] == pytest.approx(r @ r)


def crowded(extra, more=""):
    return views(DATA).execute(f"with {facts_sql(*extra)}, {LOCAL_SQL} select * from local where imbalance is not null {more}").df()


def test_pooled_regression(spark):
    d = crowded(("q_over_v", "participation_rate", "impact"), "and q_over_v > 0 and participation_rate > 0 and impact <> 0 and flow is not null")
    x = np.column_stack([np.ones(len(d)), np.log(d.q_over_v), np.log(d.participation_rate), d.imbalance.abs(), (d.flow == "proprietary").astype(float)])
    want = np.linalg.lstsq(x, np.log(d.impact.abs()), rcond=None)[0]
    got = {r["term"]: r for r in QUERIES["g07_g11_pooled_regression"](spark, DATA).collect()}
    assert [got[t]["estimate"] for t in ("const", "ln_qv", "ln_eta", "abs_imbalance", "proprietary")] == pytest.approx(want.tolist(), rel=1e-6)
    assert all(r["low"] < r["estimate"] < r["high"] and 0 <= r["p"] <= 1 for r in got.values())


def test_bootstrap_and_placebo(spark):
    d = crowded(())
    got = {r["flow"]: r for r in QUERIES["b03_b05_bootstrap"](spark, DATA).collect()}
    for flow, part in d.dropna(subset=["flow"]).groupby("flow"):
        assert got[flow]["r"] == pytest.approx(np.corrcoef(part.direction, part.imbalance)[0, 1], abs=1e-9)
        assert got[flow]["low"] <= got[flow]["r"] <= got[flow]["high"]
    runs = {r["run"]: r["r"] for r in QUERIES["b06_within_day_placebo"](spark, DATA).collect()}
    assert len(runs) == 201 and runs[0] == pytest.approx(np.corrcoef(d.direction, d.imbalance)[0, 1], abs=1e-9)
    assert abs(np.mean([runs[k] for k in range(1, 201)])) < 0.1


def test_power_law_tail_fits_its_own_tail(spark):
    d = views(DATA).execute(f"with {facts_sql('n_child')} select flow, q, n_child from fact where flow is not null").df()
    for r in QUERIES["g13_power_law_tail"](spark, DATA).collect():
        x = d.loc[d.flow == r["flow"], r["metric"]].dropna().to_numpy(float)
        tail = x[x >= r["xmin"] * (1 - 1e-12)]
        assert r["n_tail"] == len(tail) >= 50
        assert r["alpha"] == pytest.approx(1 + len(tail) / np.log(tail / r["xmin"]).sum(), rel=1e-6)


def test_clusters_hold_every_row(spark):
    cols = ("q_over_v", "participation_rate", "vt_over_v", "impact_1m", "impact_60m")
    n = views(DATA).execute(f"with {facts_sql(*cols)} select count(*) from fact where q_over_v > 0 and participation_rate > 0 and vt_over_v > 0 and impact_1m is not null and impact_60m is not null").fetchone()[0]
    got = QUERIES["g20_g21_clusters"](spark, DATA).collect()
    assert sum(r["n"] for r in got) == n and 2 <= len({r["prediction"] for r in got}) <= 4
    assert all(q == sorted(q) for r in got for k, q in r.asDict().items() if k.endswith("_quartiles"))


def test_cell_regression(spark):
    got = QUERIES["g06_g10_cell_regression"](spark, DATA).collect()
    assert got and all(math.isfinite(r["estimate"]) and r["se"] >= 0 and r["clusters"] > 1 for r in got)
