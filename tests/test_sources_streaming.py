"""Files in and out, and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from orderloom.sources import files
from orderloom.streaming.activity import session_stream, windowed_totals


def test_csv_with_either_separator(spark, tmp_path):
    for name, sep in (("semi", ";"), ("comma", ",")):
        d = tmp_path / name
        d.mkdir()
        for f in ("AAA", "BBB", "SKIP"):
            (d / f"{f}.csv").write_text(f"t{sep}q\n1{sep}2.5\n2{sep}\n")
        (d / "note.txt").write_text("x")
        got = files.read_csv(spark, str(d), "t int, q double", exclude=["SKIP.csv"]).collect()
        assert sorted((r["isin"], r["t"], r["q"]) for r in got) == [("AAA", 1, 2.5), ("AAA", 2, None), ("BBB", 1, 2.5), ("BBB", 2, None)]


def test_tape_tables_and_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, isin string")
    files.write_table(df, str(tmp_path / "t"), by=["isin"])
    assert files.read_table(spark, str(tmp_path / "t"), ["id", "none"]).columns == ["id"]
    files.write_result(df, str(tmp_path / "r.csv"))
    assert files.read_table(spark, str(tmp_path / "r.csv")).count() == 2
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    one = next((tmp_path / "p").glob("*.parquet"))
    (tmp_path / "tape").mkdir()
    one.rename(tmp_path / "tape" / "QX1.parquet")
    assert {r["isin"] for r in files.read_tape(spark, str(tmp_path / "tape")).collect()} == {"QX1"}
    files.write_manifest(str(tmp_path / "m.json"), runs=3)
    assert json.loads((tmp_path / "m.json").read_text())["runs"] == 3
    both = files.grouped(client=df, proprietary=df.drop("isin"))
    assert {(r["flow"], r["isin"]) for r in both.collect()} == {("client", "x"), ("client", "y"), ("proprietary", None)}


def test_decode_and_session(spark):
    df = spark.createDataFrame([(1, 34_200_000_000), (7, 63_000_000_000), (None, 63_000_000_001)], "c int, t bigint")
    got = files.decoded(df, {"c": {1: "one"}, "other": {1: "x"}}).select("c", files.in_session(F.col("t"), "09:30:00", "17:30:00")).collect()
    assert [tuple(r) for r in got] == [("one", True), (None, True), (None, False)]


def test_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2000, 1, 3, 9) + dt.timedelta(minutes=m)
    rows = [("a", t(0), 1.0), ("a", t(10), 2.0), ("a", t(40), 4.0), ("b", t(5), 8.0), ("z", t(600), 0.0)]
    spark.createDataFrame(rows, "who string, ts timestamp, q double").coalesce(1).write.parquet(str(tmp_path / "in"))
    later = [("z", t(1200), 0.0)]
    stream = spark.readStream.schema("who string, ts timestamp, q double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    spark.createDataFrame(later, "who string, ts timestamp, q double").write.mode("append").parquet(str(tmp_path / "in"))
    got = {(r["who"], r["session_start"], r["session_end"], r["n_events"]) for r in run(session_stream(stream, ["who"], "ts"), "s")}
    assert {x for x in got if x[0] != "z"} == {("a", t(0), t(10), 2), ("a", t(40), t(40), 1), ("b", t(5), t(5), 1)}
    totals = run(windowed_totals(stream, ["who"], "ts", "q", "1 hour", "1 hour"), "w")
    assert all(r["n"] >= 1 for r in totals)
