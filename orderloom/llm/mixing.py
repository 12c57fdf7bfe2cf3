"""Mixing sources to target shares by systematic sampling.

Every document of a source is expected the same number of times, its rate. The
expected copies are added up within the source, in order of size, one random
offset is added, and a document is emitted once for each whole number that its own
part of the sum crosses. So a document comes floor(rate) or ceil(rate) times, and
as neighbours have about the same size, a source's total keeps close to its target: it
misses it by no more than about the source's largest document. One offset is drawn
per source, whatever comes out, so each document's expected copies are its rate.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[tuple[str, float, float, int]]:
    """(source, share, rate, max_repeats) of each source with a positive target and some size.

    Shares are the targets of these sources, brought to a sum of 1. The mix is as large as the source that runs out
    first allows with its repeats, or as total, if that is less. The list is as short as the table of targets.
    """
    held = sizes.groupBy("source").agg(F.sum("size").alias("held"))
    usable = (F.col("target_weight") > 0) & (F.col("target_weight") < float("inf")) & (F.col("max_repeats") > 0) & (F.col("held") > 0)
    found = targets.join(F.broadcast(held.join(F.broadcast(targets.select("source")), "source", "left_semi")), "source").filter(usable).collect()
    whole = sum(x["target_weight"] for x in found)
    most = min((x["max_repeats"] * x["held"] * whole / x["target_weight"] for x in found), default=0.0)
    most = most if total is None else min(most, total)
    return [
        (x["source"], share, min(x["max_repeats"], most * share / x["held"]), x["max_repeats"])
        for x in sorted(found, key=lambda x: x["source"])
        for share in [x["target_weight"] / whole]
    ]


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """One row per copy: doc_id, source, copy (from 1), size.

    documents has doc_id, source and size (NULL or negative counts as 0), targets has source (each once),
    target_weight and max_repeats. Documents without a source or of one without a target are not selected, a target
    without documents is shared out among the others. Repeated rows are documents of their own. Either table empty
    gives no row. documents is read three times and must give the same rows each time, as a written table does.
    """
    spark = documents.sparkSession
    size = F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0))
    docs = documents.select("doc_id", "source", size.alias("size")).filter(F.col("source").isNotNull())
    found = rates(docs, targets, total)
    rate = spark.createDataFrame([(s, float(r), int(m)) for s, _, r, m in found], "source string, rate double, most int")
    # sizes in about 64 classes an octave; classes are dealt to salts, so that none has to be numbered in one task
    order = F.when(F.col("size") < 64, F.col("size")).otherwise(F.floor(F.log2("size") * 64 - 320).cast("bigint"))
    keyed = docs.join(F.broadcast(rate), "source").withColumns(
        {"_class": order, "_salt": F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))}
    )
    cell = ["source", "_class", "_salt"]
    before = Window.partitionBy("source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*cell).agg(F.count("*").alias("_n")).select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id"))
    numbered = keyed.join(starts, cell).select("doc_id", "source", "size", "rate", "most", nth.alias("_nth"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    return (
        numbered
        .withColumn("_n", _copies(offset))
        .filter("_n > 0")
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"), "size")
    )


def _copies(offset: Column) -> Column:
    """Whole numbers that the document's part of the sum crosses."""
    upto = lambda k: F.floor(k * F.col("rate") + offset)
    return F.least((upto(F.col("_nth")) - upto(F.col("_nth") - 1)).cast("int"), F.col("most"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_weight, documents, copies, most_copies, size and actual_share of each target, also those without documents."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    per_source = per_doc.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n").alias("copies"), F.max("n").alias("most_copies"), F.sum("size").alias("size")
    )
    whole = F.sum("size").over(Window.partitionBy(F.lit(0)))
    return (
        targets.select("source", "target_weight", "max_repeats")
        .join(per_source, "source", "left")
        .fillna(0, subset=["documents", "copies", "most_copies", "size"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("size"), whole), F.lit(0.0)))
    )
