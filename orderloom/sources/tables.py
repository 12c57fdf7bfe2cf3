"""Reading the given tables, and tables written between stages."""

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderloom.functions.text import canonical_id, canonical_isin, flow_label
from orderloom.functions.times import instant_us


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a new temporary one, but only where
    all runs in one process on one machine; elsewhere it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_TABLES: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: later jobs start from files that outlive executors.

    They are removed at the process's end, or by remove_written() when no DataFrame made from them is needed any more.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _TABLES:
        _TABLES.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Removes all tables that this application has written between stages."""
    for folder in list(_TABLES):
        if folder.endswith(f"tables-{spark.sparkContext.applicationId}"):
            _remove(spark, folder)
            _TABLES.discard(folder)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # the gateway is gone; nothing can be removed any more
        pass


def latest_deliveries(overlap: DataFrame, *columns: str) -> DataFrame:
    """One row per metaorder_id, that of the latest ingest_ts (at equal times the largest row_id), whatever it lacks.

    Rows without a metaorder_id can't be told to repeat each other: each stands for itself.
    """
    keep = list(dict.fromkeys(["metaorder_id", "row_id", "ingest_ts", *columns]))
    alone = F.when(F.col("metaorder_id").isNull(), F.col("row_id"))
    w = Window.partitionBy("metaorder_id", alone).orderBy(
        F.col("ingest_ts").desc_nulls_last(), F.col("row_id").desc_nulls_last()
    )
    return (
        overlap.select(*keep)
        .withColumn("_nth", F.row_number().over(w))
        .filter("_nth = 1")
        .drop("_nth", "ingest_ts")
    )


# Derived columns of metaorders(): the raw columns each one reads.
DERIVED = {
    "isin": (("isin",), lambda: canonical_isin(F.col("isin"))),
    "member_id": (("member_id",), lambda: canonical_id(F.col("member_id"))),
    "client_id": (("client_id",), lambda: canonical_id(F.col("client_id"))),
    "flow": (("flow_group",), lambda: flow_label(F.col("flow_group"))),
    "start_us": (("start_timestamp", "start_ns"), lambda: instant_us(F.col("start_timestamp"), F.col("start_ns"))),
    "end_us": (("end_timestamp", "end_ns"), lambda: instant_us(F.col("end_timestamp"), F.col("end_ns"))),
}


def metaorders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The current row of each metaorder with metaorder_id, row_id and the asked columns in canonical writing."""
    raw = [r for c in columns for r in (DERIVED[c][0] if c in DERIVED else (c,))]
    rows = latest_deliveries(table(spark, sf_dir, "overlap"), *raw)
    return rows.select(
        "metaorder_id",
        "row_id",
        *[DERIVED[c][1]().alias(c) if c in DERIVED else F.col(c) for c in columns if c not in ("metaorder_id", "row_id")],
    )
