"""Reading tapes and tables from files, and writing results."""

import json
import os
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def separator(spark: SparkSession, path: str) -> str:
    """";" or ",", whichever the first line of a CSV file or folder has more of."""
    line = spark.read.option("pathGlobFilter", "*.csv").text(path).limit(1).collect() if os.path.isdir(path) else spark.read.text(path).limit(1).collect()
    head = line[0][0] if line else ""
    return ";" if head.count(";") >= head.count(",") else ","


def read_csv(spark: SparkSession, path: str, schema: StructType | str, exclude: Sequence[str] = ()) -> DataFrame:
    """CSV files of a folder, but for the excluded names, with a given schema; isin is the name of the file without its ending."""
    rows = (
        spark.read.option("sep", separator(spark, path)).option("header", True).option("pathGlobFilter", "*.csv").schema(schema).csv(path)
    )
    name = F.col("_metadata.file_name")
    rows = rows.withColumn("isin", F.regexp_extract(name, r"(.+)\.csv$", 1))
    return rows.filter(~name.isin(*exclude)) if exclude else rows


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder, one per instrument; isin is the name of the file without its ending."""
    return spark.read.parquet(path).withColumn("isin", F.regexp_extract("_metadata.file_name", r"(.+)\.parquet$", 1))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet, CSV or JSON table by its ending; of the asked columns, those it has."""
    end = os.path.splitext(path)[1].lower()
    if end == ".csv":
        rows = spark.read.option("sep", separator(spark, path)).option("header", True).option("inferSchema", True).csv(path)
    elif end in (".json", ".jsonl"):
        rows = spark.read.json(path)
    elif end in (".parquet", ""):
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {end}")
    return rows if columns is None else rows.select(*[c for c in columns if c in rows.columns])


def grouped(**tables: DataFrame) -> DataFrame:
    """Tables united by name, with the column flow naming where a row is from."""
    out = None
    for name, df in tables.items():
        one = df.withColumn("flow", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def in_session(time_us: Column, first: str, last: str) -> Column:
    """Whether the wall clock is within [first, last], given as HH:MM:SS."""
    us = lambda s: sum(int(x) * k for x, k in zip(s.split(":"), (3_600_000_000, 60_000_000, 1_000_000)))
    return F.pmod(time_us, F.lit(86_400_000_000)).between(us(first), us(last))


def decoded(rows: DataFrame, codes: dict[str, dict[int, str]]) -> DataFrame:
    """Codes of each named column that there is replaced by labels; unknown ones are NULL."""
    new = {}
    for c, labels in codes.items():
        if c in rows.columns:
            value = F.lit(None).cast("string")
            for k, v in labels.items():
                value = F.when(F.col(c) == k, v).otherwise(value)
            new[c] = value
    return rows.withColumns(new)


def require(rows: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def write_table(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, in folders by the given columns."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_result(rows: DataFrame, path: str) -> None:
    """A small result as one file: CSV or Parquet by the ending."""
    one = rows.coalesce(1).write.mode("overwrite")
    if path.endswith(".csv"):
        one.option("header", True).csv(path)
    else:
        one.parquet(path)


def write_manifest(path: str, **parameters) -> None:
    """JSON of the parameters and the time."""
    with open(path, "w") as f:
        json.dump(parameters | {"written_at": datetime.now(timezone.utc).isoformat()}, f, indent=2, default=str, sort_keys=True)
