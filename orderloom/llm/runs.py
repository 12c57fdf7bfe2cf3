"""Runs of consecutive near-identical events, by optimal segmentation.

Per entity the events in order are cut so that the sum of the runs' inner
dissimilarity and a penalty per run is least. Dissimilarity of a run is infinite
if its kinds differ, else weight times the squared deviations of its events'
levels from their mean. The dynamic program over the last cut is exact; cuts that
can't win any more are pruned, so it takes about linear time.
"""

from collections.abc import Iterator
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from orderloom.llm.batches import changes, whole_groups


def segment(kind: list, level: list, penalty: float, weight: float) -> list[int]:
    """First index of each run of the best segmentation; among equally good ones, that with the later last cuts' longest runs.

    A NaN level deviates from nothing.
    """
    best, back = [-penalty], [0]
    n, total, square = [0], [0.0], [0.0]
    cuts = [0]
    for t in range(len(kind)):
        x = level[t]
        known = weight > 0 and isfinite(x)
        n.append(n[-1] + known)
        total.append(total[-1] + (x if known else 0.0))
        square.append(square[-1] + (x * x if known else 0.0))
        if t and kind[t] != kind[t - 1]:
            cuts = [t]  # any earlier start would mix kinds
        elif t:
            cuts.append(t)
        value, at, kept = float("inf"), t, []
        inner = []
        for s in cuts:
            m = n[t + 1] - n[s]
            cost = 0.0
            if m > 1:
                d = total[t + 1] - total[s]
                cost = max(0.0, square[t + 1] - square[s] - d * d / m) * weight
            inner.append(best[s] + cost)
            if best[s] + cost + penalty < value:
                value, at = best[s] + cost + penalty, s
        for s, v in zip(cuts, inner):
            if v < value or s == at:  # a start that costs as much as a new run here can never win again
                kept.append(s)
        cuts = kept
        best.append(value)
        back.append(at)
    heads, t = [], len(kind)
    while t:
        t = back[t]
        heads.append(t)
    return heads[::-1]


def collapse_runs(
    events: DataFrame,
    entity: list[str],
    time_us: str,
    event_id: str,
    kind: str,
    level: str | None = None,
    penalty: float = 1.0,
    weight: float = 1.0,
) -> DataFrame:
    """One row per run: entity columns, kind, first_id, last_id, n_events, level_mean, start_us, end_us, duration_us.

    Events come in order of time, then id. Rows with a NULL in an entity column, the time or the kind are left out and
    break nothing; a NULL or NaN level fits any run; without a level only the kind counts. Repeated rows are events
    of their own. An empty table gives none. kind is a whole number, level a double. Spark partitions the events by
    entity and sorts them; a task holds one entity's events since its last change of kind, where the optimum splits.
    """
    rows = (
        events.select(
            *entity,
            F.col(kind).cast("int").alias("_kind"),
            F.col(time_us).cast("bigint").alias("_t"),
            F.col(event_id).cast("bigint").alias("_id"),
            F.col(event_id).cast("string").alias("_name"),  # pandas would make doubles of numbers beside NULLs
            (F.lit(float("nan")) if level is None else F.coalesce(F.col(level).cast("double"), F.lit(float("nan")))).alias("_x"),
        )
        .dropna(subset=[*entity, "_kind", "_t"])
        .repartition(*entity)
        .sortWithinPartitions(*entity, "_t", "_id")
    )
    key = [*entity, "_kind"]
    schema = StructType(
        [rows.schema[c] for c in entity]
        + [StructField("kind", IntegerType()), StructField("first_id", StringType()), StructField("last_id", StringType())]
        + [StructField("n_events", LongType()), StructField("level_mean", DoubleType())]
        + [StructField(c, LongType()) for c in ("start_us", "end_us", "duration_us")]
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, key):
            yield answer(part)

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        edges = np.append(np.flatnonzero(changes(part, entity)), len(part))
        kinds, levels = part["_kind"].tolist(), part["_x"].tolist()
        heads = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            heads += [a + h for h in segment(kinds[a:b], levels[a:b], penalty, weight)]
        heads = np.array(heads, np.int64)
        ends = np.append(heads[1:], len(part)) - 1
        x = part["_x"].to_numpy()
        known = np.isfinite(x)
        total, n = np.add.reduceat(np.where(known, x, 0.0), heads), np.add.reduceat(known.astype(np.int64), heads)
        out = part[entity].iloc[heads].reset_index(drop=True)
        first, last = part["_t"].to_numpy()[heads], part["_t"].to_numpy()[ends]
        return out.assign(
            kind=part["_kind"].to_numpy()[heads],
            first_id=part["_name"].to_numpy(object)[heads],
            last_id=part["_name"].to_numpy(object)[ends],
            n_events=ends - heads + 1,
            level_mean=np.where(n > 0, total / np.maximum(n, 1), np.nan),
            start_us=first,
            end_us=last,
            duration_us=last - first,
        )

    ids = {c: F.col(c).cast("bigint") for c in ("first_id", "last_id")}
    return rows.drop("_id").mapInPandas(find, schema).withColumns({**ids, "level_mean": F.nanvl("level_mean", F.lit(None).cast("double"))})
