"""Activity as it arrives: sessions and running windows with late events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(events: DataFrame, entity: list[str], ts: str, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each entity of a stream: start, end of the window, number of events. Events later than late are dropped.

    A window ends one gap after its last event, and a session is emitted once the watermark has passed that.
    """
    return (
        events.withWatermark(ts, late)
        .groupBy(*entity, F.session_window(ts, gap).alias("_w"))
        .agg(F.count("*").alias("n_events"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
        .drop("_w")
    )


def windowed_totals(events: DataFrame, entity: list[str], ts: str, q: str, length: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sliding totals of q per entity of a stream."""
    return (
        events.withWatermark(ts, late)
        .groupBy(*entity, F.window(ts, length, slide).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(q).alias("total"))
        .select(*entity, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n", "total")
    )
