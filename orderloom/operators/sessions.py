"""Sessions of activity by occupancy bitmaps.

Each entity and frame (a day) gets a bitmap with one bit per time cell. A
morphological closing of nearly the gap's length, made of doubling shifts, joins
cells that surely belong together; its runs are the sessions. Event counts and
the exact first and last instants are joined back to the runs, and neighbouring
runs whose trimmed ends lie within the gap after all (their cells are exactly one
gap apart) are joined, so the result is exact to the microsecond.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orderloom.functions.times import DAY_US, floor_div

MAX_BITS = 1 << 24  # bits worked on at once; a longer stretch of entities is done in parts


def close_bits(bits: int, reach: int) -> int:
    """Closing with a segment of reach + 1 bits: set bits at most reach + 1 apart get everything between them set."""
    done = 0
    while done < reach:
        step = min(done + 1, reach - done)
        bits |= bits << step
        done += step
    done = 0
    while done < reach:
        step = min(done + 1, reach - done)
        bits &= bits >> step
        done += step
    return bits


def runs_of(positions: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last bit of each run of the closed bitmap of the ascending positions."""
    cells = np.zeros(int(positions[-1]) + 1, np.uint8)
    cells[positions] = 1
    closed = close_bits(int.from_bytes(np.packbits(cells, bitorder="little"), "little"), reach)
    flat = np.unpackbits(np.frombuffer(closed.to_bytes(len(cells) // 8 + 1, "little"), np.uint8), bitorder="little")
    edge = np.diff(flat, prepend=0, append=0).astype(np.int8)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _sessions(group: np.ndarray, cell: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, gap_us: int, cell_us: int):
    """Row number of each session's first cell, its start, end and count. Rows come sorted by group and cell."""
    reach = max(0, (gap_us + 1) // cell_us - 2)  # cells reach + 1 apart hold no instants further apart than the gap
    heads = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    # a stretch of empty cells that no closing can fill may be any longer: it is cut to a bit more than the reach
    ahead = np.minimum(np.diff(cell, prepend=cell[0]), reach + 3)
    ahead[heads] = reach + 3
    if gap_us == 0:  # then no two cells belong together
        ahead = ahead + 1
    place = np.cumsum(ahead)
    out, lo = [], 0
    while lo < len(heads):
        hi = max(lo + 1, int(np.searchsorted(place[heads], place[heads[lo]] + MAX_BITS)))
        a, b = heads[lo], heads[hi] if hi < len(heads) else len(cell)
        at = place[a:b] - place[a]
        out.append(a + np.searchsorted(at, runs_of(at, reach)[0]))
        lo = hi
    begin = np.concatenate(out)
    start, end = first[begin], last[np.append(begin[1:], len(cell)) - 1]
    apart = np.ones(len(begin), bool)
    apart[1:] = (group[begin[1:]] != group[begin[:-1]]) | (start[1:] - end[:-1] > gap_us)
    begin = begin[apart]
    return begin, first[begin], last[np.append(begin[1:], len(cell)) - 1], np.add.reduceat(n, begin)


def sessionize(
    events: DataFrame,
    entity: list[str],
    time_us: str,
    gap_us: int,
    frame_us: int = DAY_US,
    cell_us: int = 1_000_000,
) -> DataFrame:
    """Sessions of each entity within each frame: entity columns, frame, session_start_us, session_end_us, duration_us, n_events.

    A new session begins where more than gap_us lie between an instant and the one before. Events with a NULL in
    an entity column or in the time are left out; repeated rows and ties count as events; an empty table gives
    none; other columns don't matter, but entity columns must not bear the result's names. gap_us may be 0. A cell is
    at most half as long as the gap, so that neighbouring cells always belong together.

    Events are counted per cell before they are shuffled (at most frame_us / cell_us rows an entity and frame,
    however many events a hot entity has), and tasks get whole entity-frames, one after another.
    """
    cell_us = max(1, min(cell_us, (gap_us + 1) // 2))
    key = [*entity, "frame"]
    cells = (
        events.select(*entity, F.col(time_us).cast("bigint").alias("_us"))
        .dropna()
        .groupBy(*entity, floor_div(F.col("_us"), frame_us).alias("frame"), floor_div(F.col("_us"), cell_us).alias("_cell"))
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count("*").alias("_n"))
    )
    longs = ["session_start_us", "session_end_us", "duration_us", "n_events"]
    schema = StructType([cells.schema[c] for c in key] + [StructField(c, LongType()) for c in longs])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            new = (rows[key] != rows[key].shift()).any(axis=1).to_numpy()
            new[0] = True
            open_from = np.flatnonzero(new)[-1]  # the last entity-frame may go on in the next batch
            kept = rows.iloc[open_from:]
            if open_from:
                yield answer(rows.iloc[:open_from], new[:open_from])
        if kept is not None and len(kept):
            yield answer(kept, np.arange(len(kept)) == 0)

    def answer(rows: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        columns = [rows[c].to_numpy(np.int64) for c in ("_cell", "_first", "_last", "_n")]
        begin, start, end, n = _sessions(np.cumsum(new), *columns, gap_us, cell_us)
        out = rows[key].iloc[begin].reset_index(drop=True)
        return out.assign(session_start_us=start, session_end_us=end, duration_us=end - start, n_events=n)

    return cells.repartition(*key).sortWithinPartitions(*key, "_cell").mapInPandas(find, schema)
