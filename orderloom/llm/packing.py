"""Packing texts into containers of fixed capacity, by multiway differencing.

Texts larger than a container fill whole ones; their remainders and all other
texts are dealt at random to blocks of bounded size. In each block the multiway
differencing method of Karmarkar and Karp splits the items into m near-equal
windows: it keeps merging the two partial partitions of the largest imbalance, the
largest window of one with the smallest of the other. m begins at what the total
needs at least; full windows are closed, the items of all others differenced anew, at random
shares too, and m rises only when no window can be closed.
"""

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from orderloom.llm.batches import changes, whole_groups
from orderloom.sources.tables import written

CAPACITY = 2048
WINDOWS = 256  # aimed at in a block
ITEMS = 4096  # aimed at in a block at most
PARTITIONS = 10_000  # of blocks at most; a fixed number, as blocks are small in bytes but not in work
STRIDE = 1 << 20  # container numbers of a block
SLACK = 1 / 256  # of the capacity: windows as full as that are closed, however full the rest must be
TRIES = 3  # at random shares before the number of windows rises


def difference(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item, and the windows' totals from the largest, for m windows."""
    sized = sizes.tolist()
    # a partial partition lists its windows that hold anything, (-total, node), largest first; a node is an item or two nodes
    nodes: list[int | tuple[int, int]] = list(range(len(sized)))
    parts: list[list | None] = [[(-x, i)] for i, x in enumerate(sized)]
    heap = [(-x if m > 1 else 0, i) for i, x in enumerate(sized)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heap[0][1]
        one, two = parts[a], parts[b]
        parts[b] = None
        meet = len(one) + len(two) - m  # windows that must be put together, the largest with the smallest
        if meet > 0:
            both = one[: len(one) - meet] + two[: len(two) - meet]
            for x, y in zip(one[-meet:], two[: -meet - 1 : -1]):
                both.append((x[0] + y[0], len(nodes)))
                nodes.append((x[1], y[1]))
            both.sort()
        elif len(two) == 1:
            insort(one, two[0])
            both = one
        else:
            both = sorted(one + two)
        parts[a] = both
        heapq.heapreplace(heap, (both[0][0] - (both[-1][0] if len(both) == m else 0), a))
    root = parts[heap[0][1]]
    window = np.empty(len(sized), np.int64)
    for w, (_, node) in enumerate(root):
        todo = [node]
        while todo:
            held = nodes[todo.pop()]
            if isinstance(held, tuple):
                todo += held
            else:
                window[held] = w
    return window, np.array([-t for t, _ in root] + [0] * (m - len(root)), np.int64)


def windows(sizes: np.ndarray, capacity: int, seed: int = 0) -> np.ndarray:
    """The window of each item, in about as few windows as the total needs. No item exceeds the capacity.

    All items are differenced over the least number of windows. Windows within the capacity and about as full as the rest
    must be on average are closed; the items of all others, too full or too empty, are differenced anew. Where no window can
    be closed, the items are dealt at random to 2, 4 and then 8 shares, each differenced apart; only when that closes none
    either does the number of windows rise, by twice as many as the last time (a sixteenth of it at
    most) if nothing was closed since.
    """
    out = np.empty(len(sizes), np.int64)
    rest = np.arange(len(sizes))
    rng = np.random.default_rng(seed)
    closed = failed = 0
    rise = 1
    total = int(sizes.sum())
    m = max(1, -(-total // capacity))
    while len(rest):
        room = max((m * capacity - total) / m, capacity * SLACK)
        many = 1 if failed == 0 else min(1 << failed, m // 4)
        done = np.zeros(len(rest), bool)
        for share in [np.arange(len(rest))] if many == 1 else np.array_split(rng.permutation(len(rest)), many):
            own = sizes[rest[share]]
            at, totals = difference(own, m if many == 1 else max(1, round(m * int(own.sum()) / total)))
            if many == 1 and totals[0] <= capacity:
                out[rest] = closed + at
                return out
            good = (totals <= capacity) & (capacity - totals <= room)
            number = np.cumsum(good) - 1 + closed
            mine = good[at]
            out[rest[share[mine]]] = number[at[mine]]
            done[share[mine]] = True
            closed += int(good.sum())
            m -= int(good.sum())
        if done.any():
            rest, failed, rise = rest[~done], 0, 1
            total = int(sizes[rest].sum())
            m = max(1, m, -(-total // capacity))
        elif failed < TRIES and m >= 8:
            failed += 1
        else:
            m, failed, rise = m + rise, 0, min(rise * 2, max(1, m // 16))
    return out


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """One row per piece of an item: item, piece, container, token_from, n_tokens, offset, fill.

    An item is cut only if it alone exceeds the capacity, into full pieces and a rest. container is unique over the
    table, offset the piece's place in its container, fill the share of the container that is used. A NULL or negative
    size counts as 0; items of size 0 have a place too. Repeated rows and NULL items are items of their own. An empty
    table gives none. Other columns are dropped. items must be cheap to read again and in a fixed order, as a
    written table is.
    """
    kind_of_item = items.schema[item].dataType
    # items go as strings: pandas would make doubles of numbers beside NULLs
    sized = items.select(F.col(item).cast("string").alias(item), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_size"))
    # an item of size 0 makes one piece too; one of k times the capacity makes k full ones and no rest
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_size") / capacity)).cast("int")
    each = sized.select(item, "_size", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).withColumn(
        "n_tokens", F.least(F.lit(capacity), F.col("_size") - F.col("piece").cast("bigint") * capacity)
    )
    full = F.col("n_tokens") == capacity
    n, total = each.filter(~full).agg(F.count("*"), F.sum("n_tokens")).first()
    blocks = max(1, -(-(total or 0) // (capacity * WINDOWS)), -(-n // ITEMS))
    # full pieces need no company: each is dealt to a block too, but only to get a number there
    dealt = each.withColumn("_block", F.floor(F.rand(seed) * blocks).cast("bigint"))
    schema = StructType(
        [dealt.schema[item], StructField("piece", IntegerType()), StructField("container", LongType())]
        + [StructField(c, LongType()) for c in ("token_from", "n_tokens", "offset")]
        + [StructField("fill", DoubleType())]
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ["_block"]):
            heads = np.append(np.flatnonzero(changes(part, ["_block"])), len(part))
            for a, b in zip(heads[:-1], heads[1:]):
                yield block(part.iloc[a:b])

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["n_tokens"].to_numpy(np.int64)
        at = windows(sizes, capacity)
        order = np.argsort(at, kind="stable")
        at, sizes, rows = at[order], sizes[order], rows.iloc[order]
        upto = np.cumsum(sizes) - sizes
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(np.append(heads, len(at)))
        total = np.add.reduceat(sizes, heads)
        number = np.repeat(np.arange(len(heads)), count)
        return pd.DataFrame(
            {
                item: rows[item].to_numpy(object),
                "piece": rows["piece"].to_numpy(np.int32),
                "container": rows["_block"].to_numpy(np.int64) * STRIDE + number,
                "token_from": rows["piece"].to_numpy(np.int64) * capacity,
                "n_tokens": sizes,
                "offset": upto - np.repeat(upto[heads], count),
                "fill": np.repeat(total / capacity, count),
            }
        )

    rest = (
        dealt.filter(~full)
        .repartition(int(min(blocks, PARTITIONS)), "_block")
        .sortWithinPartitions("_block", F.col("n_tokens").desc(), item, "piece")
        .select(item, "piece", "n_tokens", "_block")
        .mapInPandas(place, schema)
    )
    # numbers of full containers: below those of the blocks
    own = dealt.filter(full).select(
        item,
        "piece",
        (-1 - F.monotonically_increasing_id()).alias("container"),
        (F.col("piece").cast("bigint") * capacity).alias("token_from"),
        "n_tokens",
        F.lit(0).cast("bigint").alias("offset"),
        F.lit(1.0).alias("fill"),
    )
    return own.unionByName(rest).withColumn(item, F.col(item).cast(kind_of_item))


def pack_documents(documents_sized: DataFrame, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """pack() over a table of doc_id and n_tokens, which is written first, as it is read more than once."""
    return pack(written(documents_sized.select("doc_id", "n_tokens"), "sizes"), "doc_id", "n_tokens", capacity, seed)
