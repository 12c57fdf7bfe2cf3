"""Mergeable percentile sketches: hierarchies of randomized compactors.

A sketch holds values in levels; a value of level h stands for 2**h of the rows.
A level of more than k values is compacted: sorted, every other value kept, from
the first or the second on as a coin falls, and moved up a level. Merging puts
levels together, level by level, and compacts those that are too full.

Each compaction of level h moves the estimated rank of any value by at most 2**h,
up or down with equal odds. So with S the sum of 4**h over all compactions, a rank
is off by more than sqrt(2 ln(2 / delta) S) with a probability of at most delta
(Hoeffding). Sketches keep S, so each answer comes with its own bound.
"""

from collections.abc import Iterator, Sequence
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from orderloom.llm.batches import changes, whole_groups

K = 400
BUFFER = 400_000  # values that a task gathers before it compacts
FIELDS = [
    StructField("n", LongType()),
    StructField("spread", DoubleType()),
    StructField("items", ArrayType(DoubleType())),
    StructField("sizes", ArrayType(IntegerType())),
]


def compact(gid: np.ndarray, level: np.ndarray, value: np.ndarray, groups: int, k: int, rng: np.random.Generator):
    """All groups' levels compacted at once. Returns gid, level and value, and what each group's S grows by."""
    grown = np.zeros(groups)
    h = 0
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(gid):
        here = level == h
        g, v = gid[here], value[here]
        full = np.bincount(g, minlength=groups) > k
        move = full[g]
        done.append((g[~move], np.full(int((~move).sum()), h, np.int8), v[~move]))
        gid, level, value = gid[~here], level[~here], value[~here]
        if move.any():
            g, v = g[move], v[move]
            order = np.lexsort((v, g))
            g, v = g[order], v[order]
            heads = np.flatnonzero(np.diff(g, prepend=-1))
            sizes = np.diff(np.append(heads, len(g)))
            rank = np.arange(len(g)) - np.repeat(heads, sizes)
            odd = np.repeat(sizes % 2 == 1, sizes) & (rank == np.repeat(sizes, sizes) - 1)
            coin = np.repeat(rng.integers(0, 2, len(heads)), sizes)
            up = (rank % 2 == coin) & ~odd
            done.append((g[odd], np.full(int(odd.sum()), h, np.int8), v[odd]))
            gid, value = np.append(gid, g[up]), np.append(value, v[up])
            level = np.append(level, np.full(int(up.sum()), h + 1, np.int8))
            grown[g[heads]] += 4.0**h
        h += 1
    if not done:
        return gid, level, value, grown
    return *(np.concatenate(x) for x in zip(*done)), grown


def _rows(keys: pd.DataFrame, gid, level, value, n, spread) -> pd.DataFrame:
    """A sketch per row of keys."""
    order = np.lexsort((level, gid))
    gid, level, value = gid[order], level[order], value[order]
    height = int(level.max()) + 1 if len(level) else 1
    sizes = np.bincount(gid.astype(np.int64) * height + level, minlength=len(keys) * height).reshape(len(keys), height)
    ends = np.cumsum(sizes.sum(axis=1))
    return keys.reset_index(drop=True).assign(
        n=n, spread=spread, items=np.split(value, ends[:-1]), sizes=list(sizes.astype(np.int32))
    )


def _merged(rows: pd.DataFrame, key: list[str], k: int, seed: int) -> pd.DataFrame:
    """One sketch per key of sketches sorted by key."""
    new = changes(rows, key)
    own = np.cumsum(new) - 1
    groups = int(own[-1]) + 1
    sizes = [np.asarray(s) for s in rows["sizes"]]
    value = np.concatenate([np.asarray(x, float) for x in rows["items"]])
    gid = np.repeat(own, [int(s.sum()) for s in sizes])
    level = np.concatenate([np.repeat(np.arange(len(s), dtype=np.int8), s) for s in sizes])
    gid, level, value, grown = compact(gid, level, value, groups, k, _coins(seed, value))
    n = np.bincount(own, weights=rows["n"].to_numpy(float), minlength=groups).astype(np.int64)
    spread = np.bincount(own, weights=rows["spread"].to_numpy(float), minlength=groups) + grown
    return _rows(rows.loc[new, key], gid, level, value, n, spread)


def _coins(seed: int, value: np.ndarray) -> np.random.Generator:
    """Random bits for these values, the same for the same values in whatever order."""
    return np.random.default_rng([seed, len(value), int(value.view(np.int64).sum()) & (2**63 - 1)])


def merge(sketches: DataFrame, key: list[str], k: int = K, seed: int = 0, salts: int = 8) -> DataFrame:
    """One sketch per key of any sketches that have the key columns: of partitions, days or other unions.

    Sketches of a key are merged in parts first, so that no task has to take in all those of a key.
    Rows with NULL keys merge like others. An empty table gives none.
    """

    def step(df: DataFrame, by: list[str], salted: int) -> DataFrame:
        schema = StructType([df.schema[c] for c in by] + FIELDS)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in whole_groups(batches, by, lambda x: _merged(x, by, k, seed + salted), 2_000):
                yield _merged(part, by, k, seed + salted)

        return df.select(*by, "n", "spread", "items", "sizes").repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)

    parts = sketches.withColumn("_salt", F.pmod(F.xxhash64("n", "items"), F.lit(salts)).cast("int"))
    return step(step(parts, [*key, "_salt"], 1), key, 0)


def sketch(rows: DataFrame, key: list[str], values: list[str], k: int = K, seed: int = 0, fields: Sequence[str] = ()) -> DataFrame:
    """A sketch per key and metric: key columns, metric, n, spread (S), items, sizes (of the levels).

    values are numeric columns; their values that are NULL, NaN or infinite are left out, and keys without any other
    have no sketch. Rows with a NULL in a key column are left out. Ties and repeated rows count as often as they come.
    Where fields are given, each row counts once for each of these columns that it has, under the further key columns
    key_field (its name) and key_value. Key columns must not be named metric, n, spread, items or sizes. Each task makes
    sketches of its own rows first.
    """
    taken = rows.select(*fields, *key, *[F.col(c).cast("double").alias(c) for c in values]).dropna(subset=key or None, how="any" if key else "all")
    by = ["key_field", "key_value", *key] if fields else list(key)
    named = [StructField("key_field", StringType()), StructField("key_value", taken.schema[fields[0]].dataType)] if fields else []
    schema = StructType([*named, *[taken.schema[c] for c in key], StructField("metric", IntegerType()), *FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += len(batch) * len(values)
            if n >= BUFFER:
                yield from each(pd.concat(kept, ignore_index=True))
                kept, n = [], 0
        if n:
            yield from each(pd.concat(kept, ignore_index=True))

    def each(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not fields:
            yield partial(part)
        for f in fields:
            own = part[part[f].notna()]
            if len(own):
                yield partial(own.assign(key_field=f, key_value=own[f])[[*by, *values]].reset_index(drop=True))

    def partial(part: pd.DataFrame) -> pd.DataFrame:
        own = part.groupby(by).ngroup().to_numpy()
        heads = np.full(own.max() + 1, -1)
        heads[own[::-1]] = np.arange(len(own))[::-1]
        m = len(values)
        value = part[values].to_numpy(float).ravel()
        gid = (own[:, None] * m + np.arange(m)).ravel()
        good = np.isfinite(value)
        gid, value = gid[good], value[good]
        n = np.bincount(gid, minlength=len(heads) * m)
        gid, level, value, grown = compact(gid, np.zeros(len(gid), np.int8), value, len(n), k, _coins(seed, value))
        keys = part[by].iloc[np.repeat(heads, m)].assign(metric=np.tile(np.arange(m, dtype=np.int32), len(heads)))
        out = _rows(keys, gid, level, value, n, grown)
        return out[out["n"] > 0]

    names = F.element_at(F.array(*[F.lit(v) for v in values]), F.col("metric") + 1)
    made = merge(taken.mapInPandas(run, schema), [*by, "metric"], k, seed)
    return made.withColumn("metric", names)


def percentiles(sketches: DataFrame, probabilities: Sequence[float], delta: float = 0.01) -> DataFrame:
    """The sketches' other columns, n, percentiles (array, one for each probability) and rank_error.

    A percentile is a value of the rows; the ranks of all of a row's percentiles, as shares of n, are off by at most
    rank_error with a probability of at least 1 - delta. Where nothing was compacted, rank_error is 0 and the value is the exact one of rank
    ceil(p * n).
    """
    other = [c for c in sketches.columns if c not in ("n", "spread", "items", "sizes")]
    schema = StructType(
        [sketches.schema[c] for c in other]
        + [FIELDS[0], StructField("percentiles", ArrayType(DoubleType())), StructField("rank_error", DoubleType())]
    )
    ps = np.asarray(probabilities, float)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found, off = [], []
            for n, s, items, sizes in zip(rows["n"], rows["spread"], rows["items"], rows["sizes"]):
                weight = np.repeat(2.0 ** np.arange(len(sizes)), sizes)
                items = np.asarray(items, float)
                order = np.argsort(items, kind="stable")
                below = np.cumsum(weight[order])
                at = np.searchsorted(below, np.maximum(1, np.ceil(ps * n - 1e-9)) - 1e-9)
                found.append(items[order][np.minimum(at, len(items) - 1)])
                off.append((sqrt(2 * log(2 * len(ps) / delta) * s) + weight.max() - 1) / n)
            yield rows[other].assign(n=rows["n"], percentiles=found, rank_error=np.asarray(off, float))

    return sketches.mapInPandas(answer, schema)
