"""Working on whole key groups of sorted partitions, however the batches cut them."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def changes(rows: pd.DataFrame, key: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before; the first row is True."""
    new = np.zeros(len(rows), bool)
    for c in key:
        v = rows[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    new[:1] = True
    return new


def whole_groups(
    batches: Iterator[pd.DataFrame],
    key: list[str],
    rest: Callable[[pd.DataFrame], pd.DataFrame] = lambda x: x,
    least: int = 1,
) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups, of at least so many rows where there are as many.

    The last group of a batch may go on in the next one and is kept back; rest may shorten what is kept.
    """
    kept: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append(batch)
        n += len(batch)
        if n < least:
            continue
        rows = pd.concat(kept, ignore_index=True)
        at = int(np.flatnonzero(changes(rows, key))[-1])
        if at:
            yield rows.iloc[:at].reset_index(drop=True)
        kept = [rest(rows.iloc[at:].reset_index(drop=True))]
        n = len(kept[0])
    if kept:
        yield pd.concat(kept, ignore_index=True)
