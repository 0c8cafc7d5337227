"""Whole groups of sorted Arrow batches, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str = "grp", most: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream that is sorted by the whole number ``key``: about ``most`` rows, more only if one group has more."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        first, last = batch.column(key)[0].as_py(), batch.column(key)[-1].as_py()
        if count >= most and first != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held, count = [], 0
        held.append(batch)
        count += batch.num_rows
        if count < most or first == last:  # no group ends in this batch
            continue
        at = batch.num_rows - int(np.count_nonzero(batch.column(key).to_numpy() == last))
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, at)])
        held, count = [batch.slice(at)], batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row always does."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)
