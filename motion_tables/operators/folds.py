"""Folds in order: what each row does depends on what the rows of its key before it have made.

Rows are dealt out by key and sorted within their partition, then read once from the first to the last, so that a key's rows are never gathered: a task
holds a batch of rows and the state of the key that it is at, and its time grows as its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch of results.
BATCH = 4096


def in_order(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: StructType) -> DataFrame:
    """What ``fold(key, rows of the key)`` gives for each key, with the rows in order (nulls first); ``fold`` reads them one by one, in the order of the columns of ``rows``."""
    n, shape = len(keys), to_arrow_schema(schema)
    if rows.columns[:n] != keys:
        rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        out = (o for key, own in groupby(every, itemgetter(slice(0, n))) for o in fold(key, own))
        while some := list(islice(out, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), shape)], schema=shape)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, for rows take more time than their size lets adaptive execution expect
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)
