"""Rows in order, key by key, through a walker that keeps state from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Positions at which another key begins, behind the first row."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        a, b = batch.column(k)[:-1], batch.column(k)[1:]
        other = pc.fill_null(pc.not_equal(a, b), False)  # not known where either is null
        new |= pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def in_order(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """What walkers make of df: start() makes one for each key, which gets the key's rows in order, some at a time.

    One exchange and one sort; a worker holds a batch and the walker's state, however long a series is.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, at = None, None
        for batch in batches:
            edges = [0, *_changes(batch, keys).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                key = [batch.column(k)[lo].as_py() for k in keys]
                if walker is None or key != at:
                    walker, at = start(), key
                yield walker(batch.slice(lo, hi - lo))

    return rows.mapInArrow(run, schema)
