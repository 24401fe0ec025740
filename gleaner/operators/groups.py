"""Groups of rows that arrive sorted by their keys, and large groups dealt to pairs of bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that agree in the first ``keys`` columns, as slices of the batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        change = np.zeros(len(b), bool)
        for k in range(keys):
            c = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
            if held:
                change[0] |= held[-1].column(k)[len(held[-1]) - 1].as_py() != c[0].item()
        cuts = [*np.flatnonzero(change).tolist(), len(b)]
        if cuts[0]:
            held.append(b.slice(0, cuts[0]))
        for x, y in zip(cuts, cuts[1:], strict=False):
            if held:
                yield held
            held = [b.slice(x, y - x)]
    if held:
        yield held


def column_of(group: list[pa.RecordBatch], k: int) -> pa.Array:
    return pa.concat_arrays([b.column(k) for b in group])


def block_pairs(rows: DataFrame, keys: list[str], blocks: Column, value: str) -> DataFrame:
    """``rows`` (keys, value) so that each two of a group meet: (keys, p, q, own, value), sorted, each p <= q in one task.

    A row goes to its own one of the group's ``blocks`` and to the pairs of it with each other one.
    """
    own = F.pmod(F.xxhash64(value), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(*keys, F.least("own", "other").cast("int").alias("p"), F.greatest("own", "other").cast("int").alias("q"), "own", value)
    return dealt.repartition(*keys, "p", "q").sortWithinPartitions(*keys, "p", "q", "own", value)


def two_sides(group: list[pa.RecordBatch], keys: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The values of the two blocks of a group from ``block_pairs``, and whether they are one block."""
    p, q, own, value = (column_of(group, keys + k).to_numpy() for k in range(4))
    return value[own == p], value[own == q], bool(p[0] == q[0])
