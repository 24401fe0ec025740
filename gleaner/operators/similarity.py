"""Pairs of 64-bit hashes within a Hamming distance, without comparing all rows with all.

Cut into more bands than the threshold, two hashes within it agree in all bands but as many; so they meet under
one of the choices of agreeing bands, and a group-by on (choice, bits in it) finds every pair.  More bands
make longer keys and more choices: ``choices`` takes the number that costs least for the number of
hashes.  Where no choice selects enough (few hashes, or thresholds of a quarter of the bits), all hashes are
one group.  Groups are compared by bit arithmetic in blocks; a large one is dealt to pairs of blocks, a
block against itself or a later one.

All hashes within t bits of each other is a quadratic result; ``near_edges`` gives a forest instead, of
at most one edge for each hash of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.components import components, forest
from gleaner.operators.groups import block_pairs, groups_of, two_sides
from gleaner.sources.scratch import Scratch

#: Hashes of a block, rows of a tile, choices a hash is posted under at most, and comparisons that cost as much as a posting.
BLOCK, TILE, MOST_CHOICES, CHEAP = 8192, 256, 1000, 1000
#: Thresholds up to which one agreeing band selects.
BANDED_MOST = 7


def _edges(bits: int, n: int) -> list[tuple[int, int]]:
    cuts = [bits * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def bands(value: Column, threshold: int, bits: int = 64) -> Column:
    """An array of (band, value of the bits in it), of which two hashes within ``threshold`` share one."""
    parts = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(_edges(bits, threshold + 1))]
    return F.array(*parts)


def choices(n: int, threshold: int, bits: int = 64) -> list[int]:
    """Masks of the bits that must agree, one of which two hashes within ``threshold`` do; none where all pairs cost less."""
    best, chosen = n * n / 2 / CHEAP, 0
    for cuts in range(threshold + 1, bits + 1):
        many = comb(cuts, threshold)
        if many > MOST_CHOICES:
            break
        cost = n * many + n * n * many / 2 ** (bits * (cuts - threshold) / cuts) / 2 / CHEAP
        if cost < best:
            best, chosen = cost, cuts
    if not chosen:
        return []
    masks = [((1 << (b - a)) - 1) << a for a, b in _edges(bits, chosen)]
    return [sum(m) - (1 << 64) * (sum(m) >> 63) for m in combinations(masks, chosen - threshold)]


def distinct_hashes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(hash, node): one row for each hash, its node the least key that has it."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("hash")).agg(F.min(key).alias("node"))


def _near(threshold: int, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance) with a < b of the close pairs between two blocks, tile by tile."""
    for at in range(0, len(x), TILE):
        d = np.bitwise_count(x[at : at + TILE, None].view(np.uint64) ^ y[None, :].view(np.uint64))
        p, q = np.nonzero(d <= threshold)
        a, b, d = x[at + p], y[q], d[p, q].astype(np.int32)
        keep = a < b if same else a != b
        yield np.minimum(a, b)[keep], np.maximum(a, b)[keep], d[keep]


def _pairs(keys: int, threshold: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, keys + 2):
            for a, b, d in _near(threshold, *two_sides(group, keys)):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["a", "b", "distance"])

    return found


def _forest(keys: int, threshold: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, keys + 2):
            u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a, b, _ in _near(threshold, *two_sides(group, keys)):
                if len(a):
                    u, v = forest(np.concatenate([u, b]), np.concatenate([v, a]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return found


def _met(hashes: DataFrame, threshold: int, bits: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Hashes (kept, distinct) dealt so that close ones meet, and by how many key columns."""
    n = hashes.count()
    masks = choices(n, threshold, bits)
    if not masks:
        return block_pairs(hashes.select("hash"), [], F.lit(max(1, -(-n // BLOCK))), "hash"), 0
    posted = hashes.select("hash", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("choice", "mask"))
    posted = posted.select("choice", F.col("hash").bitwiseAND(F.col("mask")).alias("bits"), "hash")
    # Keys of one hash are most of them; the counts are written, so that the join may split a hot key.
    shared = scratch.keep(posted.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    rows = posted.join(shared, ["choice", "bits"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    return block_pairs(rows, ["choice", "bits"], blocks, "hash"), 2


def close_hashes(hashes: DataFrame, threshold: int, bits: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, distance) for each pair of different ``hash`` values of ``hashes`` (kept, distinct), a < b, within ``threshold``."""
    if threshold < 1:
        return hashes.sparkSession.createDataFrame([], "a long, b long, distance int")
    met, keys = _met(hashes, threshold, bits, scratch or Scratch(hashes.sparkSession))
    pairs = met.mapInArrow(_pairs(keys, threshold), "a long, b long, distance int")
    return pairs.distinct() if keys else pairs


def near_edges(hashes: DataFrame, threshold: int, bits: int, scratch: Scratch) -> DataFrame:
    """(u, v): edges that connect what chains of pairs within ``threshold`` connect, without all the pairs."""
    if threshold < 1:
        return hashes.sparkSession.createDataFrame([], "u long, v long")
    met, keys = _met(hashes, threshold, bits, scratch)
    return met.mapInArrow(_forest(keys, threshold), "u long, v long")


def near_components(hashes: DataFrame, threshold: int, bits: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the hashes (kept, distinct) that have a link; a component is its least hash."""
    if threshold >= 1 and hashes.count() <= BLOCK:  # the forest of one block is the components
        stars = block_pairs(hashes.select("hash"), [], F.lit(1), "hash").coalesce(1).mapInArrow(_forest(0, threshold), "u long, v long")
        own = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
        return stars.select(F.explode(own).alias("x")).select("x.*").distinct()
    return components(near_edges(hashes, threshold, bits, scratch), scratch)


def farthest_apart(hashes: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(key, max_distance): the largest distance between two of the ``hash`` values (distinct) of a group."""
    kept = scratch.keep(hashes.select(key, "hash"))
    if kept.count() <= BLOCK:  # no group is larger than a block
        dealt = block_pairs(kept, [key], F.lit(1), "hash")
    else:
        sizes = scratch.keep(kept.groupBy(key).agg(F.count("*").alias("n")))
        dealt = block_pairs(kept.join(sizes, key), [key], F.ceil(F.col("n") / BLOCK).cast("int"), "hash")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            x, y, _ = two_sides(group, 1)
            most = 0
            for at in range(0, len(x), TILE) if len(y) else ():
                most = max(most, int(np.bitwise_count(x[at : at + TILE, None].view(np.uint64) ^ y[None, :].view(np.uint64)).max()))
            yield pa.RecordBatch.from_arrays([group[0].column(0).slice(0, 1), pa.array([most], pa.int32())], [key, "max_distance"])

    far = dealt.mapInArrow(measured, f"{key} {kept.schema[key].dataType.simpleString()}, max_distance int")
    return far.groupBy(key).agg(F.max("max_distance").alias("max_distance"))
