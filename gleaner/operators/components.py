"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.scratch import Scratch


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges u-v but the least of each component, and that least node."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars, contracted again and again so that memory follows its nodes."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        u, v = forest(np.concatenate([u, b.column(0).to_numpy()]), np.concatenate([v, b.column(1).to_numpy()]))
    for i in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000]), pa.array(v[i : i + 100_000])], ["u", "v"])


#: Contracted edges (16 bytes each) that one task may finish at once.
LOCAL_EDGES = 200_000


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long, not null); a component is its least node.

    Each round hangs larger neighbours on a node's least one (large star), then each node's smaller
    neighbours on their least (small star).  Groups are never collected: a least neighbour is an
    aggregate that is written first, so that it comes back to the edges by a join of two plain tables,
    which Spark splits where a node has a large share of the edges.
    Up to ``local_edges`` edges (counted, after each task has contracted its own) one task ends the work
    instead; 0 keeps all of it distributed.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = scratch.keep(e.mapInArrow(_contracted, "u long, v long"))
    if local_edges and e.count() <= local_edges:
        e = e.coalesce(1).mapInArrow(_contracted, "u long, v long")
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    mark = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select("v", "u"))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = scratch.keep(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
