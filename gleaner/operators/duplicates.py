"""Near-duplicate groups: rows whose hashes chain within a distance, across splits or inside one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.similarity import farthest_apart, near_components
from gleaner.sources.scratch import Scratch


def duplicate_members(rows: DataFrame, scratch: Scratch, threshold: int = 5, value: str = "dhash", bits: int = 64) -> DataFrame:
    """The rows (with a hash) that are in a group of two or more, with ``component``: the least hash of the group.

    Equal hashes are one node, so exact copies cost a group-by and not pairs.  A negative threshold
    groups nothing; one of ``bits`` or more groups everything.
    """
    rows = rows.where(F.col(value).isNotNull())
    if threshold < 0:
        return rows.limit(0).withColumn("component", F.col(value))
    if threshold >= bits:
        least = rows.agg(F.min(value).alias("component"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        return rows.crossJoin(F.broadcast(least))
    counts = scratch.keep(rows.groupBy(F.col(value).alias("hash")).agg(F.count("*").alias("n")))
    linked = near_components(counts, threshold, bits, scratch)
    groups = counts.join(linked, counts["hash"] == linked["node"], "left").where("n > 1 or component is not null").select("hash", F.coalesce("component", "hash").alias("component"))
    return rows.join(groups, rows[value] == groups["hash"]).drop("hash")


def farthest(members: DataFrame, scratch: Scratch, value: str = "dhash") -> DataFrame:
    """(component, max_distance): the largest distance between any two hashes of a group (not just linked ones)."""
    return farthest_apart(members.select("component", F.col(value).alias("hash")).distinct(), "component", scratch)


def group_summary(members: DataFrame, name: str = "rel", split: str = "split") -> DataFrame:
    """(component, files, splits, group_size) of each group."""
    return members.groupBy("component").agg(
        F.array_sort(F.collect_list(name)).alias("files"), F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("group_size")
    )
