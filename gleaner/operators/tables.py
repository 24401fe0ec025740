"""Distributed audit outputs: long tables for sets too large for a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.duplicates import duplicate_members
from gleaner.operators.image_checks import GEOMETRY, broken, outliers, undecodable
from gleaner.sources.scratch import Scratch


def file_findings(images: DataFrame, scratch: Scratch, threshold: int = 5) -> DataFrame:
    """(severity, check, group, file): one row for each file a check names, without collecting any list.

    group: the least hash of a near-duplicate group, else null.  This is what reports are made of; it
    can be written partitioned by check.
    """

    def named(rows: DataFrame, severity: str, check: str, group=None) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), (group if group is not None else F.lit(None)).cast("long").alias("group"), F.col("rel").alias("file"))

    out = named(images.where(broken()), "error", "corrupt_files")
    out = out.unionByName(named(images.where(undecodable()), "info", "undecoded_images"))
    out = out.unionByName(named(images.where("degenerate is not null"), "warning", "degenerate_images"))
    out = out.unionByName(named(outliers(images.where("ok"), GEOMETRY, "rel"), "warning", "geometry_mode_inconsistency"))
    members = scratch.keep(duplicate_members(images.where("ok").select("rel", "split", "dhash"), scratch, threshold))
    spans = members.groupBy("component").agg((F.min("split") != F.max("split")).alias("leak"))
    grouped = members.join(spans, "component")
    out = out.unionByName(named(grouped.where("leak"), "error", "cross_split_leakage", F.col("component")))
    return out.unionByName(named(grouped.where(~F.col("leak")), "warning", "near_duplicates_within_split", F.col("component")))
