"""Checks on image facts: broken, blank, odd ones out, near-duplicates, leaks between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.duplicates import duplicate_members, farthest, group_summary
from gleaner.operators.findings import finding, findings_of, told, union_all
from gleaner.sources.scratch import Scratch

GEOMETRY = ("width", "height", "mode")


def undecodable() -> Column:
    """Whether a file is of a format without a decoder here: nothing is known to be wrong with it."""
    return ~F.col("ok") & F.col("decodable").isNull()


def broken() -> Column:
    return ~F.col("ok") & F.col("decodable").isNotNull()


def by_kind(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """(kind, n, files): how many rows are of each kind, and their names in order; rows of no kind are left out."""
    return rows.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("files"))


def summary(images: DataFrame) -> DataFrame:
    """One row of all that a pass over the facts tells: counts, broken files with their errors, undecoded and blank ones by kind."""
    blank, rel = F.col("degenerate").isNotNull(), F.col("rel")
    return images.agg(
        F.count("*").alias("n_files"), F.count_if("ok").alias("n_ok"), F.count_if(broken()).alias("n_corrupt"), F.count_if(blank).alias("n_degenerate"), F.array_sort(F.collect_set("split")).alias("splits"),
        F.array_sort(F.collect_list(F.when(broken(), F.struct("rel", "error")))).alias("broken"), F.collect_list(F.when(undecodable(), rel)).alias("undecoded"),
        F.array_sort(F.collect_list(F.when(blank, F.struct("degenerate", "rel")))).alias("blank"),
    )


STATS = ("n_files", "n_ok", "n_corrupt", "n_degenerate", "splits")


def file_checks(row: DataFrame) -> DataFrame:
    """Findings on broken, undecoded and blank files, of a ``summary``."""
    of = lambda array, field: F.transform(array, lambda x: x[field])
    kinds = F.array_sort(F.array_distinct(of("blank", "degenerate")))
    files = lambda kind: of(F.filter("blank", lambda x: x["degenerate"] == kind), "rel")
    counted = F.concat_ws(", ", F.transform(kinds, lambda k: F.concat_ws(" ", F.size(files(k)).cast("string"), k)))
    by_type = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, files(k))))
    hint = F.lit("Black scans are often failed acquisitions, white ones overexposed or empty.")
    unread = F.format_string("%d image file(s) cannot be read; a loader would fail on them or skip them silently.", "n_corrupt")
    unknown = F.format_string("%d image file(s) are of formats that no decoder here reads; they were not checked.", F.size("undecoded"))
    empty = F.concat(F.format_string("%d image(s) carry no signal (", "n_degenerate"), counted, F.lit(")."))
    return findings_of(row, [
        (F.col("n_corrupt") > 0, told("error", "corrupt_files", unread, of("broken", "rel"), F.struct(F.map_from_entries("broken").alias("errors")))),
        (F.size("undecoded") > 0, told("info", "undecoded_images", unknown, F.col("undecoded"))),
        (F.col("n_degenerate") > 0, told("warning", "degenerate_images", empty, of("blank", "rel"), F.struct(by_type.alias("by_type"), hint.alias("hint")))),
    ])


def majority(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """The most frequent combination of ``columns``: one row; of equals the one with the least ``name``."""
    counts = rows.groupBy(*columns).agg(F.count("*").alias("n"), F.min(name).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select(*[F.col(c).alias(f"major_{c}") for c in columns], F.col("n").alias("major_n"))


def outliers(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """The rows that differ from the majority, with it (one row, so the join is a broadcast of it)."""
    differs = ~F.struct(*columns).eqNullSafe(F.struct(*[F.col(f"major_{c}").alias(c) for c in columns]))
    return rows.crossJoin(F.broadcast(majority(rows, columns, name))).where(differs)


def geometry(images: DataFrame) -> DataFrame:
    odd = outliers(images.where("ok"), GEOMETRY, "rel")
    found = odd.groupBy("major_width", "major_height", "major_mode").agg(F.count("*").alias("n"), F.collect_list("rel").alias("files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", F.struct(*GEOMETRY))))).alias("offenders"))
    message = F.format_string("%d image(s) differ from the usual %dx%d, mode %s; resize or convert them before batching.", "n", "major_width", "major_height", "major_mode")
    major = F.struct(*[F.col(f"major_{c}").alias(c) for c in GEOMETRY])
    return finding(found, "warning", "geometry_mode_inconsistency", message, F.col("files"), F.struct(major.alias("majority"), "offenders"))


def duplicates(images: DataFrame, scratch: Scratch, threshold: int = 5) -> DataFrame:
    """A finding for each group: an error where it spans splits, a warning where it does not."""
    members = scratch.keep(duplicate_members(images.where("ok").select("rel", "split", "dhash"), scratch, threshold))
    groups = group_summary(members).join(farthest(members, scratch), "component")
    leaks = groups.where(F.size("splits") > 1)
    leak = F.format_string("Leak: %d near-duplicate image(s) lie in several splits [%s] (largest Hamming distance %d); results measured on them are too good.", "group_size", F.concat_ws(", ", "splits"), "max_distance")
    inside = groups.where(F.size("splits") == 1).withColumn("split", F.element_at("splits", 1))
    return union_all([
        finding(leaks, "error", "cross_split_leakage", leak, F.col("files"), F.struct("splits", "group_size")),
        finding(inside, "warning", "near_duplicates_within_split", F.format_string("%d near-duplicate image(s) inside split '%s'; repeats bias training.", "group_size", "split"), F.col("files"), F.struct("split", "group_size")),
    ])


def image_stats(images: DataFrame) -> DataFrame:
    """(n_files, n_ok, n_corrupt, n_degenerate, splits): one row."""
    return summary(images).select(*STATS)


def image_findings(images: DataFrame, scratch: Scratch, threshold: int = 5, row: DataFrame | None = None) -> DataFrame:
    """All findings on images; ``row``: their ``summary``, where it has been made."""
    return union_all([file_checks(summary(images) if row is None else row), geometry(images), duplicates(images, scratch, threshold)])
