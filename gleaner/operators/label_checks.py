"""Checks on label rows: repeated, missing and unreadable entries, class shares."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.columns import ratio4
from gleaner.functions.imaging import facts
from gleaner.operators.findings import finding, findings_of, told
from gleaner.sources.image_folder import files_below, in_store
from gleaner.sources.labels_csv import resolved

MINORITY_RATIO = 0.05
#: What a scanned file is, by whether it can be decoded.
STATES = {True: "usable", False: "unreadable", None: "undecoded"}


def class_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, count, total, ratio): the share of each class, of rows as they stand."""
    counts = labels.groupBy(label).agg(F.count("*").alias("count"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("ratio", F.col("count") / F.col("total"))


def repeated(labels: DataFrame, key: str = "filepath") -> DataFrame:
    return labels.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def without(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the known ones."""
    return rows.join(known.select(key), key, "left_anti")


def within(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the known ones."""
    return rows.join(known.select(key), key, "left_semi")


def with_state(labels: DataFrame, images: DataFrame, root: str) -> DataFrame:
    """Labels with their absolute path and ``state``: missing, unreadable, undecoded (no decoder) or usable; and the thumbnail where usable.

    Paths that the scan has are joined; only the others (outside the root, or of another
    extension) are looked up one by one: in the folders of the machine, or in the store that ``root`` names.
    """
    rows = labels.withColumn("abs", resolved(F.col("filepath"), root))
    known = images.select(F.col("path").alias("abs"), F.lit(True).alias("scanned"), "decodable", "thumb16")
    strange = without(rows.select("abs").distinct(), known, "abs")
    if in_store(root):
        below = files_below(rows.sparkSession, root).select(F.regexp_replace("path", "^file:/+", "file:///").alias("abs"), F.lit(True).alias("there"), "content")
        strange = strange.join(below, "abs", "left")
    else:
        strange = strange.select("abs", F.lit(None).cast("boolean").alias("there"), F.lit(None).cast("binary").alias("content"))

    def look(batches):
        for b in batches:
            out = []
            for path, there, content in zip(b["abs"], b["there"], b["content"], strict=True):
                if content is None and "://" not in path and os.path.isfile(path):
                    there = True
                    try:
                        with open(path, "rb") as f:
                            content = f.read()
                    except OSError:
                        content = b""
                x = facts(content or b"") if there else {"decodable": False, "thumb": None}
                out.append((path, STATES[x["decodable"]] if there else "missing", x["thumb"]))
            yield pd.DataFrame(out, columns=["abs", "seen", "seen_thumb"])

    looked = strange.mapInPandas(look, "abs string, seen string, seen_thumb array<float>")
    state = F.when(~F.col("scanned") | F.col("scanned").isNull(), F.col("seen"))
    for decodable, name in STATES.items():
        state = state.when(F.col("decodable").eqNullSafe(F.lit(decodable)), name)
    return rows.join(known, "abs", "left").join(looked, "abs", "left").select("filepath", "label", "lineno", "abs", state.alias("state"), F.coalesce("thumb16", "seen_thumb").alias("thumb16"))


def entry_checks(stated: DataFrame) -> DataFrame:
    """Findings on paths that are labelled more than once, do not exist, or cannot be decoded: one pass over the labels with their state."""
    per = stated.groupBy("filepath").agg(F.count("*").alias("n"), F.bool_or(F.col("state") == "missing").alias("missing"), F.bool_or(F.col("state") == "unreadable").alias("unreadable"))
    named = lambda which: F.collect_list(F.when(which, F.col("filepath")))
    row = per.agg(named(F.col("n") > 1).alias("again"), named(F.col("missing")).alias("missing"), named(F.col("unreadable")).alias("unreadable"))
    parts = (
        ("again", "warning", "duplicate_label_entries", "%d path(s) are labelled more than once."),
        ("missing", "error", "missing_labeled_files", "%d labelled file(s) do not exist."),
        ("unreadable", "warning", "unreadable_labeled_files", "%d labelled file(s) cannot be decoded."),
    )
    return findings_of(row, [(F.size(name) > 0, told(severity, check, F.format_string(text, F.size(name)), F.col(name))) for name, severity, check, text in parts])


def share_checks(shares: DataFrame, minority_ratio: float = MINORITY_RATIO) -> DataFrame:
    """Findings on rare classes, and the shares of all, of a ``class_distribution``."""
    percent = F.format_string("%.1f%%", F.bround(F.col("ratio") * 100, 1))
    rare = shares.where(F.col("ratio") < minority_ratio)
    message = F.format_string(f"class '%s': %d of %d labels (%s), under {minority_ratio * 100:.0f}%%; consider stratified sampling, class weights or more data.", "label", "count", "total", percent)
    rare_details = F.struct(F.col("label").alias("class"), "count", ratio4(F.col("count"), F.col("total")).alias("ratio"), F.lit(minority_ratio).alias("threshold"))
    parts = F.array_sort(F.collect_list(F.struct("label", "count", percent.alias("percent"), ratio4(F.col("count"), F.col("total")).alias("ratio"))))
    all_ = shares.agg(parts.alias("parts"))
    text = F.concat_ws(", ", F.transform("parts", lambda p: F.concat(p["label"], F.lit("="), p["count"].cast("string"), F.lit(" ("), p["percent"], F.lit(")"))))
    spread = F.map_from_entries(F.transform("parts", lambda p: F.struct(p["label"], F.struct(p["count"].alias("count"), p["ratio"].alias("ratio")))))
    shown = finding(all_, "info", "class_distribution", F.concat(F.lit("Class shares: "), text), None, F.struct(spread.alias("distribution")))
    return finding(rare, "warning", "class_imbalance", message, None, rare_details).unionByName(shown)


def label_findings(labels: DataFrame, stated: DataFrame, minority_ratio: float = MINORITY_RATIO) -> DataFrame:
    """All findings on label rows."""
    return entry_checks(stated).unionByName(share_checks(class_distribution(labels), minority_ratio))
